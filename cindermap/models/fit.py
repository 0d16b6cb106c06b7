from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame


def fit_cached(pipeline: Pipeline, df: DataFrame) -> PipelineModel:
    """Fit with the training rows cached: every stage and every iteration reads them again."""
    rows = df.persist()
    try:
        return pipeline.fit(rows)
    finally:
        rows.unpersist()
