"""Scaling of scores.

Column statistics are one-row scalar subqueries: one aggregate over the table, no
window over all rows and no join. A constant column or an empty table has no
spread, and its scaled score is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.scores import logistic
from cindermap.functions.values import col, nan_to_null, safe_ratio
from cindermap.operators.aggregate import column_stats
from cindermap.operators.quantiles import exact_quantiles


def stats_of(df: DataFrame, columns: Mapping[str, Column], where: Column | None = None) -> Column:
    """Scalar struct with one field per name, each holding min, max, mean, sd and n.

    All columns share one pass; ``where`` limits the rows the statistics see.
    """
    scoped = {n: (F.when(where, c) if where is not None else c) for n, c in columns.items()}
    return df.agg(F.struct(*column_stats(scoped))).scalar()


def normalize_by(c: Column, stats: Column) -> Column:
    """``(x - min) / (max - min)``."""
    return safe_ratio(c - stats.getField("min"), stats.getField("max") - stats.getField("min"))


def zscore_by(c: Column, stats: Column) -> Column:
    """``(x - mean) / sd`` with the sample standard deviation."""
    return safe_ratio(c - stats.getField("mean"), stats.getField("sd"))


def balscale_by(c: Column, stats: Column, w_logit: float = 0.75, w_norm: float = 0.25) -> Column:
    """Weighted sum of the logistic of the z-score and the min-max position."""
    return logistic(zscore_by(c, stats)) * F.lit(w_logit) + normalize_by(c, stats) * F.lit(w_norm)


def balscale_many(
    df: DataFrame,
    targets: Mapping[str, str | Column],
    w_logit: float = 0.75,
    w_norm: float = 0.25,
    where: Column | None = None,
    factor: float = 100.0,
) -> DataFrame:
    """Add ``output name -> input`` scaled scores, all statistics in one pass.

    With ``where``, statistics and scores cover only the rows that meet it; the
    other rows get NULL.
    """
    inputs = {out: nan_to_null(source) for out, source in targets.items()}
    with_stats = df.withColumn("__stats", stats_of(df, inputs, where))
    scaled = {}
    for out, c in inputs.items():
        score = balscale_by(c, F.col("__stats").getField(out), w_logit, w_norm) * F.lit(factor)
        scaled[out] = F.when(where, score) if where is not None else score
    return with_stats.withColumns(scaled).drop("__stats")


def balscale(
    df: DataFrame,
    column: str | Column,
    out: str,
    w_logit: float = 0.75,
    w_norm: float = 0.25,
    where: Column | None = None,
    factor: float = 100.0,
) -> DataFrame:
    """X4, X5 for one column."""
    return balscale_many(df, {out: col(column)}, w_logit, w_norm, where, factor)


def normalize(df: DataFrame, column: str | Column, out: str) -> DataFrame:
    """X1."""
    c = nan_to_null(column)
    with_stats = df.withColumn("__stats", stats_of(df, {"x": c}))
    return with_stats.withColumn(out, normalize_by(c, F.col("__stats").getField("x"))).drop("__stats")


def zscore(df: DataFrame, column: str | Column, out: str) -> DataFrame:
    """X2."""
    c = nan_to_null(column)
    with_stats = df.withColumn("__stats", stats_of(df, {"x": c}))
    return with_stats.withColumn(out, zscore_by(c, F.col("__stats").getField("x"))).drop("__stats")


def scale_comparison(
    df: DataFrame, column: str, probs: Sequence[float], w_logit: float = 0.85, w_norm: float = 0.15
) -> DataFrame:
    """Quantiles of the raw, min-max and balanced versions of a column side by side."""
    x = nan_to_null(column)
    stats = F.col("__stats").getField("x")
    versions = df.withColumn("__stats", stats_of(df, {"x": x})).select(
        x.alias("raw"),
        normalize_by(x, stats).alias("normalized"),
        balscale_by(x, stats, w_logit, w_norm).alias("scaled"),
    )
    table = exact_quantiles(versions, ["raw", "normalized", "scaled"], probs)
    return table.groupBy("prob").agg(
        *[F.max(F.when(F.col("column") == v, F.col("value"))).alias(v) for v in ("raw", "normalized", "scaled")]
    )
