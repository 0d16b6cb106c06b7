"""Share of home visits that led to an alarm install, predicted for every tract (PL-1A)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import COUNTY_LEVEL, TRACT_LEVEL, pad_left, summary_id, summary_level, with_geo_parts
from cindermap.functions.scores import capped_mean
from cindermap.models.fit import fit_cached
from cindermap.models.regress import LassoFit, forest_regressor, lasso_cv
from cindermap.operators.aggregate import high_missing_columns, mode_by, strict_mean
from cindermap.operators.columns import columns_between
from cindermap.operators.filters import complete_cases
from cindermap.operators.relate import keyed_join
from cindermap.session import materialize


def install_share(installs: DataFrame, support: int = 25) -> DataFrame:
    """Per county: visits, share with an install, most frequent state and city; counties with more than ``support`` visits."""
    padded = installs.withColumn("fips", pad_left("fips", 5))
    shares = padded.groupBy("fips").agg(
        F.count(F.lit(1)).alias("N"),
        strict_mean((F.col("alarms_ins") > 0).cast("double")).alias("alarm_ins_pct"),
    )
    named = mode_by(padded, "fips", ["state", "city"]).withColumnsRenamed({"state": "visit_state", "city": "visit_city"})
    return keyed_join(shares.filter(F.col("N") > support), named, "fips", "left", null_safe=True)


def split_levels(acs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """County rows and tract rows of the profile table, with their id parts."""
    parsed = acs.withColumns({"geoid2": summary_id("geoid"), "sum_level": summary_level("geoid")})
    parsed = with_geo_parts(parsed, "geoid2")
    return parsed.filter(F.col("sum_level") == COUNTY_LEVEL), parsed.filter(F.col("sum_level") == TRACT_LEVEL)


@dataclass
class InstallModels:
    features: list[str]
    forest: PipelineModel
    lasso: LassoFit
    counties: DataFrame
    tracts: DataFrame


def install_risk(
    installs: DataFrame,
    acs: DataFrame,
    first_feature: str = "tenure_renter_occupied",
    last_feature: str = "hdsb_yes",
    sparse: tuple[str, ...] = ("plumb_no", "plumb_yes"),
    support: int = 25,
    trees: int = 100,
    folds: int = 10,
    penalties: int = 20,
    seed: int = 12,
    penalty_ratio: float = 1e-4,
) -> InstallModels:
    """PL-1A: forest and LASSO on county shares, their mean (at most 1) as tract score."""
    counties, tracts = split_levels(acs)
    training = keyed_join(
        counties.withColumnRenamed("geoid2", "fips").drop(*sparse), install_share(installs, support), "fips", "inner"
    )
    named = [c for c in columns_between(acs, first_feature, last_feature) if c not in sparse]
    too_sparse = set(high_missing_columns(tracts, named))
    features = [c for c in named if c not in too_sparse]
    # A gap in any column drops the county; parts a county does not have (tract) are empty text, not missing.
    ready = materialize(complete_cases(training).select("fips", "alarm_ins_pct", *features), "training")
    forest = fit_cached(forest_regressor(features, "alarm_ins_pct", trees, seed=seed), ready)
    lasso = lasso_cv(ready, features, "alarm_ins_pct", ["fips"], penalties, folds, seed, ratio=penalty_ratio)

    def scored(df: DataFrame) -> DataFrame:
        usable = complete_cases(df, features)
        return lasso.model.transform(forest.transform(usable).drop("features")).drop("features")

    tract_scores = scored(tracts).select(
        capped_mean("pred_rf", "pred_lasso").alias("risk_1a"), "state", "cnty", "tract", "geoid2"
    )
    county_scores = scored(counties.withColumnRenamed("geoid2", "fips")).select("fips", "pred_rf", "pred_lasso")
    return InstallModels(features, forest, lasso, county_scores, tract_scores)
