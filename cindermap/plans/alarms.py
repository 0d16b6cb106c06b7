"""Smoke-alarm presence per tract: target and weighted linear model (PL-1B-T, PL-1B-M)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import INCIDENT_KEY, TRACT_LEVEL, normalize_incident_key, pad_left, summary_id, summary_level
from cindermap.functions.values import presence_flag, safe_ratio
from cindermap.models.fit import fit_cached
from cindermap.models.regress import least_squares, rmse
from cindermap.operators.aggregate import stack, three_state_counts
from cindermap.operators.columns import numeric_columns, tag
from cindermap.operators.filters import BUILDING_FIRE, containing, good_geocode
from cindermap.operators.prep import mean_impute, scaled_weights
from cindermap.operators.relate import keyed_join, keyed_lookup, skew_join
from cindermap.operators.sample import hash_split
from cindermap.session import materialize

COUNT_NAMES = {
    "all": "all_fire", "unknown": "alarm_unknown", "true": "alarm_presented", "false": "alarm_not_presented",
}


def with_ratios(df: DataFrame, suffix: str = "") -> DataFrame:
    """Share without alarm among all fires and among those with known state."""
    none, shown = F.col(f"alarm_not_presented{suffix}"), F.col(f"alarm_presented{suffix}")
    return df.withColumns(
        {
            "ratio_no_alarm_in_all": safe_ratio(none, f"all_fire{suffix}"),
            "ratio_no_alarm_in_all_known": safe_ratio(none, shown + none),
        }
    )


def presence_counts(
    basic: DataFrame,
    fire: DataFrame,
    formatted: DataFrame,
    geocoded: DataFrame,
    pattern: str = BUILDING_FIRE,
    by: Sequence[str] = (),
) -> DataFrame:
    """PL-1B-T: building fires per tract by alarm state, over well-geocoded addresses.

    One year's tables give one year's counts. Tables that hold several years take
    ``by=["year"]``, a column of ``basic``, and need one plan for all of them.
    """
    key = list(INCIDENT_KEY)
    n = F.count(F.lit(1))
    # Each side becomes counts per key before it meets the next, so a key with very many copies
    # (all incidents without a key, say) costs one row per side and not one row per pair.
    building = normalize_incident_key(containing(basic, "INC_TYPE", pattern).select(*key, *by))
    building = building.groupBy(*key, *by).agg(n.alias("n_basic"))
    detectors = normalize_incident_key(fire.select(*key, presence_flag("DETECTOR", "DET_TYPE").alias("present")))
    detectors = detectors.groupBy(*key, "present").agg(n.alias("n_fire"))
    flagged = keyed_lookup(detectors, building, key)
    addresses = normalize_incident_key(formatted.select(*key, "row_seq"))
    places = addresses.join(
        geocoded.filter(good_geocode("rating", "tractid")).select("row_seq", "tractid"), "row_seq", "inner"
    )
    places = places.groupBy(*key, "tractid").agg(n.alias("n_place"))
    located = skew_join(places, flagged, key, "inner", null_safe=True, probe=addresses)
    weight = F.col("n_place") * F.col("n_basic") * F.coalesce(F.col("n_fire"), F.lit(1))
    return three_state_counts(located, ["tractid", *by], "present", COUNT_NAMES, weight)


def presence_all_years(yearly: Mapping[str, DataFrame]) -> DataFrame:
    """PL-1B-T: the years under each other, with yearly ratios."""
    return stack(*[tag(with_ratios(t), "year", year) for year, t in sorted(yearly.items())])


def presence_totals(stacked: DataFrame) -> DataFrame:
    """One row per tract with totals over the years and their ratios."""
    totals = stacked.groupBy("tractid").agg(
        *[F.sum(c).alias(f"{c}_all_years") for c in COUNT_NAMES.values()]
    )
    return with_ratios(totals, "_all_years")


def tract_features(acs: DataFrame) -> DataFrame:
    """Tract rows of the profile table with their tract id and mean-filled numeric columns."""
    features = numeric_columns(acs)
    tracts = acs.filter(summary_level("geoid") == TRACT_LEVEL).select(
        pad_left(summary_id("geoid"), 11).alias("tractid"), *features
    )
    return mean_impute(tracts, features)


@dataclass
class WeightedLinear:
    model: PipelineModel
    features: list[str]
    holdout_rmse: DataFrame
    full_rmse: DataFrame
    tracts_with_fires: DataFrame
    all_tracts: DataFrame


def weighted_linear(
    totals: DataFrame, acs: DataFrame, support: int = 25, test_share: float = 0.1, seed: int = 12
) -> WeightedLinear:
    """PL-1B-M: no-alarm share by tract features, weighted by the number of fires, scored for all tracts."""
    features = numeric_columns(acs)
    tracts = tract_features(acs)
    # The counts are the costly part; model, errors and scores read them from here.
    merged = materialize(keyed_join(totals, tracts, "tractid", "left"), "merged")
    supported = mean_impute(merged.filter(F.col("all_fire_all_years") > support), features)
    split = hash_split(supported, ["tractid"], test_share, seed)
    train = scaled_weights(split.filter(~F.col("is_test")), "all_fire_all_years", "weight")
    model = fit_cached(least_squares(features, "ratio_no_alarm_in_all", "weight", "weighted_linear_pred"), train)

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(df).drop("features")

    held = scored(split.filter("is_test")).agg(rmse("ratio_no_alarm_in_all", "weighted_linear_pred").alias("rmse"))
    with_fires = scored(mean_impute(merged, features))
    full = with_fires.agg(rmse("ratio_no_alarm_in_all", "weighted_linear_pred").alias("rmse"))
    kept = [*totals.columns, "weighted_linear_pred"]
    ordered = with_fires.select(*kept).orderBy(F.desc("all_fire_all_years"), "tractid")
    return WeightedLinear(model, features, held, full, ordered, scored(tracts).select("tractid", "weighted_linear_pred"))
