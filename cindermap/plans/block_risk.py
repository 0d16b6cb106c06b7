"""Block-group risk rolled up, and the household survey (PL-1C, PL-1C-X)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import compose, pad_left, with_geo_parts
from cindermap.functions.values import strip_ticks
from cindermap.operators.aggregate import (
    collect_unique,
    counts_by,
    first_per_key,
    share_where,
    strict_mean,
    with_group_value,
    with_min_support,
)
from cindermap.operators.bins import bin_counts, fixed_breaks, histogram, quantile_breaks
from cindermap.operators.relate import lookup_first
from cindermap.operators.scale import balscale


def with_block_parts(blocks: DataFrame) -> DataFrame:
    """K1 on 12-character block-group ids; shorter ids have lost their leading zero."""
    return with_geo_parts(blocks.withColumn("bg_geoid", pad_left("bg_geoid", 12)), "bg_geoid", block=True)


def tract_risk(blocks: DataFrame) -> DataFrame:
    """PL-1C: mean block risk per tract, scaled to 0-100, with the number of blocks."""
    per_tract = (
        with_block_parts(blocks)
        .groupBy("state", "cnty", "tract")
        .agg((strict_mean("smoke_alarm_risk") * 100).alias("mean_risk"), F.count(F.lit(1)).alias("blocks_per_tract"))
    )
    scaled = balscale(per_tract, "mean_risk", "risk_1c")
    return scaled.select(
        compose("state", "cnty", "tract").alias("tract_geoid"), "state", "cnty", "tract", "blocks_per_tract", "risk_1c"
    )


def blocks_with_support(blocks: DataFrame) -> DataFrame:
    """Every block with the number of blocks in its tract."""
    return with_group_value(with_block_parts(blocks), ["state", "cnty", "tract"], blocks_per_tract=F.count(F.lit(1)))


def county_risk(blocks: DataFrame) -> DataFrame:
    """PL-1C by county: mean risk, population, blocks and the 5-digit code."""
    per_county = (
        with_block_parts(blocks)
        .groupBy("state", "cnty")
        .agg(
            strict_mean("smoke_alarm_risk").alias("smoke_alarm_risk"),
            F.sum("bg_pop").alias("ct_pop"),
            F.count(F.lit(1)).alias("blocks_per_county"),
        )
    )
    return per_county.withColumn("county5_code", compose(pad_left("state", 2), "cnty"))


def county_bins(counties: DataFrame, column: str = "smoke_alarm_risk", points: int = 10, quantile: bool = True) -> DataFrame:
    """Bin counts of a county measure with quantile or fixed-width breaks."""
    breaks = (quantile_breaks if quantile else fixed_breaks)(counties, column, points)
    return bin_counts(counties, column, breaks, points)


SURVEY_TEXT = ("CONTROL", "COUNTY", "STATE", "DIVISION", "SMOKE", "SMOKPWR", "SPRNKLR", "BATTERY")


def clean_survey(survey: DataFrame, state_fips: DataFrame, support: int = 30) -> DataFrame:
    """PL-1C-X: ticks removed, state abbreviation attached, counties with more than ``support`` households."""
    plain = survey.withColumns({c: strip_ticks(c) for c in SURVEY_TEXT if c in survey.columns})
    codes = state_fips.select(pad_left("fips", 2).alias("STATE"), "abb")
    named = lookup_first(plain, codes, "STATE", ["abb"], ["abb"])
    return with_min_support(named, ["COUNTY", "STATE"], support)


def with_state_number(df: DataFrame, column: str, counties: DataFrame, out: str = "state_num") -> DataFrame:
    """Two-digit state number of a state abbreviation, whatever its case.

    ``counties`` has ``fips, acronym``, one row per county; the first county of a state names it.
    """
    states = counties.select(
        F.substring(pad_left("fips", 5), 1, 2).alias(out), F.upper("acronym").alias("__code"), pad_left("fips", 5).alias("__fips")
    )
    coded = df.withColumn("__code", F.upper(column))
    return lookup_first(coded, first_per_key(states, out, ["__fips"]), "__code", [out], [out]).drop("__code")


def states_of_county_codes(households: DataFrame) -> DataFrame:
    """County codes occur in many states, so a county is a (county, state) pair."""
    return collect_unique(households, "COUNTY", "abb", "states")


def smoke_alarm_share(households: DataFrame) -> DataFrame:
    """A5: share of households with a working alarm per county."""
    return households.groupBy("COUNTY", "STATE").agg(share_where(F.col("SMOKE") == "1").alias("smoke_share"))


def households_by_state(households: DataFrame) -> DataFrame:
    """A12, O1."""
    return counts_by(households, "abb").orderBy(F.desc("n"), "abb")


def share_histogram(shares: DataFrame, bins: int = 50) -> DataFrame:
    return histogram(shares, "smoke_share", bins)
