"""Building fires per 1,000 people and reporting coverage (PL-2A, PL-2A-C)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import INCIDENT_KEY, normalize_incident_key, prefixed
from cindermap.functions.scores import rate_per
from cindermap.operators.aggregate import coverage, distinct_keys, first_per_key
from cindermap.operators.filters import BUILDING_FIRE, containing, known
from cindermap.operators.relate import keyed_join, skew_join


def fires_per_tract(
    basic: DataFrame,
    formatted: DataFrame,
    geocoded: DataFrame,
    pattern: str = BUILDING_FIRE,
    dedup_incidents: bool = False,
) -> DataFrame:
    """Building fires per tract. An incident with several addresses counts once per address unless deduplicated."""
    key = list(INCIDENT_KEY)
    building = normalize_incident_key(containing(basic, "INC_TYPE", pattern).select(*key))
    addresses = normalize_incident_key(formatted.select(*key, "row_seq"))
    if dedup_incidents:
        addresses = first_per_key(addresses, key, ["row_seq"])
        building = building.distinct()
    # Incidents become counts per key before the join: copies of a key do not multiply with its addresses.
    per_key = building.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    located = keyed_join(addresses, geocoded.select("row_seq", "tractid"), "row_seq", "left")
    per_place = located.filter(F.col("row_seq").isNotNull() & F.col("tractid").isNotNull())
    per_place = per_place.groupBy(*key, "tractid").agg(F.count(F.lit(1)).alias("n_place"))
    placed = skew_join(per_place, per_key, key, "inner", null_safe=True, probe=addresses)
    return placed.groupBy("tractid").agg(F.sum(F.col("n") * F.col("n_place")).alias("N"))


def fire_rate(by_tract: DataFrame, population: DataFrame, min_population: int = 100, per: float = 1000.0) -> DataFrame:
    """PL-2A: ``population`` has ``tractid, population``; tracts without census population drop out."""
    joined = keyed_join(by_tract, population.select("tractid", "population"), "tractid", "inner")
    rated = joined.filter(F.col("population") > min_population)
    return rated.select(
        "tractid",
        prefixed("1400000US", "tractid").alias("id"),
        "N",
        "population",
        rate_per("N", "population", per).alias("fire_per_1000"),
    )


def building_fire_rate(
    basic: DataFrame, formatted: DataFrame, geocoded: DataFrame, population: DataFrame, dedup_incidents: bool = False
) -> DataFrame:
    """PL-2A for one year."""
    return fire_rate(fires_per_tract(basic, formatted, geocoded, dedup_incidents=dedup_incidents), population)


def state_coverage(geocoded_years: Sequence[DataFrame], relation: DataFrame, counties: DataFrame) -> DataFrame:
    """PL-2A-C: share of each state's population in tracts that any year reports from.

    ``relation`` has ``STATE10, TRACT10, GEOID10, POP10`` and may list a tract several
    times; ``counties`` has ``STATE, STATEFP, COUNTYFP``.
    """
    covered = distinct_keys(*[g.select("tractid") for g in geocoded_years]).filter(known("tractid"))
    tracts = first_per_key(relation, "GEOID10", ["TRACT10", "STATE10", "POP10"])
    table = coverage(tracts, covered.withColumnRenamed("tractid", "GEOID10"), "GEOID10", "STATE10", "POP10")
    states = first_per_key(counties.select("STATE", "STATEFP", "COUNTYFP"), "STATEFP", ["COUNTYFP", "STATE"])
    names = states.select(F.col("STATEFP").alias("STATE10"), "STATE")
    return keyed_join(table, names, "STATE10", "inner")
