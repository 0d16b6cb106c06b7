"""The final risk table: six indicators on one scale, combined per tract (PL-AGG)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import (
    compose,
    county_fips_of,
    county_of,
    pad_left,
    state_of,
    tract_of,
)
from cindermap.functions.scores import damped_rate, mean_of_known, mean_strict, stabilized_rate
from cindermap.functions.values import blank_to_null, first_known
from cindermap.operators.aggregate import first_per_key, stack, strict_mean, with_group_value
from cindermap.operators.relate import keyed_join
from cindermap.operators.scale import balscale, balscale_many
from cindermap.session import materialize

INDICATORS = ("risk_1a", "risk_1b", "risk_1c", "risk_2a", "risk_2c", "risk_3a")
REGION_COLUMNS = ("region_code", "region_name", "chapter_code", "chapter_name", "county_name_long")
OUTPUT = (
    "state", "cnty", "tract", "tract_geoid", *REGION_COLUMNS, "risk_cnty", "risk", *INDICATORS,
    "risk1_agg", "risk2_agg", "risk3_agg",
)
MIN_POPULATION = 200


def _known(df: DataFrame) -> DataFrame:
    return df.filter(F.col("tract_geoid").isNotNull())


def tract_id(c: Column | str) -> Column:
    """K4, K5: the 11 characters of a tract id, with the zeros it lost when it was stored as a number; blank is missing."""
    return pad_left(blank_to_null(c), 11)


def rows_without_tract(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Per source (tables made by the ``*_rows`` functions) its rows and those that the final table leaves out for want of a tract id."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("tract_geoid").isNull()).alias("n_without_tract")).withColumn("source", F.lit(name))
        for name, df in sources.items()
    ]
    return stack(*counts).select("source", "n_rows", "n_without_tract")


def install_rows(scores: DataFrame) -> DataFrame:
    parts = compose(pad_left("state", 2), pad_left("cnty", 3), pad_left("tract", 6))
    return scores.select(parts.alias("tract_geoid"), F.col("risk_1a").alias("install"))


def alarm_rows(scores: DataFrame) -> DataFrame:
    return scores.select(
        tract_id("tractid").alias("tract_geoid"), F.col("weighted_linear_pred").alias("alarm")
    )


def block_rows(blocks: DataFrame) -> DataFrame:
    """K1: the tract is the first 11 characters of the padded block-group id."""
    tract = F.substring(pad_left("bg_geoid", 12), 1, 11)
    return blocks.select(tract.alias("tract_geoid"), F.col("smoke_alarm_risk").alias("block"), F.lit(1).alias("blocks"))


def fire_rows(yearly: DataFrame, base_year: str) -> DataFrame:
    base = F.when(F.col("year") == base_year, F.col("population"))
    return yearly.select(tract_id("tractid").alias("tract_geoid"), F.col("N").alias("fires"), base.alias("base"))


def response_rows(responses: DataFrame) -> DataFrame:
    return responses.select(tract_id("x").alias("tract_geoid"), F.col("freq").alias("responses"))


def casualty_rows(scores: DataFrame) -> DataFrame:
    return scores.select(tract_id("geoid").alias("tract_geoid"), F.col("risk_3a").alias("casualty"))


def population_rows(population: DataFrame) -> DataFrame:
    return population.select(tract_id("tract_geoid").alias("tract_geoid"), F.col("P0010001").cast("long").alias("census"))


def _only(score: str) -> Column:
    """A13 (aggregate): the one score of a tract; two are an error, not a choice."""
    n = F.count(score)
    text = F.concat(F.lit("tract "), F.first("tract_geoid"), F.lit(" has "), n.cast("string"), F.lit(f" scores {score}"))
    return F.when(n <= 1, F.max(score)).otherwise(F.raise_error(text).cast("double"))


def fire_measure() -> dict[str, Column]:
    """A20, P8 (aggregates): fires of all years, zero where there are none; population of the base year, else census, else 0."""
    return {
        "N": F.coalesce(F.sum("fires"), F.lit(0)),
        "population": first_known(F.max("base"), F.max("census"), default=0),
    }


def fire_indicator(yearly: DataFrame, tracts: DataFrame, population: DataFrame, base_year: str = "2009") -> DataFrame:
    """Fires of all years per 1,000 people, scaled over tracts with more than 200 people.

    ``yearly`` has ``tractid, year, N, population``; tracts of the other two tables
    without fires count zero.
    """
    rows = stack(fire_rows(yearly, base_year), tracts.select(tract_id("tract_geoid").alias("tract_geoid")), population_rows(population))
    rated = rows.groupBy("tract_geoid").agg(*[c.alias(n) for n, c in fire_measure().items()])
    rated = rated.withColumn("rate", stabilized_rate("N", "population"))
    return balscale(rated, "rate", "risk_2a", where=F.col("population") > MIN_POPULATION)


def response_indicator(responses: DataFrame, population: DataFrame) -> DataFrame:
    """Responses per 1,000 people, damped for small tracts, scaled like the fires."""
    rows = stack(response_rows(responses), population_rows(population))
    rated = rows.groupBy("tract_geoid").agg(
        F.coalesce(F.sum("responses"), F.lit(0)).alias("freq"), F.coalesce(F.max("census"), F.lit(0)).alias("population")
    )
    rated = rated.withColumn("rate", damped_rate("freq", "population"))
    return balscale(rated, "rate", "risk_2c", where=F.col("population") > MIN_POPULATION)


def raw_scores(*sources: DataFrame) -> DataFrame:
    """One row per tract of any source, with the unscaled measure of every indicator.

    The sources are stacked and grouped once. That is one shuffle, combined on the
    map side, where a chain of full joins would shuffle the growing result each
    time. Installs, alarms and casualties give a tract one score; a second one raises.
    Rows without tract id belong to no tract (:func:`rows_without_tract` counts them).
    """
    g = _known(stack(*sources)).groupBy("tract_geoid").agg(
        _only("install").alias("risk_1a"),
        _only("alarm").alias("risk_1b"),
        F.when(F.count("blocks") == F.count("block"), F.avg("block") * 100).alias("risk_1c"),
        F.count("blocks").alias("blocks"),
        *[c.alias(n) for n, c in fire_measure().items()],
        F.coalesce(F.sum("responses"), F.lit(0)).alias("freq"),
        F.coalesce(F.max("census"), F.lit(0)).alias("census"),
        _only("casualty").alias("risk_3a"),
    )
    enough, counted = F.col("population") > MIN_POPULATION, F.col("census") > MIN_POPULATION
    has_blocks = F.col("blocks") > 0
    geoid = F.col("tract_geoid")
    return g.select(
        "tract_geoid",
        *[F.when(has_blocks, c).alias(n) for n, c in (("state", state_of(geoid)), ("cnty", county_of(geoid)), ("tract", tract_of(geoid)))],
        "risk_1a",
        "risk_1b",
        "risk_1c",
        F.when(enough, stabilized_rate("N", "population")).alias("risk_2a"),
        F.when(counted, damped_rate("freq", "census")).alias("risk_2c"),
        "risk_3a",
    )


def scale_and_combine(raw: DataFrame) -> DataFrame:
    """All indicators on the 0-100 scale, from one statistics pass, and their mean."""
    scaled = balscale_many(raw, {c: c for c in INDICATORS})
    return scaled.withColumn("risk", mean_of_known(*INDICATORS))


def finish(combined: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """County mean, region attributes and group composites.

    Tracts that only other indicators know have no state and county and form one group.
    """
    with_county = with_group_value(combined, ["state", "cnty"], risk_cnty=strict_mean("risk"))
    counties = first_per_key(
        crosswalk.select("county_fips", *REGION_COLUMNS), "county_fips", ["chapter_code", "region_code", *REGION_COLUMNS]
    )
    placed = keyed_join(
        with_county.withColumn("county_fips", county_fips_of("tract_geoid")), counties, "county_fips", "left"
    )
    scored = placed.withColumns(
        {
            "risk1_agg": mean_strict("risk_1a", "risk_1b", "risk_1c"),
            "risk2_agg": mean_strict("risk_2a", "risk_2c"),
            "risk3_agg": F.col("risk_3a"),
        }
    )
    return scored.select(*OUTPUT)


def risk_table(
    installs: DataFrame,
    alarms: DataFrame,
    blocks: DataFrame,
    yearly_fires: DataFrame,
    responses: DataFrame,
    casualties: DataFrame,
    population: DataFrame,
    crosswalk: DataFrame,
    base_year: str = "2009",
) -> DataFrame:
    """PL-AGG: 20 columns, one row per tract known to any indicator."""
    raw = raw_scores(
        install_rows(installs),
        alarm_rows(alarms),
        block_rows(blocks),
        fire_rows(yearly_fires, base_year),
        response_rows(responses),
        casualty_rows(casualties),
        population_rows(population),
    )
    # Stored once: statistics, scores and county means each read it.
    return finish(scale_and_combine(materialize(raw, "scores")), crosswalk)
