"""Disaster response cases per area and day (PL-2C)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.operators.aggregate import distinct_count_by, duplicate_audit, strict_sum
from cindermap.operators.columns import numeric_columns
from cindermap.operators.filters import home_fire, known
from cindermap.operators.quantiles import summary_table
from cindermap.operators.rank import with_rank
from cindermap.operators.spatial import assign_polygon


def home_fire_cases(cases: DataFrame) -> DataFrame:
    """a case without an event type is not a home fire."""
    return cases.filter(home_fire("event_type_old_categories"))


def locate_cases(
    cases: DataFrame, polygons: DataFrame, lon: str = "esri_longitude_x", lat: str = "esri_latitude_x", cell: float = 0.1
) -> DataFrame:
    """J11 on home-fire cases: adds ``tract``; a case without coordinates has none."""
    return assign_polygon(cases, polygons, lon, lat, cell, "tract")


def fires_per_tract(located: DataFrame) -> DataFrame:
    """Cases per tract in the layout the final job reads."""
    placed = located.filter(F.col("tract").isNotNull())
    return placed.groupBy(F.col("tract").alias("x")).agg(F.count(F.lit(1)).alias("freq"))


def cases_per_day(cases: DataFrame) -> DataFrame:
    """A3: cases per tract and day; a group with a missing count is missing. Rows without tract or day belong to no group."""
    grouped = cases.filter(F.col("tract").isNotNull() & F.col("incident_disaster_date").isNotNull())
    return grouped.groupBy("tract", "incident_disaster_date").agg(strict_sum("num_case").alias("risk_indicator"))


def cases_per_tract(cases: DataFrame) -> DataFrame:
    grouped = cases.filter(F.col("tract").isNotNull())
    return grouped.groupBy("tract").agg(strict_sum("num_case").alias("risk_indicator"))


def repeated_cases(cases: DataFrame) -> DataFrame:
    """Case numbers that occur more than once."""
    return duplicate_audit(cases, "case_num", "number")


def cases_by(cases: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Distinct cases per region, state and county, ZIP code or state; largest first."""
    return distinct_count_by(cases, keys, "case_num", "number_cases")


def state_order(cases: DataFrame) -> DataFrame:
    """O3: states in display order, from few to many cases, unknown states left out."""
    counted = cases_by(cases, "esri_state").filter(known("esri_state"))
    return with_rank(counted, ["number_cases", "esri_state"], "position")


def case_summary(cases: DataFrame) -> DataFrame:
    """A10 of every numeric column."""
    return summary_table(cases, numeric_columns(cases))
