"""Coordinates to census block groups (PL-GEO)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.functions.keys import payload_value
from cindermap.functions.values import blank_to_null
from cindermap.operators.relate import keyed_join
from cindermap.operators.spatial import assign_polygon
from cindermap.sources.tables import with_row_id

BLOCK_PATH = ("Block", "_FIPS")


def number_visits(visits: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """S13."""
    return with_row_id(visits, order_by, "id")


def parse_payloads(payloads: DataFrame, path: Sequence[str] = BLOCK_PATH) -> DataFrame:
    """``id, xml`` to ``id, block_group``; an unusable answer is tagged ``error``."""
    return payloads.select("id", payload_value("xml", path).alias("block_group"))


def attach_blocks(visits: DataFrame, located: DataFrame) -> DataFrame:
    """Visits with the block group found for them; visits without one stay."""
    return keyed_join(visits, located.select("id", "block_group"), "id", "left")


def locate_visits(visits: DataFrame, polygons: DataFrame, cell: float = 0.1) -> DataFrame:
    """Visits with text coordinates assigned to block-group polygons."""
    numeric = visits.withColumns(
        {
            "__lon": blank_to_null("Longitude").try_cast("double"),
            "__lat": blank_to_null("Latitude").try_cast("double"),
        }
    )
    return assign_polygon(numeric, polygons, "__lon", "__lat", cell, "block_group").drop("__lon", "__lat")


def share_located(located: DataFrame) -> DataFrame:
    found = F.col("block_group").isNotNull() & (F.col("block_group") != "error")
    return located.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(found, F.lit(False))).alias("n_missing"))
