"""Global positions without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.functions.values import col
from cindermap.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row in partition below


def dense_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Number the rows 1..n in the given total order.

    One range shuffle sorts the rows across tasks and each task numbers its own
    range; the table is written once, and the start of each range is added from
    the per-range row counts. A value that many rows share does not land in one
    task as long as ``order_by`` goes on to a unique column.
    """
    spark = df.sparkSession
    order = [col(o) for o in order_by]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    stored = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "index")

    stored = stored.withColumns(
        {
            "__part": F.shiftright("__at", _ROW_BITS),
            "__pos": F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    # One row per range: the window below sees at most n rows, whatever the table holds.
    sizes = stored.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    placed = stored.join(F.broadcast(starts), "__part")
    return placed.withColumn(name, F.col("__start") + F.col("__pos") + F.lit(1)).drop("__at", "__part", "__pos", "__start")


def chunk_ids(df: DataFrame, k: int, order_by: Sequence[str | Column], name: str = "chunk") -> DataFrame:
    """Split into ``k`` consecutive chunks whose sizes differ by at most one, larger chunks first."""
    indexed = dense_index(df, order_by, "__index")
    counted = indexed.withColumn("__n", indexed.agg(F.count(F.lit(1))).scalar())
    i, n = F.col("__index") - F.lit(1), F.col("__n")
    extra = n % F.lit(k)
    small = F.floor((n - extra) / F.lit(k))
    in_large = i < extra * (small + 1)
    large_chunk = F.floor(i / (small + 1))
    small_chunk = extra + F.floor(F.try_divide(i - extra * (small + 1), small))
    chunk = F.when(in_large, large_chunk).otherwise(small_chunk) + F.lit(1)
    return counted.withColumn(name, chunk.cast("int")).drop("__index", "__n")


def with_rank(df: DataFrame, order_by: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """O3: the position of each category in the order of a measure (display order)."""
    return dense_index(df, order_by, name)
