"""Helpers shared by the corpus operators: tables, positions along an order, connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindermap.session import materialize

WORD = r"[^\x20\x09-\x0D]+"  # a word: any run of characters that are not ASCII white space


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_totals(df: DataFrame, value: str, order: Sequence[str | Column], group: Sequence[str] = ()) -> DataFrame:
    """Positions and sums of ``value`` along ``order``, one sequence for each ``group``, without a one-task window.

    Adds ``before`` (sum of ``value`` over the rows before this one), ``position`` (their
    number), ``total`` and ``n_rows`` of the group. The rows are dealt by range, so
    that a group of any size spreads over tasks; each range sums itself, and what lies
    before a range comes from one row per range and group (their number is at most ranges
    plus groups). Rows that tie in ``order`` follow in the order in which they are read.
    Nulls in ``value`` count as 0, null groups are a group, null orders come first.
    Select the columns first: all are written to the shared folder, as they come and once more by range.
    """
    spark = df.sparkSession
    order = [F.col(o).asc_nulls_first() if isinstance(o, str) else o for o in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumns({"__tie": F.monotonically_increasing_id(), "__v": F.coalesce(F.col(value), F.lit(0)).cast("long")})
    # finding the ranges reads the rows once more, so what makes them must not run twice
    ranged = materialize(tied, "rows").repartitionByRange(n, *group, *order, "__tie").withColumn("__part", F.spark_partition_id())
    stored = materialize(ranged, "ranges")

    sizes = stored.groupBy("__part", *group).agg(F.sum("__v").alias("__sum"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = sizes.select(
        F.col("__part").alias("__p"),
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__sum_before"),
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n_before"),
        F.sum("__sum").over(whole).alias("total"),
        F.sum("__n").over(whole).alias("n_rows"),
    )
    match = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy("__part", *group).orderBy(*order, "__tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        stored.join(starts, match)
        .withColumns(
            {
                "before": F.col("__sum_before") + F.sum("__v").over(upto) - F.col("__v"),
                "position": F.col("__n_before") + F.row_number().over(inside) - F.lit(1),
            }
        )
        .drop("__tie", "__v", "__part", "__p", "__sum_before", "__n_before", *[f"__g{i}" for i in range(len(group))])
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (``a``, ``b``); label: the smallest node that links reach.

    Labels take the least label of their neighbours and then jump to the label of their
    label, so a chain halves in each round. Each round is a written table; only the
    number of changes comes to the driver.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = materialize(least.join(jump, "label").select("node", F.least("label", "next").alias("label"), "old"), "labels")
        if after.filter(F.col("label") != F.col("old")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
