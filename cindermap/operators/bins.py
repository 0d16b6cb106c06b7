"""Binning (B1-B6). Breaks are scalar arrays computed by one aggregate; bins are right-closed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.values import col, nan_to_null, safe_ratio
from cindermap.operators.quantiles import quantile_array


def even_probs(points: int) -> list[float]:
    """``points`` probabilities from 0 to 1 at equal steps."""
    return [i / (points - 1) for i in range(points)]


def quantile_breaks(df: DataFrame, column: str | Column, points: int = 10) -> Column:
    """B1: ``points`` quantile breaks, so ``points - 1`` bins."""
    return quantile_array(df, column, even_probs(points))


def fixed_breaks(df: DataFrame, column: str | Column, points: int = 10) -> Column:
    """B2: ``points`` breaks at equal distance from the minimum to the maximum."""
    x = nan_to_null(column)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    step = (hi - lo) / F.lit(float(points - 1))
    inner = [lo + step * F.lit(float(i)) for i in range(points - 1)]
    return ends.select(F.array(*inner, hi)).scalar()


def given_breaks(breaks: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(b)) for b in breaks])


def bin_index(c: Column | str, breaks: Column, points: int) -> Column:
    """Bin number 1..points-1 for right-closed bins, the lowest break included; outside or missing is NULL."""
    x = nan_to_null(c)
    chain = F.when(x.isNull() | (x < breaks.getItem(0)), F.lit(None).cast("int"))
    for i in range(1, points):
        chain = chain.when(x <= breaks.getItem(i), F.lit(i))
    return chain


def cut(df: DataFrame, column: str, breaks: Column, points: int, out: str = "bin") -> DataFrame:
    """Add the bin number."""
    with_breaks = df.withColumn("__breaks", breaks)
    return with_breaks.withColumn(out, bin_index(column, F.col("__breaks"), points)).drop("__breaks")


def bin_counts(
    df: DataFrame, column: str, breaks: Column, points: int, set_missing: Column | None = None
) -> DataFrame:
    """Rows per non-empty bin with its ends and a ``count (low, high)`` label.

    ``set_missing`` marks rows whose value is treated as missing first.
    """
    x = nan_to_null(column)
    if set_missing is not None:
        x = F.when(~F.coalesce(set_missing, F.lit(False)), x)
    binned = df.select(x.alias("x"), breaks.alias("__breaks")).select(
        bin_index("x", F.col("__breaks"), points).alias("bin")
    )
    counted = binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    ends = counted.withColumn("__breaks", breaks).select(
        "bin", "n", F.get("__breaks", F.col("bin") - 1).alias("low"), F.get("__breaks", F.col("bin")).alias("high")
    )
    return ends.withColumn("label", F.format_string("%d (%.3f, %.3f)", "n", "low", "high"))


def histogram(df: DataFrame, column: str | Column, bins: int) -> DataFrame:
    """Counts of ``bins`` equal-width right-closed bins, empty ones included.

    The bin is computed, not searched, and moved by one where rounding put a value
    on the wrong side of a break, so the cost does not grow with ``bins``.
    """
    x = nan_to_null(column)
    ends = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = F.col("__ends").getField("lo"), F.col("__ends").getField("hi")
    width = (hi - lo) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i == F.lit(bins), hi).otherwise(lo + width * i.cast("double"))

    present = df.select(x.alias("x"), ends.alias("__ends")).filter(F.col("x").isNotNull())
    raw = F.coalesce(F.ceil(safe_ratio(F.col("x") - lo, width)), F.lit(1)).cast("int")
    g = F.least(F.greatest(raw, F.lit(1)), F.lit(bins))
    placed = present.select("x", "__ends", g.alias("g"))
    g = F.col("g")
    fixed = (
        F.when((g > 1) & (F.col("x") <= edge(g - 1)), g - 1)
        .when((g < bins) & (F.col("x") > edge(g)), g + 1)
        .otherwise(g)
    )
    counted = placed.groupBy(fixed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # Both sides hold at most ``bins`` rows.
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(F.broadcast(counted), "bin", "left").withColumn("__ends", ends)
    return out.select(
        "bin",
        edge(F.col("bin") - 1).alias("low"),
        edge(F.col("bin")).alias("high"),
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
    )
