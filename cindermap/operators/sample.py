"""Sampling and splitting (R1-R7). Every draw is a hash of a key, so it does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from fractions import Fraction
from math import ceil, floor, isclose

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.operators.rank import dense_index
from cindermap.session import materialize

_HASH_BITS = 52
_HASH_SPAN = 1 << _HASH_BITS  # hashes stay exact when held as a double
RADIX_BITS = 16  # of the hash that one histogram counts by
BUCKET_ROWS = 100_000  # a bucket of a class with more rows is counted by its next bits


def key_hash(keys: Sequence[str], seed: int) -> Column:
    """Uniform integer in ``[0, 2**52)`` from the key and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(_HASH_SPAN))


def key_share(keys: Sequence[str], seed: int) -> Column:
    """Uniform number in ``[0, 1)`` from the key and the seed."""
    return key_hash(keys, seed) / F.lit(float(_HASH_SPAN))


def class_sizes(df: DataFrame, target: str) -> dict[str, int]:
    """Rows per class; only the class list reaches the driver."""
    return {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}


def sample_plan(sizes: Mapping[str, int], classes: Sequence[str], shares: Sequence[float], n: int | None) -> dict[str, int]:
    """Rows to take per class. The first class is primary and gets ``n`` (default: its size)."""
    if len(classes) != len(shares):
        raise ValueError("one share per class")
    if not isclose(sum(shares), 1.0):
        raise ValueError("shares must add up to 1")
    if set(classes) != set(sizes):
        raise ValueError(f"classes in the data are {sorted(map(str, sizes))}")
    primary = sizes[classes[0]] if n is None else n
    total = ceil(primary / _exact(shares[0]))
    plan = {classes[0]: primary}
    plan.update({c: floor(_exact(share) * total) for c, share in zip(classes[1:], shares[1:])})
    return plan


def _exact(share: float) -> Fraction:
    """The share as it is written: .55 is 55 of 100, not the double next to it."""
    return Fraction(repr(share)) if isinstance(share, float) else Fraction(share)


def share_rank(n: Column, share: float) -> Column:
    """``ceil(share * n)`` in whole numbers."""
    f = _exact(share)
    if not 0 <= f <= 1:
        raise ValueError("a share lies between 0 and 1")
    # quotient and rest of n apart, so that the product stays within 63 bits
    whole, rest = F.call_function("div", n, F.lit(f.denominator)), n % F.lit(f.denominator)
    return whole * F.lit(f.numerator) + F.call_function("div", rest * F.lit(f.numerator) + F.lit(f.denominator - 1), F.lit(f.denominator))


def rank_cuts(df: DataFrame, group: str, keys: Sequence[str], seed: int, rank: Callable[[Column], Column]) -> DataFrame:
    """(``__group``, ``__cut``): hash and keys of the row with rank ``rank(n)`` in hash order, for every group of n rows.

    A radix histogram: rows are counted per group by the first bits of the hash, and only the one bucket per group that
    holds the rank is looked at again, by its next bits as long as it is large, then row by row. Two passes for any number of groups up to
    about ``2^RADIX_BITS * BUCKET_ROWS`` rows in a group, one more for each further ``RADIX_BITS``. Ranks are whole numbers from
    end to end; equal hashes are told apart by their keys. Groups whose rank is 0 have no row.
    """
    h = key_hash(keys, seed)
    rows = df.select(F.col(group).alias("__group"), h.alias("__h"), F.struct(h.alias("h"), *[F.col(k) for k in keys]).alias("__at"))
    upto = Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)
    chosen, used = None, 0
    while True:
        used = min(used + RADIX_BITS, _HASH_BITS)
        inside = rows if chosen is None else _within(rows, chosen)
        counted = inside.withColumn("__bucket", F.shiftright("__h", _HASH_BITS - used))
        counted = counted.groupBy("__group", "__bucket", *([] if chosen is None else ["__rank"])).agg(F.count(F.lit(1)).alias("__n"))
        if chosen is None:
            counted = counted.withColumn("__rank", rank(F.sum("__n").over(Window.partitionBy("__group"))))
        placed = counted.withColumn("__upto", F.sum("__n").over(upto))
        held = placed.filter((F.col("__rank") > F.col("__upto") - F.col("__n")) & (F.col("__rank") <= F.col("__upto")))
        chosen = materialize(
            held.select("__group", F.col("__bucket").alias("__b"), (F.col("__rank") - F.col("__upto") + F.col("__n")).alias("__rank"), "__n", F.lit(_HASH_BITS - used).alias("__shift")), "ranks"
        )
        if used == _HASH_BITS or chosen.filter(F.col("__n") > BUCKET_ROWS).isEmpty():
            break
    order = Window.partitionBy("__group").orderBy("__at")
    last = _within(rows, chosen).withColumn("__place", F.row_number().over(order)).filter(F.col("__place") == F.col("__rank"))
    return materialize(last.select("__group", F.col("__at").alias("__cut")), "cuts")


def _within(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows in the chosen bucket of their group."""
    of = chosen.select(F.col("__group").alias("__g"), "__b", "__rank", "__shift")
    return rows.join(of, F.col("__group").eqNullSafe(F.col("__g")) & (F.expr("shiftright(__h, __shift)") == F.col("__b"))).drop("__g", "__b", "__shift")


def _up_to(df: DataFrame, group: str, keys: Sequence[str], seed: int, rank: Callable[[Column], Column]) -> DataFrame:
    """``df`` with ``__taken``: whether a row is among the first ``rank(n)`` of its group in hash order."""
    cuts = rank_cuts(df, group, keys, seed, rank)
    at = F.struct(key_hash(keys, seed).alias("h"), *[F.col(k) for k in keys])
    joined = df.withColumn("__at", at).join(cuts, F.col(group).eqNullSafe(F.col("__group")), "left")
    return joined.withColumn("__taken", F.coalesce(F.col("__at") <= F.col("__cut"), F.lit(False))).drop("__at", "__group", "__cut")


def draw_with_replacement(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, int], target: str, sizes: Mapping[str, int], seed: int
) -> DataFrame:
    """Exactly ``wanted[c]`` draws from each class, each draw a row of its own with a ``draw_id``.

    Rows are numbered in (class, key) order by one range shuffle, so a class that
    holds nearly all rows is still spread over all tasks; a draw is a hashed number
    and meets its row by an equi-join on that number.
    """
    spark = df.sparkSession
    classes = sorted(sizes, key=lambda c: (c is not None, c))  # the order of the numbered rows: by value, missing first
    indexed = dense_index(df, [target, *keys], "__row")
    # Rows are in (class, key) order, so each class is one run whose start follows from the class sizes.
    start, draw_start, starts, limits = 0, 0, {}, []
    for c in classes:
        starts[c] = start
        start += sizes[c]
    for c in classes:
        draw_start += wanted.get(c, 0)
        limits.append((c, draw_start))
    draws = spark.range(draw_start).withColumnRenamed("id", "draw_id")
    h = key_hash(["draw_id"], seed)
    pick = None
    for c, limit in limits:
        if not wanted.get(c, 0):
            continue
        if not sizes[c]:
            raise ValueError(f"class {c!r} has no rows")
        value = F.lit(starts[c]) + F.pmod(h, F.lit(sizes[c])) + F.lit(1)
        condition = F.col("draw_id") < F.lit(limit)
        pick = F.when(condition, value) if pick is None else pick.when(condition, value)
    return draws.withColumn("__row", pick).join(indexed, "__row").drop("__row")


def draw_without_replacement(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, int], target: str, sizes: Mapping[str, int], seed: int
) -> DataFrame:
    """The ``wanted[c]`` rows with the smallest key hash of each class (keys must be unique)."""
    for c, n in wanted.items():
        if n > sizes.get(c, 0):
            raise ValueError(f"class {c!r} has {sizes.get(c, 0)} rows, {n} wanted without replacement")
    rank = F.lit(0).cast("long")
    for c, n in wanted.items():
        rank = F.when(F.col("__group").eqNullSafe(F.lit(c)), F.lit(n).cast("long")).otherwise(rank)
    kept = _up_to(df, target, keys, seed, lambda _: rank).filter("__taken").drop("__taken")
    return kept.withColumn("draw_id", key_hash(keys, seed))


def downsample(
    df: DataFrame,
    target: str,
    classes: Sequence[str],
    shares: Sequence[float],
    keys: Sequence[str],
    replace: bool = True,
    n: int | None = None,
    seed: int = 12,
) -> DataFrame:
    """Sample to an exact class balance, with replacement by default."""
    sizes = class_sizes(df, target)
    plan = sample_plan(sizes, classes, shares, n)
    draw = draw_with_replacement if replace else draw_without_replacement
    return draw(df, keys, plan, target, sizes, seed)


def upsample_where(df: DataFrame, condition: Column, n: int, keys: Sequence[str], seed: int = 12) -> DataFrame:
    """Append ``n`` draws with replacement from the rows that meet the condition; originals have no ``draw_id``."""
    pool = df.filter(condition).withColumn("__class", F.lit("pool"))
    sizes = class_sizes(pool, "__class")
    extra = draw_with_replacement(pool, keys, {"pool": n}, "__class", sizes, seed).drop("__class")
    return df.unionByName(extra, allowMissingColumns=True)


def hash_split(df: DataFrame, keys: Sequence[str], test_share: float, seed: int = 12, out: str = "is_test") -> DataFrame:
    """Mark test rows by key hash; the same key is always on the same side."""
    return df.withColumn(out, key_share(keys, seed) < F.lit(test_share))


def stratified_split(
    df: DataFrame, target: str, keys: Sequence[str], train_share: float = 0.8, seed: int = 12, out: str = "is_train"
) -> DataFrame:
    """Mark ``ceil(train_share * rows)`` rows of every class as training rows (keys must be unique); rows without a class are none."""
    marked = _up_to(df, target, keys, seed, lambda n: share_rank(n, train_share))
    return marked.withColumn(out, F.col("__taken") & F.col(target).isNotNull()).drop("__taken")


def with_fold(df: DataFrame, keys: Sequence[str], folds: int, seed: int = 12, out: str = "fold") -> DataFrame:
    """Fold number for ``CrossValidator(foldCol=...)``."""
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), *[F.col(k) for k in keys]), F.lit(folds)).cast("int"))


def sample_per_band(df: DataFrame, band: str, n: int, keys: Sequence[str], seed: int = 12) -> DataFrame:
    """The first ``n`` rows of each band in hash order, or all if there are fewer (keys must be unique).

    The hash of the last one taken comes from the radix histogram; no band is sorted, whatever part of the rows it holds.
    """
    return _up_to(df, band, keys, seed, lambda size: F.least(size, F.lit(n).cast("long"))).filter("__taken").drop("__taken")
