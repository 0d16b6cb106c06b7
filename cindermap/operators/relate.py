"""Joins (J1-J10, J13).

No join carries a broadcast hint for a table that grows with the data: Spark
compares the measured size with its threshold and falls back to a shuffled
join. The only hinted sides are those with a bound stated next to the hint.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.operators.aggregate import first_per_key

_marks = count()  # every join renames its right keys to names of its own
LEFT_SIDE_JOINS = ("inner", "left", "left_semi", "left_anti")


def _names(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _their_names(keys: list[str]) -> dict[str, str]:
    mark = next(_marks)
    return {k: f"__r{mark}_{k}" for k in keys}


def _match(left_keys: list[Column], right_keys: list[Column], null_safe: bool) -> Column:
    pairs = zip(left_keys, right_keys)
    return reduce(and_, [l.eqNullSafe(r) if null_safe else l == r for l, r in pairs])


def _refuse_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    both = (set(left.columns) & set(right.columns)) - set(keys)
    if both:
        raise ValueError(f"columns on both sides, rename them first: {sorted(both)}")


def keyed_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on named keys; the key columns appear once.

    ``null_safe`` also matches a missing key part with a missing key part, as
    data-frame libraries do; it still runs as a hash or sort-merge join.
    """
    keys = _names(on)
    if how not in ("left_semi", "left_anti"):
        _refuse_overlap(left, right, keys)
    if not null_safe:
        return left.join(right, keys, how)
    theirs = _their_names(keys)
    renamed = right.withColumnsRenamed(theirs)
    joined = left.join(renamed, _match([F.col(k) for k in keys], [F.col(theirs[k]) for k in keys], True), how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("right", "full", "outer", "full_outer"):
        joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(theirs[k])) for k in keys})
    return joined.drop(*theirs.values())


def keyed_lookup(x: DataFrame, y: DataFrame, on: str | Sequence[str], null_safe: bool = True) -> DataFrame:
    """Every row of ``y`` with the matching rows of ``x``; ``x`` columns come first."""
    keys = _names(on)
    joined = keyed_join(y, x, keys, "left", null_safe)
    rest = [c for c in x.columns if c not in keys] + [c for c in y.columns if c not in keys]
    return joined.select(*keys, *rest)


MOST_TRACKED = 1_000_000  # items of a frequent-items sketch at most


def hot_keys(*frames: DataFrame, on: str | Sequence[str], hot_share: float | None = None) -> list[dict[int, int]]:
    """For each table the keys with more rows than a task has in the mean, as hash of the key: tasks that it is worth.

    The mean is the rows over ``spark.sql.shuffle.partitions``; ``hot_share`` names another share of the rows. One job for all
    tables: each task keeps a frequent-items sketch of the key hashes, four times as many items as keys can be hot, and only the
    sketches meet. So nothing is shuffled by key, whatever the number of keys. A sketch may count a third of the mean too much, so
    a key near the mean may be among the hot ones, but none is missed as long as partitions are fewer than a quarter of ``MOST_TRACKED``.
    There are at most ``1 / hot_share`` hot keys in a table.
    """
    keys, share = _names(on), hot_share or 1 / int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = min(MOST_TRACKED // 4, ceil(1 / share))
    sketches = []
    for i, df in enumerate(frames):
        hashed = df.select(_key_hash(keys).alias("h"))
        sketches.append(hashed.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {most}, {4 * max(most, 256)})").alias("top")))
    out: list[dict[int, int]] = [{} for _ in frames]
    for row in reduce(DataFrame.union, sketches).collect():
        limit = row["n"] * share
        out[row["i"]] = {t["item"]: ceil(t["count"] / limit) for t in row["top"] if t["item"] is not None and t["count"] > max(limit, 1)}
    return out


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    hot_share: float | None = None,
    probe: DataFrame | None = None,
    hot: tuple[Mapping[int, int], Mapping[int, int]] | None = None,
) -> DataFrame:
    """Equi-join in which single keys may hold a large share of the rows of either side.

    Hot keys of both sides are looked for in one job, those of ``left`` in ``probe`` where that is cheaper to compute and
    has the same keys; or pass what :func:`hot_keys` gave as ``hot``, where it serves several joins. Without hot keys this is the plain
    join. A key worth r tasks on the left and c on the right becomes a grid: a left row takes one of r rows of the grid and goes
    to all its c cells, a right row takes one of c columns and goes to all its r cells. So neither side meets in one task, and each pair meets
    in one cell. All rows are kept; the result equals the plain join.

    The place in the grid is a hash of the row and of the input partition, so it does not
    change when a lost task runs again, and identical copies of one row still
    spread because they come from many partitions.
    """
    if how not in LEFT_SIDE_JOINS:
        raise ValueError(f"skew_join supports {LEFT_SIDE_JOINS}")
    keys, existence = _names(on), how in ("left_semi", "left_anti")
    if existence:
        right = right.select(*keys).distinct()  # one row per key: nothing is hot on the right
    else:
        _refuse_overlap(left, right, keys)
    looked = left if probe is None else probe
    if hot is None:
        hot = (hot_keys(looked, on=keys, hot_share=hot_share)[0], {}) if existence else hot_keys(looked, right, on=keys, hot_share=hot_share)
    rows, columns = hot[0], {} if existence else hot[1]
    if not rows and not columns:
        return keyed_join(left, right, keys, how, null_safe)

    grid = [(h, rows.get(h, 1), columns.get(h, 1)) for h in {**rows, **columns}]
    # at most as many rows as keys can be hot on two sides
    cells = F.broadcast(left.sparkSession.createDataFrame(grid, "__h long, __rows int, __columns int"))
    unknown = reduce(or_, [F.col(k).isNull() for k in keys])

    def placed(df: DataFrame, own: str, other: str, at: str, to: str) -> DataFrame:
        marked = df.withColumn("__hash", _key_hash(keys)).join(cells, F.col("__hash") == F.col("__h"), "left").drop("__hash", "__h")
        # a missing key part matches nothing, so such rows need not be repeated
        repeat = F.coalesce(F.col(other), F.lit(1)) if null_safe else F.when(unknown, F.lit(1)).otherwise(F.coalesce(F.col(other), F.lit(1)))
        hashable = [F.col(f"`{name}`") for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
        salt = F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), F.coalesce(F.col(own), F.lit(1))).cast("int")
        return marked.withColumns({at: salt, "__repeat": repeat}).withColumn(to, F.explode(F.sequence(F.lit(0), F.col("__repeat") - 1))).drop("__rows", "__columns")

    lefts = placed(left, "__rows", "__columns", "__i", "__j")
    theirs = _their_names(keys)
    rights = placed(right, "__columns", "__rows", "__rj", "__ri").drop("__repeat").withColumnsRenamed(theirs).withColumn("__hit", F.lit(True))
    match = _match([F.col(k) for k in keys], [F.col(theirs[k]) for k in keys], null_safe)
    joined = lefts.join(rights, match & (F.col("__i") == F.col("__ri")) & (F.col("__j") == F.col("__rj")), how)
    if existence or how == "inner" or not columns:
        return joined.drop("__i", "__j", "__ri", "__rj", "__hit", "__repeat", *theirs.values())
    # A left row that was repeated may find nothing in some of its cells; it is without partner only if its key is not on the right.
    found = joined.filter(F.col("__hit") | (F.col("__repeat") == 1)).drop("__i", "__j", "__ri", "__rj", "__hit", "__repeat", *theirs.values())
    hot_right = _key_hash(keys).isin(list(columns))
    # at most as many keys as are hot on the right, but for keys of equal hash
    present = F.broadcast(right.filter(hot_right).select(*keys).distinct())
    alone = keyed_join(left.filter(hot_right if null_safe else hot_right & ~unknown), present, keys, "left_anti", null_safe)
    # by place: names may differ in case only
    nothing = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in keys]
    return found.union(alone.select("*", *nothing))


def lookup_first(
    df: DataFrame, lookup: DataFrame, on: str | Sequence[str], order_by: Sequence[str], take: Sequence[str]
) -> DataFrame:
    """Attach columns of the first lookup row per key; rows without a match get NULL."""
    keys = _names(on)
    one = first_per_key(lookup, keys, order_by).select(*keys, *take)
    return keyed_join(df, one, keys, "left")


def unmatched(df: DataFrame, other: DataFrame, on: str | Sequence[str], null_safe: bool = False) -> DataFrame:
    """The rows that find no partner."""
    return keyed_join(df, other, on, "left_anti", null_safe)


def values_missing_in(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The distinct keys of ``df`` that ``other`` lacks; a missing key is a value.

    Both sides are reduced to one row per key before they meet.
    """
    keys = _names(on)
    return keyed_join(df.select(*keys).distinct(), other.select(*keys).distinct(), keys, "left_anti", null_safe=True)


def match_audit(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """One row with the number of rows, of rows without partner, and their share.

    Both sides are reduced to one row per key before they meet, so a hot key costs nothing.
    """
    keys = _names(on)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    present = other.select(*keys).distinct().withColumn("__found", F.lit(True))
    joined = per_key.join(present, keys, "left")
    missing = F.when(F.col("__found").isNull(), F.col("__n")).otherwise(F.lit(0))
    return joined.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("n_unmatched"),
    ).withColumn("unmatched_share", F.try_divide(F.col("n_unmatched").cast("double"), F.col("n_rows").cast("double")))
