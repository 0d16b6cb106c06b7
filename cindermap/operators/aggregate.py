"""Grouping operators.

Every group is reduced on the map side first; no operator here gathers the rows
of a group in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.functions.values import col, nan_to_null, safe_ratio


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def stack(*frames: DataFrame) -> DataFrame:
    """Append tables by column name; a column missing in one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_keys(*frames: DataFrame) -> DataFrame:
    """The distinct rows of all tables together."""
    return stack(*frames).distinct()


def first_per_key(df: DataFrame, keys: str | Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order_by`` (NULL first), which should be a total order.

    Each task keeps the first row of a key before anything is shuffled (a group limit below the ranking), so
    a key with very many copies is not gathered, and rows stay in their columns.
    """
    names = _names(keys)
    if len(names) == len(df.columns):
        return df.dropDuplicates(names)
    place = F.row_number().over(Window.partitionBy(*names).orderBy(*[col(o).asc_nulls_first() for o in order_by]))
    return df.withColumn("__place", place).filter(F.col("__place") == 1).drop("__place")


def counts_by(df: DataFrame, keys: str | Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key combination; a missing key is a group of its own."""
    return df.groupBy(*_names(keys)).agg(F.count(F.lit(1)).alias(name))


def frequency(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Absolute and relative frequency of every combination."""
    table = counts_by(df, keys, "n")
    total = table.agg(F.sum("n")).scalar()
    return table.withColumn("share", safe_ratio(F.col("n"), total))


def three_state_counts(
    df: DataFrame, keys: str | Sequence[str], flag: str, names: Mapping[str, str], weight: Column | None = None
) -> DataFrame:
    """A2: all rows, TRUE, FALSE and unknown per key in one pass.

    ``names`` maps ``all``, ``unknown``, ``true``, ``false`` to the output names.
    With ``weight`` a row stands for that many rows.
    """
    f, one = F.col(flag), F.lit(1) if weight is None else weight

    def total(condition: Column | None) -> Column:
        return F.sum((one if condition is None else F.when(condition, one).otherwise(F.lit(0))).cast("long"))

    return df.groupBy(*_names(keys)).agg(
        total(None).alias(names["all"]),
        total(f.isNull()).alias(names["unknown"]),
        total(f).alias(names["true"]),
        total(~f).alias(names["false"]),
    )


def strict_sum(c: Column | str) -> Column:
    """A3 (aggregate): sum that is missing as soon as one value of the group is."""
    c = col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def strict_mean(c: Column | str) -> Column:
    """A4 (aggregate): mean that is missing as soon as one value of the group is."""
    c = col(c)
    return F.when(F.count(F.lit(1)) == F.count(c), F.avg(c))


def share_where(condition: Column) -> Column:
    """A5, A19 (aggregate): share of the group's rows that meet the condition."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def distinct_values(c: Column | str) -> Column:
    """A7 (aggregate): number of distinct values, a missing value counting as one."""
    return F.count_distinct(F.struct(col(c)))


def approx_distinct_values(c: Column | str, error: float = 0.01) -> Column:
    """A7 (aggregate), sketched; a missing value is not counted."""
    return F.approx_count_distinct(col(c), error)


def distinct_count_by(df: DataFrame, keys: str | Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct values per group, largest first, ties by key."""
    names = _names(keys)
    counted = df.groupBy(*names).agg(distinct_values(column).alias(name))
    return counted.orderBy(F.desc(name), *[F.asc_nulls_first(k) for k in names])


def top(df: DataFrame, by: str, ties: Sequence[str], k: int) -> DataFrame:
    """The ``k`` largest rows; ``ties`` makes the choice unique."""
    return df.orderBy(F.desc(by), *[F.asc_nulls_first(t) for t in ties]).limit(k)


def mode_by(df: DataFrame, keys: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Most frequent non-missing value per group and column, ties to the smallest value.

    One scan turns the columns into (group, column, value) rows, whose counts are combined in the tasks; what is left per group chooses for
    all columns at once. So there are two shuffles for any number of columns, and only one row per distinct value reaches the choice.
    """
    names = _names(keys)
    kinds = sorted({df.schema[c].dataType.simpleString() for c in columns})
    slot = {c: f"v{kinds.index(df.schema[c].dataType.simpleString())}" for c in columns}

    def cell(i: int, column: str | None) -> Column:
        values = [(F.col(column) if column and slot[column] == f"v{k}" else F.lit(None)).cast(kind).alias(f"v{k}") for k, kind in enumerate(kinds)]
        return F.struct(F.lit(i).alias("i"), *values)

    # the cell -1 keeps groups without any value
    present = [F.when(F.col(c).isNotNull(), cell(i, c)) for i, c in enumerate(columns)]
    cells = df.select(*[F.col(k).alias(f"__k{j}") for j, k in enumerate(names)], F.explode(F.array_compact(F.array(cell(-1, None), *present))).alias("c"))
    keyed = [f"__k{j}" for j in range(len(names))]
    counted = cells.groupBy(*keyed, "c").agg(F.count(F.lit(1)).alias("n"))
    best = [F.min(F.when(F.col("c.i") == i, F.struct((-F.col("n")).alias("n"), F.col(f"c.{slot[c]}").alias("v")))).alias(f"__b{i}") for i, c in enumerate(columns)]
    chosen = counted.groupBy(*keyed).agg(*best)
    return chosen.select(*[F.col(k).alias(n) for k, n in zip(keyed, names)], *[F.col(f"__b{i}.v").alias(c) for i, c in enumerate(columns)])


def unique_values(df: DataFrame, keys: str | Sequence[str], column: str) -> DataFrame:
    """A8 in long form: one row per group and distinct value."""
    return df.select(*_names(keys), column).filter(F.col(column).isNotNull()).distinct()


def collect_unique(df: DataFrame, keys: str | Sequence[str], column: str, name: str) -> DataFrame:
    """Sorted list of the distinct values per group.

    Meant for code lists (state codes per county): values are made distinct across
    the cluster first, so the list holds the code list at most, never the rows.
    Use :func:`unique_values` for a column without such a bound.
    """
    pairs = unique_values(df, keys, column)
    return pairs.groupBy(*_names(keys)).agg(F.sort_array(F.collect_list(column)).alias(name))


def with_group_value(df: DataFrame, keys: str | Sequence[str], **values: Column) -> DataFrame:
    """Attach group aggregates to every row; a missing key is a group of its own.

    Aggregate and join back instead of a window that would gather each group. The joined table has one row per group, so
    adaptive execution can split the rows of a large group over tasks; nothing runs while the plan is built.
    """
    from cindermap.operators.relate import keyed_join

    names = _names(keys)
    per_group = df.groupBy(*names).agg(*[v.alias(n) for n, v in values.items()])
    return keyed_join(df, per_group, names, "left", null_safe=True)


def with_min_support(df: DataFrame, keys: str | Sequence[str], more_than: int) -> DataFrame:
    """rows of groups with more than ``more_than`` rows."""
    marked = with_group_value(df, keys, __support=F.count(F.lit(1)))
    return marked.filter(F.col("__support") > more_than).drop("__support")


def duplicate_audit(df: DataFrame, keys: str | Sequence[str], name: str = "n") -> DataFrame:
    """Keys that occur more than once, most frequent first."""
    names = _names(keys)
    table = counts_by(df, names, name).filter(F.col(name) > 1)
    return table.orderBy(F.desc(name), *[F.asc_nulls_first(k) for k in names])


def column_stats(columns: Mapping[str, Column]) -> list[Column]:
    """Min, max, mean, sample sd and count of each named expression, as aggregate structs."""
    out = []
    for name, expression in columns.items():
        x = nan_to_null(expression)
        out.append(
            F.struct(
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("sd"),
                F.count(x).alias("n"),
            ).alias(name)
        )
    return out


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and share of every column, one pass, long form."""
    chosen = list(columns) if columns is not None else df.columns
    kinds = dict(df.dtypes)

    def missing(name: str) -> Column:
        c = F.col(f"`{name}`")
        return (c.isNull() | F.isnan(c)) if kinds[name] in ("double", "float") else c.isNull()

    one = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.coalesce(missing(c), F.lit(True))).alias(f"__m{i}") for i, c in enumerate(chosen)],
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("n_missing")) for i, c in enumerate(chosen)]
    )
    return (
        one.select("__rows", F.explode(pairs).alias("p"))
        .select("p.column", "p.n_missing", "__rows")
        .withColumn("share_missing", safe_ratio("n_missing", "__rows"))
        .drop("__rows")
    )


def high_missing_columns(df: DataFrame, columns: Sequence[str], more_than: float = 0.05) -> list[str]:
    """I4: names of columns whose missing share exceeds the limit (one row per column reaches the driver)."""
    profile = missing_profile(df, columns).filter(F.col("share_missing") > more_than)
    return [r["column"] for r in profile.select("column").collect()]


def distinct_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of distinct values per column, long form."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    )
    values = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").distinct()
    return values.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def coverage(
    regions: DataFrame, covered: DataFrame, id_column: str, group: str, amount: str
) -> DataFrame:
    """Per group, the amount of all units, of the covered units, and their ratio (groups with cover only)."""
    flagged = regions.join(covered.select(id_column).distinct().withColumn("__in", F.lit(True)), id_column, "left")
    return (
        flagged.groupBy(group)
        .agg(
            F.sum(amount).alias("total_population"),
            F.sum(F.when(F.col("__in"), F.col(amount))).alias("covered_population"),
            F.count_if(F.col("__in")).alias("__hits"),
        )
        .filter(F.col("__hits") > 0)
        .drop("__hits")
        .withColumn("coverage", safe_ratio("covered_population", "total_population"))
    )
