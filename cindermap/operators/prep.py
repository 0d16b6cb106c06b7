"""Feature preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.values import nan_to_null, safe_ratio
from cindermap.operators.columns import numeric_columns, text_columns
from cindermap.operators.quantiles import quantile_row

_CHUNK = 200  # aggregate expressions per pass, which keeps generated code within bounds


def _fill(df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Fill numeric gaps (NULL and NaN) from scalar subqueries."""
    return df.withColumns({c: F.coalesce(nan_to_null(f"`{c}`"), v) for c, v in values.items()})


def mean_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Gaps become the column mean; a column without any value stays missing."""
    out = df
    for i in range(0, len(columns), _CHUNK):
        part = columns[i : i + _CHUNK]
        means = df.agg(F.struct(*[F.avg(nan_to_null(f"`{c}`")).alias(f"m{j}") for j, c in enumerate(part)])).scalar()
        out = out.withColumn("__fill", means)
        out = _fill(out, {c: F.col("__fill").getField(f"m{j}") for j, c in enumerate(part)}).drop("__fill")
    return out


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-missing text per column, ties to the smallest; long form ``(column, value)``."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])
    counted = (
        df.select(F.explode(cells).alias("c"))
        .select("c.column", "c.value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def central_impute(
    df: DataFrame, numeric: Sequence[str] | None = None, nominal: Sequence[str] | None = None
) -> DataFrame:
    """Numeric gaps become the exact median, text gaps the mode."""
    numeric = list(numeric) if numeric is not None else numeric_columns(df)
    nominal = list(nominal) if nominal is not None else text_columns(df)
    out = df
    for i in range(0, len(numeric), _CHUNK):
        part = numeric[i : i + _CHUNK]
        medians = quantile_row(df, part, [0.5]).select(F.struct(*[F.col(f"`{c}`")[0].alias(f"m{j}") for j, c in enumerate(part)])).scalar()
        out = out.withColumn("__fill", medians)
        out = _fill(out, {c: F.col("__fill").getField(f"m{j}") for j, c in enumerate(part)}).drop("__fill")
    if nominal:
        # One entry per column.
        entries = F.collect_list(F.struct(F.col("column").alias("key"), F.col("value")))
        modes = column_modes(df, nominal).agg(F.map_from_entries(entries)).scalar()
        out = out.withColumn("__fill", modes)
        out = out.withColumns(
            {c: F.coalesce(F.col(f"`{c}`"), F.col("__fill")[c]) for c in nominal}
        ).drop("__fill")
    return out


def near_zero_variance(
    df: DataFrame, columns: Sequence[str], freq_cut: float = 95 / 5, unique_cut: float = 10.0
) -> DataFrame:
    """Per column the ratio of the two largest value counts, the percentage of distinct values, and the verdict.

    Missing are NULL and, in numeric columns, NaN; the text ``NaN`` is a value.
    Flagged are columns with one value at most, or with a ratio above ``freq_cut``
    and a distinct percentage of at most ``unique_cut``. Values are counted across
    the cluster first; the choice of the top two sees one row per distinct value.
    """
    kinds = dict(df.dtypes)

    def value(name: str) -> Column:
        x = F.col(f"`{name}`")
        return (F.when(~F.isnan(x), x) if kinds[name] in ("double", "float") else x).cast("string")

    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    counted = (
        df.select(F.explode(cells).alias("c"))
        .select("c.column", "c.value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = counted.filter(F.col("value").isNotNull())
    lead = F.struct(F.col("n"), F.col("value"))
    tops = known.groupBy("column").agg(F.max(lead).alias("top"), F.count(F.lit(1)).alias("n_distinct"))
    # One row per column, so the hint is bounded by the schema.
    second = (
        known.join(F.broadcast(tops.select("column", "top")), "column")
        .filter(lead != F.col("top"))
        .groupBy("column")
        .agg(F.max("n").alias("second"))
    )
    rows = counted.groupBy("column").agg(F.sum("n").alias("n_rows"))
    table = rows.join(tops, "column", "left").join(second, "column", "left")
    distinct = F.coalesce(F.col("n_distinct"), F.lit(0))
    ratio = F.coalesce(safe_ratio(F.col("top.n"), F.col("second")), F.lit(0.0))
    percent = safe_ratio(distinct * 100, F.col("n_rows"))
    zero = distinct <= 1
    return table.select(
        "column",
        ratio.alias("freq_ratio"),
        percent.alias("percent_unique"),
        zero.alias("zero_var"),
        (zero | ((ratio > freq_cut) & (percent <= unique_cut))).alias("nzv"),
    )


def drop_near_zero_variance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    flagged = near_zero_variance(df, columns).filter("nzv").select("column")
    return df.drop(*[r["column"] for r in flagged.collect()])


def scaled_weights(df: DataFrame, column: str, out: str = "weight") -> DataFrame:
    """``x / max(x)``."""
    x = nan_to_null(column)
    return df.withColumn("__max", df.agg(F.max(x)).scalar()).withColumn(out, safe_ratio(x, "__max")).drop("__max")


def l1_weights(df: DataFrame, column: str, out: str = "weight") -> DataFrame:
    """``x / sum(x)``."""
    x = nan_to_null(column)
    return df.withColumn("__sum", df.agg(F.sum(x)).scalar()).withColumn(out, safe_ratio(x, "__sum")).drop("__sum")


def center_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean, over its sample sd; a constant column becomes NULL."""
    from cindermap.operators.scale import stats_of, zscore_by

    stats = stats_of(df, {f"s{j}": nan_to_null(f"`{c}`") for j, c in enumerate(columns)})
    with_stats = df.withColumn("__stats", stats)
    scaled = {
        c: zscore_by(nan_to_null(f"`{c}`"), F.col("__stats").getField(f"s{j}")) for j, c in enumerate(columns)
    }
    return with_stats.withColumns(scaled).drop("__stats")


def feature_vector(columns: Sequence[str], out: str = "features") -> VectorAssembler:
    """I7."""
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="error")


def vector_scaler(column: str = "features", out: str = "scaled") -> StandardScaler:
    """I5 inside an ML pipeline."""
    return StandardScaler(inputCol=column, outputCol=out, withMean=True, withStd=True)


def label_indexer(column: str, out: str = "label") -> StringIndexer:
    """I8: categories in alphabetical order, as factor levels are."""
    return StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="error")
