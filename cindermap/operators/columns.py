"""Column-set operators."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardize_names(df: DataFrame) -> DataFrame:
    """Lower case, with each run of dots or spaces turned into one underscore."""
    return df.toDF(*[re.sub(r"[. ]+", "_", name.lower()) for name in df.columns])


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Keep the first of the columns that share a name."""
    marked = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    first: dict[str, str] = {}
    for position, name in enumerate(df.columns):
        first.setdefault(name, f"c{position}")
    return marked.select(*[F.col(source).alias(name) for name, source in first.items()])


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included."""
    names = df.columns
    start, stop = names.index(first), names.index(last)
    if start > stop:
        raise ValueError(f"{first} comes after {last}")
    return names[start : stop + 1]


def drop_between(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*columns_between(df, first, last))


def drop_matching(df: DataFrame, names: Iterable[str] = (), patterns: Iterable[str] = ()) -> DataFrame:
    """Drop by exact name and by regex at the start of the name."""
    gone = set(names)
    tests = [re.compile(p) for p in patterns]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone and not any(t.match(c) for t in tests)])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P4."""
    return df.withColumnsRenamed(mapping)


def tag(df: DataFrame, name: str, value: object) -> DataFrame:
    """Constant column such as the data year."""
    return df.withColumn(name, F.lit(value))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    skip = set(exclude)
    return [name for name, kind in df.dtypes if kind in kinds and name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [name for name, kind in df.dtypes if kind == "string" and name not in skip]
