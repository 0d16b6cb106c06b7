"""Delimited and Parquet sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindermap.functions.values import blank_to_null_all
from cindermap.operators.aggregate import stack
from cindermap.operators.columns import tag


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, sep: str = ",", header: bool = True,
    malformed: str = "raise",
) -> DataFrame:
    """Delimited text with a declared schema; no pass over the data to guess types.

    With a header, columns are taken by name in any file order, and columns the
    schema leaves out are not parsed. A blank field is missing. A field that its type
    cannot hold ends the read, or is missing with ``malformed="null"``.
    """
    if malformed not in ("raise", "null"):
        raise ValueError(f"malformed is raise or null, not {malformed!r}")
    reader = spark.read.option("header", header).option("sep", sep).option("mode", "FAILFAST" if malformed == "raise" else "PERMISSIVE")
    if not header:
        return blank_to_null_all(reader.schema(schema).csv(path))
    first = path if isinstance(path, str) else path[0]
    names = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(first).columns
    known = {f.name: f.dataType for f in schema.fields}
    absent = [n for n in known if n not in names]
    if absent:
        raise ValueError(f"{first} has no column {absent}")
    full = T.StructType([T.StructField(n, known.get(n, T.StringType())) for n in names])
    wide = reader.option("enforceSchema", False).schema(full).csv(path)
    return blank_to_null_all(wide.select(*[F.col(f"`{f.name}`") for f in schema.fields]))


def read_caret(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """S2."""
    return read_delimited(spark, path, schema, sep="^")


def read_parts(spark: SparkSession, folder: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """All header-less part files of a folder in one read."""
    return read_delimited(spark, folder, schema, sep=sep, header=False)


def read_below_title(
    spark: SparkSession, path: str, schema: T.StructType, key: str, key_pattern: str, sep: str = ","
) -> DataFrame:
    """A table whose header follows a title; title and header are the lines without a valid key.

    Lines are cut into text first; a field of a line with a key that its type cannot hold raises.
    """
    texts = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
    table = read_delimited(spark, path, texts, sep, False, "null").filter(F.col(key).rlike(key_pattern))
    return table.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in schema.fields])


def read_one(spark: SparkSession, spec: Mapping[str, object]) -> DataFrame:
    """One file set: ``{"format": "csv" | "caret" | "dbf" | "parquet", "path": ..., "schema": ...}``."""
    kind, path, schema = spec["format"], spec["path"], spec.get("schema")
    if kind == "parquet":
        table = spark.read.parquet(path)
        return table.select(*schema.names) if schema is not None else table
    if kind == "dbf":
        from cindermap.sources.dbf import read_dbf

        return read_dbf(spark, path, schema)
    if kind in ("csv", "caret"):
        return read_delimited(spark, path, schema, sep="^" if kind == "caret" else ",")
    raise ValueError(f"unknown format {kind!r}")


def read_years(spark: SparkSession, specs: Mapping[int | str, Mapping[str, object]]) -> DataFrame:
    """One table over several years; the format is chosen per file set, columns are matched by name."""
    return stack(*[tag(read_one(spark, spec), "year", str(year)) for year, spec in sorted(specs.items())])


def write_delimited(df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists") -> None:
    """One file per task, each with a header."""
    df.write.option("header", True).option("sep", sep).mode(mode).csv(path)


def save_by_year(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Parquet partitioned by year; returns the stored table."""
    df.write.partitionBy("year").mode(mode).parquet(path)
    spark = df.sparkSession
    return spark.read.schema(df.schema).parquet(path)


def save_tables(tables: Mapping[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Named tables as Parquet folders side by side."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of :func:`save_tables` by name; any folder that Spark reads will do."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def with_row_id(df: DataFrame, order_by: Sequence[str | Column], name: str = "id") -> DataFrame:
    """Row number in a named order, the same on every run."""
    from cindermap.operators.rank import dense_index

    return dense_index(df, order_by, name)
