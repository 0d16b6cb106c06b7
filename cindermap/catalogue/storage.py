"""Sources and sinks: each query writes a driver table to the shared folder in one format and reads it back."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import table, text
from cindermap.session import scratch_path
from cindermap.sources.dbf import read_dbf
from cindermap.sources.schemas import CHAPTER_CROSSWALK, layout
from cindermap.sources.tables import (
    read_below_title,
    read_delimited,
    read_parts,
    read_years,
    save_by_year,
    write_delimited,
)

_ORDERS = layout("o_orderkey o_custkey o_orderstatus o_orderpriority", "", "o_totalprice")


def _orders(spark, folder):
    """Orders with text ids; a pending order has a blank priority."""
    return table(spark, folder, "orders").select(
        text("o_orderkey").alias("o_orderkey"), F.lpad(text("o_custkey"), 8, "0").alias("o_custkey"), "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "o_totalprice",
    )


_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS o_custkey, o_totalprice,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority FROM orders"""


@query(_SQL)
def comma_file(spark, folder):
    """Columns by name, ids keep their zeros, blanks are missing."""
    path = scratch_path(spark, "csv")
    write_delimited(_orders(spark, folder), path)
    wanted = T.StructType([f for f in _ORDERS.fields if f.name != "o_orderstatus"])
    return read_delimited(spark, path, wanted)


@query(_SQL)
def caret_file(spark, folder):
    """S2."""
    path = scratch_path(spark, "caret")
    write_delimited(_orders(spark, folder), path, sep="^")
    return read_delimited(spark, path, _ORDERS, sep="^").drop("o_orderstatus")


@query(_SQL)
def part_files(spark, folder):
    """Parts without header."""
    path = scratch_path(spark, "parts")
    o = _orders(spark, folder)
    o.write.option("header", False).csv(path)
    return read_parts(spark, path, T.StructType([_ORDERS[c] for c in o.columns])).drop("o_orderstatus")


@query("""
SELECT CASE o_orderstatus WHEN 'F' THEN '2009' WHEN 'O' THEN '2010' ELSE '2011' END AS year, COUNT(*) AS n,
  COUNT(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS n_priority, round(SUM(o_totalprice), 2) AS price FROM orders GROUP BY 1""")
def mixed_years(spark, folder):
    """A format per year, stacked by name."""
    o = _orders(spark, folder)
    specs = {}
    for year, status, kind in (("2009", "F", "caret"), ("2010", "O", "csv"), ("2011", "P", "parquet")):
        path, rows = scratch_path(spark, kind), o.filter(F.col("o_orderstatus") == status)
        if kind == "parquet":
            rows.withColumn("o_orderpriority", F.nullif(F.col("o_orderpriority"), F.lit(""))).write.parquet(path)
        else:
            write_delimited(rows, path, sep="^" if kind == "caret" else ",")
        specs[year] = {"format": kind, "path": path, "schema": _ORDERS}
    years = read_years(spark, specs)
    return years.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_orderpriority").alias("n_priority"), F.round(F.sum("o_totalprice"), 2).alias("price")
    )


@query("""
SELECT lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS county_fips, CAST(s_suppkey AS VARCHAR) AS chapter_code, s_name AS chapter_name FROM supplier""")
def titled_file(spark, folder):
    """The header follows a title line."""
    path = scratch_path(spark, "titled")
    s = table(spark, folder, "supplier")
    line = F.concat_ws(",", F.lpad(text("s_nationkey"), 5, "0"), F.lit("r"), F.lit("region"), text("s_suppkey"), "s_name", F.lit("county"))
    top = spark.range(1).select(F.explode(F.array(F.lit("Chapter list"), F.lit(",".join(CHAPTER_CROSSWALK.names)))).alias("value"))
    top.unionByName(s.select(line.alias("value"))).write.text(path)
    rows = read_below_title(spark, path, CHAPTER_CROSSWALK, "county_fips", "^[0-9]{5}$")
    return rows.select("county_fips", "chapter_code", "chapter_name")


@query("""
SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, COUNT(*) AS n, round(SUM(o_totalprice), 2) AS price
FROM orders WHERE year(o_orderdate) >= 1998 GROUP BY 1""")
def yearly_store(spark, folder):
    """Stored by year, read back with only the years asked for."""
    o = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    kept = save_by_year(o.select("o_orderkey", "o_totalprice", "year"), scratch_path(spark, "years"))
    return kept.filter(F.col("year") >= "1998").groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")
    )


_DBF_FIELDS = (("KEY", "N", 12, 0), ("CUST", "C", 12, 0), ("PRICE", "N", 14, 2), ("PRIO", "C", 16, 0))


def _dbf_files(folder: str):
    """Each batch of rows becomes a DBF file of its own; the name fixes it, so a rerun writes the same file."""

    def write(batches):
        import pandas as pd
        from pyarrow import fs
        from pyspark import TaskContext

        target, inner = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        target.create_dir(inner, recursive=True)
        task = TaskContext.get()
        for number, rows in enumerate(batches):
            described = b"".join(
                name.encode().ljust(11, b"\0") + kind.encode() + b"\0" * 4 + bytes([length, decimals]) + b"\0" * 14
                for name, kind, length, decimals in _DBF_FIELDS
            )
            width = 1 + sum(f[2] for f in _DBF_FIELDS)
            head = struct.pack("<B3xIHH20x", 3, len(rows), 33 + len(described), width)
            body = "".join(
                f" {r.key:>12d}{r.cust:<12s}{r.price:>14.2f}{r.prio:<16s}" for r in rows.itertuples(index=False)
            ).encode("latin-1")
            name = f"{inner}/part-{task.partitionId()}-{number}.dbf"
            draft = f"{name}.{task.taskAttemptId()}"
            with target.open_output_stream(draft) as out:
                out.write(head + described + b"\r" + body + b"\x1a")
            target.move(draft, name)
            yield pd.DataFrame({"rows": [len(rows)]})

    return write


@query("""
SELECT o_orderkey AS "KEY", lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS "CUST", o_totalprice AS "PRICE",
  CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS "PRIO" FROM orders""")
def dbf_files(spark, folder):
    """S3, K9: fixed-width records, blanks missing."""
    path = scratch_path(spark, "dbf")
    o = _orders(spark, folder).select(
        F.col("o_orderkey").cast("long").alias("key"), F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("prio"),
    )
    o.mapInPandas(_dbf_files(path), "rows long").write.format("noop").mode("overwrite").save()
    return read_dbf(spark, path)
