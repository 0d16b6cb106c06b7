"""Bins, histograms and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import TRACT_SQL, table, tracts
from cindermap.operators.bins import bin_counts, cut, fixed_breaks, histogram, quantile_breaks
from cindermap.operators.rank import chunk_ids, dense_index
from cindermap.plans.block_risk import county_bins, county_risk


def _case(x, breaks):
    steps = " ".join(f"WHEN {x} <= {b} THEN {i}" for i, b in enumerate(breaks[1:], 1))
    return f"CASE {steps} END"


_Q = [f"q[{i}]" for i in range(1, 12)]


@query(f"""
WITH b AS (SELECT quantile_cont(c_acctbal, [{', '.join(str(i / 10) for i in range(11))}]) AS q FROM customer)
SELECT c_custkey, {_case('c_acctbal', _Q)} AS bin FROM customer, b""")
def decile_classes(spark, folder):
    """B1, B3, B5."""
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return cut(c, "c_acctbal", quantile_breaks(c, "c_acctbal", 11), 11).select("c_custkey", "bin")


_FIXED = [f"(lo + (hi - lo) / 9 * {i})" for i in range(9)] + ["hi"]


@query(f"""
WITH e AS (SELECT MIN(c_acctbal) AS lo, MAX(c_acctbal) AS hi FROM customer),
n AS (SELECT {_case('c_acctbal', _FIXED)} AS bin, COUNT(*) AS n FROM customer, e
  WHERE c_mktsegment <> 'MACHINERY' GROUP BY 1)
SELECT bin, n, round(lo + (hi - lo) / 9 * (bin - 1), 4) AS low, round(lo + (hi - lo) / 9 * bin, 4) AS high FROM n, e""")
def fixed_bin_counts(spark, folder):
    """One segment is set to missing first."""
    c = table(spark, folder, "customer")
    counts = bin_counts(c, "c_acctbal", fixed_breaks(c, "c_acctbal", 10), 10, F.col("c_mktsegment") == "MACHINERY")
    return counts.select("bin", "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("""
WITH e AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem),
i AS (SELECT CAST(unnest(generate_series(1, 50)) AS INTEGER) AS bin),
f AS (SELECT bin, lo + (hi - lo) / 50 * (bin - 1) AS low, CASE WHEN bin = 50 THEN hi ELSE lo + (hi - lo) / 50 * bin END AS high FROM i, e)
SELECT bin, round(low, 4) AS low, round(high, 4) AS high, COUNT(l_extendedprice) AS n FROM f LEFT JOIN lineitem
  ON (l_extendedprice > low OR (bin = 1 AND l_extendedprice = low)) AND l_extendedprice <= high GROUP BY bin, low, high""")
def price_histogram(spark, folder):
    """B6."""
    h = histogram(table(spark, folder, "lineitem"), "l_extendedprice", 50)
    return h.select("bin", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "n")


@query("SELECT c_custkey, CAST(ntile(7) OVER (ORDER BY c_custkey) AS INTEGER) AS chunk FROM customer")
def row_chunks(spark, folder):
    """W4."""
    return chunk_ids(table(spark, folder, "customer").select("c_custkey"), 7, ["c_custkey"])


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_id FROM lineitem""")
def row_numbers(spark, folder):
    """Numbering in an order whose leading value repeats in a third of the rows."""
    l = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"
    )
    order = ["l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return dense_index(l, order, "row_id").drop("l_returnflag")


@query(f"""
WITH c AS (SELECT substring(geoid, 1, 5) AS fips, AVG(c_acctbal) AS risk FROM ({TRACT_SQL}) GROUP BY 1),
b AS (SELECT quantile_cont(risk, [{', '.join(f'{i}.0/9' for i in range(10))}]) AS q FROM c)
SELECT {_case('risk', _Q[:10])} AS bin, COUNT(*) AS n FROM c, b GROUP BY 1""")
def county_quantile_bins(spark, folder):
    """PL-1C, B1, B3, B4."""
    blocks = tracts(spark, folder).select(
        F.concat("geoid", F.lit("1")).alias("bg_geoid"), F.col("c_acctbal").alias("smoke_alarm_risk"), F.col("population").alias("bg_pop")
    )
    return county_bins(county_risk(blocks)).select("bin", "n")
