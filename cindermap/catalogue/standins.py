"""The domain tables, derived from the driver tables.

tract = customer, county = nation, state = region, population = whole part of the
absolute account balance, incident = orders, incident detail = lineitem, response
case = events. Each ``*_SQL`` constant is the same table for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.functions.keys import pad_left

TRACT_SQL = """
  SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0')
         || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0')
                 ELSE CAST(c_custkey AS VARCHAR) END AS geoid,
         c_custkey, c_acctbal, c_mktsegment, n_nationkey, n_regionkey, n_name,
         CAST(floor(abs(c_acctbal)) AS BIGINT) AS population
  FROM customer JOIN nation ON c_nationkey = n_nationkey"""

INC_TYPE_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN '111' WHEN '2-HIGH' THEN '1110'
  WHEN '3-MEDIUM' THEN '112' WHEN '5-LOW' THEN '500' END"""


# Declared so that no job is spent on reading footers before a query starts.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def text(c: str) -> Column:
    return F.col(c).cast("string")


def tracts(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    joined = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    geoid = F.concat(pad_left("n_regionkey", 2), pad_left("n_nationkey", 3), pad_left("c_custkey", 6))
    return joined.select(
        geoid.alias("geoid"), "c_custkey", "c_acctbal", "c_mktsegment", "n_nationkey", "n_regionkey", "n_name",
        F.floor(F.abs("c_acctbal")).alias("population"),
    )


def incident_type() -> Column:
    p = F.col("o_orderpriority")
    return (
        F.when(p == "1-URGENT", "111").when(p == "2-HIGH", "1110").when(p == "3-MEDIUM", "112").when(p == "5-LOW", "500")
    )


def incident_key() -> list[Column]:
    """Key of an order as an incident; the state of some incidents is missing."""
    return [
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("STATE"),
        text("o_custkey").alias("FDID"),
        F.date_format("o_orderdate", "MMddyyyy").alias("INC_DATE"),
        text("o_orderkey").alias("INC_NO"),
        F.lit("0").alias("EXP_NO"),
    ]


def basic_incidents(spark: SparkSession, folder: str) -> DataFrame:
    status, priority, price = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        *incident_key(),
        incident_type().alias("INC_TYPE"),
        F.when(status == "F", "NN").when(status == "O", "40").otherwise("00").alias("MIXED_USE"),
        F.when(priority == "1-URGENT", "419").when(priority == "2-HIGH", "429").when(priority == "3-MEDIUM", "500")
        .when(priority == "4-NOT SPECIFIED", "962").alias("PROP_USE"),
        F.date_format("o_orderdate", "HHmm").alias("ALARM"),
        F.lit(None).cast("string").alias("DET_ALERT"),
        F.lit(0).cast("long").alias("FF_DEATH"),
        (price > 480000).cast("long").alias("OTH_DEATH"),
        F.lit(0).cast("long").alias("FF_INJ"),
        (price > 400000).cast("long").alias("OTH_INJ"),
        F.year("o_orderdate").cast("string").alias("year"),
    )


def fire_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """Detector facts, known for closed and pending orders only."""
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    detector = F.when(price < 150000, "N").when(price < 300000, "1").otherwise("U")
    kind = (
        F.when(priority == "1-URGENT", F.when(price < 100000, "1").when(price < 250000, "2").otherwise("5"))
        .when(price > 350000, "0")
        .when(price < 60000, "")
    )
    orders = table(spark, folder, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    return orders.select(
        *incident_key(), detector.alias("DETECTOR"), kind.alias("DET_TYPE"), F.lit(1).cast("long").alias("NUM_UNIT"),
        *[F.lit(None).cast("string").alias(c) for c in ("NOT_RES", "DET_POWER", "DET_OPERAT", "DET_EFFECT", "DET_FAIL")],
    )


PRESENCE_SQL = """
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, o_custkey, o_totalprice, c_acctbal, t.geoid,
    CASE WHEN det_type IN ('1', '5') THEN TRUE WHEN det_type IN ('2', '4', '0') OR detector = 'N' THEN FALSE END AS flag
  FROM (SELECT *, CASE WHEN o_orderstatus IN ('F', 'P') THEN
             CASE WHEN o_totalprice < 150000 THEN 'N' WHEN o_totalprice < 300000 THEN '1' ELSE 'U' END END AS detector,
           CASE WHEN o_orderstatus IN ('F', 'P') THEN
             CASE WHEN o_orderpriority = '1-URGENT' THEN
                    CASE WHEN o_totalprice < 100000 THEN '1' WHEN o_totalprice < 250000 THEN '2' ELSE '5' END
                  WHEN o_totalprice > 350000 THEN '0' WHEN o_totalprice < 60000 THEN '' END END AS det_type
        FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) o
  JOIN (""" + TRACT_SQL + """) t ON t.c_custkey = o.o_custkey
  WHERE c_acctbal >= 0 AND floor(o_totalprice / 5000) - 1 >= 0 AND floor(o_totalprice / 5000) - 1 < 21"""


def formatted_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        *incident_key(), F.col("o_orderkey").alias("row_seq"), F.col("o_orderpriority").alias("input_address")
    )


def geocoded_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Geocodes; a customer with a negative balance has a blank tract."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = orders.join(tracts(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    null_text = F.lit(None).cast("string")
    return joined.select(
        F.col("o_orderkey").alias("row_seq"),
        (F.floor(F.col("o_totalprice") / 5000) - 1).alias("rating"),
        (F.col("n_nationkey") * -1.0).alias("lon"),
        (F.col("n_regionkey") * 1.0).alias("lat"),
        F.concat("geoid", F.lit("1")).alias("tabblock_id"),
        F.substring("geoid", 1, 5).alias("county"),
        F.when(F.col("c_acctbal") >= 0, F.col("geoid")).otherwise("").alias("tractid"),
        null_text.alias("geomout"),
        F.col("c_mktsegment").alias("output_address"),
    )


def yearly_fires(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents per tract and year with the tract's population, known for positive balances only."""
    orders = table(spark, folder, "orders").filter(F.col("o_orderpriority").rlike("URGENT|HIGH|MEDIUM"))
    counted = orders.groupBy("o_custkey", F.year("o_orderdate").cast("string").alias("year")).agg(
        F.count(F.lit(1)).alias("N")
    )
    joined = counted.join(tracts(spark, folder), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.col("geoid").alias("tractid"), "year", "N", F.when(F.col("c_acctbal") > 0, F.col("population")).alias("population")
    )


YEARLY_FIRES_SQL = """
  SELECT t.geoid AS tractid, y.year, y.N, CASE WHEN t.c_acctbal > 0 THEN t.population END AS population
  FROM (SELECT o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS year, COUNT(*) AS N FROM orders
        WHERE regexp_matches(o_orderpriority, 'URGENT|HIGH|MEDIUM') GROUP BY 1, 2) y
  JOIN (""" + TRACT_SQL + """) t ON t.c_custkey = y.o_custkey"""


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Response cases: one event is one case record; quiet users are the regions."""
    e = table(spark, folder, "events")
    return e.select(
        F.concat(text("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("case_num"),
        F.nullif(F.col("event_type"), F.lit("error")).alias("esri_state"),
        F.col("event_type").alias("event"),
        F.date_format("ts", "yyyy-MM-dd").alias("incident_disaster_date"),
        text("user_id").alias("tract"),
        F.when(F.col("value") >= 5.0, F.floor("value")).alias("num_case"),
        "event_id", "user_id", "value",
    )


CASES_SQL = """
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS case_num,
         nullif(event_type, 'error') AS esri_state, event_type AS event,
         strftime(ts, '%Y-%m-%d') AS incident_disaster_date, CAST(user_id AS VARCHAR) AS tract,
         CASE WHEN value >= 5.0 THEN CAST(floor(value) AS BIGINT) END AS num_case, event_id, user_id, value
  FROM events"""
