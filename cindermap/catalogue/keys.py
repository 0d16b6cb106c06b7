"""Keys, text cleaning and column sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import TRACT_SQL, table, text, tracts
from cindermap.functions import keys as K
from cindermap.functions.values import blank_to_null, blank_to_null_all, number_from_text, strip_ticks
from cindermap.operators.aggregate import counts_by
from cindermap.operators.columns import columns_between, drop_matching, drop_repeated_columns, rename, standardize_names, tag
from cindermap.operators.filters import complete_cases, containing, home_fire, where_equal


@query(f"""
SELECT geoid, '14000US' || geoid AS full_id, substring(geoid, 1, 2) AS state, substring(geoid, 3, 3) AS cnty,
  substring(geoid, 6, 6) AS tract, substring(geoid, 1, 5) AS fips, substring(geoid, length(geoid) - 3, 4) AS tail,
  substring(geoid, 1, length(geoid) - 4) AS head, '14000' AS level, geoid AS id,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS padded,
  CASE WHEN length(CAST(c_custkey + 100 AS VARCHAR)) = 3 THEN '0' || CAST(c_custkey + 100 AS VARCHAR) ELSE CAST(c_custkey + 100 AS VARCHAR) END AS restored
FROM ({TRACT_SQL})""")
def pad_and_slice(spark, folder):
    """K1-K6."""
    t = tracts(spark, folder).withColumn("full_id", K.prefixed("14000US", "geoid"))
    return t.select(
        "geoid", "full_id", K.state_of("geoid").alias("state"), K.county_of("geoid").alias("cnty"),
        K.tract_of("geoid").alias("tract"), K.county_fips_of("geoid").alias("fips"),
        K.take_right("geoid", 4).alias("tail"), K.drop_right("geoid", 4).alias("head"),
        K.summary_level("full_id").alias("level"), K.summary_id("full_id").alias("id"),
        K.pad_left("c_custkey", 3).alias("padded"),
        K.restore_leading_zero(text_of(F.col("c_custkey") + 100), 3).alias("restored"),
    )


def text_of(c):
    return c.cast("string")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE) END AS price,
  o_orderpriority AS ticked, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS status FROM orders""")
def number_cleanup(spark, folder):
    """K7-K9: numbers stored with thousands separators, ticks and blanks."""
    whole = F.format_number(F.floor("o_totalprice"), 0)
    raw = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", ".").otherwise(F.concat(F.lit('"'), whole, F.lit('"'))).alias("price"),
        F.concat(F.lit("'"), "o_orderpriority", F.lit("'")).alias("ticked"),
        F.when(F.col("o_orderstatus") == "O", "  ").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    return blank_to_null_all(raw).select(
        "o_orderkey", number_from_text("price").alias("price"), strip_ticks("ticked").alias("ticked"),
        blank_to_null("status").alias("status"),
    )


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_totalprice < 20000 THEN 'error'
  ELSE '55' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(9, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') END AS block FROM orders""")
def payload_extract(spark, folder):
    """Ids out of XML answers; broken and empty answers are tagged."""
    code = F.concat(F.lit("55"), K.pad_left("o_custkey", 9))
    good = K.formatted('<Response status="OK"><Block FIPS="%s"/><County name="x"/></Response>', code)
    xml = F.when(F.col("o_orderstatus") == "P", F.lit("Service <unavailable")).when(
        F.col("o_totalprice") < 20000, F.lit("<Response/>")
    ).otherwise(good)
    answers = table(spark, folder, "orders").select("o_orderkey", xml.alias("xml"))
    return answers.select("o_orderkey", K.payload_value("xml", ["Block", "_FIPS"]).alias("block"))


@query("""
SELECT o_orderkey, o_totalprice, CAST('1995' AS VARCHAR) AS data_year FROM orders
WHERE regexp_matches(o_orderpriority, 'HIGH|URG') AND o_orderstatus = 'F'""")
def text_filters(spark, folder):
    """F5, F8, P4, P6."""
    o = containing(table(spark, folder, "orders"), "o_orderpriority", "HIGH|URG")
    kept = rename(where_equal(o, "o_orderstatus", "F"), {"o_totalprice": "price"})
    return tag(kept.select("o_orderkey", F.col("price").alias("o_totalprice")), "data_year", "1995")


@query("""
SELECT event_type, COUNT(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY event_type""")
def coded_events(spark, folder):
    """F2, A1."""
    kept = table(spark, folder, "events").filter(home_fire("event_type", ["error", "purchase"]))
    return counts_by(kept, "event_type")


@query("""
SELECT p_partkey, p_retailprice, p_size FROM part WHERE p_retailprice > 920 AND p_type <> 'ECONOMY'""")
def complete_rows(spark, folder):
    """NULL and NaN are both missing."""
    price = F.when(F.col("p_retailprice") > 920, F.col("p_retailprice")).otherwise(F.lit(float("nan")))
    rows = table(spark, folder, "part").select(
        "p_partkey", price.alias("p_retailprice"), "p_size", F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("kind")
    )
    return complete_cases(rows, ["p_retailprice", "kind"]).drop("kind")


@query("""
SELECT l_orderkey AS line_order_key, l_linenumber AS line_number, l_quantity AS quantity FROM lineitem""")
def tidy_columns(spark, folder):
    """Standard names, first of repeated columns, ranges and prefixes."""
    l = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("Line..Order.Key"), F.col("l_linenumber").alias("Line Number"),
        F.col("l_quantity").alias("Quantity"), F.col("l_tax").alias("Quantity"), F.col("l_discount").alias("base.rate"),
        F.col("l_partkey").alias("Part"), F.col("l_suppkey").alias("Supplier"),
    )
    tidy = standardize_names(drop_repeated_columns(l))
    return drop_matching(tidy, columns_between(tidy, "part", "supplier"), ["base"])


@query(f"""
WITH g AS (SELECT '05000US' || substring(geoid, 1, 5) AS id, population FROM ({TRACT_SQL})
  UNION ALL SELECT '14000US' || geoid, population FROM ({TRACT_SQL}))
SELECT split_part(id, 'US', 2) AS id, COUNT(*) AS n, CAST(SUM(population) AS BIGINT) AS population
FROM g WHERE split_part(id, 'US', 1) = '05000' GROUP BY 1""")
def level_split(spark, folder):
    """County rows out of a table that mixes levels."""
    t = tracts(spark, folder).select("geoid", "population")
    both = t.select(K.prefixed("05000US", K.county_fips_of("geoid")).alias("full_id"), "population").unionByName(
        t.select(K.prefixed("14000US", "geoid").alias("full_id"), "population")
    )
    county = where_equal(both.withColumn("level", K.summary_level("full_id")), "level", K.COUNTY_LEVEL)
    return county.groupBy(K.summary_id("full_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("population").alias("population")
    )
