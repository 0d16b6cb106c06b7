"""Join semantics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import TRACT_SQL, YEARLY_FIRES_SQL, table, text, tracts, yearly_fires
from cindermap.functions.scores import stabilized_rate
from cindermap.functions.values import first_known
from cindermap.operators.filters import share_passing
from cindermap.operators.relate import keyed_join, keyed_lookup, lookup_first, match_audit, skew_join
from cindermap.plans.incidents import residential_by_tract


@query("""
WITH a AS (SELECT nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority, COUNT(*) AS n
  FROM orders GROUP BY 1, 2),
b AS (SELECT nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority, MAX(o_totalprice) AS top
  FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'O' GROUP BY 1, 2)
SELECT a.status, a.priority, n, top FROM a LEFT JOIN b
  ON a.status IS NOT DISTINCT FROM b.status AND a.priority IS NOT DISTINCT FROM b.priority""")
def nullsafe_join(spark, folder):
    """Missing key parts match each other."""
    o = table(spark, folder, "orders").select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"),
        "o_totalprice", F.col("o_orderstatus").alias("raw"),
    )
    a = o.groupBy("status", "priority").agg(F.count(F.lit(1)).alias("n"))
    b = o.filter("o_totalprice > 300000 AND raw <> 'O'").groupBy("status", "priority").agg(F.max("o_totalprice").alias("top"))
    return keyed_join(a, b, ["status", "priority"], "left", null_safe=True)


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice, o_totalprice FROM lineitem
LEFT JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O') ON l_orderkey = o_orderkey""")
def left_lookup(spark, folder):
    """Every detail with its incident; details of unknown incidents stay."""
    x = table(spark, folder, "orders").filter("o_orderstatus <> 'O'").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_totalprice"
    )
    y = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return keyed_lookup(x, y, "l_orderkey", null_safe=False)


@query("""
SELECT l_returnflag, l_linestatus, COUNT(*) AS n, round(SUM(l_quantity / mean_quantity), 2) AS relative
FROM lineitem JOIN (SELECT l_returnflag AS f, AVG(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1) ON l_returnflag = f
GROUP BY 1, 2""")
def skewed_join(spark, folder):
    """J3 with keys that each hold a large share of the rows."""
    l = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey")
    m = l.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("mean_quantity"))
    joined = skew_join(l, m, "l_returnflag", "inner")
    return joined.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity") / F.col("mean_quantity")), 2).alias("relative")
    )


_RELATION_SQL = """SELECT s_suppkey, g.step AS step FROM supplier,
  (SELECT 0 AS step UNION ALL SELECT 1 UNION ALL SELECT 2) g
  WHERE s_acctbal >= 0 AND (g.step = 0 OR (g.step = 1 AND s_acctbal >= 3000) OR (g.step = 2 AND s_acctbal >= 6000))"""


def _zip_relation(spark, folder):
    """Supplier = ZIP code on one to three tracts by its balance; a negative balance is on none."""
    steps = F.when(F.col("s_acctbal") >= 6000, 3).when(F.col("s_acctbal") >= 3000, 2).otherwise(1)
    s = table(spark, folder, "supplier").filter("s_acctbal >= 0")
    return s.select("s_suppkey", F.explode(F.sequence(F.lit(0), steps - 1)).alias("step"))


@query(f"""
SELECT l_suppkey, step, COUNT(*) AS n, round(SUM(l_extendedprice), 2) AS price
FROM lineitem LEFT JOIN ({_RELATION_SQL}) r ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def many_to_many(spark, folder):
    """Every tract of a ZIP code, ZIP codes on no tract kept."""
    l = table(spark, folder, "lineitem").select("l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber")
    r = _zip_relation(spark, folder).withColumnRenamed("s_suppkey", "l_suppkey")
    joined = skew_join(l, r, "l_suppkey", "left")
    return joined.groupBy("l_suppkey", "step").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(f"""
WITH z AS (SELECT CAST(s_suppkey AS VARCHAR) AS zip, CAST(s_suppkey AS VARCHAR) || '-' || CAST(step AS VARCHAR) AS geoid
  FROM ({_RELATION_SQL})),
k AS (SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS zip FROM lineitem),
b AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'NN' WHEN 'O' THEN '40' ELSE '00' END AS mixed,
  CASE o_orderpriority WHEN '1-URGENT' THEN '419' WHEN '2-HIGH' THEN '429' WHEN '3-MEDIUM' THEN '500'
    WHEN '4-NOT SPECIFIED' THEN '962' END AS prop FROM orders)
SELECT geoid, COUNT(*) AS n, CAST(SUM(CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END) AS BIGINT) AS injured
FROM b LEFT JOIN k ON l_orderkey = o_orderkey LEFT JOIN z ON z.zip = k.zip
WHERE mixed IN ('40', '58') OR (mixed IN ('NN', '00') AND prop IN ('400', '419', '429', '439', '449', '459', '460', '462', '464'))
GROUP BY geoid""")
def residential_by_tract_counts(spark, folder):
    """Residential incidents over all tracts of their ZIP codes, per tract."""
    from cindermap.catalogue.standins import basic_incidents, incident_key

    basic = basic_incidents(spark, folder)
    orders = table(spark, folder, "orders")
    zips = table(spark, folder, "lineitem").select("l_orderkey", text("l_suppkey").alias("ZIP5")).distinct()
    address = orders.join(zips, F.col("o_orderkey") == F.col("l_orderkey")).select(*incident_key(), "ZIP5")
    tract = F.concat_ws("-", text("s_suppkey"), text("step"))
    relation = _zip_relation(spark, folder).select(
        text("s_suppkey").alias("zcta5"), F.lit("00").alias("state"), F.lit("000").alias("county"),
        text("step").alias("tract"), tract.alias("geoid"),
    )
    placed = residential_by_tract(basic, address, relation)
    return placed.groupBy("geoid").agg(F.count(F.lit(1)).alias("n"), F.sum("OTH_INJ").alias("injured"))


@query("""
SELECT COUNT(*) AS n_rows, CAST(SUM(CASE WHEN p_partkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unmatched,
  round(AVG(CASE WHEN p_partkey IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS unmatched_share
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY') ON l_partkey = p_partkey""")
def unmatched_audit(spark, folder):
    """J10."""
    parts = table(spark, folder, "part").filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    a = match_audit(table(spark, folder, "lineitem").select("l_partkey"), parts, "l_partkey")
    return a.withColumn("unmatched_share", F.round("unmatched_share", 6))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY')""")
def unmatched_rows(spark, folder):
    """The rows themselves, hot keys spread."""
    parts = table(spark, folder, "part").filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"))
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return skew_join(l, parts, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""
SELECT n_nationkey, n_name, s_name, s_acctbal FROM nation LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) s
  ON s_nationkey = n_nationkey AND rn = 1""")
def lookup_first_match(spark, folder):
    """The first supplier of each nation."""
    s = table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return lookup_first(n, s, "n_nationkey", ["s_acctbal", "s_suppkey"], ["s_name", "s_acctbal"])


@query("""
WITH a AS (SELECT o_custkey, COUNT(*) AS n_closed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey, COUNT(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT o_custkey, n_closed, n_urgent FROM a FULL JOIN b USING (o_custkey)""")
def full_outer(spark, folder):
    """Keys of either side, coalesced."""
    o = table(spark, folder, "orders")
    closed = o.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_closed"))
    urgent = o.filter("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_urgent"))
    return keyed_join(closed, urgent, "o_custkey", "full")


_YEARS = [str(y) for y in range(1995, 2002)]


@query(f"""
WITH y AS ({YEARLY_FIRES_SQL}), t AS ({TRACT_SQL})
SELECT t.geoid AS tract_geoid,
  {', '.join(f"CAST(SUM(CASE WHEN y.year = '{y}' THEN y.N ELSE 0 END) AS BIGINT) AS n_{y}" for y in _YEARS)},
  CAST(COALESCE(SUM(y.N), 0) AS BIGINT) AS n_all,
  COALESCE(MAX(CASE WHEN y.year = '1995' THEN y.population END), MIN(t.population), 0) AS population,
  round(COALESCE(SUM(y.N), 0) * 1000.0::DOUBLE /
    (COALESCE(MAX(CASE WHEN y.year = '1995' THEN y.population END), MIN(t.population), 0) + 1), 6) AS rate
FROM t LEFT JOIN y ON y.tractid = t.geoid GROUP BY t.geoid""")
def multi_year_outer(spark, folder):
    """Yearly counts side by side with zero fill; one grouping stands for the chain of full joins."""
    fires = yearly_fires(spark, folder).withColumnRenamed("tractid", "tract_geoid")
    census = tracts(spark, folder).select(F.col("geoid").alias("tract_geoid"), F.col("population").alias("census"))
    rows = fires.unionByName(census, allowMissingColumns=True)
    def of_year(y):
        return F.coalesce(F.sum(F.when(F.col("year") == y, F.col("N"))), F.lit(0)).alias(f"n_{y}")

    wide = rows.groupBy("tract_geoid").agg(
        *[of_year(y) for y in _YEARS],
        F.coalesce(F.sum("N"), F.lit(0)).alias("n_all"),
        first_known(F.max(F.when(F.col("year") == "1995", F.col("population"))), F.max("census"), default=0).alias("population"),
    )
    return wide.withColumn("rate", F.round(stabilized_rate("n_all", "population"), 6))


@query("""
SELECT o_orderstatus, round(AVG(CASE WHEN o_totalprice BETWEEN 0 AND 150000 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS low_share
FROM orders GROUP BY o_orderstatus""")
def passing_share(spark, folder):
    """F11."""
    o = table(spark, folder, "orders")
    s = o.groupBy("o_orderstatus").agg(share_passing(F.col("o_totalprice").between(0, 150000)).alias("s"))
    return s.select("o_orderstatus", F.round("s", 6).alias("low_share"))
