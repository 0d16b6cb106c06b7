"""Group counts, shares, modes, profiles and row-wise means."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import CASES_SQL, TRACT_SQL, cases, table, text, tracts
from cindermap.functions.scores import capped_mean, complement_of_mean, mean_of_known, mean_strict, prior_corrected
from cindermap.functions.values import clamp, first_known, later_rule_wins, threshold_label
from cindermap.operators.aggregate import (
    collect_unique,
    distinct_keys,
    distinct_profile,
    duplicate_audit,
    first_per_key,
    frequency,
    high_missing_columns,
    missing_profile,
    mode_by,
    share_where,
    top,
    with_group_value,
    with_min_support,
)
from cindermap.operators.filters import excluding, known
from cindermap.operators.prep import near_zero_variance
from cindermap.operators.quantiles import exact_quantiles, summary_table
from cindermap.operators.rank import with_rank
from cindermap.plans import responses


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM o WHERE rn = 1""")
def first_per_incident(spark, folder):
    """W2."""
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity"
    )
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
    return first_per_key(rows, ["l_orderkey", "l_linenumber"], order).drop("l_shipdate", "l_quantity")


@query("""
SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def repeated_keys(spark, folder):
    """A13, O1."""
    return duplicate_audit(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""
SELECT esri_state, COUNT(DISTINCT case_num) AS number_cases FROM ({CASES_SQL}) GROUP BY esri_state""")
def distinct_cases(spark, folder):
    """A7, O1."""
    return responses.cases_by(cases(spark, folder), "esri_state")


@query(f"""
SELECT tract, COUNT(DISTINCT esri_state) + MAX(CASE WHEN esri_state IS NULL THEN 1 ELSE 0 END) AS n_types
FROM ({CASES_SQL}) GROUP BY tract""")
def distinct_with_missing(spark, folder):
    """A missing value is one value."""
    from cindermap.operators.aggregate import distinct_values

    return cases(spark, folder).groupBy("tract").agg(distinct_values("esri_state").alias("n_types"))


@query(f"""
SELECT tract, COUNT(DISTINCT case_num) AS number_cases FROM ({CASES_SQL}) GROUP BY tract
ORDER BY number_cases DESC, tract LIMIT 10""")
def busiest_tracts(spark, folder):
    """O2."""
    return top(responses.cases_by(cases(spark, folder), "tract"), "number_cases", ["tract"], 10)


@query(f"""
SELECT tract, incident_disaster_date,
  CASE WHEN COUNT(*) = COUNT(num_case) THEN CAST(SUM(num_case) AS BIGINT) END AS risk_indicator
FROM ({CASES_SQL}) GROUP BY tract, incident_disaster_date""")
def daily_counts(spark, folder):
    """A3 with missing values poisoning their group."""
    return responses.cases_per_day(cases(spark, folder))


@query(f"""
SELECT tract, CASE WHEN COUNT(*) = COUNT(num_case) THEN CAST(SUM(num_case) AS BIGINT) END AS risk_indicator
FROM ({CASES_SQL}) GROUP BY tract""")
def strict_totals(spark, folder):
    """A3."""
    return responses.cases_per_tract(cases(spark, folder))


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag AS v, COUNT(*) AS n FROM lineitem GROUP BY 1, 2),
d AS (SELECT l_suppkey, CAST(l_quantity AS VARCHAR) AS v, COUNT(*) AS n FROM lineitem GROUP BY 1, 2),
a AS (SELECT l_suppkey, v, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v) AS rn FROM c),
b AS (SELECT l_suppkey, v, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, v) AS rn FROM d)
SELECT a.l_suppkey, a.v AS flag, b.v AS quantity FROM a JOIN b ON a.l_suppkey = b.l_suppkey AND a.rn = 1 AND b.rn = 1""")
def mode_by_group(spark, folder):
    """A6."""
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("flag"), text("l_quantity").alias("quantity")
    )
    return mode_by(rows, "l_suppkey", ["flag", "quantity"])


@query("""
SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types
FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand""")
def types_of_brands(spark, folder):
    """A8 on a code list."""
    lists = collect_unique(table(spark, folder, "part"), "p_brand", "p_type", "types")
    return lists.withColumn("types", F.array_join("types", ","))


@query(f"""
WITH s AS (SELECT tract, COUNT(*) AS n, AVG(CASE WHEN event = 'error' THEN 1.0 ELSE 0.0 END) AS share
  FROM ({CASES_SQL}) GROUP BY tract)
SELECT tract, n, round(CAST(share AS DOUBLE), 6) AS error_share FROM s WHERE n > 30""")
def supported_shares(spark, folder):
    """W1, F7, A5."""
    kept = with_min_support(cases(spark, folder), "tract", 30)
    shares = kept.groupBy("tract").agg(F.count(F.lit(1)).alias("n"), share_where(F.col("event") == "error").alias("s"))
    return shares.select("tract", "n", F.round("s", 6).alias("error_share"))


@query(f"""
SELECT event_id, user_id, round(AVG(value) OVER (PARTITION BY user_id), 8) AS user_mean,
  COUNT(*) OVER (PARTITION BY user_id) AS user_rows FROM ({CASES_SQL})""")
def group_values(spark, folder):
    """Aggregates on every row."""
    rows = cases(spark, folder).select("event_id", "user_id", "value")
    marked = with_group_value(rows, "user_id", m=F.avg("value"), user_rows=F.count(F.lit(1)))
    return marked.select("event_id", "user_id", F.round("m", 8).alias("user_mean"), "user_rows")


_SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS statistic, COUNT({c}) AS n, round(AVG({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd,
  round(MIN({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(MAX({c}), 4) AS max FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)


@query(_SUMMARY)
def summary_statistics(spark, folder):
    """A10, A9."""
    s = summary_table(
        table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
    return s.select("statistic", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "min", "p25", "median", "p75", "max")])


_TENTHS = [i / 10 for i in range(11)]


@query(" UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(l_extendedprice, {p}), 4) AS value FROM lineitem" for p in _TENTHS
))
def deciles(spark, folder):
    """A11."""
    q = exact_quantiles(table(spark, folder, "lineitem"), ["l_extendedprice"], _TENTHS)
    return q.select("prob", F.round("value", 4).alias("value"))


@query("""
WITH c AS (SELECT nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1, 2)
SELECT priority, o_orderstatus, n, round(CAST(n AS DOUBLE) / (SELECT SUM(n) FROM c), 6) AS share FROM c""")
def contingency(spark, folder):
    """Missing values are a group."""
    rows = table(spark, folder, "orders").select(
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"), "o_orderstatus"
    )
    f = frequency(rows, ["priority", "o_orderstatus"])
    return f.withColumn("share", F.round("share", 6))


def _gappy(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_retailprice") > 920, F.col("p_retailprice")).alias("price"),
        F.when(F.col("p_size") > 2, F.col("p_size")).alias("size"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("kind"),
    )


_GAPPY_SQL = """SELECT p_partkey, CASE WHEN p_retailprice > 920 THEN p_retailprice END AS price,
  CASE WHEN p_size > 2 THEN p_size END AS size, nullif(p_type, 'ECONOMY') AS kind FROM part"""


@query(f"""
WITH g AS ({_GAPPY_SQL}), m AS (
  SELECT 'price' AS "column", COUNT(*) - COUNT(price) AS n_missing, COUNT(*) AS n FROM g
  UNION ALL SELECT 'size', COUNT(*) - COUNT(size), COUNT(*) FROM g
  UNION ALL SELECT 'kind', COUNT(*) - COUNT(kind), COUNT(*) FROM g)
SELECT "column", n_missing, round(CAST(n_missing AS DOUBLE) / n, 6) AS share_missing,
  CAST(n_missing AS DOUBLE) / n > 0.05 AS too_sparse FROM m""")
def missing_values(spark, folder):
    """A17, I4."""
    g = _gappy(spark, folder)
    sparse = high_missing_columns(g, ["price", "size", "kind"])
    p = missing_profile(g, ["price", "size", "kind"])
    return p.select("column", "n_missing", F.round("share_missing", 6).alias("share_missing"),
                    F.col("column").isin(sparse).alias("too_sparse") if sparse else F.lit(False).alias("too_sparse"))


@query("""
SELECT 'p_brand' AS "column", COUNT(DISTINCT p_brand) AS n_distinct FROM part
UNION ALL SELECT 'p_type', COUNT(DISTINCT p_type) FROM part
UNION ALL SELECT 'p_size', COUNT(DISTINCT p_size) FROM part""")
def distinct_counts(spark, folder):
    """A18."""
    return distinct_profile(table(spark, folder, "part"), ["p_brand", "p_type", "p_size"])


_NZV = " UNION ALL ".join(f"""
SELECT '{n}' AS "column", COUNT(*) AS n_distinct, CAST(SUM(n) AS BIGINT) AS n_rows, MAX(n) AS top,
  (SELECT n FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY {e} ORDER BY n DESC LIMIT 1 OFFSET 1)) AS second
FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY {e})""" for n, e in (
    ("rare", "l_extendedprice > 104900"), ("flag", "l_returnflag"), ("tax", "l_tax"), ("one", "l_quantity > 0")))


@query(f"""
SELECT "column", round(COALESCE(CAST(top AS DOUBLE) / second, 0.0), 6) AS freq_ratio,
  round(100.0 * n_distinct / CAST(n_rows AS DOUBLE), 6) AS percent_unique, n_distinct <= 1 AS zero_var,
  n_distinct <= 1 OR (COALESCE(CAST(top AS DOUBLE) / second, 0.0) > 19 AND 100.0 * n_distinct / CAST(n_rows AS DOUBLE) <= 10) AS nzv
FROM ({_NZV})""")
def near_zero_var(spark, folder):
    """I3."""
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_extendedprice") > 104900).alias("rare"), F.col("l_returnflag").alias("flag"),
        F.col("l_tax").alias("tax"), (F.col("l_quantity") > 0).alias("one"),
    )
    t = near_zero_variance(rows, ["rare", "flag", "tax", "one"])
    return t.select("column", F.round("freq_ratio", 6).alias("freq_ratio"),
                    F.round("percent_unique", 6).alias("percent_unique"), "zero_var", "nzv")


@query("""
SELECT c_custkey,
  CASE WHEN c_acctbal >= 0 THEN round(c_acctbal / 100, 6) END AS a,
  round((CASE WHEN c_acctbal >= 0 THEN c_acctbal / 100 ELSE 0 END + c_nationkey)
    / CAST(CASE WHEN c_acctbal >= 0 THEN 2 ELSE 1 END AS DOUBLE), 6) AS known_mean,
  CASE WHEN c_acctbal >= 0 THEN round((c_acctbal / 100 + c_nationkey) / 2, 6) END AS strict_mean,
  CASE WHEN c_acctbal >= 0 THEN round(least((c_acctbal / 100 + c_nationkey) / 2, 30), 6) END AS capped,
  CASE WHEN c_acctbal >= 0 THEN round(1 - (c_acctbal / 100 + c_nationkey) / 2, 6) END AS complement,
  CASE WHEN c_acctbal >= 0 THEN round(greatest(least(c_acctbal / 100, 40), 5), 6) END AS bounded,
  CASE WHEN c_acctbal >= 0 THEN CASE WHEN c_acctbal / 100 > 50 THEN 'other' ELSE 'event' END END AS label,
  CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE CAST(c_nationkey AS BIGINT) END AS fallback,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'c' WHEN c_acctbal > 5000 THEN 'b' WHEN c_acctbal > 0 THEN 'a' ELSE 'none' END AS rule
FROM customer""")
def row_scores(spark, folder):
    """A15, A16, X10, X11, P7-P10."""
    c = table(spark, folder, "customer")
    a = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 100)
    b = F.col("c_nationkey")
    bal = F.col("c_acctbal")
    return c.select(
        "c_custkey",
        F.round(a, 6).alias("a"),
        F.round(mean_of_known(a, b), 6).alias("known_mean"),
        F.round(mean_strict(a, b), 6).alias("strict_mean"),
        F.round(capped_mean(a, b, upper=30.0), 6).alias("capped"),
        F.round(complement_of_mean(a, b), 6).alias("complement"),
        F.round(clamp(a, 5.0, 40.0), 6).alias("bounded"),
        threshold_label(a, "other", "event", 50.0).alias("label"),
        first_known(F.when(bal >= 0, F.floor(bal)), b.cast("long")).alias("fallback"),
        later_rule_wins([(bal > 0, "a"), (bal > 5000, "b"), (F.col("c_mktsegment") == "MACHINERY", "c")], "none").alias("rule"),
    )


@query("""
WITH p AS (SELECT AVG(CASE WHEN toxic <> 0 THEN 1.0 ELSE 0.0 END) AS prior FROM labels)
SELECT quality, toxic, COUNT(*) AS n, round(CAST(MIN(prior) AS DOUBLE), 6) AS prior,
  round(CAST(0.4 * MIN(prior) / 0.5 AS DOUBLE), 6) AS corrected
FROM labels, p GROUP BY quality, toxic""")
def class_priors(spark, folder):
    """A19, X9."""
    rows = table(spark, folder, "labels")
    prior = rows.agg(share_where(F.col("toxic") != 0)).scalar()
    counted = rows.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n")).withColumn("p", prior)
    return counted.select(
        "quality", "toxic", "n", F.round("p", 6).alias("prior"),
        F.round(prior_corrected(F.lit(0.4), F.col("p")), 6).alias("corrected"),
    )


@query(f"""
WITH c AS (SELECT esri_state, COUNT(DISTINCT case_num) AS number_cases FROM ({CASES_SQL})
  WHERE esri_state IS NOT NULL AND esri_state <> '' GROUP BY esri_state)
SELECT esri_state, number_cases, row_number() OVER (ORDER BY number_cases, esri_state) AS position FROM c""")
def category_rank(spark, folder):
    """O3, F3."""
    return responses.state_order(cases(spark, folder))


@query(f"""
SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'
UNION SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""")
def distinct_union(spark, folder):
    """U1, U2."""
    o = table(spark, folder, "orders")
    first = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    second = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return distinct_keys(first, second)


@query(f"""
SELECT geoid, population, row_number() OVER (ORDER BY population DESC, geoid) AS place
FROM ({TRACT_SQL}) WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE')""")
def ranked_tracts(spark, folder):
    """O1, O3, F10."""
    kept = excluding(tracts(spark, folder), "c_mktsegment", ["MACHINERY", "FURNITURE"]).filter(known("geoid"))
    return with_rank(kept.select("geoid", "population"), [F.desc("population"), "geoid"], "place")
