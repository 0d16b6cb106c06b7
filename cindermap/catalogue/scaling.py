"""Scaled scores, rates and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.counts import _GAPPY_SQL, _gappy
from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import TRACT_SQL, YEARLY_FIRES_SQL, table, tracts, yearly_fires
from cindermap.operators.prep import center_scale, central_impute, l1_weights, mean_impute, scaled_weights
from cindermap.operators.scale import balscale, normalize, scale_comparison, zscore
from cindermap.plans.risk_table import fire_indicator, response_indicator

BALSCALE = "1.0 / (1.0 + exp(-(({x}) - m) / s)) * {a} + (({x}) - lo) / (hi - lo) * {b}"
STATS = "MIN({x}) AS lo, MAX({x}) AS hi, AVG({x}) AS m, stddev_samp({x}) AS s"


@query(f"""
WITH k AS (SELECT {STATS.format(x='c_acctbal')} FROM customer)
SELECT c_custkey, round((c_acctbal - lo) / (hi - lo), 6) AS normalized, round((c_acctbal - m) / s, 6) AS z,
  round(100 * ({BALSCALE.format(x='c_acctbal', a=0.75, b=0.25)}), 6) AS balanced,
  round({BALSCALE.format(x='c_acctbal', a=0.85, b=0.15)}, 6) AS explored
FROM customer, k""")
def balscale_all(spark, folder):
    """X1-X4."""
    c = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    out = zscore(normalize(c, "c_acctbal", "normalized"), "c_acctbal", "z")
    out = balscale(out, "c_acctbal", "balanced")
    out = balscale(out, "c_acctbal", "explored", 0.85, 0.15, factor=1.0)
    return out.select("c_custkey", *[F.round(x, 6).alias(x) for x in ("normalized", "z", "balanced", "explored")])


@query(f"""
WITH y AS ({YEARLY_FIRES_SQL}), t AS ({TRACT_SQL}),
r AS (SELECT t.geoid AS tract_geoid, CAST(COALESCE(SUM(y.N), 0) AS BIGINT) AS N,
    COALESCE(MAX(CASE WHEN y.year = '1996' THEN y.population END), MIN(t.population), 0) AS population
  FROM t LEFT JOIN y ON y.tractid = t.geoid GROUP BY t.geoid),
q AS (SELECT *, N / (population + 1.0::DOUBLE) * 1000 AS rate FROM r),
k AS (SELECT {STATS.format(x='rate')} FROM q WHERE population > 200)
SELECT tract_geoid, N, population, round(rate, 6) AS rate,
  CASE WHEN population > 200 THEN round(100 * ({BALSCALE.format(x='rate', a=0.75, b=0.25)}), 6) END AS risk_2a
FROM q, k""")
def scoped_balscale(spark, folder):
    """Scores and their statistics cover tracts above the population limit only."""
    t = tracts(spark, folder).select(F.col("geoid").alias("tract_geoid"), F.col("population").alias("P0010001"))
    out = fire_indicator(yearly_fires(spark, folder), t, t, "1996")
    return out.select("tract_geoid", "N", "population", F.round("rate", 6).alias("rate"), F.round("risk_2a", 6).alias("risk_2a"))


@query(f"""
WITH t AS ({TRACT_SQL}), f AS (SELECT user_id, COUNT(*) AS freq FROM events GROUP BY 1),
q AS (SELECT geoid, COALESCE(freq, 0) AS freq, population,
    COALESCE(freq, 0) / (population + 100.0::DOUBLE) * 1000 * ln(population + 1.0::DOUBLE) AS rate
  FROM t LEFT JOIN f ON user_id = c_custkey),
k AS (SELECT {STATS.format(x='rate')} FROM q WHERE population > 200)
SELECT geoid AS tract_geoid, freq, population, round(rate, 6) AS rate,
  CASE WHEN population > 200 THEN round(100 * ({BALSCALE.format(x='rate', a=0.75, b=0.25)}), 6) END AS risk_2c
FROM q, k""")
def damped_rates(spark, folder):
    """X8, X5."""
    t = tracts(spark, folder)
    freq = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("freq"))
    fires = freq.join(t, F.col("user_id") == F.col("c_custkey")).select(F.col("geoid").alias("x"), "freq")
    pop = t.select(F.col("geoid").alias("tract_geoid"), F.col("population").alias("P0010001"))
    out = response_indicator(fires, pop)
    return out.select("tract_geoid", "freq", "population", F.round("rate", 6).alias("rate"), F.round("risk_2c", 6).alias("risk_2c"))


_PROBS = [i / 10 for i in range(11)]
_NORM = "(c_acctbal - lo) / (hi - lo)"


@query(f"""
WITH k AS (SELECT {STATS.format(x='c_acctbal')} FROM customer),
v AS (SELECT c_acctbal AS raw, {_NORM} AS normalized, {BALSCALE.format(x='c_acctbal', a=0.85, b=0.15)} AS scaled FROM customer, k)
""" + " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(raw, {p}), 5) AS raw, "
    f"round(quantile_cont(normalized, {p}), 5) AS normalized, round(quantile_cont(scaled, {p}), 5) AS scaled FROM v"
    for p in _PROBS
))
def scaled_quantiles(spark, folder):
    """X13."""
    t = scale_comparison(table(spark, folder, "customer"), "c_acctbal", _PROBS)
    return t.select("prob", *[F.round(c, 5).alias(c) for c in ("raw", "normalized", "scaled")])


@query(f"""
WITH g AS ({_GAPPY_SQL}), m AS (SELECT median(price) AS mp, median(size) AS ms FROM g),
k AS (SELECT kind AS mk FROM g WHERE kind IS NOT NULL GROUP BY kind ORDER BY COUNT(*) DESC, kind LIMIT 1)
SELECT p_partkey, COALESCE(price, mp) AS price, COALESCE(CAST(size AS DOUBLE), ms) AS size, COALESCE(kind, mk) AS kind FROM g, m, k""")
def central_imputation(spark, folder):
    """Medians and modes."""
    return central_impute(_gappy(spark, folder), ["price", "size"], ["kind"])


@query(f"""
WITH g AS ({_GAPPY_SQL}), m AS (SELECT AVG(price) AS mp, AVG(size) AS ms FROM g)
SELECT p_partkey, round(COALESCE(price, mp), 6) AS price, round(COALESCE(CAST(size AS DOUBLE), ms), 6) AS size FROM g, m""")
def mean_imputation(spark, folder):
    """I1."""
    filled = mean_impute(_gappy(spark, folder), ["price", "size"])
    return filled.select("p_partkey", F.round("price", 6).alias("price"), F.round("size", 6).alias("size"))


@query("""
WITH f AS (SELECT o_custkey, COUNT(*) AS n, AVG(o_totalprice) AS p FROM orders GROUP BY 1),
m AS (SELECT MAX(n) AS top, SUM(n) AS total, AVG(p) AS mp, stddev_samp(p) AS sp FROM f)
SELECT o_custkey, round(CAST(n AS DOUBLE) / top, 6) AS weight, round(CAST(n AS DOUBLE) / total, 8) AS l1, round((p - mp) / sp, 6) AS p FROM f, m""")
def observation_weights(spark, folder):
    """I6, I5."""
    f = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("p"))
    w = center_scale(l1_weights(scaled_weights(f, "n"), "n", "l1"), ["p"])
    return w.select("o_custkey", F.round("weight", 6).alias("weight"), F.round("l1", 8).alias("l1"), F.round("p", 6).alias("p"))
