"""Incident jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import (
    CASES_SQL,
    INC_TYPE_SQL,
    PRESENCE_SQL,
    TRACT_SQL,
    basic_incidents,
    cases,
    fire_incidents,
    formatted_addresses,
    geocoded_addresses,
    table,
    tracts,
)
from cindermap.plans import alarms, responses
from cindermap.plans.casualty import binary_target, casualty_target
from cindermap.plans.fire_rate import building_fire_rate
from cindermap.plans.incidents import blend, geocoded_outcomes


def _tables(spark, folder):
    return (
        basic_incidents(spark, folder), fire_incidents(spark, folder),
        formatted_addresses(spark, folder), geocoded_addresses(spark, folder),
    )


@query(f"""
WITH t AS ({TRACT_SQL}), o AS (SELECT *, {INC_TYPE_SQL} AS inc_type FROM orders)
SELECT geoid AS tractid, '1400000US' || geoid AS id, COUNT(*) AS "N", population, round(COUNT(*) * 1000.0::DOUBLE / population, 6) AS fire_per_1000
FROM o JOIN t ON o_custkey = c_custkey WHERE regexp_matches(inc_type, '111') AND c_acctbal >= 0 AND population > 100
GROUP BY geoid, population""")
def fires_per_1k(spark, folder):
    """PL-2A: F5, J4, A1, J3, X6, K3, F7."""
    basic, _, formatted, geocoded = _tables(spark, folder)
    pop = tracts(spark, folder).select(F.col("geoid").alias("tractid"), "population")
    out = building_fire_rate(basic, formatted, geocoded, pop)
    return out.withColumn("fire_per_1000", F.round("fire_per_1000", 6))


_RATIOS = """round(CAST({f} AS DOUBLE) / {a}, 6) AS ratio_no_alarm_in_all,
  round(CAST({f} AS DOUBLE) / nullif({t} + {f}, 0), 6) AS ratio_no_alarm_in_all_known"""


@query(f"""
WITH p AS ({PRESENCE_SQL}),
c AS (SELECT geoid AS tractid, COUNT(*) AS all_fire, COUNT(*) - COUNT(flag) AS alarm_unknown,
  CAST(SUM(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS alarm_presented,
  CAST(SUM(CASE WHEN NOT flag THEN 1 ELSE 0 END) AS BIGINT) AS alarm_not_presented FROM p GROUP BY geoid)
SELECT *, {_RATIOS.format(f='alarm_not_presented', t='alarm_presented', a='all_fire')} FROM c""")
def presence_counts(spark, folder):
    """PL-1B-T: F5, J4, P11, J3, F6, A2, A14."""
    basic, fire, formatted, geocoded = _tables(spark, folder)
    out = alarms.with_ratios(alarms.presence_counts(basic, fire, formatted, geocoded))
    return out.withColumns({c: F.round(c, 6) for c in ("ratio_no_alarm_in_all", "ratio_no_alarm_in_all_known")})


@query(f"""
WITH p AS ({PRESENCE_SQL}),
c AS (SELECT geoid AS tractid, year, COUNT(*) AS all_fire, COUNT(*) - COUNT(flag) AS alarm_unknown,
  CAST(SUM(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS alarm_presented,
  CAST(SUM(CASE WHEN NOT flag THEN 1 ELSE 0 END) AS BIGINT) AS alarm_not_presented FROM p GROUP BY geoid, year)
SELECT *, {_RATIOS.format(f='alarm_not_presented', t='alarm_presented', a='all_fire')} FROM c""")
def presence_by_year(spark, folder):
    """PL-1B-T per year, all years in one plan."""
    out = alarms.with_ratios(alarms.presence_counts(*_tables(spark, folder), by=["year"]))
    return out.withColumns({c: F.round(c, 6) for c in ("ratio_no_alarm_in_all", "ratio_no_alarm_in_all_known")})


@query(f"""
WITH p AS ({PRESENCE_SQL}),
c AS (SELECT geoid AS tractid, COUNT(*) AS all_fire_all_years, COUNT(*) - COUNT(flag) AS alarm_unknown_all_years,
  CAST(SUM(CASE WHEN flag THEN 1 ELSE 0 END) AS BIGINT) AS alarm_presented_all_years,
  CAST(SUM(CASE WHEN NOT flag THEN 1 ELSE 0 END) AS BIGINT) AS alarm_not_presented_all_years FROM p GROUP BY geoid)
SELECT *, {_RATIOS.format(f='alarm_not_presented_all_years', t='alarm_presented_all_years', a='all_fire_all_years')} FROM c""")
def presence_all_years(spark, folder):
    """PL-1B-T over years: U1, A20, A14."""
    yearly = alarms.presence_counts(*_tables(spark, folder), by=["year"])
    out = alarms.presence_totals(yearly)
    return out.withColumns({c: F.round(c, 6) for c in ("ratio_no_alarm_in_all", "ratio_no_alarm_in_all_known")})


def _blend_tables(spark, folder):
    """Incident details as incidents; some states are missing, returned items are the fire incidents."""
    l = table(spark, folder, "lineitem")
    key = [
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("STATE"), F.col("l_suppkey").cast("string").alias("FDID"),
        F.date_format("l_shipdate", "MMddyyyy").alias("INC_DATE"), F.col("l_orderkey").cast("string").alias("INC_NO"),
        F.concat_ws("-", "l_linenumber", "l_partkey").alias("EXP_NO"),
    ]

    def none(*names):
        return [F.lit(None).cast("string").alias(n) for n in names]

    o = table(spark, folder, "orders")
    known = l.join(o.filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return {
        "basic": l.select(*key, F.col("l_returnflag").alias("INC_TYPE"), F.col("l_quantity").cast("long").alias("OTH_DEATH"),
                          F.lit(0).cast("long").alias("FF_DEATH"), *none("ALARM", "DET_ALERT")),
        "address": l.filter("l_tax < 0.05").select(*key, F.col("l_linestatus").alias("CITY"), F.col("l_partkey").cast("string").alias("ZIP5")),
        "fire": l.filter("l_returnflag <> 'N'").select(
            *key, F.year("l_shipdate").cast("string").alias("year"), F.lit(1).cast("long").alias("NUM_UNIT"), F.col("l_returnflag").alias("DETECTOR"),
            *none("NOT_RES", "DET_TYPE", "DET_POWER", "DET_OPERAT", "DET_EFFECT", "DET_FAIL")),
        "formatted": known.select(*key, F.col("l_orderkey").alias("row_seq"), F.col("l_linestatus").alias("input_address")),
        "geocoded": geocoded_addresses(spark, folder),
    }


_BLEND_SQL = """
WITH l AS (SELECT *, nullif(l_linestatus, 'O') AS st, strftime(l_shipdate, '%m%d%Y') AS dt,
    l_linenumber || '-' || l_partkey AS ex FROM lineitem),
key AS (SELECT DISTINCT st, l_suppkey, dt, l_orderkey, ex FROM l),
f AS (SELECT st, l_suppkey, dt, l_orderkey, ex, COUNT(*) AS n FROM l WHERE l_returnflag <> 'N' GROUP BY ALL),
b AS (SELECT st, l_suppkey, dt, l_orderkey, ex, COUNT(*) AS n, SUM(CAST(floor(l_quantity) AS BIGINT)) AS q FROM l GROUP BY ALL),
a AS (SELECT st, l_suppkey, dt, l_orderkey, ex, COUNT(*) AS n FROM l WHERE l_tax < 0.05 GROUP BY ALL),
g AS (SELECT st, l_suppkey, dt, l_orderkey, ex, COUNT(*) AS n FROM l JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P' GROUP BY ALL),
t AS (""" + TRACT_SQL + """),
j AS (SELECT f.st, f.dt, c_acctbal, geoid, f.n * COALESCE(a.n, 1) * COALESCE(g.n, 1) AS w, b.n AS bn, b.q, a.n IS NOT NULL AS has_zip, g.n IS NOT NULL AS has_geo
  FROM f JOIN b ON f.st IS NOT DISTINCT FROM b.st AND f.l_suppkey = b.l_suppkey AND f.dt = b.dt AND f.l_orderkey = b.l_orderkey AND f.ex = b.ex
  LEFT JOIN a ON f.st IS NOT DISTINCT FROM a.st AND f.l_suppkey = a.l_suppkey AND f.dt = a.dt AND f.l_orderkey = a.l_orderkey AND f.ex = a.ex
  LEFT JOIN g ON f.st IS NOT DISTINCT FROM g.st AND f.l_suppkey = g.l_suppkey AND f.dt = g.dt AND f.l_orderkey = g.l_orderkey AND f.ex = g.ex
  JOIN orders ON o_orderkey = f.l_orderkey JOIN t ON c_custkey = o_custkey)
SELECT substring(dt, 5, 4) AS year, st AS state, CASE WHEN has_geo THEN CASE WHEN c_acctbal >= 0 THEN substring(geoid, 1, 5) ELSE '' END END AS county,
  CAST(SUM(w * bn) AS BIGINT) AS n, CAST(SUM(w * q) AS BIGINT) AS deaths, CAST(SUM(CASE WHEN has_zip THEN w * bn ELSE 0 END) AS BIGINT) AS with_zip
FROM j GROUP BY ALL"""


def _blend_summary(blended):
    return blended.groupBy("year", F.col("STATE").alias("state"), F.substring("tractid", 1, 5).alias("county")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("OTH_DEATH").alias("deaths"), F.count("ZIP5").alias("with_zip")
    )


@query(_BLEND_SQL)
def incident_blend(spark, folder):
    """PL-BLEND: J1, J2, P6, all years in one plan; missing states match missing states."""
    return _blend_summary(blend(_blend_tables(spark, folder), by=["year"]))


@query(f"""
WITH t AS ({TRACT_SQL})
SELECT nullif(o_orderstatus, 'P') AS "STATE", CAST(o_custkey AS VARCHAR) AS "FDID", CAST(o_orderkey AS VARCHAR) AS "INC_NO", geoid AS tractid,
  CASE WHEN o_totalprice > 480000 THEN 'death' ELSE 'other' END AS two, CASE WHEN o_totalprice > 480000 THEN 'death'
    WHEN o_totalprice > 400000 THEN 'inj' ELSE 'no_inj' END AS three
FROM orders JOIN t ON o_custkey = c_custkey WHERE c_acctbal >= 0""")
def casualty_outcomes(spark, folder):
    """PL-3A-D: J2, J1, F3, W2, P7: one geocoded row per incident with its target; each address is listed twice, each incident again without harm."""
    basic, _, formatted, geocoded = _tables(spark, folder)
    later = basic.withColumns({"seq": F.lit(1), "OTH_DEATH": F.lit(0).cast("long"), "OTH_INJ": F.lit(0).cast("long")})
    basic = basic.withColumn("seq", F.lit(0)).unionByName(later)
    again = formatted.withColumn("row_seq", F.col("row_seq") + 0)
    out = geocoded_outcomes(basic, formatted.unionByName(again), geocoded, ["seq"])
    return out.select("STATE", "FDID", "INC_NO", "tractid", binary_target("death", "OTH_DEATH").alias("two"),
                      casualty_target().alias("three"))


@query("""
SELECT c AS column_name, CAST(COUNT(v) AS BIGINT) AS n, round(AVG(v), 4) AS mean, round(median(v), 4) AS median FROM (
  SELECT 'event_id' AS c, event_id::DOUBLE AS v FROM events UNION ALL SELECT 'user_id', user_id FROM events
  UNION ALL SELECT 'value', value FROM events UNION ALL
  SELECT 'num_case', CASE WHEN value >= 5.0 THEN floor(value) END FROM events) GROUP BY c""")
def case_summary(spark, folder):
    """PL-2C: A10 of all numeric columns of the cases."""
    s = responses.case_summary(cases(spark, folder))
    return s.select(F.col("statistic").alias("column_name"), "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@query(f"""
SELECT case_num, COUNT(*) AS number FROM ({CASES_SQL}) GROUP BY case_num HAVING COUNT(*) > 1""")
def repeated_cases(spark, folder):
    """PL-2C: A13."""
    return responses.repeated_cases(cases(spark, folder))
