"""Whole jobs from raw rows to their last table: responses, geocoding, stacked years, stored bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.areas import _polygons
from cindermap.catalogue.incidents import _BLEND_SQL, _blend_summary, _blend_tables
from cindermap.catalogue.registry import query
from cindermap.catalogue.standins import table
from cindermap.operators.relate import values_missing_in
from cindermap.plans import geocode, responses
from cindermap.plans.incidents import blend_years, keyless_rows
from cindermap.session import scratch_path
from cindermap.sources.tables import load_tables, save_tables

_AREAS = """
g AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS geoid, 2.0::DOUBLE * n_nationkey AS k, n_nationkey % 2 = 0 AS rect FROM nation),
h AS (SELECT p.id, MIN(geoid) AS geoid FROM p JOIN g ON CASE WHEN rect THEN x BETWEEN k AND k + 1.5 AND y BETWEEN 0 AND 12
  ELSE y >= 0 AND 9.7 * (x - k) >= y AND 9.7 * (k + 2 - x) >= y END GROUP BY p.id)"""


def _responses(spark, folder):
    """Response cases with event types and coordinates; an error has no coordinates, a view no event type."""
    kind = F.col("event_type")
    event = F.when(kind == "click", "Fire : Single Family").when(kind == "purchase", "Fire : Multi-Family").when(kind == "error", "Fire").when(kind != "view", "Flood")
    return table(spark, folder, "events").select(
        "event_id", event.alias("event_type_old_categories"), F.when(kind != "error", F.col("value")).alias("esri_longitude_x"),
        (F.col("user_id") / 10.0 + 0.03).alias("esri_latitude_x"), F.date_format("ts", "yyyy-MM-dd").alias("incident_disaster_date"),
        F.when(F.col("value") >= 1.0, F.floor("value")).alias("num_case"),
    )


_LOCATED = f"""
WITH p AS (SELECT event_id AS id, CASE WHEN event_type <> 'error' THEN value END AS x, user_id / 10.0::DOUBLE + 0.03 AS y FROM events WHERE event_type IN ('click', 'purchase', 'error')), {_AREAS}"""


@query(f"""{_LOCATED}
SELECT geoid AS x, COUNT(*) AS freq FROM h GROUP BY geoid""")
def responses_per_tract(spark, folder):
    """PL-2C: F2, J11, A1: home fires among the cases, located, counted per tract in the layout of the final job."""
    return responses.fires_per_tract(responses.locate_cases(responses.home_fire_cases(_responses(spark, folder)), _polygons(spark, folder), cell=1.0))


@query(f"""{_LOCATED}
SELECT geoid AS tract, strftime(ts, '%Y-%m-%d') AS incident_disaster_date,
  CAST(CASE WHEN COUNT(*) = COUNT(CASE WHEN value >= 1.0 THEN 1 END) THEN SUM(floor(value)) END AS BIGINT) AS risk_indicator
FROM h JOIN events ON id = event_id GROUP BY 1, 2""")
def responses_per_day(spark, folder):
    """PL-2C: F2, J11, A3: cases per located tract and day."""
    located = responses.locate_cases(responses.home_fire_cases(_responses(spark, folder)), _polygons(spark, folder), cell=1.0)
    return responses.cases_per_day(located)


def _visits(spark, folder):
    """Visits with coordinates as text, as they are entered: some are blank, some are no numbers."""
    kind = F.col("event_type")
    lon = F.when(kind == "error", " ").when(kind == "view", "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, folder, "events").select("ts", "event_id", lon.alias("Longitude"), F.round(F.col("user_id") / 10.0 + 0.03, 2).cast("string").alias("Latitude"))


_VISITS = f"""
WITH p AS (SELECT event_id AS id, value AS x, user_id / 10.0::DOUBLE + 0.03 AS y FROM events WHERE event_type NOT IN ('error', 'view')), {_AREAS}"""


@query(f"""{_VISITS}
SELECT row_number() OVER (ORDER BY ts, event_id) AS id, event_id, geoid AS block_group FROM events LEFT JOIN h ON h.id = event_id""")
def visits_located(spark, folder):
    """PL-GEO: S13, J11: visits numbered in the order of entry, with the block group that holds them."""
    numbered = geocode.number_visits(_visits(spark, folder), ["ts", "event_id"])
    return geocode.locate_visits(numbered, _polygons(spark, folder), cell=1.0).select("id", "event_id", "block_group")


@query(f"""{_VISITS}
SELECT COUNT(*) AS n, COUNT(*) - COUNT(geoid) AS n_missing FROM events LEFT JOIN h ON h.id = event_id""")
def visits_share_located(spark, folder):
    """PL-GEO: how many visits found no block group."""
    return geocode.share_located(geocode.locate_visits(_visits(spark, folder), _polygons(spark, folder), cell=1.0))


_SPAN = "CASE WHEN substring(dt, 5, 4) < '1995' THEN 'before 1995' ELSE 'from 1995' END"


@query(_BLEND_SQL.replace("SELECT substring(dt, 5, 4) AS year", f"SELECT {_SPAN} AS year"))
def stacked_blends(spark, folder):
    """PL-BLEND, U1: blends of two spans of years under each other, each tagged."""
    tables = _blend_tables(spark, folder)
    early = F.col("year") < "1995"
    spans = {name: {**tables, "fire": tables["fire"].filter(c).drop("year")} for name, c in (("before 1995", early), ("from 1995", ~early))}
    return _blend_summary(blend_years(spans))


@query("""
SELECT 'basic' AS "table", COUNT(*) AS n_rows, COUNT(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'A') AS n_keyless FROM lineitem
UNION ALL SELECT 'address', COUNT(*), 0 FROM lineitem WHERE l_tax < 0.05
UNION ALL SELECT 'fire', COUNT(*), 0 FROM lineitem WHERE l_returnflag <> 'N'
UNION ALL SELECT 'formatted', COUNT(*), 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""")
def keyless_incidents(spark, folder):
    """PL-BLEND: rows of the blended tables with no key part; here open lines with a returned item lose theirs in the basic table."""
    tables = _blend_tables(spark, folder)
    lost = F.col("STATE").isNull() & (F.col("INC_TYPE") == "A")
    keys = ("STATE", "FDID", "INC_DATE", "INC_NO", "EXP_NO")
    basic = tables["basic"].withColumn("lost", lost)
    basic = basic.withColumns({k: F.when(~F.coalesce("lost", F.lit(False)), F.col(k)) for k in keys}).drop("lost")
    return keyless_rows({**tables, "basic": basic})


@query("""
SELECT 'orders' AS "table", COUNT(*) AS n_rows, COUNT(DISTINCT o_orderstatus) AS n_codes, round(SUM(o_totalprice), 2) AS total FROM orders
UNION ALL SELECT 'customers', COUNT(*), COUNT(DISTINCT c_mktsegment), round(SUM(c_acctbal), 2) FROM customer
UNION ALL SELECT 'parts', COUNT(*), COUNT(DISTINCT p_brand), round(SUM(p_retailprice), 2) FROM part""")
def stored_bundle(spark, folder):
    """Named tables stored together and read back by name."""
    picked = {
        "orders": table(spark, folder, "orders").select(F.col("o_orderstatus").alias("code"), F.col("o_totalprice").alias("amount")),
        "customers": table(spark, folder, "customer").select(F.col("c_mktsegment").alias("code"), F.col("c_acctbal").alias("amount")),
        "parts": table(spark, folder, "part").select(F.col("p_brand").alias("code"), F.col("p_retailprice").alias("amount")),
    }
    path = scratch_path(spark, "bundle")
    save_tables(picked, path)
    out = None
    for name, df in load_tables(spark, path, list(picked)).items():
        one = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("code").alias("n_codes"), F.round(F.sum("amount"), 2).alias("total"))
        out = one if out is None else out.union(one)
    return out


@query("""
SELECT side, code FROM (SELECT 'customers only' AS side, code FROM (SELECT c_nationkey AS code FROM customer WHERE c_acctbal < -950 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
UNION ALL SELECT 'suppliers only', code FROM (SELECT s_nationkey AS code FROM supplier WHERE s_acctbal > 9000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -950))""")
def code_differences(spark, folder):
    """Codes of one list that another lacks, both ways."""
    debtors = table(spark, folder, "customer").filter("c_acctbal < -950").select(F.col("c_nationkey").alias("code"))
    rich = table(spark, folder, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("code"))
    return values_missing_in(debtors, rich, "code").select(F.lit("customers only").alias("side"), "code").union(
        values_missing_in(rich, debtors, "code").select(F.lit("suppliers only").alias("side"), "code"))
