"""Areas: block groups, counties, coverage, polygons and the final risk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindermap.catalogue.registry import query
from cindermap.catalogue.scaling import BALSCALE, STATS
from cindermap.catalogue.standins import TRACT_SQL, YEARLY_FIRES_SQL, table, text, tracts, yearly_fires
from cindermap.functions.keys import pad_left, with_geo_parts
from cindermap.operators.aggregate import stack
from cindermap.operators.spatial import assign_polygon, attach_scores
from cindermap.plans import block_risk, geocode, installs
from cindermap.plans.fire_rate import state_coverage
from cindermap.plans.risk_table import INDICATORS, risk_table


def blocks(spark, folder):
    """Two block groups per tract with a non-negative balance; the id has lost its leading zero."""
    t = tracts(spark, folder).filter("c_acctbal >= 0")
    short = F.substring("geoid", 2, 20)
    return stack(
        t.select(F.concat(short, F.lit("1")).alias("bg_geoid"), (F.col("c_acctbal") / 5000).alias("smoke_alarm_risk"),
                 F.col("population").alias("bg_pop")),
        t.select(F.concat(short, F.lit("2")).alias("bg_geoid"), (F.col("n_nationkey") / 25).alias("smoke_alarm_risk"),
                 F.lit(10).cast("long").alias("bg_pop")),
    )


BLOCK_TRACT_SQL = f"""
  SELECT geoid, substring(geoid, 1, 2) AS state, substring(geoid, 3, 3) AS cnty, substring(geoid, 6, 6) AS tract,
    (c_acctbal / 5000 + n_nationkey / 25.0::DOUBLE) / 2 * 100 AS mean_risk, population FROM ({TRACT_SQL}) WHERE c_acctbal >= 0"""


@query(f"""
WITH r AS ({BLOCK_TRACT_SQL}), k AS (SELECT {STATS.format(x='mean_risk')} FROM r)
SELECT geoid AS tract_geoid, state, cnty, tract, 2::BIGINT AS blocks_per_tract,
  round(100 * ({BALSCALE.format(x='mean_risk', a=0.75, b=0.25)}), 6) AS risk_1c FROM r, k""")
def block_to_tract(spark, folder):
    """PL-1C: K1, A4, A1, K3, X4."""
    out = block_risk.tract_risk(blocks(spark, folder))
    return out.withColumn("risk_1c", F.round("risk_1c", 6))


@query(f"""
SELECT state, cnty, round(AVG(mean_risk) / 100, 9) AS smoke_alarm_risk, CAST(SUM(population + 10) AS BIGINT) AS ct_pop,
  2 * COUNT(*) AS blocks_per_county, state || cnty AS county5_code FROM ({BLOCK_TRACT_SQL}) GROUP BY state, cnty""")
def block_to_county(spark, folder):
    """PL-1C by county: A3, A4."""
    out = block_risk.county_risk(blocks(spark, folder))
    return out.withColumn("smoke_alarm_risk", F.round("smoke_alarm_risk", 9))


@query(f"""
SELECT substring(geoid, 2, 20) || b AS bg, 2::BIGINT AS blocks_per_tract
FROM ({TRACT_SQL}), (SELECT '1' AS b UNION ALL SELECT '2') WHERE c_acctbal >= 0""")
def blocks_per_tract(spark, folder):
    """W1, K1."""
    out = block_risk.blocks_with_support(blocks(spark, folder))
    return out.select(F.substring("bg_geoid", 2, 20).alias("bg"), "blocks_per_tract")


def _survey(spark, folder):
    """Households = customers, codes wrapped in ticks."""
    def tick(c):
        return F.concat(F.lit("'"), c, F.lit("'"))

    t = tracts(spark, folder)
    smoke = F.when(F.col("c_acctbal") > 3000, "1").when(F.col("c_acctbal") > 0, "2").otherwise("B")
    return t.select(
        tick(text("c_custkey")).alias("CONTROL"), tick(pad_left("n_nationkey", 3)).alias("COUNTY"),
        tick(pad_left("n_regionkey", 2)).alias("STATE"), tick(smoke).alias("SMOKE"),
    )


def _state_codes(spark, folder):
    r = table(spark, folder, "region")
    return r.select(text("r_regionkey").alias("fips"), F.substring("r_name", 1, 2).alias("abb"))


_SURVEY_SQL = f"""
  SELECT * FROM (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS "COUNTY", lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS "STATE",
    substring(r_name, 1, 2) AS abb, c_acctbal > 3000 AS has, COUNT(*) OVER (PARTITION BY n_nationkey, n_regionkey) AS n
  FROM ({TRACT_SQL}) JOIN region ON r_regionkey = n_regionkey) WHERE n > 30"""


@query(f"""
SELECT "COUNTY", "STATE", round(AVG(CASE WHEN has THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS smoke_share FROM ({_SURVEY_SQL}) GROUP BY 1, 2""")
def survey_shares(spark, folder):
    """PL-1C-X: K8, K4, J9, W1, F7, A5."""
    kept = block_risk.clean_survey(_survey(spark, folder), _state_codes(spark, folder))
    s = block_risk.smoke_alarm_share(kept)
    return s.withColumn("smoke_share", F.round("smoke_share", 6))


@query(f"""SELECT abb, COUNT(*) AS n FROM ({_SURVEY_SQL}) GROUP BY abb""")
def survey_states(spark, folder):
    """PL-1C-X: A12, O1."""
    return block_risk.households_by_state(block_risk.clean_survey(_survey(spark, folder), _state_codes(spark, folder)))


@query("""
SELECT c_custkey, upper(substring(r_name, 1, 3)) AS abb, lpad(CAST(r_regionkey AS VARCHAR), 2, '0') AS state_num
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey""")
def state_numbers(spark, folder):
    """State abbreviations to numbers through the first county of each state."""
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counties = nation.select((F.col("n_regionkey") * 1000 + F.col("n_nationkey")).alias("fips"), F.lower(F.substring("r_name", 1, 3)).alias("acronym"))
    people = table(spark, folder, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    coded = people.select("c_custkey", F.upper(F.substring("r_name", 1, 3)).alias("abb"))
    return block_risk.with_state_number(coded, "abb", counties)


@query("""
WITH r AS (SELECT s_nationkey, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS fips, l_returnflag AS state, l_linestatus AS city,
    l_quantity - 10 AS ins FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
s AS (SELECT fips, state, row_number() OVER (PARTITION BY fips ORDER BY COUNT(*) DESC, state) AS rn FROM r GROUP BY fips, state),
c AS (SELECT fips, city, row_number() OVER (PARTITION BY fips ORDER BY COUNT(*) DESC, city) AS rn FROM r GROUP BY fips, city)
SELECT r.fips, COUNT(*) AS "N", round(AVG(CASE WHEN ins > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS alarm_ins_pct,
  MIN(s.state) AS visit_state, MIN(c.city) AS visit_city
FROM r JOIN s ON s.fips = r.fips AND s.rn = 1 JOIN c ON c.fips = r.fips AND c.rn = 1 GROUP BY r.fips HAVING COUNT(*) > 25""")
def install_shares(spark, folder):
    """PL-1A target: K4, A5, A6, F7."""
    s = table(spark, folder, "supplier")
    l = table(spark, folder, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    visits = l.select(text("s_nationkey").alias("fips"), F.col("l_returnflag").alias("state"),
                      F.col("l_linestatus").alias("city"), (F.col("l_quantity") - 10).alias("alarms_ins"))
    out = installs.install_share(visits)
    return out.withColumn("alarm_ins_pct", F.round("alarm_ins_pct", 6))


@query(f"""
WITH t AS ({TRACT_SQL}), g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'),
s AS (SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') AS STATE10, r_name, population, c_acctbal >= 0 AND o_custkey IS NOT NULL AS covered
  FROM t JOIN region ON r_regionkey = n_regionkey LEFT JOIN g ON o_custkey = c_custkey)
SELECT "STATE10", CAST(SUM(population) AS BIGINT) AS total_population,
  CAST(SUM(CASE WHEN covered THEN population END) AS BIGINT) AS covered_population,
  round(SUM(CASE WHEN covered THEN population END) / CAST(SUM(population) AS DOUBLE), 6) AS coverage, MIN(r_name) AS "STATE"
FROM s GROUP BY 1 HAVING MAX(CAST(covered AS INTEGER)) = 1""")
def coverage_by_state(spark, folder):
    """PL-2A-C: U2, J8, A3, A14, A21, W2."""
    t = tracts(spark, folder)
    tract = F.when(F.col("c_acctbal") >= 0, F.col("geoid")).otherwise("")
    orders = table(spark, folder, "orders").join(t, F.col("o_custkey") == F.col("c_custkey"))
    years = [orders.filter(c).select(tract.alias("tractid")) for c in ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'")]
    rel = t.select(pad_left("n_regionkey", 2).alias("STATE10"), F.substring("geoid", 6, 20).alias("TRACT10"),
                   F.col("geoid").alias("GEOID10"), F.col("population").alias("POP10"))
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counties = nation.select(F.col("r_name").alias("STATE"), pad_left("n_regionkey", 2).alias("STATEFP"),
                             pad_left("n_nationkey", 3).alias("COUNTYFP"))
    out = state_coverage(years, stack(rel, rel), counties)
    return out.withColumn("coverage", F.round("coverage", 6))


def _polygons(spark, folder):
    """A rectangle per even nation, a triangle per odd one."""
    k = F.col("n_nationkey").cast("double") * 2
    def p(x, y):
        return F.struct(x.alias("lon"), F.lit(y).alias("lat"))

    ring = F.when(
        F.col("n_nationkey") % 2 == 0, F.array(p(k, 0.0), p(k + 1.5, 0.0), p(k + 1.5, 12.0), p(k, 12.0))
    ).otherwise(F.array(p(k, 0.0), p(k + 2.0, 0.0), p(k + 1.0, 9.7)))
    return table(spark, folder, "nation").select(pad_left("n_nationkey", 3).alias("geoid"), ring.alias("ring"))


@query("""
WITH p AS (SELECT event_id, value AS x, user_id / 10.0::DOUBLE + 0.03 AS y FROM events WHERE event_type <> 'error'),
g AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS geoid, 2.0::DOUBLE * n_nationkey AS k, n_nationkey % 2 = 0 AS rect FROM nation),
h AS (SELECT event_id, MIN(geoid) AS geoid FROM p JOIN g ON CASE WHEN rect THEN x BETWEEN k AND k + 1.5 AND y BETWEEN 0 AND 12
  ELSE y >= 0 AND 9.7 * (x - k) >= y AND 9.7 * (k + 2 - x) >= y END GROUP BY event_id)
SELECT e.event_id, h.geoid FROM events e LEFT JOIN h USING (event_id)""")
def point_in_polygon(spark, folder):
    """Points without coordinates or outside every polygon keep a missing area."""
    there = F.col("event_type") != "error"
    pts = table(spark, folder, "events").select(
        "event_id", F.when(there, F.col("value")).alias("lon"), (F.col("user_id") / 10.0 + 0.03).alias("lat")
    )
    return assign_polygon(pts, _polygons(spark, folder), cell=1.0).select("event_id", "geoid")


@query("""
SELECT lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS geoid, CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 3 END AS corners,
  round(s.balance, 4) AS balance FROM nation
LEFT JOIN (SELECT s_nationkey, AVG(s_acctbal) AS balance FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s_nationkey = n_nationkey""")
def shapes_with_scores(spark, folder):
    """J13."""
    scores = table(spark, folder, "supplier").filter("s_acctbal > 0").groupBy(pad_left("s_nationkey", 3).alias("area")).agg(
        F.avg("s_acctbal").alias("balance")
    )
    out = attach_scores(_polygons(spark, folder), scores, "area")
    return out.select("geoid", F.size("ring").alias("corners"), F.round("balance", 4).alias("balance"))


@query("""
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'error' WHEN value >= 5 THEN '55' || CAST(user_id AS VARCHAR) END AS block_group
FROM events""")
def visits_with_blocks(spark, folder):
    """PL-GEO: K10, J6: parsed answers back onto the visits; visits without an answer stay."""
    e = table(spark, folder, "events")
    xml = F.when(F.col("event_type") == "error", "no answer").otherwise(
        F.format_string('<Response><Block FIPS="55%d"/></Response>', "user_id")
    )
    answers = e.filter("event_type = 'error' OR value >= 5").select(F.col("event_id").alias("id"), xml.alias("xml"))
    return geocode.attach_blocks(e.select(F.col("event_id").alias("id")), geocode.parse_payloads(answers))


def risk_inputs(spark, folder) -> dict:
    t = tracts(spark, folder)
    orders = table(spark, folder, "orders")
    closed = orders.filter("o_orderstatus = 'F'").groupBy("o_custkey").agg((F.avg("o_totalprice") / 500000).alias("p"))
    short = F.substring("geoid", 2, 20)
    by_customer = F.col("o_custkey") == F.col("c_custkey")
    large = orders.groupBy("o_custkey").agg(F.avg((F.col("o_totalprice") > 400000).cast("double")).alias("risk_3a"))
    freq = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("freq"))
    nation = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    chapters = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return {
        "installs": with_geo_parts(t.filter("c_mktsegment <> 'BUILDING'"), "geoid").select(
            (F.col("c_acctbal") / 10000).alias("risk_1a"), "state", "cnty", "tract"
        ),
        "alarms": closed.join(t, by_customer).select(short.alias("tractid"), F.col("p").alias("weighted_linear_pred")),
        "blocks": blocks(spark, folder),
        "yearly_fires": yearly_fires(spark, folder),
        "responses": freq.join(t, F.col("user_id") == F.col("c_custkey")).select(short.alias("x"), "freq"),
        "casualties": large.join(t, by_customer).select("geoid", "risk_3a"),
        "population": t.select(F.col("geoid").alias("tract_geoid"), F.col("population").alias("P0010001")),
        "crosswalk": chapters.select(
            F.concat(pad_left("n_regionkey", 2), pad_left("n_nationkey", 3)).alias("county_fips"),
            F.substring("r_name", 1, 2).alias("region_code"), F.col("r_name").alias("region_name"),
            text("s_suppkey").alias("chapter_code"), F.col("s_name").alias("chapter_name"),
            F.col("n_name").alias("county_name_long"),
        ),
    }


def _scaled(name, x, where="TRUE"):
    return f"""{name} AS (WITH k AS (SELECT {STATS.format(x=x)} FROM {name}_raw WHERE {where})
  SELECT geoid, CASE WHEN {where} THEN 100 * ({BALSCALE.format(x=x, a=0.75, b=0.25)}) END AS v FROM {name}_raw, k)"""


_KNOWN = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in INDICATORS)
_TOTAL = " + ".join(f"COALESCE({c}, 0)" for c in INDICATORS)


@query(f"""
WITH t AS ({TRACT_SQL}), y AS ({YEARLY_FIRES_SQL}),
a_raw AS (SELECT geoid, c_acctbal / 10000 AS x FROM t WHERE c_mktsegment <> 'BUILDING'), {_scaled('a', 'x')},
b_raw AS (SELECT geoid, AVG(o_totalprice) / 500000 AS x FROM orders JOIN t ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1),
{_scaled('b', 'x')},
c_raw AS (SELECT geoid, mean_risk AS x FROM ({BLOCK_TRACT_SQL})), {_scaled('c', 'x')},
d_raw AS (SELECT geoid, population, n / (population + 1.0::DOUBLE) * 1000 AS x FROM (SELECT t.geoid, COALESCE(SUM(y.N), 0) AS n,
    COALESCE(MAX(CASE WHEN y.year = '1995' THEN y.population END), MIN(t.population), 0) AS population
    FROM t LEFT JOIN y ON y.tractid = t.geoid GROUP BY 1)), {_scaled('d', 'x', 'population > 200')},
e_raw AS (SELECT geoid, population, COALESCE(freq, 0) / (population + 100.0::DOUBLE) * 1000 * ln(population + 1.0::DOUBLE) AS x
    FROM t LEFT JOIN (SELECT user_id, COUNT(*) AS freq FROM events GROUP BY 1) ON user_id = c_custkey), {_scaled('e', 'x', 'population > 200')},
f_raw AS (SELECT geoid, AVG(CASE WHEN o_totalprice > 400000 THEN 1.0::DOUBLE ELSE 0 END) AS x FROM orders JOIN t ON o_custkey = c_custkey GROUP BY 1),
{_scaled('f', 'x')},
u AS (SELECT t.geoid AS tract_geoid, substring(c.geoid, 1, 2) AS state, substring(c.geoid, 3, 3) AS cnty, substring(c.geoid, 6, 6) AS tract,
    a.v AS risk_1a, b.v AS risk_1b, c.v AS risk_1c, d.v AS risk_2a, e.v AS risk_2c, f.v AS risk_3a FROM t
    LEFT JOIN a ON a.geoid = t.geoid LEFT JOIN b ON b.geoid = t.geoid LEFT JOIN c ON c.geoid = t.geoid
    LEFT JOIN d ON d.geoid = t.geoid LEFT JOIN e ON e.geoid = t.geoid LEFT JOIN f ON f.geoid = t.geoid),
r AS (SELECT *, ({_TOTAL}) / nullif(CAST({_KNOWN} AS DOUBLE), 0) AS risk FROM u),
w AS (SELECT *, CASE WHEN COUNT(*) OVER p = COUNT(risk) OVER p THEN AVG(risk) OVER p END AS risk_cnty FROM r WINDOW p AS (PARTITION BY state, cnty)),
x AS (SELECT * FROM (SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS county_fips,
    substring(r_name, 1, 2) AS region_code, r_name AS region_name, CAST(s_suppkey AS VARCHAR) AS chapter_code, s_name AS chapter_name,
    n_name AS county_name_long, row_number() OVER (PARTITION BY n_nationkey ORDER BY CAST(s_suppkey AS VARCHAR)) AS rn
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE rn = 1)
SELECT state, cnty, tract, tract_geoid, region_code, region_name, chapter_code, chapter_name, county_name_long,
  round(risk_cnty, 4) AS risk_cnty, round(risk, 4) AS risk, {', '.join(f'round({c}, 4) AS {c}' for c in INDICATORS)},
  round((risk_1a + risk_1b + risk_1c) / 3, 4) AS risk1_agg, round((risk_2a + risk_2c) / 2, 4) AS risk2_agg, round(risk_3a, 4) AS risk3_agg
FROM w LEFT JOIN x ON x.county_fips = substring(tract_geoid, 1, 5)""")
def risk_aggregate(spark, folder):
    """PL-AGG, the flagship: six indicators scaled, combined, averaged by county, joined to regions."""
    out = risk_table(**risk_inputs(spark, folder), base_year="1995")
    numbers = [c for c, kind in out.dtypes if kind == "double"]
    return out.withColumns({c: F.round(c, 4) for c in numbers})
