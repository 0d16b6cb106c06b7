import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cindermap.functions.scores import mean_of_known
from cindermap.plans import alarms, block_risk, casualty, fire_rate, geocode, incidents, responses, risk_table
from cindermap.sources.schemas import BASIC_INCIDENT, FIRE_INCIDENT, FORMATTED_ADDRESS, GEOCODED_ADDRESS, INCIDENT_ADDRESS

KEY = ("STATE", "FDID", "INC_DATE", "INC_NO", "EXP_NO")


def table(spark, schema, *records):
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in records], schema)


def inc(no, state="WA", **more):
    return {"STATE": state, "FDID": "1", "INC_DATE": "01052011", "INC_NO": str(no), "EXP_NO": "0", **more}


@pytest.fixture(scope="module")
def year(spark):
    basic = table(spark, BASIC_INCIDENT,
                  inc(1, INC_TYPE="111", MIXED_USE="40", OTH_DEATH=1, OTH_INJ=0), inc(2, None, INC_TYPE="1110", MIXED_USE="NN", PROP_USE="419", OTH_INJ=2, OTH_DEATH=0),
                  inc(3, INC_TYPE="112", MIXED_USE="NN", PROP_USE="500"), inc(4, INC_TYPE="111"), inc(5, INC_TYPE="121", OTH_DEATH=0, OTH_INJ=0), inc(6, INC_TYPE=None))
    fire = table(spark, FIRE_INCIDENT, inc(1, DETECTOR="N", DET_TYPE="1"), inc(2, None, DETECTOR="1", DET_TYPE="2"), inc(4, DETECTOR=None, DET_TYPE=""))
    address = table(spark, INCIDENT_ADDRESS, inc(1, CITY="a", ZIP5="98101"), inc(2, None, CITY="b", ZIP5="98102"), inc(3, ZIP5="98101"), inc(5, ZIP5="00000"))
    formatted = table(spark, FORMATTED_ADDRESS, inc(1, row_seq=11, input_address="x"), inc(1, row_seq=10, input_address="y"), inc(2, None, row_seq=20),
                      inc(4, row_seq=40), inc(5, row_seq=50), inc(6, row_seq=60))
    geocoded = table(spark, GEOCODED_ADDRESS, {"row_seq": 10, "rating": 20, "tractid": "T1"}, {"row_seq": 11, "rating": 21, "tractid": "T2"},
                     {"row_seq": 20, "rating": 0, "tractid": "T1"}, {"row_seq": 40, "rating": 5, "tractid": ""}, {"row_seq": 50, "rating": -1, "tractid": "T3"})
    return {"basic": basic, "fire": fire, "address": address, "formatted": formatted, "geocoded": geocoded}


def test_blend(spark, year):
    out = incidents.blend_years({"2011": year, "2012": year})
    one = rows(out.filter("year = '2011'"), "INC_NO", "STATE", "INC_TYPE", "ZIP5", "row_seq", "tractid")
    assert one == [("1", "WA", "111", "98101", 10, "T1"), ("1", "WA", "111", "98101", 11, "T2"), ("2", None, "1110", "98102", 20, "T1"), ("4", "WA", "111", None, 40, "")]
    assert out.count() == 8
    strict = incidents.blend_year(year, "2011", null_safe=False)
    assert rows(strict.filter("STATE IS NULL"), "INC_TYPE", "row_seq") == [(None, None)]


def test_presence(spark, year):
    counts = alarms.presence_counts(year["basic"], year["fire"], year["formatted"], year["geocoded"])
    assert rows(counts, "tractid", "all_fire", "alarm_unknown", "alarm_presented", "alarm_not_presented") == [("T1", 2, 0, 1, 1)]
    stacked = alarms.presence_all_years({"2010": counts, "2011": counts})
    assert rows(stacked, "year", "ratio_no_alarm_in_all") == [("2010", 0.5), ("2011", 0.5)]
    total = alarms.presence_totals(stacked).first()
    assert (total["all_fire_all_years"], total["alarm_presented_all_years"], total["ratio_no_alarm_in_all_known"]) == (4, 2, 0.5)


def test_fire_rate_counts_addresses(spark, year):
    by = fire_rate.fires_per_tract(year["basic"], year["formatted"], year["geocoded"])
    assert rows(by) == [("", 1), ("T1", 2), ("T2", 1)]
    assert rows(fire_rate.fires_per_tract(year["basic"], year["formatted"], year["geocoded"], dedup_incidents=True)) == [("", 1), ("T1", 2)]
    population = spark.createDataFrame([("T1", 101), ("T2", 100), ("T9", 500)], "tractid string, population long")
    assert rows(fire_rate.fire_rate(by, population)) == [("T1", "1400000UST1", 2, 101, 2 / 101 * 1000)]


def test_residential_tracts(spark, year):
    zcta = spark.createDataFrame([("98101", "53", "033", "1", "g1"), ("98101", "53", "033", "2", "g2"), ("98102", "53", "033", "3", "g3")],
                                 "zcta5 string, state string, county string, tract string, geoid string")
    out = incidents.residential_by_tract(year["basic"], year["address"], zcta)
    assert rows(out, "INC_NO", "geoid") == [("1", "g1"), ("1", "g2"), ("2", "g3"), ("5", None)]
    short = incidents.residential_by_tract(year["basic"], year["address"], zcta, ("FDID", "INC_DATE", "INC_NO"))
    assert "STATE" not in short.columns and rows(short, "INC_NO", "geoid") == rows(out, "INC_NO", "geoid")


def test_outcomes_take_the_first_address(spark, year):
    out = incidents.geocoded_outcomes(year["basic"], year["formatted"], year["geocoded"], ["ALARM"])
    assert rows(out, "INC_NO", "STATE", "tractid") == [("1", "WA", "T1"), ("2", None, "T1"), ("5", "WA", "T3")]
    assert rows(out.select("INC_NO", casualty.casualty_target(), casualty.binary_target("injury", "OTH_INJ"))) == [
        ("1", "death", "other"), ("2", "inj", "injury"), ("5", "no_inj", "other")]


def test_coverage(spark):
    years = [spark.createDataFrame([(t,) for t in ts], "tractid string") for ts in (["a1", "", None], ["a1", "b1", "zz"])]
    rel = spark.createDataFrame([("01", "1", "a1", 30), ("01", "1", "a1", 30), ("01", "2", "a2", 70), ("02", "1", "b1", 5), ("03", "1", "c1", 9)],
                                "STATE10 string, TRACT10 string, GEOID10 string, POP10 long")
    counties = spark.createDataFrame([("AL", "01", "001"), ("AL", "01", "003"), ("AK", "02", "001")], "STATE string, STATEFP string, COUNTYFP string")
    assert rows(fire_rate.state_coverage(years, rel, counties)) == [("01", 100, 30, 0.3, "AL"), ("02", 5, 5, 1.0, "AK")]


def test_published_coverage_rule(spark):
    # Published totals, covered population and coverage of four states.
    golden = [
        ("AL", "01", 4779736, 4055986, 0.848579503135738),
        ("AK", "02", 710231, 708375, 0.997386765714254),
        ("AZ", "04", 6392017, 5971753, 0.934251739317965),
        ("AR", "05", 2915918, 2914514, 0.999518504978535),
    ]
    rel = [(f, i, f"{f}{i}", n) for _, f, total, inside, _ in golden for i, n in (("in", inside), ("out", total - inside))]
    rel = spark.createDataFrame(rel, "STATE10 string, TRACT10 string, GEOID10 string, POP10 long")
    covered = rel.filter("TRACT10 = 'in'").select(F.col("GEOID10").alias("tractid"))
    counties = spark.createDataFrame([(s, f, "001") for s, f, *_ in golden], "STATE string, STATEFP string, COUNTYFP string")
    got = rows(fire_rate.state_coverage([covered], rel, counties), "STATE", "total_population", "covered_population", "coverage")
    assert [(s, t, c, pytest.approx(r, abs=1e-12)) for s, _, t, c, r in sorted(golden)] == got


def test_responses(spark):
    cases = spark.createDataFrame(
        [("1", "Fire", 1.0, 1.0, "t1", "d1", 2, "WA"), ("2", "Fire : Single Family", 9.0, 9.0, "t1", "d1", None, ""), ("3", "Flood", 1.0, 1.0, "t1", "d2", 1, None),
         ("4", None, 1.0, 1.0, None, "d2", 1, "WA"), ("5", "Fire : Multi-Family", None, 1.0, "t2", "d2", 4, "OR"), ("1", "Fire", 1.0, 1.0, "t1", "d1", 3, "WA")],
        "case_num string, event_type_old_categories string, esri_longitude_x double, esri_latitude_x double, tract string, incident_disaster_date string, num_case long, esri_state string")
    fires = responses.home_fire_cases(cases)
    assert [r[0] for r in rows(fires.select("case_num"))] == ["1", "1", "2", "5"]
    shape = spark.createDataFrame([("g", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "geoid string, ring array<struct<lon:double,lat:double>>")
    located = responses.locate_cases(fires.drop("tract").dropDuplicates(["case_num"]), shape)
    assert rows(responses.fires_per_tract(located)) == [("g", 1)]
    assert rows(responses.cases_per_day(cases)) == [("t1", "d1", None), ("t1", "d2", 1), ("t2", "d2", 4)]
    assert rows(responses.cases_per_tract(cases)) == [("t1", None), ("t2", 4)]
    assert rows(responses.repeated_cases(cases)) == [("1", 2)]
    assert rows(responses.cases_by(cases, "esri_state")) == [(None, 1), ("", 1), ("OR", 1), ("WA", 2)]
    assert rows(responses.state_order(cases)) == [("OR", 1, 1), ("WA", 2, 2)]


def test_blocks(spark):
    blocks = spark.createDataFrame([("10010001001", 0.2, 5), ("010010001002", 0.4, 6), ("010010002001", 0.8, 1), ("010010003001", None, 1)],
                                   "bg_geoid string, smoke_alarm_risk double, bg_pop long")
    out = rows(block_risk.tract_risk(blocks), "tract_geoid", "cnty", "blocks_per_tract", "risk_1c")
    low, high = (100 * (0.75 / (1 + math.exp(-z)) + 0.25 * n) for z, n in ((-1 / math.sqrt(2), 0), (1 / math.sqrt(2), 1)))
    assert [r[:3] for r in out] == [("01001000100", "001", 2), ("01001000200", "001", 1), ("01001000300", "001", 1)]
    assert out[0][3] == pytest.approx(low) and out[1][3] == pytest.approx(high) and out[2][3] is None
    county = block_risk.county_risk(blocks.filter("smoke_alarm_risk IS NOT NULL")).first()
    assert (county["ct_pop"], county["blocks_per_county"], county["county5_code"]) == (12, 3, "01001")


def test_survey(spark):
    people = [(f"'{i}'", "'001'", "'01'", "'1'" if i < 20 else "'2'") for i in range(31)] + [(f"'{i}'", "'001'", "'02'", "'1'") for i in range(30)]
    survey = spark.createDataFrame(people, "CONTROL string, COUNTY string, STATE string, SMOKE string")
    codes = spark.createDataFrame([("1", "AL"), ("2", "AK"), ("1", "ZZ")], "fips string, abb string")
    kept = block_risk.clean_survey(survey, codes)
    assert rows(block_risk.smoke_alarm_share(kept)) == [("001", "01", 20 / 31)]
    assert rows(block_risk.states_of_county_codes(kept)) == [("001", ["AL"])]
    assert rows(block_risk.households_by_state(kept)) == [("AL", 31)]
    assert block_risk.share_histogram(block_risk.smoke_alarm_share(kept), 5).agg(F.sum("n")).first()[0] == 1


def test_geocode(spark):
    visits = geocode.number_visits(spark.createDataFrame([("1.0", "1.0"), ("1.0", ""), ("bad", "9.0")], "Latitude string, Longitude string"), ["Latitude", "Longitude"])
    assert rows(visits, "id", "Latitude") == [(1, "1.0"), (2, "1.0"), (3, "bad")]
    shape = spark.createDataFrame([("530330001001", [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "geoid string, ring array<struct<lon:double,lat:double>>")
    assert rows(geocode.locate_visits(visits, shape), "id", "block_group") == [(1, None), (2, "530330001001"), (3, None)]
    answers = geocode.parse_payloads(spark.createDataFrame([(1, "<R><Block FIPS='7'/></R>"), (3, "x")], "id long, xml string"))
    merged = geocode.attach_blocks(visits, answers)
    assert rows(merged, "id", "block_group") == [(1, "7"), (2, None), (3, "error")]
    assert rows(geocode.share_located(merged)) == [(3, 2)]


def scaled(values):
    """The published scaling, by hand."""
    x = np.array([v for v in values if v is not None], float)
    if len(x) < 2 or x.std(ddof=1) == 0:
        return [None for _ in values]
    return [None if v is None else 100 * (0.75 / (1 + math.exp(-(v - x.mean()) / x.std(ddof=1))) + 0.25 * (v - x.min()) / (x.max() - x.min())) for v in values]


def test_risk_table_by_hand(spark):
    g = ["01001000100", "01001000200", "02003000100", "02003000200", "09009000900"]
    s = spark.createDataFrame
    installs = s([(0.1, "01", "001", "000100"), (0.5, "01", "001", "000200"), (0.9, "02", "003", "000100")], "risk_1a double, state string, cnty string, tract string")
    alarm = s([("1001000100", 0.2), ("1001000200", 0.3), ("09009000900", 0.7)], "tractid string, weighted_linear_pred double")
    blocks = s([("10010001001", 0.1, 1), ("10010001002", 0.3, 1), ("10010002001", 0.5, 1), ("020030001001", 0.6, 1), ("020030002001", None, 1)],
               "bg_geoid string, smoke_alarm_risk double, bg_pop long")
    yearly = s([(g[0], "2009", 3, 300), (g[0], "2010", 2, 999), (g[1], "2010", 4, 999)], "tractid string, year string, N long, population long")
    resp = s([("1001000100", 6), ("02003000100", 1)], "x string, freq long")
    cas = s([(g[0], 0.01), (g[1], 0.02), (g[2], 0.05)], "geoid string, risk_3a double")
    pop = s([(g[0], 310), (g[1], 400), (g[2], 200), (g[3], 1000)], "tract_geoid string, P0010001 long")
    cross = s([("01001", "r1", "R1", "c2", "C2", "Late"), ("01001", "r1", "R1", "c1", "C1", "Autauga")],
              "county_fips string, region_code string, region_name string, chapter_code string, chapter_name string, county_name_long string")
    out = risk_table.risk_table(installs, alarm, blocks, yearly, resp, cas, pop, cross)
    assert tuple(out.columns) == risk_table.OUTPUT and len(out.columns) == 20
    got = {r["tract_geoid"]: r for r in out.collect()}
    assert sorted(got) == g

    want = {
        "risk_1a": scaled([0.1, 0.5, 0.9, None, None]),
        "risk_1b": scaled([0.2, 0.3, None, None, 0.7]),
        "risk_1c": scaled([20, 50, 60, None, None]),
        # population: 300 from the base year, else census; 200 people are not enough
        "risk_2a": scaled([5 / 301 * 1000, 4 / 401 * 1000, None, 0.0, None]),
        "risk_2c": scaled([6 / 410 * 1000 * math.log(311), 0.0, None, 0.0, None]),
        "risk_3a": scaled([0.01, 0.02, 0.05, None, None]),
    }
    mean = []
    for i, t in enumerate(g):
        for c, values in want.items():
            assert got[t][c] == (pytest.approx(values[i]) if values[i] is not None else None), (t, c)
        known = [values[i] for values in want.values() if values[i] is not None]
        mean.append(sum(known) / len(known) if known else None)
        assert got[t]["risk"] == pytest.approx(mean[i])
    assert got[g[0]]["risk_cnty"] == pytest.approx((mean[0] + mean[1]) / 2) == got[g[1]]["risk_cnty"]
    assert got[g[4]]["state"] is None and got[g[4]]["risk_cnty"] == pytest.approx(mean[4])
    assert (got[g[0]]["state"], got[g[0]]["cnty"], got[g[0]]["tract"]) == ("01", "001", "000100")
    assert got[g[1]]["chapter_name"] == "C1" and got[g[2]]["chapter_name"] is None
    assert got[g[0]]["risk1_agg"] == pytest.approx(sum(want[c][0] for c in ("risk_1a", "risk_1b", "risk_1c")) / 3)
    assert got[g[2]]["risk1_agg"] is None and got[g[3]]["risk2_agg"] == pytest.approx((want["risk_2a"][3] + want["risk_2c"][3]) / 2)
    assert got[g[2]]["risk3_agg"] == got[g[2]]["risk_3a"]


def test_row_mean_without_any_value(spark):
    df = spark.createDataFrame([(None, None)], "a double, b double")
    assert rows(df.select(mean_of_known("a", "b"))) == [(None,)]
