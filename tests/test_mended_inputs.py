"""Inputs that once gave a wrong answer or lost rows without a word."""

import pytest
from conftest import rows

from cindermap.models.regress import penalty_path
from cindermap.operators import relate
from cindermap.operators.prep import near_zero_variance
from cindermap.plans import incidents, risk_table
from cindermap.sources import tables as S
from cindermap.sources.schemas import CHAPTER_CROSSWALK, layout

KEY = "STATE string, FDID string, INC_DATE string, INC_NO string, EXP_NO string"


def sources(spark, alarms, fires=()):
    s = spark.createDataFrame
    return {
        "installs": s([(0.1, "1", "1", "100")], "risk_1a double, state string, cnty string, tract string"),
        "alarms": s(alarms, "tractid string, weighted_linear_pred double"),
        "blocks": s([("10010001001", 0.1)], "bg_geoid string, smoke_alarm_risk double"),
        "yearly_fires": s(list(fires), "tractid string, year string, N long, population long"),
        "responses": s([("1001000100", 6)], "x string, freq long"),
        "casualties": s([("1001000100", 0.01)], "geoid string, risk_3a double"),
        "population": s([("1001000100", 310)], "tract_geoid string, P0010001 long"),
        "crosswalk": s([("01001", "r1", "R1", "c1", "C1", "Autauga")], CHAPTER_CROSSWALK),
    }


def test_ids_without_zero_are_one_tract(spark):
    out = risk_table.risk_table(**sources(spark, [("01001000100", 0.2)], [("1001000100", "2009", 3, 300)])).collect()
    assert [(r["tract_geoid"], r["state"], r["county_name_long"]) for r in out] == [("01001000100", "01", "Autauga")]


def test_two_scores_of_a_tract_raise(spark):
    with pytest.raises(Exception, match="tract 01001000100 has 2 scores alarm"):
        risk_table.risk_table(**sources(spark, [("01001000100", 0.3), ("1001000100", 0.9)])).collect()


def test_rows_without_tract_are_counted(spark):
    alarms = spark.createDataFrame([("1001000100", 0.3), (" ", 0.4), (None, 0.5)], "tractid string, weighted_linear_pred double")
    assert rows(risk_table.rows_without_tract({"alarms": risk_table.alarm_rows(alarms)})) == [("alarms", 3, 2)]


def test_repeated_incident_takes_its_first_row(spark):
    key = ("WA", "1", "01052011", "1", "0")
    basic = spark.createDataFrame([(*key, 1, 1, 0, 0, 0), (*key, 2, 0, 0, 0, 0)], f"{KEY}, seq int, OTH_DEATH long, FF_DEATH long, FF_INJ long, OTH_INJ long")
    formatted = spark.createDataFrame([(*key, 10)], f"{KEY}, row_seq long")
    geocoded = spark.createDataFrame([(10, "b", "c", "T1")], "row_seq long, tabblock_id string, county string, tractid string")
    out = incidents.geocoded_outcomes(basic, formatted, geocoded, ["seq"])
    assert "seq" not in out.columns and rows(out, "INC_NO", "OTH_DEATH") == [("1", 1)]


def test_malformed_fields(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,x\na,1\nb,oops\n")
    path, schema = str(tmp_path / "t.csv"), layout("id", "", "x")
    assert rows(S.read_delimited(spark, path, schema, malformed="null")) == [("a", 1.0), ("b", None)]
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_delimited(spark, path, schema).collect()


def test_text_nan_is_a_value(spark):
    df = spark.createDataFrame([("NaN", 1.0), ("NaN", float("nan")), ("b", float("nan"))], "t string, x double")
    assert rows(near_zero_variance(df, ["t", "x"]), "column", "freq_ratio", "zero_var") == [("t", 2.0, False), ("x", 0.0, True)]


def test_penalties_do_not_jump_with_the_row_count(spark):
    few = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 2.0)], "a double, b double, y double")
    path = penalty_path(few, ["a", "b"], "y", 3, ratio=1e-4)
    assert path[-1] / path[0] == pytest.approx(1e-4)


def test_hot_keys_follow_the_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(10000).selectExpr("CASE WHEN id < 5000 THEN 1L WHEN id < 5030 THEN 2L ELSE id END AS k")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "400")
        few = df.filter("k % 2 = 0")
        first, second, none = relate.hot_keys(df, few, df.limit(0), on="k")
        assert sorted(first.values()) == [2, 200] and len(second) == 1 and none == {}
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert list(relate.hot_keys(df, on="k")[0].values()) == [4]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
