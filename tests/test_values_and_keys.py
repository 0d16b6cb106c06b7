from conftest import rows
from pyspark.sql import functions as F

from cindermap.functions import keys as K
from cindermap.functions import scores as S
from cindermap.functions import values as V


def one(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_number_text(spark):
    df = one(spark, "i int, t string", (1, "1,234"), (2, "."), (3, ""), (4, "12"), (5, '"2,000.5"'), (6, None))
    assert rows(df.select("i", V.number_from_text("t"))) == [(1, 1234.0), (2, None), (3, None), (4, 12.0), (5, 2000.5), (6, None)]


def test_blank_and_ticks(spark):
    df = one(spark, "i int, a string, b string", (1, "  ", "'1'"), (2, " x ", "-6"), (3, None, None))
    assert rows(V.blank_to_null_all(df).select("i", "a", V.strip_ticks("b"))) == [(1, None, "1"), (2, "x", "-6"), (3, None, None)]


def test_ratio_has_no_infinity(spark):
    df = one(spark, "i int, n double, d double", (1, 1.0, 0.0), (2, 0.0, 0.0), (3, 1.0, 4.0), (4, None, 2.0))
    assert rows(df.select("i", V.safe_ratio("n", "d"))) == [(1, None), (2, None), (3, 0.25), (4, None)]


def test_later_rule_wins_and_presence(spark):
    df = one(spark, "i int, d string, t string", (1, "N", "1"), (2, "N", None), (3, None, "2"), (4, "1", ""), (5, None, None), (6, "U", "5"))
    got = rows(df.select("i", V.presence_flag("d", "t")))
    assert got == [(1, True), (2, False), (3, False), (4, None), (5, None), (6, True)]


def test_clamp_and_label_keep_missing(spark):
    df = one(spark, "i int, x double", (1, 1.5), (2, -0.5), (3, None), (4, 0.5))
    got = rows(df.select("i", V.clamp("x", upper=1.0), V.clamp("x", 0.0, 1.0), V.threshold_label("x", "other", "event")))
    assert got == [(1, 1.0, 1.0, "other"), (2, -0.5, 0.0, "event"), (3, None, None, None), (4, 0.5, 0.5, "event")]


def test_row_means(spark):
    nan = float("nan")
    df = one(spark, "i int, a double, b double", (1, 2.0, 4.0), (2, None, 4.0), (3, None, None), (4, nan, 3.0), (5, nan, None))
    assert rows(df.select("i", S.mean_of_known("a", "b"))) == [(1, 3.0), (2, 4.0), (3, None), (4, 3.0), (5, None)]
    assert rows(df.select("i", S.mean_strict("a", "b"))) == [(1, 3.0), (2, None), (3, None), (4, None), (5, None)]


def test_rates(spark):
    df = one(spark, "n long, p long", (3, 0))
    got = rows(df.select(S.rate_per("n", "p"), S.stabilized_rate("n", "p"), S.damped_rate("n", "p"), S.prior_corrected(F.lit(0.4), 0.1)))
    assert got == [(None, 3000.0, 0.0, 0.08000000000000002)]


def test_geoid_parts_and_padding(spark):
    df = one(spark, "g string", ("530330001002",))
    got = rows(K.with_geo_parts(df, "g", block=True))
    assert got == [("530330001002", "53", "033", "000100", "2")]
    ids = one(spark, "i int, t string", (1, "1001"), (2, "123456"), (3, "1001020100"), (4, "01001020100"), (5, None))
    assert rows(ids.select("i", K.pad_left("t", 5), K.restore_leading_zero("t"))) == [
        (1, "01001", "1001"), (2, "123456", "123456"), (3, "1001020100", "01001020100"),
        (4, "01001020100", "01001020100"), (5, None, None)]


def test_right_slices_and_summary_level(spark):
    df = one(spark, "i int, g string", (1, "14000US53033000100"), (2, "abc"))
    got = rows(df.select("i", K.summary_level("g"), K.summary_id("g"), K.take_right("g", 4), K.drop_right("g", 4)))
    assert got == [(1, "14000", "53033000100", "0100", "14000US5303300"), (2, "abc", None, "abc", "abc")]


def test_payload_failures_are_tagged(spark):
    df = one(spark, "i int, x string", (1, '<R><Block FIPS="53"/></R>'), (2, "oops"), (3, "<a><b>"), (4, None), (5, "<R/>"),
             (6, "<R><Census><fips>77</fips></Census></R>"))
    got = rows(df.select("i", K.payload_value("x", ["Block", "_FIPS"]), K.payload_value("x", ["Census", "fips"], None)))
    assert got == [(1, "53", None), (2, "error", None), (3, "error", None), (4, "error", None), (5, "error", None), (6, "error", "77")]


def test_incident_key_has_one_form(spark):
    a = one(spark, "STATE string, FDID int, INC_DATE int, INC_NO int, EXP_NO int", ("WA ", 12, 1052011, 7, 0))
    b = one(spark, "STATE string, FDID string, INC_DATE string, INC_NO string, EXP_NO string", ("WA", " 12", "01052011", "7", "0"))
    assert rows(K.normalize_incident_key(a)) == rows(K.normalize_incident_key(b)) == [("WA", "12", "01052011", "7", "0")]
