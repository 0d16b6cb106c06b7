import pytest
from conftest import rows
from pyspark.sql import functions as F

from cindermap.operators import aggregate as A
from cindermap.operators import columns as C
from cindermap.operators import filters as L
from cindermap.operators import relate as R


def test_names_and_column_sets(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], ["A..B", "Base.x", "Zip Code", "Last"])
    tidy = C.standardize_names(df)
    assert tidy.columns == ["a_b", "base_x", "zip_code", "last"]
    assert C.columns_between(tidy, "base_x", "last") == ["base_x", "zip_code", "last"]
    assert C.drop_matching(tidy, ["last"], ["^base"]).columns == ["a_b", "zip_code"]
    twice = df.select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.lit(3).alias("a"))
    assert rows(C.drop_repeated_columns(twice)) == [(1, 2)]


def test_residential_precedence(spark):
    data = [(1, "40", None, None), (2, "NN", "419", None), (3, "NN", "500", None), (4, "10", "419", None), (5, "10", "500", "121"),
            (6, None, None, None), (7, "00", "464", "111"), (8, "58", "500", "111")]
    df = spark.createDataFrame(data, "i int, m string, p string, t string")
    assert [r[0] for r in rows(df.filter(L.residential("m", "p", "t")))] == [1, 2, 5, 7, 8]


def test_other_filters(spark):
    df = spark.createDataFrame([(1, "111", -1, "t"), (2, "1110", 20, "t"), (3, "112", 21, "t"), (4, None, 0, ""), (5, "2111", 0, None)],
                               "i int, k string, r int, t string")
    assert [r[0] for r in rows(L.containing(df, "k", "111"))] == [1, 2, 5]
    assert [r[0] for r in rows(df.filter(L.good_geocode("r", "t")))] == [2]
    assert [r[0] for r in rows(L.excluding(df, "k", ["111"]))] == [2, 3, 4, 5]
    assert [r[0] for r in rows(df.filter(L.known("t")))] == [1, 2, 3]
    assert rows(df.agg(L.share_passing(F.col("k") == "111"))) == [(0.2,)]
    nan = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None)], "i int, x double")
    assert [r[0] for r in rows(L.complete_cases(nan))] == [1]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti", "full"])
def test_null_safe_join_matches_brute_force(spark, how):
    a = [("x", None, 1), (None, "p", 2), ("x", "p", 3), (None, None, 4)]
    b = [("x", None, 10), (None, None, 20), (None, None, 21), ("y", "p", 30)]
    l, r = spark.createDataFrame(a, "k string, m string, a int"), spark.createDataFrame(b, "k string, m string, b int")
    got = rows(R.keyed_join(l, r, ["k", "m"], how, null_safe=True))
    want = []
    for x in a:
        hits = [y[2] for y in b if y[:2] == x[:2]]
        if how in ("left_semi", "left_anti"):
            want += [x] if bool(hits) == (how == "left_semi") else []
        else:
            want += [(*x, h) for h in hits] or ([] if how == "inner" else [(*x, None)])
    if how == "full":
        want += [(y[0], y[1], None, y[2]) for y in b if y[:2] not in [x[:2] for x in a]]
    assert got == rows(spark.createDataFrame(want, "k string, m string, a int, b int")) if len(want[0]) == 4 else sorted(map(str, want)) == sorted(map(str, got))


def test_plain_join_drops_missing_keys(spark):
    l, r = spark.createDataFrame([(None, 1)], "k string, a int"), spark.createDataFrame([(None, 2)], "k string, b int")
    assert rows(R.keyed_join(l, r, "k", "inner")) == []
    assert rows(R.keyed_lookup(r, l, "k")) == [(None, 2, 1)]


def test_overlapping_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "k int, a int")
    with pytest.raises(ValueError):
        R.keyed_join(df, df, "k")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_skew_join_equals_plain_join(spark, how, null_safe):
    # one key and the missing key hold a third of the rows each; one right key repeats
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).cast("int").alias("k"), F.col("id").alias("a"))
    right = spark.createDataFrame([(7, 1), (7, 2), (10, 3), (None, 4), (9999, 5)], "k int, b int")
    got = R.skew_join(left, right, "k", how, null_safe, hot_share=0.01)
    want = R.keyed_join(left, right, "k", how, null_safe)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_skew_join_spreads_a_hot_key(spark):
    left = spark.range(0, 40000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit(1).alias("copy"))
    right = spark.range(40000).select(F.col("id").alias("k"), F.lit(1).alias("b"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "32")

        def largest(df):
            return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        plain, spread = largest(R.keyed_join(left, right, "k")), largest(R.skew_join(left, right, "k"))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert plain > 13000
    assert spread < plain / 2


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_keys_hot_on_both_sides(spark, how, null_safe):
    # 7 is hot on both sides, 8 and the missing key on the right only, 9 on the left only and without partner
    def side(n, name, parts):
        i = F.col("id")
        k = F.when(i % 4 == 0, 7).when(i % 4 == 1, parts[0]).when(i % 4 == 2, parts[1]).otherwise(i)
        return spark.range(n).select(k.cast("int").alias("k"), i.alias(name))

    left, right = side(240, "a", (9, F.col("id"))), side(300, "b", (8, F.lit(None)))
    left = left.union(spark.createDataFrame([(8, 1000), (None, 1001), (None, 1002)], "k int, a long"))
    got = R.skew_join(left, right, "k", how, null_safe, hot_share=0.04)
    want = R.keyed_join(left, right, "k", how, null_safe)
    assert got.columns == want.columns
    assert rows(got) == rows(want)


def test_equal_hashes_lose_no_row(spark, monkeypatch):
    # all keys look like one hot key; keys without partner stay once
    monkeypatch.setattr(R, "_key_hash", lambda keys: F.lit(5).cast("long"))
    left = spark.range(60).select((F.col("id") % 20).cast("int").alias("k"), F.col("id").alias("a"))
    right = spark.range(40).select((F.col("id") % 10).cast("int").alias("k"), F.col("id").alias("b"))
    assert rows(R.skew_join(left, right, "k", hot_share=0.1)) == rows(R.keyed_join(left, right, "k"))


def test_a_key_hot_on_the_right_is_spread(spark):
    left = spark.range(0, 4000, 1, 16).select(F.when(F.col("id") < 8, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit(1).alias("a"))
    right = spark.range(0, 30000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.lit(1).alias("b"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "32")

        def largest(df):
            return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]

        plain, spread = largest(R.keyed_join(left, right, "k", "inner")), largest(R.skew_join(left, right, "k", "inner"))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert plain >= 80000 and spread < plain / 2


def test_lookup_first_and_audit(spark):
    df = spark.createDataFrame([("01",), ("02",), (None,)], "STATE string")
    codes = spark.createDataFrame([("01", "b", 2), ("01", "a", 1)], "STATE string, abb string, o int")
    assert rows(R.lookup_first(df, codes, "STATE", ["o"], ["abb"])) == [(None, None), ("01", "a"), ("02", None)]
    assert rows(R.match_audit(df, codes, "STATE")) == [(3, 2, 2 / 3)]
    assert rows(R.unmatched(df, codes, "STATE")) == [(None,), ("02",)]


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), ("a", None, "w")], "k string, o int, v string")
    assert rows(A.first_per_key(df, "k", ["o", "v"])) == [(None, 5, "z"), ("a", None, "w")]


def test_three_states_and_strict(spark):
    df = spark.createDataFrame([("a", True, 1), ("a", None, 2), ("b", False, None), ("b", False, 3)], "t string, f boolean, n long")
    names = {"all": "n", "unknown": "u", "true": "y", "false": "x"}
    assert rows(A.three_state_counts(df, "t", "f", names)) == [("a", 2, 1, 1, 0), ("b", 2, 0, 0, 2)]
    assert rows(df.groupBy("t").agg(A.strict_sum("n"), A.strict_mean("n"))) == [("a", 3, 1.5), ("b", None, None)]


def test_modes_with_ties_and_missing(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("a", None), ("b", None), (None, "q")], "k string, v string")
    assert rows(A.mode_by(df, "k", ["v"])) == [(None, "q"), ("a", "x"), ("b", None)]


def test_distinct_counts_missing_once(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", None), ("a", None), ("b", "2")], "k string, v string")
    assert rows(A.distinct_count_by(df, "k", "v", "n")) == [("a", 2), ("b", 1)]
    assert rows(A.collect_unique(df, "k", "v", "l")) == [("a", ["1"]), ("b", ["2"])]


def test_group_values_support_and_frequency(spark):
    df = spark.createDataFrame([("a", 1.0)] * 31 + [("b", 2.0)] * 30 + [(None, 3.0)], "k string, x double")
    assert {r[0] for r in rows(A.with_min_support(df, "k", 30))} == {"a"}
    marked = rows(A.with_group_value(df, "k", n=F.count(F.lit(1))).select("k", "n").distinct())
    assert marked == [(None, 1), ("a", 31), ("b", 30)]
    assert rows(A.frequency(df, "k")) == [(None, 1, 1 / 62), ("a", 31, 0.5), ("b", 30, 30 / 62)]


def test_profiles(spark):
    df = spark.createDataFrame([(1, float("nan"), "a"), (None, 1.0, None), (1, None, "b"), (2, 2.0, "b")], "i int, x double, t string")
    assert rows(A.missing_profile(df)) == [("i", 1, 0.25), ("t", 1, 0.25), ("x", 2, 0.5)]
    assert sorted(A.high_missing_columns(df, ["i", "x", "t"], 0.3)) == ["x"]
    assert rows(A.distinct_profile(df, ["t"])) == [("t", 3)]


def test_stack_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, t string"), spark.createDataFrame([("y", 2, True)], "t string, i int, z boolean")
    assert rows(A.stack(a, b)) == [(1, "x", None), (2, "y", True)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, x double")
    assert rows(A.first_per_key(empty, "k", ["x"])) == []
    assert rows(A.with_group_value(empty, "k", m=F.avg("x"))) == []
    assert rows(A.missing_profile(empty)) == [("k", 0, None), ("x", 0, None)]
