import pytest
from conftest import rows
from pyspark.sql import functions as F

from cindermap.operators import sample as R


def classes(spark, parts=3, **sizes):
    data, i = [], 0
    for name, n in sizes.items():
        for _ in range(n):
            data.append((i, name))
            i += 1
    return spark.createDataFrame(data, "i long, target string").repartition(parts)


def test_published_example_sizes(spark):
    out = R.downsample(classes(spark, a=15, b=15, c=30), "target", ["a", "b", "c"], [0.5, 0.25, 0.25], ["i"])
    assert rows(out.groupBy("target").count()) == [("a", 15), ("b", 7), ("c", 7)]
    assert rows(out.select(F.count_distinct("draw_id"))) == [(29,)]


def test_plan_arithmetic():
    sizes = {"death": 10849, "inj": 56890, "no_inj": 4058912}
    plan = R.sample_plan(sizes, ["death", "inj", "no_inj"], [0.25, 0.25, 0.5], None)
    assert plan == {"death": 10849, "inj": 10849, "no_inj": 21698}
    assert R.sample_plan({"d": 5, "o": 9}, ["d", "o"], [0.5, 0.5], 20000) == {"d": 20000, "o": 20000}


def test_arguments_are_checked(spark):
    sizes = {"a": 1, "b": 2}
    for names, shares in ((["a", "b"], [0.5, 0.4]), (["a", "b"], [1.0]), (["a"], [1.0]), (["a", "c"], [0.5, 0.5])):
        with pytest.raises(ValueError):
            R.sample_plan(sizes, names, shares, None)
    with pytest.raises(ValueError):
        R.downsample(classes(spark, a=4, b=2), "target", ["a", "b"], [0.5, 0.5], ["i"], replace=False)


def test_draws_do_not_depend_on_partitions(spark):
    def draw(parts):
        df = classes(spark, parts, a=20, b=300)
        return rows(R.downsample(df, "target", ["a", "b"], [0.5, 0.5], ["i"], n=100), "draw_id", "i", "target")

    first = draw(1)
    assert len(first) == 200 and first == draw(7)
    assert len({r[1] for r in first if r[2] == "a"}) > 15


def test_one_row_class(spark):
    out = R.downsample(classes(spark, a=1, b=10), "target", ["a", "b"], [0.5, 0.5], ["i"], n=5)
    assert rows(out.filter("target = 'a'").select("i").distinct()) == [(0,)]
    assert out.count() == 10


def test_without_replacement_is_distinct(spark):
    out = R.downsample(classes(spark, a=40, b=300), "target", ["a", "b"], [0.5, 0.5], ["i"], replace=False)
    assert rows(out.groupBy("target").agg(F.count("*"), F.count_distinct("i"))) == [("a", 40, 40), ("b", 40, 40)]


def test_splits(spark):
    df = classes(spark, a=33, b=250, c=1)
    out = R.stratified_split(df, "target", ["i"], 0.8)
    assert rows(out.groupBy("target").agg(F.count_if("is_train"))) == [("a", 27), ("b", 200), ("c", 1)]
    again = R.stratified_split(classes(spark, 9, a=33, b=250, c=1), "target", ["i"], 0.8)
    assert rows(out, "i", "is_train") == rows(again, "i", "is_train")
    share = R.hash_split(spark.range(20000), ["id"], 0.1).agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.09 < share < 0.11


def test_upsample_and_bands(spark):
    df = classes(spark, a=30, b=500)
    up = R.upsample_where(df, F.col("target") == "a", 1000, ["i"])
    assert up.count() == 1530 and up.filter("draw_id IS NOT NULL AND target <> 'a'").count() == 0
    kept = R.sample_per_band(df, "target", 50, ["i"])
    assert rows(kept.groupBy("target").agg(F.count("*"), F.count_distinct("i"))) == [("a", 30, 30), ("b", 50, 50)]
    best = sorted(df.filter("target = 'b'").withColumn("h", R.key_hash(["i"], 12)).select("h", "i").collect())[:50]
    assert {r["i"] for r in best} == {r["i"] for r in kept.filter("target = 'b'").collect()}


def test_share_ranks_are_whole_numbers(spark):
    import random
    from fractions import Fraction
    from math import ceil

    rng = random.Random(4)
    shares = [0.55, 0.07, 0.29, 0.57, 0.1, 0.3, 0.7, 0.0, 1.0, *[round(rng.random(), rng.randrange(1, 5)) for _ in range(31)]]
    sizes = [0, 1, 7, 100, 10**15, *[rng.randrange(1, 10 ** rng.randrange(2, 12)) for _ in range(20)]]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    got = df.select("n", *[R.share_rank(F.col("n"), share).alias(f"r{i}") for i, share in enumerate(shares)]).collect()
    assert len(got) * len(shares) == 1000
    for row in got:
        assert list(row)[1:] == [ceil(Fraction(str(share)) * row["n"]) for share in shares]


def test_split_takes_the_share_that_is_written(spark):
    df = classes(spark, a=100, b=300)
    for share, want in ((0.55, (55, 165)), (0.07, (7, 21)), (0.29, (29, 87)), (0.0, (0, 0)), (1.0, (100, 300))):
        out = R.stratified_split(df, "target", ["i"], share)
        assert rows(out.groupBy("target").agg(F.count_if("is_train"))) == [("a", want[0]), ("b", want[1])]


def test_radix_descends_and_ties_go_by_key(spark, monkeypatch):
    df = classes(spark, a=40, b=900)
    whole = rows(R.sample_per_band(df, "target", 333, ["i"]), "target", "i")
    best = {c: sorted((r["h"], r["i"]) for r in df.filter(F.col("target") == c).withColumn("h", R.key_hash(["i"], 12)).collect())[:333] for c in "ab"}
    assert whole == sorted((c, i) for c in "ab" for _, i in best[c])
    monkeypatch.setattr(R, "RADIX_BITS", 3)
    monkeypatch.setattr(R, "BUCKET_ROWS", 1)
    assert rows(R.sample_per_band(df, "target", 333, ["i"]), "target", "i") == whole
    # one hash for all rows: the keys decide
    monkeypatch.setattr(R, "key_hash", lambda keys, seed: F.lit(5).cast("long"))
    assert rows(R.sample_per_band(df, "target", 3, ["i"]), "i") == [(0,), (1,), (2,), (40,), (41,), (42,)]


def test_bands_without_name_and_empty_tables(spark):
    df = spark.createDataFrame([(i, None if i < 9 else "x") for i in range(30)], "i long, target string")
    assert rows(R.sample_per_band(df, "target", 5, ["i"]).groupBy("target").count()) == [(None, 5), ("x", 5)]
    assert R.sample_per_band(df.limit(0), "target", 5, ["i"]).count() == 0
    assert R.stratified_split(df.limit(0), "target", ["i"], 0.5).count() == 0
