import pytest
from pyspark.sql import functions as F

from cindermap.models import classify as C


def test_bins_keep_few_and_rare_values_apart(spark):
    df = spark.range(10_000).select(
        F.lit(3.0).alias("same"), (F.col("id") % 1000 == 0).cast("double").alias("rare"), (F.col("id") % 25).cast("double").alias("code"),
        F.when(F.col("id") % 100 == 0, F.col("id") / 7.0).otherwise(0.0).alias("tail"), F.rand(1).alias("any"))
    same, rare, code, tail, many = C.bin_splits(df, df.columns)
    assert same[1:-1] == [3.0] and rare[1:-1] == [0.0, 1.0] and code[1:-1] == [float(i) for i in range(25)]
    assert len(tail) == len(many) == C.BINS + 1 and tail[1] == 0.0
    assert all(a < b for s in (same, rare, code, tail, many) for a, b in zip(s, s[1:]))


def test_units_weigh_all_rows_and_stay_few(spark):
    small = spark.range(100).select((F.col("id") % 5).alias("x"))
    kept = C.bootstrap_units(small, ["x"])
    assert kept.count() == 100 and kept.filter("__weight <> 1").count() == 0
    for n in (10_000, 100_000):
        units = C.bootstrap_units(spark.range(n).select(F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % 10).alias("x")), ["x"], 500)
        per_value = {r["x"]: r["w"] for r in units.groupBy("x").agg(F.sum("__weight").alias("w")).collect()}
        assert per_value == pytest.approx({0: n * 0.8, 8: n * 0.1, 9: n * 0.1})
        # the work of a forest no longer follows the rows
        assert units.count() <= 500 + 3 and units.agg(F.max("__weight")).first()[0] <= n / 500
        assert units.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_forest_of_weighted_rows_finds_the_classes(spark, tmp_path):
    x = F.rand(3)
    df = spark.range(20_000).select((x * 10).alias("a"), F.rand(4).alias("noise"), F.lit(1.0).alias("flat")).withColumn(
        "kind", F.when(F.col("a") > 7, "high").otherwise("low"))
    features = ["a", "noise", "flat"]
    model = C.fit_forest(df, features, "kind", trees=10, depth=4, units=1000)
    scored = C.score(model, df, ["a"], high=C.class_probability(model, "high"), said=C.class_label(model))
    # one bin of 32 may lie across the border
    assert scored.filter((F.col("said") == "high") != (F.col("a") > 7)).count() < 20_000 / 32
    assert scored.rdd.getNumPartitions() >= 8
    weights = {r["variable"]: r["importance"] for r in C.importance_table(model, features, spark).collect()}
    assert weights["a"] > 0.9 and weights["flat"] == 0 and sum(weights.values()) == pytest.approx(1)
    model.write().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    assert C.score(again, df, ["a"], high=C.class_probability(again, "high")).agg(F.sum("high")).first()[0] == pytest.approx(scored.agg(F.sum("high")).first()[0])
