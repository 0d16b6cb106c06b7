"""Class types and counts on which sampling once went wrong."""

from collections import Counter

from cindermap.operators.sample import downsample, stratified_split


def test_integer_classes_keep_their_counts(spark):
    rows = [(i, 10 if i < 30 else 2 if i < 120 else 3) for i in range(300)]
    got = downsample(spark.createDataFrame(rows, "id long, c int"), "c", [10, 2, 3], [0.25, 0.25, 0.5], ["id"])
    assert Counter(r["c"] for r in got.collect()) == {10: 30, 2: 30, 3: 60}


def test_exact_draw_without_replacement(spark):
    rows = [(i, "a" if i < 7 else "b") for i in range(32)]
    got = downsample(spark.createDataFrame(rows, "id long, c string"), "c", ["a", "b"], [0.5, 0.5], ["id"], replace=False)
    assert Counter(r["c"] for r in got.collect()) == {"a": 7, "b": 7}


def test_boolean_target_splits(spark):
    rows = [(i, None if i == 0 else i % 2 == 0) for i in range(41)]
    got = stratified_split(spark.createDataFrame(rows, "id long, c boolean"), "c", ["id"], 0.75).collect()
    assert Counter((r["c"], r["is_train"]) for r in got) == {(True, True): 15, (True, False): 5, (False, True): 15, (False, False): 5, (None, False): 1}
