import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from cindermap.operators import bins as B
from cindermap.operators import prep as P
from cindermap.operators import rank as K
from cindermap.operators import scale as S
from cindermap.operators.quantiles import exact_quantiles, quantile_row, summary_table

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def frame(spark, values, parts=4):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i long, x double").repartition(parts)


def samples():
    r = random.Random(7)
    normal = [r.gauss(3, 1) for _ in range(20000)]
    return {
        "normal": normal,
        "cubed": [v**3 for v in normal[:5000]] + [1000.0] * 5,
        "ties": [float(r.randrange(5)) for _ in range(3000)],
        "hot": [1.5] * 4000 + [r.random() for _ in range(2000)],
        "constant": [2.0] * 50,
        "gaps": [None, float("nan"), 1.0, 4.0, 2.0],
        "two": [1.0, 2.0],
        "one": [5.0],
    }


@pytest.mark.parametrize("name", list(samples()))
def test_quantiles_match_numpy(spark, name):
    values = samples()[name]
    known = [v for v in values if v is not None and not math.isnan(v)]
    got = {r["prob"]: r["value"] for r in exact_quantiles(frame(spark, values), ["x"], PROBS, accuracy=1000).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(known, p), abs=1e-12)


def test_quantiles_of_several_columns_and_of_nothing(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    got = rows(quantile_row(df, ["a", "b", "c"], [0.25, 0.5]))
    assert got == [([25.0, 50.0], [-75.0, -50.0], [None, None])]


def test_quantile_probabilities_in_any_order(spark):
    got = exact_quantiles(frame(spark, range(11)), ["x"], [0.9, 0.1], method="linear").collect()
    assert {(r["prob"], r["value"]) for r in got} == {(0.9, 9.0), (0.1, 1.0)}


def test_rank_method(spark):
    got = exact_quantiles(frame(spark, range(1, 11)), ["x"], [0.05, 0.25, 0.3, 1.0], method="inverse").collect()
    assert {r["prob"]: r["value"] for r in got} == {0.05: 1.0, 0.25: 3.0, 0.3: 3.0, 1.0: 10.0}


def test_only_few_rows_are_ordered_whatever_the_values(spark, monkeypatch):
    import random

    from cindermap.operators import quantiles as Q

    r = random.Random(2)
    tail = [math.exp(r.gauss(0, 30)) for _ in range(20000)]  # nearly all of the range is empty
    values = tail + [-v for v in tail] + [0.0] * 9000 + [7.0] * 9000
    seen = []
    ordered = Q._ordered
    monkeypatch.setattr(Q, "_ordered", lambda v, intervals: seen.extend(intervals) or ordered(v, intervals))
    monkeypatch.setattr(Q, "ORDERED", 40)
    got = {r["prob"]: r["value"] for r in exact_quantiles(frame(spark, values), ["x"], PROBS, accuracy=100).collect()}
    for p in PROBS:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert seen and max(interval.inside for interval in seen) <= 40


def test_ranks_of_shares_are_whole_numbers(spark):
    got = exact_quantiles(frame(spark, range(1, 101)), ["x"], [0.55, 0.07, 0.29], method="inverse").collect()
    assert {r["prob"]: r["value"] for r in got} == {0.55: 55.0, 0.07: 7.0, 0.29: 29.0}


def test_summary_table(spark):
    got = summary_table(frame(spark, [1, 2, 3, 4, None]), ["x"]).first()
    assert got["n"] == 4 and got["mean"] == 2.5 and got["p25"] == 1.75 and got["median"] == 2.5 and got["max"] == 4.0
    assert got["sd"] == pytest.approx(np.std([1, 2, 3, 4], ddof=1))


@pytest.mark.parametrize("name", ["normal", "cubed"])
def test_balscale_properties(spark, name):
    values = samples()[name][:2000]
    out = S.balscale(frame(spark, values), "x", "s", factor=1.0).orderBy("x").collect()
    scores = [r["s"] for r in out]
    assert all(0.0 <= s <= 1.0 for s in scores)
    assert scores == sorted(scores)
    x = np.array([r["x"] for r in out])
    want = 0.75 / (1 + np.exp(-(x - x.mean()) / x.std(ddof=1))) + 0.25 * (x - x.min()) / (x.max() - x.min())
    assert np.allclose(scores, want)


def test_scaling_edges(spark):
    nan = float("nan")
    assert rows(S.balscale(frame(spark, [2, 2]), "x", "s").select("s")) == [(None,), (None,)]
    assert rows(S.balscale(frame(spark, [1]), "x", "s").select("s")) == [(None,)]
    assert rows(S.normalize(frame(spark, [1, None, nan, 3]), "x", "s").select("i", "s")) == [(0, 0.0), (1, None), (2, None), (3, 1.0)]
    assert rows(S.balscale(frame(spark, []), "x", "s")) == []


def test_scoped_scaling(spark):
    df = spark.createDataFrame([(1, 200, 5.0), (2, 201, 1.0), (3, 500, 3.0), (4, None, 9.0)], "i int, p long, x double")
    out = {r["i"]: r["s"] for r in S.balscale(df, "x", "s", where=F.col("p") > 200).collect()}
    assert out[1] is None and out[4] is None
    z = 1 / math.sqrt(2)
    assert out[3] == pytest.approx(100 * (0.75 / (1 + math.exp(-z)) + 0.25))


def test_bins_are_right_closed(spark):
    df = frame(spark, [0, 1, 1.5, 2, 3, -1, 4, None])
    out = B.cut(df, "x", B.given_breaks([0, 1, 2, 3]), 4)
    assert [r[1] for r in rows(out.select("i", "bin"))] == [1, 1, 2, 2, 3, None, None, None]
    counts = B.bin_counts(df, "x", B.given_breaks([0, 1, 2, 3]), 4, F.col("x") == 1.5)
    assert rows(counts.select("bin", "n", "low", "high", "label")) == [
        (1, 2, 0.0, 1.0, "2 (0.000, 1.000)"), (2, 1, 1.0, 2.0, "1 (1.000, 2.000)"), (3, 1, 2.0, 3.0, "1 (2.000, 3.000)")]


def test_breaks_and_histogram(spark):
    df = frame(spark, [0, 1, 2, 3, 4, 10])
    got = df.select(B.fixed_breaks(df, "x", 6).alias("b"), B.quantile_breaks(df, "x", 3).alias("q")).first()
    assert got["b"] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0] and got["q"] == [0.0, 2.5, 10.0]
    assert rows(B.histogram(df, "x", 5).select("bin", "n")) == [(1, 3), (2, 2), (3, 0), (4, 0), (5, 1)]


@pytest.mark.parametrize("bins", [7, 50])
def test_histogram_matches_brute_force(spark, bins):
    values = [round(v, 1) for v in samples()["normal"][:3000]]
    lo, hi = min(values), max(values)
    edges = [lo + (hi - lo) / bins * i for i in range(bins)] + [hi]
    want = [sum((v > a or (i == 0 and v == a)) and v <= b for v in values) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert [r["n"] for r in B.histogram(frame(spark, values), "x", bins).orderBy("bin").collect()] == want


def test_dense_index_and_chunks(spark):
    df = spark.range(0, 1003, 1, 7).select((F.col("id") % 2).alias("g"), "id")
    ranked = K.dense_index(df, [F.desc("g"), "id"], "r", partitions=5).collect()
    order = sorted(range(1003), key=lambda i: (-(i % 2), i))
    assert {r["id"]: r["r"] for r in ranked} == {v: n for n, v in enumerate(order, 1)}
    sizes = rows(K.chunk_ids(df, 10, ["id"]).groupBy("chunk").agg(F.count("*"), F.min("id")))
    assert sizes == [(1, 101, 0), (2, 101, 101), (3, 101, 202)] + [(c, 100, 303 + 100 * (c - 4)) for c in range(4, 11)]
    assert sorted(r["chunk"] for r in K.chunk_ids(spark.range(3), 5, ["id"]).collect()) == [1, 2, 3]


def test_imputation(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1.0, "b"), (2, nan, None), (3, 10.0, "a"), (4, 4.0, "b"), (5, None, "a")], "i int, x double, t string")
    assert [r[1:] for r in rows(P.central_impute(df, ["x"], ["t"]))] == [(1.0, "b"), (4.0, "a"), (10.0, "a"), (4.0, "b"), (4.0, "a")]
    assert [r[1] for r in rows(P.mean_impute(df, ["x"]))] == [1.0, 5.0, 10.0, 4.0, 5.0]


def test_near_zero_variance(spark):
    data = [(0 if i < 96 else 1, 5, i, None, i % 2) for i in range(100)]
    df = spark.createDataFrame(data, "few int, one int, all int, none int, even int")
    got = {r["column"]: (r["freq_ratio"], r["percent_unique"], r["nzv"]) for r in P.near_zero_variance(df, df.columns).collect()}
    assert got == {"few": (24.0, 2.0, True), "one": (0.0, 1.0, True), "all": (1.0, 100.0, False), "none": (0.0, 0.0, True), "even": (1.0, 2.0, False)}
    assert P.drop_near_zero_variance(df, df.columns).columns == ["all", "even"]


def test_weights_and_centering(spark):
    df = frame(spark, [1, 2, 5])
    assert [r[1] for r in rows(P.scaled_weights(df, "x").select("i", "weight"))] == [0.2, 0.4, 1.0]
    assert [r[1] for r in rows(P.l1_weights(df, "x").select("i", "weight"))] == [0.125, 0.25, 0.625]
    assert sum(r["x"] for r in P.center_scale(df, ["x"]).collect()) == pytest.approx(0.0)
