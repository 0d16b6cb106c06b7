import numpy as np
import pytest
from conftest import rows
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cindermap.catalogue import QUERIES
from cindermap.models import boost, tune
from cindermap.plans import compare


class Enough(Exception):
    pass


def test_model_comparison_boosts_all_trees(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    spark.createDataFrame([(i, i % 9, [float(v) for v in r.normal(size=64)]) for i in range(150)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen, plain = [], tune.boosting_grid

    def recorded(*args, **more):
        seen.append(plain(*args, **more))
        raise Enough

    monkeypatch.setattr(compare, "boosting_grid", recorded)
    with pytest.raises(Enough):
        QUERIES["model_comparison"](spark, str(tmp_path))
    assert len(seen[0].results) == 8 and [len(e.leaf) for e in seen[0].model.ensembles] == [300] * 3


def labelled(spark, n=600):
    # many values, few values and one value; the classes lie across them, and some rows are of another class
    r = np.random.default_rng(7)
    a, b = r.normal(size=n), r.integers(0, 5, size=n)
    label = np.where(r.random(n) < 0.1, r.integers(0, 3, size=n), (a > 0.3).astype(int) + (b > 2))
    df = spark.createDataFrame([(i, [float(a[i]), float(b[i]), 1.0, float(a[i] * b[i])], float(label[i])) for i in range(n)], "id long, x array<double>, label double")
    return df.select("id", array_to_vector("x").alias("features"), "label")


def test_tasks_grow_the_trees_of_spark_ml(spark, monkeypatch):
    df, grid = labelled(spark), {"depths": (1, 3), "min_rows": (1, 20), "trees": 6}
    tasks = tune.boosting_grid(df, ["id"], **grid)
    assert isinstance(tasks.model, boost.BoostedModel)
    monkeypatch.setattr(boost, "TASK_BYTES", 0)
    jobs = tune.boosting_grid(df, ["id"], **grid)
    assert not isinstance(jobs.model, boost.BoostedModel) and tasks.results == jobs.results and tasks.best[1] > 0.7
    said = [rows(t.model.transform(df).select("id", "prediction")) for t in (tasks, jobs)]
    assert said[0] == said[1] and len({p for _, p in said[0]}) == 3


def test_all_rows_are_counted_however_they_are_dealt(spark):
    df, boosting = labelled(spark, 200), boost.TaskBoosting(["id"], 4, 0.1)
    counts = [boosting.counts(df.repartition(n, F.col("id") % m), [(1, 10), (2, 10)], 3, 12) for n, m in ((1, 1), (5, 3))]
    assert counts[0] == counts[1] and set(counts[0]) == {(s, k) for s in (0, 1) for k in (0, 1, 2)}
    assert all(sum(sum(counts[0][s, k].values()) for k in range(3)) == 200 for s in (0, 1))


def test_bins_are_even_and_keep_few_values_apart():
    assert list(boost.split_points(np.array([3.0, 1.0, 1.0, 2.0]))) == [1.5, 2.5] and not len(boost.split_points(np.ones(9)))
    many = boost.split_points(np.arange(3200.0))
    assert len(many) == 31 and set(np.bincount(np.searchsorted(many, np.arange(3200.0)))) == {100}


def test_rows_without_label_and_a_lone_fold_are_errors(spark):
    df = labelled(spark, 20)
    with pytest.raises(ValueError, match="no label"):
        boost.TaskBoosting(["id"], 2, 0.1).fit(df.withColumn("label", F.when(F.col("id") > 0, F.col("label"))), (1, 1))
    with pytest.raises(ValueError, match="one fold"):
        boost.TaskBoosting(["id"], 2, 0.1).counts(df.limit(1), [(1, 1)], 2, 12)
