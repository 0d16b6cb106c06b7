from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cindermap.models import tune


def test_fits_fill_the_cores():
    assert tune.fits_at_once(1, 12, 2) == 12 and tune.fits_at_once(4, 12, 2) == 3
    assert tune.fits_at_once(40, 12, 2) == 2  # many rows: few fits of many tasks


def test_a_search_of_few_rows_runs_many_fits_of_one_task(spark, monkeypatch):
    rows = [(i, Vectors.dense([float(i % 7), float(i % 5)]), float(i % 7 > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, ["id", "features", "label"])
    seen, plain = [], tune.ThreadPoolExecutor
    monkeypatch.setattr(tune, "ThreadPoolExecutor", lambda n: seen.append(n) or plain(n))
    results = [tune.forest_grid(df.repartition(n, F.col("id") % m), ["id"], per_split=(1, 2), trees=3, depth=3) for n, m in ((1, 1), (6, 4))]
    assert seen == [spark.sparkContext.defaultParallelism] * 2
    # the same rows give the same counts however they are dealt
    assert results[0].counts == results[1].counts and sum(results[0].counts[0, 0].values()) + sum(results[0].counts[0, 1].values()) == 300
    monkeypatch.setattr(tune, "ROWS_PER_TASK", 50)
    split = tune.forest_grid(df, ["id"], per_split=(1,), trees=3, depth=3)
    assert seen[-1] == 2 and sum(sum(c.values()) for c in split.counts.values()) == 300
