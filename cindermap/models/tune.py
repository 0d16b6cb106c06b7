"""Model comparison by grid and cross-validation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.base import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.models.boost import BoostedModel, TaskBoosting, fits_in_task
from cindermap.models.moments import Moments, fold_moments
from cindermap.models.pls import PlsModel, pls_models, with_indicators
from cindermap.operators.sample import with_fold


ROWS_PER_TASK = 50_000  # of a search: a task of fewer rows costs more for its start and its sums than for the rows


@dataclass
class Tuned:
    model: Model | BoostedModel
    results: list[tuple[str, float]]  # (settings, mean metric over the folds)

    @property
    def best(self) -> tuple[str, float]:
        return max(self.results, key=lambda r: r[1])


@dataclass
class Searched:
    """Confusion counts of every setting and fold, from which any metric is read; a model is fitted for the best setting of a metric."""

    estimator: Estimator | TaskBoosting
    settings: list[tuple[str, dict | tuple]]
    counts: dict[tuple[int, int], dict[tuple[float, float], int]]  # (setting, fold): (actual, predicted): rows
    rows: DataFrame

    def results(self, metric: str) -> list[tuple[str, float]]:
        out = []
        for i, (name, _) in enumerate(self.settings):
            marks = [agreement_of(counts)[metric] or 0.0 for (setting, _), counts in sorted(self.counts.items()) if setting == i]
            out.append((name, sum(marks) / max(len(marks), 1)))
        return out

    def tuned(self, metric: str) -> Tuned:
        results = self.results(metric)
        best = max(range(len(results)), key=lambda i: results[i][1])
        return Tuned(self.estimator.fit(self.rows, self.settings[best][1]), results)


def agreement_of(counts: Mapping[tuple[float, float], int]) -> dict[str, float | None]:
    """Accuracy and Kappa of confusion counts."""
    n = sum(counts.values())
    if not n:
        return {"accuracy": None, "kappa": None}
    actual, predicted = Counter(), Counter()
    for (a, p), m in counts.items():
        actual[a] += m
        predicted[p] += m
    seen = sum(m for (a, p), m in counts.items() if a == p) / n
    chance = sum(actual[c] * predicted[c] for c in actual) / n**2
    return {"accuracy": seen, "kappa": (seen - chance) / (1 - chance) if chance < 1 else 0.0}


def fits_at_once(tasks: int, cores: int, parallelism: int) -> int:
    """Fits that run side by side: as many as fill the cores with ``tasks`` tasks each, ``parallelism`` at least."""
    return max(parallelism, cores // max(tasks, 1))


def _search(df: DataFrame, estimator: Estimator, grid: list, keys: Sequence[str], folds: int, seed: int, parallelism: int) -> Searched:
    """Fit every setting once per fold and count what it says of the rows left out. ``df`` has ``features``, ``label`` and the key columns.

    A fit has one task per ``ROWS_PER_TASK`` rows, and cores that one fit leaves idle take other fits: few rows make
    many fits of one task, many rows few fits of many tasks.
    """
    parts = max(1, ceil(df.count() / ROWS_PER_TASK))
    # sorted, so that a search draws the same samples whatever order the rows come in
    ready = with_fold(df, keys, folds, seed, "__fold").repartition(parts, *keys).sortWithinPartitions(*keys).persist()
    ready.count()  # once, before all fits ask for it at the same time
    threads = fits_at_once(parts, df.sparkSession.sparkContext.defaultParallelism, parallelism)
    names = [", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)) for m in grid]

    def one(task: tuple[int, int]) -> dict[tuple[float, float], int]:
        setting, k = task
        model = estimator.fit(ready.filter(F.col("__fold") != k).select("features", "label"), grid[setting])
        held = model.transform(ready.filter(F.col("__fold") == k).select("features", "label"))
        # classes x classes rows
        return {(r["label"], r["prediction"]): r["n"] for r in held.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()}

    tasks = [(setting, k) for k in range(folds) for setting in range(len(grid))]
    try:
        with ThreadPoolExecutor(threads) as pool:
            counts = dict(zip(tasks, pool.map(one, tasks)))
    finally:
        ready.unpersist()
    return Searched(estimator, list(zip(names, grid)), counts, df)


def boosting_grid(
    df: DataFrame,
    keys: Sequence[str],
    depths: Sequence[int] = (1, 2, 3, 4),
    min_rows: Sequence[int] = (10, 20),
    trees: int = 300,
    step: float = 0.1,
    folds: int = 2,
    seed: int = 12,
    parallelism: int = 2,
) -> Tuned:
    """M7: gradient boosting, one binary ensemble per class (boosting in Spark ML is binary).

    A table that a task holds is boosted by tasks of whole ensembles, a larger one by Spark ML, for which each tree is some jobs.
    """
    if fits_in_task(df):
        pairs = [(d, m) for d in depths for m in min_rows]
        boosting = TaskBoosting(keys, trees, step)
        named = [(f"maxDepth={d}, minInstancesPerNode={m}", (d, m)) for d, m in pairs]
        return Searched(boosting, named, boosting.counts(df, pairs, folds, seed), df).tuned("accuracy")
    boost = GBTClassifier(maxIter=trees, stepSize=step, seed=seed)
    grid = ParamGridBuilder().addGrid(boost.maxDepth, list(depths)).addGrid(boost.minInstancesPerNode, list(min_rows)).build()
    return _search(df, OneVsRest(classifier=boost, parallelism=4), grid, keys, folds, seed, parallelism).tuned("accuracy")


def forest_grid(
    df: DataFrame,
    keys: Sequence[str],
    per_split: Sequence[int] = (8, 9, 10, 11, 12, 13, 14),
    trees: int = 200,
    depth: int = 10,
    folds: int = 2,
    seed: int = 12,
    parallelism: int = 2,
) -> Searched:
    """M8: forest over the number of features per split; ``tuned`` gives the best by accuracy or by Kappa from the same fits."""
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    grid = ParamGridBuilder().addGrid(forest.featureSubsetStrategy, [str(m) for m in per_split]).build()
    return _search(df, forest, grid, keys, folds, seed, parallelism)


def network_grid(
    df: DataFrame,
    keys: Sequence[str],
    n_features: int,
    n_classes: int,
    sizes: Sequence[int] = (1, 2, 3, 4),
    max_iter: int = 100,
    folds: int = 2,
    seed: int = 12,
    parallelism: int = 2,
) -> Tuned:
    """One hidden layer of 1-4 units on scaled features. Spark ML has no weight decay; the grid leaves it out."""
    net = MultilayerPerceptronClassifier(maxIter=max_iter, seed=seed)
    grid = ParamGridBuilder().addGrid(net.layers, [[n_features, s, n_classes] for s in sizes]).build()
    return _search(df, net, grid, keys, folds, seed, parallelism).tuned("accuracy")


def pls_grid(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    target: str,
    components: Sequence[int] = (1, 2, 3),
    folds: int = 2,
    seed: int = 12,
) -> tuple[PlsModel, list[tuple[str, float]]]:
    """M9: number of components by cross-validated accuracy, then a fit on all rows.

    One scan takes the cross products of each fold, from which come the models of every fold and number of components; a second
    one counts what all of them say of the rows left out.
    """
    classes, wide, columns = with_indicators(with_fold(df, keys, folds, seed, "__fold"), features, target)
    ready = wide.select(target, "__fold", *columns).persist()
    try:
        parts = fold_moments(ready, columns, "__fold")
        whole = reduce(Moments.__add__, parts.values())
        models = {k: pls_models(whole - part, features, classes, components) for k, part in parts.items()}

        def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter = Counter()
            for batch in batches:
                actual, fold = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]])
                for k in np.unique(fold).tolist():
                    rows = np.flatnonzero(fold == k)
                    for i, model in enumerate(models[k]):
                        said = (x[rows] @ model.weights + model.intercepts).argmax(axis=1)
                        seen.update((k, i, actual[r] == classes[s]) for r, s in zip(rows.tolist(), said.tolist()))
            table = [{"fold": k, "i": i, "right": right, "n": n} for (k, i, right), n in seen.items()]
            yield from pa.Table.from_pylist(table, pa.schema([("fold", pa.int32()), ("i", pa.int32()), ("right", pa.bool_()), ("n", pa.int64())])).to_batches()

        rated = ready.select(target, "__fold", *features).dropna().mapInArrow(rate, "fold int, i int, right boolean, n long")
        marks = rated.groupBy("fold", "i").agg((F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")).collect()
    finally:
        ready.unpersist()
    results = [(f"components={c}", sum(m["accuracy"] for m in marks if m["i"] == i) / max(len(parts), 1)) for i, c in enumerate(components)]
    best = components[max(range(len(components)), key=lambda i: results[i][1])]
    return pls_models(whole, features, classes, [best])[0], results
