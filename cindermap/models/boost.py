"""Gradient boosting of tables that one task holds (M7): a whole ensemble is one task, instead of some Spark jobs for each of its trees.

The trees are those of Spark ML's ``OneVsRest(GBTClassifier)``: one binary ensemble per class on labels of -1 and 1, log loss, variance
splits over ``BINS`` bins, the first tree in full and the others by the step. Bins come from all rows, not from a sample of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.models.classify import BINS
from cindermap.operators.sample import with_fold

TASK_BYTES = 64 << 20  # of features that a task holds; larger tables are boosted by Spark ML, whose fits deal rows over tasks


@dataclass
class Ensemble:
    """Trees of one binary model, each filled up to its depth: a node that is not split sends all rows to the left."""

    feature: np.ndarray  # trees x inner nodes, level by level
    threshold: np.ndarray  # rows above it go to the right
    leaf: np.ndarray  # trees x leaves, by the step

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.zeros(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < len(feature):  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


@dataclass
class BoostedModel:
    ensembles: list[Ensemble]  # by class

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``: the class of the largest margin, ties to the first class."""
        ensembles = self.ensembles

        @F.arrow_udf("double")
        def said(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.float64())
            wide = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
            return pa.array(np.argmax([e.margin(wide) for e in ensembles], axis=0).astype(float))

        return df.withColumn("prediction", said(vector_to_array("features")))


def split_points(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between at most ``bins`` bins of one feature: between all values if there are few, else at even shares of the rows."""
    values, counts = np.unique(x, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) < bins:
        return middle
    upto = np.cumsum(counts)
    near = (upto[:-1] + upto[1:]) / 2  # a share up to here is nearer to the rows before the threshold than to those with the next value
    stride = len(x) / bins
    found, wanted, at = [], stride, 0
    while (at := max(at, int(np.searchsorted(near, wanted, "right")))) < len(middle):
        found.append(middle[at])
        wanted, at = wanted + stride, at + 1
    return np.array(found)


def binned(x: np.ndarray, splits: Sequence[np.ndarray]) -> np.ndarray:
    """Features x rows: the number of thresholds below a value."""
    return np.array([np.searchsorted(s, column, "left") for s, column in zip(splits, x.T)], dtype=np.uint8).reshape(len(splits), len(x))


def grow(bins: np.ndarray, target: np.ndarray, depth: int, min_rows: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One regression tree: (feature, last bin to the left) of its inner nodes, means of its leaves, leaf of each row.

    ``first`` are the rows per feature and bin, which all trees share on their first level.
    """
    width, n = bins.shape
    feature, last = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, 255)
    node, rows, mean, squared = np.zeros(n, dtype=np.int64), np.arange(n), np.array([target.mean()]), target * target
    for level in range(depth):
        nodes, start = 2**level, 2**level - 1
        at = node * BINS
        counts, sums, squares = (np.empty((nodes, width, BINS)) for _ in range(3))
        for j in range(width):
            cell = at + bins[j]
            sums[:, j] = np.bincount(cell, target, nodes * BINS).reshape(nodes, BINS)
            squares[:, j] = np.bincount(cell, squared, nodes * BINS).reshape(nodes, BINS)
            counts[:, j] = first[j] if level == 0 else np.bincount(cell, minlength=nodes * BINS).reshape(nodes, BINS)
        n_left, left, left2 = counts.cumsum(axis=2), sums.cumsum(axis=2), squares.cumsum(axis=2)
        n_total, total, total2 = (a[:, :, -1:] for a in (n_left, left, left2))
        n_right, right, right2 = n_total - n_left, total - left, total2 - left2
        # by Spark ML's steps, so that of splits equally good but for rounding the same one is taken
        with np.errstate(divide="ignore", invalid="ignore"):
            of_left, of_right = (left2 - left * left / n_left) / n_left, (right2 - right * right / n_right) / n_right
            gain = (total2 - total * total / n_total) / n_total - n_left / n_total * of_left - n_right / n_total * of_right
        gain = np.where((n_left >= min_rows) & (n_right >= min_rows), gain, -np.inf).reshape(nodes, width * BINS)
        best = gain.argmax(axis=1)
        split = np.flatnonzero(gain[np.arange(nodes), best] > 0)
        if not len(split):  # nor is any below
            return feature, last, np.repeat(mean, 2 ** (depth - level)), node << (depth - level)
        f, b = np.divmod(best[split], BINS)
        feature[start + split], last[start + split] = f, b
        mean = np.repeat(mean, 2)
        mean[2 * split] = left[split, f, b] / n_left[split, f, b]
        mean[2 * split + 1] = right[split, f, b] / n_right[split, f, b]
        node = 2 * node + (bins[feature[start + node], rows] > last[start + node])
    return feature, last, mean, node


def boost(x: np.ndarray, is_class: np.ndarray, depth: int, min_rows: int, trees: int, step: float, splits: Sequence[np.ndarray]) -> Ensemble:
    """The binary ensemble of one class."""
    bins = binned(x, splits)
    cuts = np.full((len(splits), 256), np.inf)
    for j, s in enumerate(splits):
        cuts[j, : len(s)] = s
    first = np.array([np.bincount(row, minlength=BINS) for row in bins])
    label = np.where(is_class, 1.0, -1.0)
    margin, target, grown = np.zeros(len(x)), label, []
    for i in range(trees):
        feature, last, mean, leaf = grow(bins, target, depth, min_rows, first)
        mean = mean * (step if i else 1.0)
        grown.append((feature, cuts[feature, last], mean))
        margin += mean[leaf]
        with np.errstate(over="ignore"):
            target = 4.0 * label / (1.0 + np.exp(2.0 * label * margin))
    return Ensemble(*map(np.array, zip(*grown)))


def fits_in_task(df: DataFrame) -> bool:
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(vector_to_array("features")))).first()
    return n * (width or 0) * 8 <= TASK_BYTES


@dataclass
class TaskBoosting:
    """Boosting of rows that ``fits_in_task`` holds for; a setting is (depth, least rows of a leaf)."""

    keys: Sequence[str]
    trees: int
    step: float

    def fit(self, df: DataFrame, setting: tuple[int, int]) -> BoostedModel:
        return BoostedModel(self._ensembles(df.withColumn("__fold", F.lit(0)), [(setting, None)])[0][1])

    def counts(self, df: DataFrame, settings: Sequence[tuple[int, int]], folds: int, seed: int) -> dict[tuple[int, int], Counter]:
        """(setting, fold): (actual, predicted): rows, from models of the rows of the other folds."""
        folded = with_fold(df, self.keys, folds, seed, "__fold")
        out = {}
        for at, (label, margins) in enumerate(self._ensembles(folded, [(s, k) for s in settings for k in range(folds)])):
            said = np.argmax(margins, axis=0).astype(float) if len(label) else label
            out[divmod(at, folds)] = Counter(zip(label.tolist(), said.tolist()))
        return out

    def _ensembles(self, df: DataFrame, fits: Sequence[tuple[tuple[int, int], int | None]]) -> list[tuple[np.ndarray, list]]:
        """For each (setting, fold left out): the labels of that fold and by class its margins, or for no fold by class the ensembles.

        The rows go to the tasks as one broadcast; each fit of a class is a task.
        """
        # sorted, so that sums do not depend on the order the rows come in
        table = df.sort(*self.keys).select("__fold", "label", vector_to_array("features").alias("x")).toArrow()
        if table.column(1).null_count:
            raise ValueError("a row has no label")
        if not len(table):
            raise ValueError("no rows to boost")
        fold, label = table.column(0).to_numpy(), table.column(1).to_numpy()
        x = table.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        if any(k is not None and (fold == k).all() for _, k in fits):
            raise ValueError("all rows are in one fold")
        context, trees, step = df.sparkSession.sparkContext, self.trees, self.step
        shared = context.broadcast((x, label, fold))

        def one(task: tuple[int, int, tuple[int, int], int | None]) -> tuple[int, int, np.ndarray | Ensemble]:
            at, c, (depth, min_rows), k = task
            x, label, fold = shared.value
            train = fold != (-1 if k is None else k)
            some = x[train]
            model = boost(some, label[train] == c, depth, min_rows, trees, step, [split_points(column) for column in some.T])
            return at, c, model if k is None else model.margin(x[~train])

        classes = range(int(label.max()) + 1)
        tasks = sorted(((at, c, setting, k) for at, (setting, k) in enumerate(fits) for c in classes), key=lambda t: -t[2][0])  # the longest ones first
        try:
            found = {(at, c): got for at, c, got in context.parallelize(tasks, len(tasks)).map(one).collect()}
        finally:
            shared.unpersist()
        return [(label[fold == k] if k is not None else label[:0], [found[at, c] for c in classes]) for at, (_, k) in enumerate(fits)]
