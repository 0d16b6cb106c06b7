"""Counts, means and centred cross products of columns, per fold, in one scan.

Linear methods need nothing else of the rows. The training part of a fold is the whole without the fold, so
cross-validation of any number of settings costs the one scan; what reaches the driver is features x features numbers per fold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHAPE = "fold int, n long, mean binary, products binary"


@dataclass
class Moments:
    """``products``: sums of (x_i - mean_i) (x_j - mean_j)."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def __sub__(self, part: Moments) -> Moments:
        """The rows that are not in ``part``."""
        n = self.n - part.n
        if not part.n or not n:
            return self if n else Moments(0, np.zeros_like(self.mean), np.zeros_like(self.products))
        mean = (self.n * self.mean - part.n * part.mean) / n
        apart = part.mean - mean
        return Moments(n, mean, self.products - part.products - np.outer(apart, apart) * (n * part.n / self.n))

    def squared_error(self, weights: np.ndarray, intercept: float) -> float:
        """Sum of squared errors of predicting the last column from the others."""
        line = np.append(-weights, 1.0)
        return float(line @ self.products @ line + self.n * (line @ self.mean - intercept) ** 2)


def _of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    return Moments(len(x), mean, (x - mean).T @ (x - mean))


def fold_moments(df: DataFrame, columns: Sequence[str], fold: str | None = None) -> dict[int, Moments]:
    """Moments of numeric columns for each value of ``fold`` (one fold, 0, without); rows with a missing value are left out.

    Each task adds up its own rows; tasks meet in two steps, so that no task holds one matrix of each.
    """
    size = len(columns)

    def row(k: int, m: Moments) -> dict:
        return {"fold": k, "n": m.n, "mean": m.mean.astype("<f8").tobytes(), "products": m.products.astype("<f8").tobytes()}

    def table(rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(rows, pa.schema([("fold", pa.int32()), ("n", pa.int64()), ("mean", pa.binary()), ("products", pa.binary())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:]])
            folds = batch.column(0).to_numpy(zero_copy_only=False)
            whole = np.isfinite(x).all(axis=1)
            for k in np.unique(folds[whole]).tolist():
                m = _of(x[whole & (folds == k)])
                held[k] = held[k] + m if k in held else m
        yield from table([row(k, m) for k, m in held.items()]).to_batches()

    def read(rows: pa.Table) -> list[Moments]:
        return [Moments(r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(size, size)) for r in rows.to_pylist()]

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        return table([row(key[0].as_py(), reduce(Moments.__add__, read(rows)))])

    chosen = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    parts = chosen.mapInArrow(count, _SHAPE)
    deals = math.ceil(math.sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = parts.groupBy("fold", F.pmod(F.xxhash64("mean"), F.lit(deals)).alias("deal")).applyInArrow(add, _SHAPE)
    found = some.groupBy("fold").applyInArrow(add, _SHAPE).toArrow()
    return dict(zip(found["fold"].to_pylist(), read(found)))
