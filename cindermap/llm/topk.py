"""Exact top-k inner products by sequential reads of sorted lists (no random access)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.session import materialize

CANDIDATE_ROWS = 8_192  # rows whose lists are sorted and read together
QUERY_ROWS = 512  # queries that read the lists of such rows together
QUERY_BYTES = 32 << 20  # of the queries that are sent to all tasks at once
DEPTHS = (1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 1.0)  # how far lists are read before bounds are compared


def _exact(q: np.ndarray, c: np.ndarray) -> type:
    """The narrowest type in which every inner product is exact."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else object


class Lists:
    """One list per component: the rows of a block by value."""

    def __init__(self, c: np.ndarray):
        self.n, self.dim = c.shape
        self.rows = np.argsort(c, axis=0, kind="stable")
        self.values = np.take_along_axis(c, self.rows, axis=0)

    def part(self, start: int, end: int) -> np.ndarray:
        """Places ``start`` to ``end`` of all lists, as a matrix of rows with zeros for what lies elsewhere."""
        out = np.zeros((self.n, self.dim), self.values.dtype)
        np.put_along_axis(out, self.rows[start:end], self.values[start:end], axis=0)
        return out

    def unread(self, start: int, end: int, bound: np.ndarray) -> np.ndarray:
        """A matrix of rows with ``bound`` for the components that lie in places ``start`` to ``end``, else zeros."""
        out = np.zeros((self.n, self.dim), self.values.dtype)
        np.put_along_axis(out, self.rows[start:end], np.broadcast_to(bound, (end - start, self.dim)), axis=0)
        return out


def best_in_block(q: np.ndarray, lists: Lists, k: int, own: np.ndarray, bar: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, rows, scores, places read) for every query: the rows of the block that can be among its ``k`` best.

    A list is read from the top where the query's weight is positive and from the bottom where it is negative. What is read is
    added to the running sum of its row once. A row's lower bound is its sum with the far end of each list it was not met in yet, its upper
    bound the sum with the last value read there. Rows whose upper bound is below the k-th best lower bound, or below ``bar``, the
    k-th best score of the query in earlier blocks, are outsiders. A query stops when no outsider is left among
    more than k rows, or none of the block qualifies; the scores of those left are resolved by reading the rest of the lists for them
    alone. ``own[i, j]`` bars row j for query i.
    """
    n = lists.n
    if not n or not len(q):
        return
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    sums = np.zeros((len(q), n), q.dtype)
    reading = np.arange(len(q))
    bar = np.full(len(q), -np.inf) if bar is None else bar
    low, high = (lists.values[0], lists.values[-1]) if lists.dim else (None, None)
    read = 0
    for depth in DEPTHS if lists.dim else (1.0,):
        upto = max(read, math.ceil(n * depth))
        barred = own[reading]
        if lists.dim:
            sums = sums + up[reading] @ lists.part(n - upto, n - read).T + down[reading] @ lists.part(read, upto).T
        read = upto
        if read < n and lists.dim:
            top, bottom = lists.values[n - read], lists.values[read - 1]
            upper = sums + up[reading] @ lists.unread(0, n - read, top).T + down[reading] @ lists.unread(read, n, bottom).T
            lower = sums + up[reading] @ lists.unread(0, n - read, low).T + down[reading] @ lists.unread(read, n, high).T
        else:
            upper = lower = sums
        ranked = np.where(barred, -np.inf, lower)
        best = np.partition(ranked, n - k, axis=1)[:, n - k] if n > k else np.full(len(reading), -np.inf)
        left = (upper >= np.maximum(best, bar[reading])[:, None]) & ~barred
        done = (left.sum(axis=1) <= k) | (read == n)
        rest = (lists.part(0, n - read), lists.part(read, n)) if read < n and lists.dim and (left[done]).any() else None
        for at in np.flatnonzero(done):
            rows = np.flatnonzero(left[at])
            scores = sums[at, rows]
            if rest and len(rows):
                scores = scores + up[reading[at]] @ rest[0][rows].T + down[reading[at]] @ rest[1][rows].T
            yield int(reading[at]), rows, scores, read
        reading, sums = reading[~done], sums[~done]
        if not len(reading):
            return


class _Best:
    """The k best (score, id) of every query over the blocks of a task."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.empty(0, np.int64)] * n, [np.empty(0, object)] * n
        self.bar, self.read, self.places = np.full(n, -np.inf), np.zeros(n, np.int64), 0

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([self.scores[query], scores])
        keep = np.lexsort((ids, -scores))[: self.k]
        self.ids[query], self.scores[query] = ids[keep], scores[keep]
        if len(keep) == self.k:
            self.bar[query] = float(scores[keep[-1]])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.floor(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def _typed(m: np.ndarray, kind: type) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) if kind is object else m.astype(kind)


def top_k(vectors: DataFrame, k: int, is_query: Column, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", report: bool = False) -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows: query_id, rank, key, score.

    Components are floor(``scale`` * x), so scores are whole numbers; ties go to the smaller key. ``is_query``
    picks the queries. They are sent to the tasks in portions of ``QUERY_BYTES`` at most; the candidates stay where they
    are. A task reads its candidates in blocks of ``CANDIDATE_ROWS``, each as sorted lists (see ``best_in_block``), and hands the k-th
    best score of each query on to its next block. It returns k rows per query, so what is shuffled grows with queries times tasks, not with pairs
    of blocks. With ``report``, ``read_share`` is the part of all list places that were read before the query could stop.

    Rows with a null key, a null vector, or a null or non-finite component take no part. Inner products need equal length: vectors of each length are
    searched among themselves, empty ones all with score 0. A component whose ``scale``-fold passes the range of doubles
    raises an error, as its score is no whole number of 63 bits. A query's own row is every
    row with its key; rows that repeat a key are queries and candidates of their own, so ranks of
    such a query repeat. With fewer than k others, all are returned. No rows or no queries give no rows.
    Scores must fit 63 bits.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    sized = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).filter(finite)
    scaled = F.transform(F.col(vector), lambda x: x.cast("double") * F.lit(scale))
    within = F.forall(scaled, lambda x: F.abs(x) < F.lit(float("inf")))
    sized = sized.select(
        F.col(key).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.when(within, scaled).otherwise(F.raise_error(F.lit("a component is too large to be scaled")).cast("array<double>")).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    sized = materialize(sized, "vectors")
    spark, found = vectors.sparkSession, []
    # one row per length
    for dim, asking in sized.filter("asks").groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        portions = math.ceil(asking * (8 * dim + 16) / QUERY_BYTES)
        whole = sized.filter(F.size("v") == dim)
        for portion in range(portions):
            some = whole.filter("asks").filter(F.pmod(F.xxhash64("id", "row"), F.lit(portions)) == portion).select("id", "row", "v").toArrow()
            if some.num_rows:
                found.append(materialize(_portion(whole.select("id", "v"), some, dim, k), "found"))
    shape = "query_id long, query_row long, id long, score long, places long, read long"
    near = spark.createDataFrame([], shape) if not found else found[0]
    for more in found[1:]:
        near = near.union(more)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "id")
    read = F.sum("read").over(Window.partitionBy("query_id", "query_row")) / F.sum("places").over(Window.partitionBy("query_id", "query_row"))
    ranked = near.withColumns({"rank": F.row_number().over(best), "read_share": read}).filter((F.col("rank") <= k) & F.col("id").isNotNull())
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score", *(["read_share"] if report else []))


def _portion(candidates: DataFrame, queries: pa.Table, dim: int, k: int) -> DataFrame:
    """Per task the ``k`` best of its candidates for each of the queries; the first row of a query tells what was read for it."""
    asked = candidates.sparkSession.sparkContext.broadcast(
        (queries["id"].to_numpy(), queries["row"].to_numpy(), _matrix(queries["v"].combine_chunks(), dim))
    )
    schema = pa.schema([(n, pa.int64()) for n in ("query_id", "query_row", "id", "score", "places", "read")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_rows, q = asked.value
        best = _Best(len(q_ids), k)

        def block(ids: np.ndarray, c: np.ndarray) -> None:
            kind = _exact(q, c)
            lists, typed = Lists(_typed(c, kind)), _typed(q, kind)
            best.places += len(ids)
            for s in range(0, len(q_ids), QUERY_ROWS):
                part = slice(s, s + QUERY_ROWS)
                for at, rows, scores, read in best_in_block(typed[part], lists, k, q_ids[part, None] == ids[None, :], best.bar[part]):
                    best.read[s + at] += read
                    if len(rows):
                        best.add(s + at, ids[rows], np.array([int(v) for v in scores], object))

        for batch in batches:
            ids, c = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            for s in range(0, len(ids), CANDIDATE_ROWS):
                block(ids[s : s + CANDIDATE_ROWS], c[s : s + CANDIDATE_ROWS])
        for s in range(0, len(q_ids), 1_000):
            out = []
            for i in range(s, min(s + 1_000, len(q_ids))):
                ids, scores = best.ids[i].tolist() or [None], best.scores[i].tolist() or [None]
                out += [(int(q_ids[i]), int(q_rows[i]), c, v, best.places if j == 0 else 0, int(best.read[i]) if j == 0 else 0) for j, (c, v) in enumerate(zip(ids, scores))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return candidates.mapInArrow(search, "query_id long, query_row long, id long, score long, places long, read long")
