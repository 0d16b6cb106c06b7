"""Packing of token pieces into fixed windows by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.llm.common import running_totals
from cindermap.llm.tokens import encoder
from cindermap.session import materialize

_BATCH_BYTES = 8 << 20  # ids in one Arrow batch on the way out of Python

_PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, leading_space: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and its end id, cut every ``window`` ids.

    Returns doc_id, start, length, doc_tokens and ids (little-endian unsigned 32-bit). A null
    or empty text is its end id alone; a long text is cut as it is encoded.
    """
    step = 4 * window
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, leading_space, special_as_text=False), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out, held = [], 0
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(body.as_py() or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    out.append((doc, at // 4, len(part) // 4, len(ids) // 4, part))
                held += len(ids)
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, _PIECES)


def fullest(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of lengths, the longest one left included, that leaves the least room in a window.

    Subset sums as bits of one integer: after each length the bits tell which sums its
    copies and those of the lengths before can make. The best sum is traced back through them.
    """
    longest = max(counts)
    room = window - longest
    lengths = [(n, min(c - (n == longest), room // n)) for n, c in sorted(counts.items(), reverse=True)]
    mask, reach = (1 << (room + 1)) - 1, [1]
    steps = []
    for n, c in lengths:
        size = 1
        while c > 0:  # copies in powers of two: any number up to c can be made
            take = min(size, c)
            steps.append((n, take))
            reach.append((reach[-1] | reach[-1] << n * take) & mask)
            c, size = c - take, size * 2
    best = reach[-1].bit_length() - 1
    chosen = {longest: 1}
    for (n, take), before in zip(reversed(steps), reversed(reach[:-1])):
        if not before >> best & 1:
            chosen[n] = chosen.get(n, 0) + take
            best -= n * take
    return chosen


def window_plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """Windows for ``counts`` pieces of each length, as runs of equal windows.

    Each run repeats one best filling as often as the counts allow, which uses up one of its
    lengths, so there are few runs whatever the number of pieces. A row is (length, first rank, end rank,
    pieces of this length per window, first window, offset of the first such piece).
    """
    left, rank, plan, first = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        chosen = fullest(left, window)
        times = min(left[n] // c for n, c in chosen.items())
        offset = 0
        for n, c in sorted(chosen.items(), reverse=True):
            plan.append((n, rank[n], rank[n] + c * times, c, first, offset))
            rank[n], left[n], offset = rank[n] + c * times, left[n] - c * times, offset + n * c
            if not left[n]:
                del left[n]
        first += times
    return plan


def pack(pieces: DataFrame, window: int, length: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Adds sequence_id and offset (of a piece in its sequence) to pieces of 1 to ``window`` tokens.

    Minimum bin slack over the lengths alone: the number of pieces of every length, at most ``window`` numbers, is
    what the plan is made from, whatever the number of pieces. Pieces are ranked within their length
    by global positions, and the rank says which window and which place in it. Every
    sequence is gapless from 0 and has at most ``window`` tokens; only the last runs have room left.
    No pieces give no rows; repeated pieces all count; nulls in ``order`` come first.
    """
    spark = pieces.sparkSession
    ranked = materialize(
        running_totals(pieces.withColumn("__len", F.col(length).cast("int")), "__len", list(order), ["__len"]).drop("before", "total", "n_rows"), "pieces"
    )
    counts = {r[0]: r[1] for r in ranked.groupBy("__len").count().collect()}  # at most ``window`` rows
    if any(not 1 <= n <= window for n in counts):
        raise ValueError(f"pieces must have 1 to {window} tokens, found {min(counts)} to {max(counts)}")
    plan = spark.createDataFrame(window_plan(counts, window), "__l int, __from long, __to long, __per long, __first long, __offset long")
    place = F.col("position") - F.col("__from")
    return (
        ranked.join(F.broadcast(plan), (F.col("__len") == F.col("__l")) & (F.col("position") >= F.col("__from")) & (F.col("position") < F.col("__to")))
        .withColumns(
            {
                "sequence_id": F.col("__first") + F.floor(place / F.col("__per")).cast("long"),
                "offset": F.col("__offset") + (place % F.col("__per")) * F.col("__len").cast("long"),
            }
        )
        .drop("position", "__len", "__l", "__from", "__to", "__per", "__first", "__offset")
    )


def pack_documents(docs: DataFrame, tokenizer: str, window: int, end_id: int, leading_space: bool = True) -> DataFrame:
    """Documents as sequences of at most ``window`` tokens: the pieces with their ids and their places."""
    return pack(token_pieces(docs, tokenizer, window, end_id, leading_space), window)
