"""Contiguous shards of near equal byte size from global prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.llm.common import running_totals
from cindermap.session import materialize

ROW_BYTES = 8  # what a row takes besides its text


def text_bytes(text: str | Column = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def shard_by_bytes(docs: DataFrame, shards: int, carry: Sequence[str] = (), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal documents to shards 0 to ``shards - 1``, contiguous in the order of ``key``, at equal targets of bytes.

    Each range of the order sums its own sizes; prefix sums over the ranges give each
    document the bytes before it, and the middle of the document falls into one of
    ``shards`` equal stretches of the whole. A shard's size is thus within one document of
    the target at either end. Only (key, size, checksum, ``carry``) is shuffled.

    Returns key, size, text_crc32, shard, slot (its place in the shard, from 0), ``carry``.
    A null text has no bytes and the checksum of the empty text, a null key comes first,
    rows with one key follow each other by checksum, repeated rows all count. A document
    larger than a target leaves its neighbours' shards empty. No rows give no rows.
    """
    sized = docs.select(
        F.col(key).alias(key),
        text_bytes(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        *[c for c in carry if c not in (key, "size", "text_crc32")],
    )
    summed = running_totals(sized, "size", [key, "text_crc32"])
    # twice the middle of the document against twice the whole; decimals, as bytes times shards can pass 63 bits
    middle = (F.col("before") * F.lit(2) + F.col("size")).cast("decimal(22,0)") * F.lit(shards).cast("decimal(10,0)")
    shard = F.floor(middle / (F.col("total").cast("decimal(22,0)") * F.lit(2)).cast("decimal(22,0)"))
    placed = materialize(
        summed.withColumn("shard", F.least(shard.cast("int"), F.lit(shards - 1))).drop("before", "total", "n_rows"), "shards"
    )
    firsts = placed.groupBy("shard").agg(F.min("position").alias("__first"))  # at most one row per shard
    return placed.join(firsts, "shard").withColumn("slot", F.col("position") - F.col("__first")).drop("position", "__first")
