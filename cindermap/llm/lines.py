"""Removal of passages that repeat: overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.session import materialize


_BLANKS = " \t\x0b\f\r"


def _bare(line: Column) -> Column:
    """A line without white space at its ends, the \\r of a line end included."""
    return F.trim(line, F.lit(_BLANKS))


def line_windows(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per window of ``size`` consecutive lines that are not blank.

    Lines are compared without white space at their ends. (key, text_digest) names the
    document, ``window`` is a 128-bit digest of the lines, ``at`` counts the windows, and ``lines`` holds the
    positions of the window's lines in the text.
    """
    lines = F.filter(
        F.transform(F.split(F.col(text), "\n", -1), lambda line, i: F.struct(i.alias("pos"), F.md5(_bare(line).cast("binary")).alias("h"), (F.length(_bare(line)) > 0).alias("full"))),
        lambda x: x["full"],
    )
    numbered = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.md5(F.col(text).cast("binary")).alias("text_digest"), lines.alias("l"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("l") - F.lit(size)),
        lambda i: F.struct(
            i.alias("at"),
            F.md5(F.concat(*[F.get(F.col("l"), i + F.lit(k))["h"] for k in range(size)]).cast("binary")).alias("window"),
            F.array(*[F.get(F.col("l"), i + F.lit(k))["pos"] for k in range(size)]).alias("lines"),
        ),
    )
    return numbered.filter(F.size("l") >= size).select("key", "text_digest", F.explode(spans).alias("s")).select("key", "text_digest", "s.at", "s.window", "s.lines")


def covered_lines(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_digest, removed): positions of the lines that a repeated window covers, for documents that have any.

    The first occurrence of a window, in the order of key, digest and place, stays; all
    later ones are covered, and covered positions that overlap merge. A later occurrence
    that overlaps the first one itself covers only the lines after it, so that a
    run of equal lines keeps its first ``size``.
    """
    windows = materialize(line_windows(docs, size, key, text), "windows")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("text_digest").alias("digest"), F.col("at").alias("at"))
    # counts first: what is found once, nearly all, never reaches the ordering below
    firsts = windows.groupBy("window").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    firsts = materialize(firsts.select("window", "first"), "repeats")
    same = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("text_digest") == F.col("first.digest"))
    gap = F.when(same, F.col("at") - F.col("first.at")).otherwise(F.lit(size))
    later = windows.join(firsts, "window").withColumn("gap", gap).filter(F.col("gap") > 0)
    cut = F.expr(f"slice(lines, greatest(1, {size} - gap + 1), {size})")
    return later.select("key", "text_digest", F.explode(cut).alias("pos")).groupBy("key", "text_digest").agg(F.collect_set("pos").alias("removed"))


def dedup_lines(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without later occurrences of windows of ``size`` consecutive lines; all columns stay.

    Lines are hashed without white space at their ends; blank lines neither make nor break a
    window and always stay. Documents of fewer lines than ``size`` have no window and stay
    as they are; a null text stays null; a document whose lines all go keeps the empty text. Rows that
    repeat both key and text are one document and get the same result. A null key is the last
    in order. All steps are DataFrame functions; a window that a third of all
    documents share is one row after the map-side combine, and its occurrences are dealt
    by AQE's split of skewed joins, not gathered.
    """
    removed = materialize(covered_lines(docs, size, key, text), "covered").select(
        F.col("key").alias("__key"), F.col("text_digest").alias("__digest"), F.col("removed").alias("__removed")
    )
    # what is removed grows with the documents, so both sides are dealt by key at every size
    joined = docs.join(removed.hint("merge"), F.col(key).eqNullSafe(F.col("__key")) & (F.md5(F.col(text).cast("binary")) == F.col("__digest")), "left")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col("__removed"), i)), "\n")
    return joined.withColumn(text, F.when(F.col("__removed").isNull(), F.col(text)).otherwise(kept)).select(*docs.columns)
