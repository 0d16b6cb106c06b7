"""Collocations: frequent phrases from depth-truncated suffix subtrees, built group by group of word prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.llm.common import running_totals
from cindermap.session import materialize

BUDGET = 200_000  # leaves, counted per task, that one prefix, and one group of prefixes, may have; a group holds less than twice as many
LEAST_BITS, MOST_BITS = 16, 28  # size of the table of pair counters: about one counter for sixteen bytes of text, 2^28 at most
LOCAL_WORDS, LOCAL_ROWS = 200_000, 1_000_000  # what a task keeps before it hands on what it has counted
SHARES = 256  # in which a language's phrases are ranked first
_BLOCK = 1 << 16  # counters of one row
_STOP = b"."  # stands for the end of a piece; no word holds it
_PIECES = bytes(ord(_STOP) if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Words(dict):
    """Numbers of the words of one task; the end of a piece is 0."""

    def __init__(self):
        super().__init__({_STOP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Reader:
    """The texts of a task as arrays of word numbers, and the hashes of the words."""

    def __init__(self):
        self.words, self.names = _Words(), []
        self.hashes = np.empty(0, np.uint64)

    def read(self, texts: Sequence[bytes]) -> np.ndarray:
        """Word numbers of the texts; 0 after each piece and between texts."""
        parts = [np.zeros(1, np.int32)]
        for text in texts:
            words = text.lower().translate(_PIECES).replace(_STOP, b" . ").split()  # bytes: only A-Z change
            words.append(_STOP)
            parts.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        new = list(self.words)[len(self.names) :]
        self.names += new
        self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return np.concatenate(parts)

    def pairs(self, ids: np.ndarray, lang: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether a word and the next one are a pair, the counter of the pair) for all places but the last."""
        h = self.hashes[ids]
        mixed = (h[:-1] * _K1 + h[1:] + np.uint64(xxhash.xxh3_64_intdigest(lang))) * _K2
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _K1
        return (ids[:-1] != 0) & (ids[1:] != 0), (mixed >> np.uint64(64 - bits)).astype(np.uint32)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a batch by language, in portions that bound a task's memory."""
    texts: dict[str, list[bytes]] = {}
    size = 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        body = text.as_py()
        texts.setdefault(lang, []).append(body)
        size += len(body)
        if size > 1 << 24:
            yield from texts.items()
            texts, size = {}, 0
    yield from texts.items()


def _counted(texts: DataFrame, bits: int, limit: int) -> DataFrame:
    """One reading of the texts: rows (lang, word, f) of words, and rows (block, at, times) of the counters of pairs, each per task."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("block", pa.int32()), ("at", pa.binary()), ("times", pa.binary())])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    def words_of(reader: _Reader, seen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in seen.items():
            at = np.flatnonzero(counts)
            at = at[at != 0]
            for i in range(0, len(at), 50_000):
                some = at[i : i + 50_000]
                yield rows(lang=[lang] * len(some), word=[reader.names[j].decode("utf-8", "replace") for j in some], f=counts[some])

    def pairs_of(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        counter, times = np.unique(np.concatenate(found), return_counts=True)
        times = np.minimum(times, limit).astype("<i4")  # a sum of such counts reaches the limit where the true one does
        block = counter // _BLOCK
        cuts = np.flatnonzero(np.diff(block)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(counter)]])
        low = (counter % _BLOCK).astype("<u2")
        for i in range(0, len(starts), 64):
            some = list(zip(starts[i : i + 64], ends[i : i + 64]))
            yield rows(block=[int(block[s]) for s, _ in some], at=[low[s:e].tobytes() for s, e in some], times=[times[s:e].tobytes() for s, e in some])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen, found, n = _Reader(), {}, [], 0
        for batch in batches:
            for lang, texts in _by_lang(batch):
                ids = reader.read(texts)
                counts, old = np.bincount(ids, minlength=len(reader.names)), seen.get(lang)
                if old is not None:
                    counts[: len(old)] += old
                seen[lang] = counts
                pair, counter = reader.pairs(ids, lang, bits)
                found.append(counter[pair])
                n += len(found[-1])
                if n > 4 * LOCAL_ROWS:
                    yield from pairs_of(found)
                    found, n = [], 0
                if len(reader.names) > LOCAL_WORDS:
                    yield from words_of(reader, seen)
                    reader, seen = _Reader(), {}
        yield from words_of(reader, seen)
        yield from pairs_of(found)

    return texts.mapInArrow(count, "lang string, word string, f long, block int, at binary, times binary")


def _often(counted: DataFrame, bits: int, limit: int) -> bytes:
    """One bit per counter: whether the pairs that share it occur ``limit`` times or more. At most 2^MOST_BITS bits.

    The rows of a block are added in two steps, so that no task holds all of them.
    """
    some = counted.filter(F.col("block").isNotNull()).select("block", "at", "times")
    blocks = max(1, (1 << bits) // _BLOCK)
    deals = math.ceil(math.sqrt(some.count() / blocks + 1))

    def total(table: pa.Table) -> np.ndarray:
        out = np.zeros(_BLOCK, np.int64)
        for at, times in zip(table["at"], table["times"]):
            out[np.frombuffer(at.as_py(), "<u2")] += np.frombuffer(times.as_py(), "<i4")
        return np.minimum(out, limit)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        out = total(table)
        at = np.flatnonzero(out)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "at": [at.astype("<u2").tobytes()], "times": [out[at].astype("<i4").tobytes()]})

    def mark(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(total(table) >= limit, bitorder="little").tobytes()]})

    once = some.groupBy("block", F.pmod(F.xxhash64("at"), F.lit(deals)).alias("deal")).applyInArrow(add, "block int, at binary, times binary")
    marked = dict(once.groupBy("block").applyInArrow(mark, "block int, bits binary").collect())
    return b"".join(bytes(marked.get(b, bytes(_BLOCK // 8))) for b in range(blocks))


_LEAVES = "lang string, prefix string, leaves int, suffixes array<string>, totals array<long>"
_LEAVES_SCHEMA = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("leaves", pa.int32()), ("suffixes", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])


def _leaf_rows(langs: list[str], prefixes: list[str], sizes: np.ndarray, suffixes: list, totals) -> pa.RecordBatch:
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(values, kind)) for values, kind in ((suffixes, pa.string()), (totals, pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(prefixes, pa.string()), pa.array(sizes, pa.int32()), *lists], schema=_LEAVES_SCHEMA)


def _suffixes(texts: DataFrame, often, bits: int, depth: int) -> DataFrame:
    """Per task and first word one row of suffixes with their totals: the words from a place on, cut at the first pair that cannot be frequent or after ``depth`` words.

    Equal suffixes of a task are one. Places whose first pair is not frequent give none.
    """

    def totals(reader: _Reader, kept: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in kept.items():
            m = np.concatenate(parts)
            m = m[np.lexsort(m.T[::-1])]
            first = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]).any(axis=1)]))
            total = np.diff(np.concatenate([first, [len(m)]]))
            m, names = m[first], reader.names
            word = np.concatenate([[0], np.flatnonzero(np.diff(m[:, 0])) + 1, [len(m)]])  # where first words begin
            at = 0
            while at < len(word) - 1:
                upto = max(at + 1, int(np.searchsorted(word, word[at] + 50_000, "right")) - 1)
                rows = slice(word[at], word[upto])
                text = [b" ".join([names[j] for j in row if j]) for row in m[rows].tolist()]
                heads = [names[j] for j in m[word[at:upto], 0].tolist()]
                yield _leaf_rows([lang] * len(heads), heads, np.diff(word[at : upto + 1]), text, total[rows])
                at = upto

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(often.value, np.uint8)
        reader, kept, n = _Reader(), {}, 0
        for batch in batches:
            for lang, texts in _by_lang(batch):
                ids = reader.read(texts)
                pair, counter = reader.pairs(ids, lang, bits)
                go = pair & ((bitmap[counter >> 3] >> (counter & 7).astype(np.uint8)) & 1).astype(bool)
                at = np.flatnonzero(go)
                if not len(at):
                    continue
                m = np.zeros((len(at), depth), np.int32)
                m[:, 0], m[:, 1], alive = ids[at], ids[at + 1], np.ones(len(at), bool)
                for k in range(2, depth):
                    # the last place ends a piece, so a pair that goes on never starts there
                    alive = alive & go[np.minimum(at + k - 1, len(go) - 1)]
                    m[alive, k] = ids[at[alive] + k]
                kept.setdefault(lang, []).append(m)
                n += len(m)
            if n > LOCAL_ROWS or len(reader.names) > LOCAL_WORDS:
                yield from totals(reader, kept)
                reader, kept, n = _Reader(), {}, 0
        yield from totals(reader, kept)

    return texts.mapInArrow(cut, _LEAVES)


def _lengthened(rows: DataFrame, k: int) -> DataFrame:
    """Rows with prefixes of ``k`` words; a shorter suffix is a prefix of its own."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, suffixes, totals in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
                parts: dict[str, list[tuple[str, int]]] = {}
                for suffix, total in zip(suffixes.as_py(), totals.as_py()):
                    parts.setdefault(" ".join(suffix.split(" ", k)[:k]), []).append((suffix, total))
                each = [leaf for part in parts.values() for leaf in part]
                yield _leaf_rows([lang] * len(parts), list(parts), np.array([len(p) for p in parts.values()]), [s for s, _ in each], [t for _, t in each])

    return rows.mapInArrow(split, _LEAVES)


def _groups(rows: DataFrame, depth: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the group of their prefix: one word, more where more than ``budget`` leaves begin alike; and the nodes above prefixes.

    A prefix of ``depth`` words has one leaf per task, so the lengthening ends. Prefixes in the order of language and words are
    cut into groups by the running sum of their leaves.
    """
    done: list[DataFrame] = []
    sizes: list[DataFrame] = []
    tops = [rows.sparkSession.createDataFrame([], "lang string, phrase string, words int, a long")]
    for k in range(1, depth + 1):
        counts = materialize(rows.groupBy("lang", "prefix").agg(F.sum("leaves").alias("leaves")), "prefixes")
        fits = F.col("leaves") <= F.lit(budget) if k < depth else F.lit(True)
        heavy = materialize(counts.filter(~fits).select("lang", "prefix"), "crowded")  # at most leaves / budget rows
        sizes.append(counts.filter(fits))
        if heavy.isEmpty():
            done.append(rows.withColumn("k", F.lit(k)))
            break
        done.append(rows.join(heavy, ["lang", "prefix"], "left_anti").withColumn("k", F.lit(k)))
        rows = rows.join(heavy, ["lang", "prefix"], "left_semi")
        if k > 1:
            below = F.sum(F.aggregate("totals", F.lit(0).cast("long"), lambda total, n: total + n))
            tops.append(rows.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.lit(k).alias("words"), below.alias("a")).select("lang", "phrase", "words", "a"))
        rows = materialize(_lengthened(rows, k + 1), "longer")
    placed = running_totals(reduce(DataFrame.union, sizes), "leaves", ["lang", "prefix"]).select("lang", "prefix", F.expr(f"before div {budget}").alias("group"))
    grouped = reduce(DataFrame.union, done).join(materialize(placed, "groups"), ["lang", "prefix"]).select("group", "lang", "k", "suffixes", "totals")
    return grouped, reduce(DataFrame.union, tops)


def _subtrees(grouped: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a): the inner nodes and leaves of each group's subtree that occur ``least`` times or more.

    Nodes of fewer words than the group's prefix are not whole here.
    """

    def build(table: pa.Table) -> pa.Table:
        held: dict[tuple[str, int], dict[str, int]] = {}
        for lang, k, suffixes, totals in zip(table["lang"].to_pylist(), table["k"].to_pylist(), table["suffixes"], table["totals"]):
            into = held.setdefault((lang, k), {})
            for suffix, total in zip(suffixes.as_py(), totals.as_py()):
                into[suffix] = into.get(suffix, 0) + total
        found: list[tuple[str, str, int, int]] = []
        path: list[str] = []  # words of the open nodes, with the totals of the leaves below each
        totals: list[int] = []

        def close(upto: int) -> None:
            while len(path) > upto:
                total = totals.pop()
                if total >= least and len(path) >= max(2, k):
                    found.append((lang, " ".join(path), len(path), total))
                path.pop()
                if totals:
                    totals[-1] += total

        for (lang, k), leaves in held.items():
            for words, total in sorted([(suffix.split(" "), n) for suffix, n in leaves.items()]):
                common = 0
                while common < len(path) and common < len(words) and path[common] == words[common]:
                    common += 1
                close(common)
                path.extend(words[common:])
                totals.extend([0] * (len(words) - common))
                totals[-1] += total
            close(0)
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table({"lang": pa.array(columns[0], pa.string()), "phrase": pa.array(columns[1], pa.string()), "words": pa.array(columns[2], pa.int32()), "a": pa.array(columns[3], pa.int64())})

    return grouped.groupBy("group").applyInArrow(build, "lang string, phrase string, words int, a long")


def _part(start: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), start, n), " ")


def _scored(frequent: DataFrame, words: DataFrame, n: DataFrame) -> DataFrame:
    """Candidates with the cut of the lowest score: (lang, phrase, words, a, l, r, n, score)."""
    known = frequent.select("lang", "phrase", "a").union(words.select("lang", F.col("word").alias("phrase"), F.col("f").alias("a")))
    known = materialize(known, "known")
    cuts = frequent.join(n, "lang").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _part(F.lit(1), F.col("k")), "right": _part(F.col("k") + 1, F.col("words") - F.col("k"))})
    for side, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    score = F.expr("(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("cut")
    return cuts.groupBy("lang", "phrase", "words", "a", "n").agg(best).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def _inside(frequent: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of candidates that lie in a longer one with ``percent`` or more of their occurrences."""
    place = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> struct(i, m))))"))
    parts = frequent.filter("words > 2").select("lang", "phrase", F.col("a").alias("longer"), place.alias("p"))
    parts = parts.select("lang", _part(F.col("p.i"), F.col("p.m")).alias("phrase"), "longer")
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return most.join(frequent, ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("a") * percent).select("lang", "phrase")


def collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, text: str = "text", lang: str = "lang", budget: int = BUDGET
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and these into words at
    blanks and tabs. Phrases of 2 to ``longest`` words with a = ``least`` or more occurrences are candidates; the score
    is floor(1000 a n / (l r)) at the cut with the lowest one (ties: the first cut). Candidates inside a longer one that has ``percent`` or more of
    their occurrences are dropped.

    1. One reading counts the words of each language and, in a table of counters of bounded size, pairs of words. A pair whose counter
       stays below ``least`` is in no candidate; pairs that share a counter only let more through.
    2. A second reading gives the suffix at each place, cut at the first pair that cannot be frequent and at ``longest`` words.
       Equal suffixes are added up in the task and handed on by first word: these are the leaves with their totals.
    3. Vertical partitioning: prefixes of one word are lengthened where more than ``budget`` leaves share them, and put together
       in groups of less than twice the budget.
    4. Each group builds its truncated subtree by itself, from its sorted leaves; counts are sums of leaf totals,
       those of nodes above a long prefix sums over all its leaves.

    Counts are exact: every occurrence of a phrase that is frequent has only pairs that pass. A null or empty text has no words, a null
    language is ``und``, repeated rows count each time, no rows give no rows. Words may be of any length; other
    columns are not read. Ties in the ranking go to the higher a, then to the phrase in the order of bytes.
    """
    if least < 1 or longest < 2:
        raise ValueError("least must be 1 or more and longest 2 or more")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter(F.octet_length("text") > 0)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / 16 + 1))))
    texts = texts.withColumn("text", F.col("text").cast("binary"))

    counted = materialize(_counted(texts, bits, least), "counted")
    words = materialize(counted.filter(F.col("word").isNotNull()).groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    n = materialize(words.groupBy("lang").agg(F.sum("f").alias("n")), "languages")
    often = spark.sparkContext.broadcast(_often(counted, bits, least))
    grouped, tops = _groups(materialize(_suffixes(texts, often, bits, longest), "leaves"), longest, budget)
    frequent = materialize(_subtrees(grouped, least).union(tops.filter(F.col("a") >= least)), "frequent")
    scored = materialize(_scored(frequent, words.filter(F.col("f") >= least), n), "scored")
    left = scored.join(materialize(_inside(frequent, percent), "inside"), ["lang", "phrase"], "left_anti")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # most are ruled out within a share of the language, so no task orders all of it
    shares = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = left.withColumn("__r", F.row_number().over(Window.partitionBy("lang", shares).orderBy(*order))).filter(F.col("__r") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
