"""Similarity join on word shingles: groups of similar documents, their token matrix, and the groups worth opening."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.llm.common import components
from cindermap.session import materialize

BANDS = 6  # pairs of minima that bring similar documents to one leader
BUCKETS = 2048  # token buckets of the bit matrix; a power of two
ZONE = 1.6  # share of all tokens, as a multiple of 1 - threshold, that the matrix looks at
LIGHT = 16  # nodes of one token whose pairs are rows of a join
BLOCK = 2048  # nodes of one token that are compared with as many others in one task
_CACHE_WORDS = 100_000  # bounds the memory of a worker; a full cache starts anew
_HASHES: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct shingles of the words of a text as sorted 64-bit hashes; A-Z in lower case.

    Fewer words than ``size`` are one shingle, no words none. Two shingles of one text fall together with a chance
    of about n^2 / 2^64.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters, ASCII white space
    if not words:
        return np.empty(0, np.int64)
    if len(_HASHES) > _CACHE_WORDS:
        _HASHES.clear()
    for w in words:
        if w not in _HASHES:
            _HASHES[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * _M1 + h[i : len(h) - n + 1 + i])
    return np.unique(_mix(out).view(np.int64))


def _misses(n: Column | int, num: int, den: int):
    """Tokens of a set of ``n`` that a set at the threshold num/den or more can lack."""
    return (n * (den - num)) // den if isinstance(n, int) else F.floor(n * F.lit(den - num) / F.lit(den)).cast("long")


def sets_of(docs: DataFrame, size: int, num: int, den: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One narrow row per document: what grouping and the matrix need of its shingles, not the shingles.

    doc_id, n (shingles), node (128-bit digest of the set; null without words), bands (hashes of pairs of minima), bits (a row of
    the bit matrix: one bit per bucket of tokens) and zone: all tokens in the lowest part of the hash range, the same
    part for all documents, then more in the order of the hash if these are fewer than ``misses + 1``.
    """
    limit = _limit(num, den)
    seeds = np.array([int.from_bytes(hashlib.md5(b"%d" % i).digest()[:8], "little") for i in range(2 * BANDS)], np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("zone", pa.list_(pa.int64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(body.as_py(), size)
                if not len(s):
                    out.append((doc, 0, None, [], [], []))
                    continue
                minima = np.array([_mix(s.view(np.uint64) ^ seed).min() for seed in seeds])
                bands = _mix(minima[::2] * _M1 + minima[1::2] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                zone = s[: max(int(np.searchsorted(s, limit)), min(len(s), _misses(len(s), num, den) + 1))]
                row = np.zeros(BUCKETS, np.uint8)
                row[s & (BUCKETS - 1)] = 1
                out.append((doc, len(s), hashlib.md5(s.tobytes()).digest(), bands, np.packbits(row).view("<i8"), zone))
            columns = list(zip(*out)) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(measure, "doc_id long, n long, node binary, bands array<long>, bits array<long>, zone array<long>")


def _limit(num: int, den: int) -> int:
    """Tokens below it are the low part of the hash range."""
    return min(int(min(1.0, ZONE * (den - num) / den) * 2.0**64 - 2.0**63), 2**63 - 1)


def _whole(docs: DataFrame, wanted: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(v, tokens) with all tokens of the nodes in ``wanted`` (v, node, doc_id), read again from the texts."""
    schema = pa.schema([("node", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(b.as_py(), size) for b in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary()), pa.array(sets, schema[1].type)], schema=schema)

    ids = wanted.select(F.col("doc_id").alias("__id")).distinct()
    found = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("text")).join(ids, F.col("__key").eqNullSafe(F.col("__id")), "left_semi")
    sets = found.select("text").mapInArrow(again, "node binary, tokens array<long>")
    # rows that share a document id but not its text fall out here
    return sets.join(wanted.select("v", "node"), "node").groupBy("v").agg(F.first("tokens").alias("tokens"))


def _bits_in(x: str, y: str, how: str) -> Column:
    """Number of buckets in which two rows of the bit matrix differ, or that the first has and the second lacks."""
    step = {"differ": lambda p, q: p.bitwiseXOR(q), "lacks": lambda p, q: p.bitwiseAND(F.bitwise_not(q))}[how]
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(step(p, q))), F.lit(0), lambda total, n: total + n)


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, num: int, den: int, key: str, text: str) -> DataFrame:
    """Of pairs (a, b) of nodes those whose sets link: first by their rows of the bit matrix, then by all tokens."""
    side = {s: nodes.select(F.col("v").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b")
    # at num/den the sets differ in at most (n_a + n_b) * (den - num) / (den + num) tokens, and in no more buckets than tokens
    near = both.filter(_bits_in("bits_a", "bits_b", "differ") * F.lit(den + num) <= (F.col("n_a") + F.col("n_b")) * F.lit(den - num))
    near = materialize(near.select("a", "b", "n_a", "n_b"), "near")
    ends = near.select(F.col("a").alias("v")).union(near.select("b")).distinct().join(nodes.select("v", "node", "doc_id"), "v")
    whole = materialize(_whole(docs, materialize(ends, "ends"), size, key, text), "tokens")
    sets = near.join(whole.select(F.col("v").alias("a"), F.col("tokens").alias("t_a")), "a").join(whole.select(F.col("v").alias("b"), F.col("tokens").alias("t_b")), "b")
    shared = F.size(F.array_intersect("t_a", "t_b")).cast("long")
    return sets.filter(shared * F.lit(den) >= F.lit(num) * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def similar(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document: components of sets with a Jaccard similarity of num/den or more.

    1. Equal sets are one node, found by a 128-bit digest. Everything below is about nodes.
    2. Grouping: nodes with equal pairs of hash minima meet the smallest of them, their leader, and join it if their
       sets link, checked on all tokens. Linked nodes form groups; a group of any number of copies takes one
       comparison per copy and band.
    3. Token-group matrix: (token, group) for the tokens in the low part of the hash range, kept only where two groups
       or more share the token, and for every group the union of its tokens as a row of bits, one per bucket of tokens. A set can lack at most misses = n (1 - num/den) of its tokens and still link, so a
       node must share one of any misses + 1 of them with the other side; taken are the rarest in one order for
       all nodes. Most nodes have that many tokens no other group holds and meet nobody.
    4. For each (node, group) that meet, buckets that the union lacks bound the overlap with the group; only
       groups that can hold a linked set are opened, and nodes in them that meet are compared, by bits and then on all tokens.

    No link between different groups is lost: the prefixes are exact, the bound is an upper one, and
    there is no cap. A null or empty text and one without words has no shingles and its own id as component;
    equal ids in several rows each return; a null id takes part, but names a component only as null where
    no other id is in it. No rows give no rows.
    """
    # written once, so v names a row from here on; the row with the smallest v stands for all equal sets
    rows = materialize(sets_of(docs, size, num, den, key, text).withColumn("v", F.monotonically_increasing_id()), "sets")
    worded = rows.filter(F.col("node").isNotNull())
    classes = materialize(worded.groupBy("node").agg(F.min("v").alias("v"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies")), "classes")
    twice = materialize(classes.filter("copies > 1").select("node", F.col("v").alias("kept")), "twice")
    copies = materialize(worded.select("v", "node").join(twice, "node").filter("v <> kept").select("v"), "copies")
    nodes = worded.join(copies, "v", "left_anti")
    args = (nodes, docs, size, num, den, key, text)

    met = nodes.select("v", F.posexplode("bands").alias("band", "h"))
    leaders = materialize(met.groupBy("band", "h").agg(F.min("v").alias("leader"), F.count(F.lit(1)).alias("met")).filter(F.col("met") > 1).drop("met"), "leaders")
    follow = met.join(leaders, ["band", "h"]).filter(F.col("v") != F.col("leader")).select(F.col("v").alias("a"), F.col("leader").alias("b")).distinct()
    links = materialize(_linked(follow, *args), "links")
    posts, often = _prefixes(nodes, _groups(links), num, den)
    # copies of one text that are no copies of their leader: each joins the nearest of those it meets
    nearest = materialize(_linked(_crowded(posts, often, nodes, _groups(links), num, den, nearest=True), *args), "links")
    groups = materialize(_groups(links.union(nearest)), "groups")

    meeting = _meeting(posts, often, nodes, groups, num, den).union(_crowded(posts, often, nodes, groups, num, den)).distinct()
    more = materialize(_linked(meeting, *args), "links")
    named = classes.join(groups, "v", "left").withColumn("gid", F.coalesce("gid", "v"))
    if not more.isEmpty():
        ends = {s: groups.select(F.col("v").alias(s), F.col("gid").alias(f"g_{s}")) for s in "ab"}
        between = more.join(ends["a"], "a", "left").join(ends["b"], "b", "left")
        between = between.select(F.coalesce("g_a", "a").alias("a"), F.coalesce("g_b", "b").alias("b")).distinct()
        merged = components(between).select(F.col("node").alias("gid"), "label")
        named = named.join(merged, "gid", "left").withColumn("gid", F.coalesce("label", "gid")).drop("label")
    named = materialize(named.select("gid", "node", "first_doc", "copies"), "named")
    first = named.groupBy("gid").agg(F.min("first_doc").alias("component"), F.sum("copies").alias("members")).filter(F.col("members") > 1)
    # only documents that are not alone need to be told; all others are their own component
    told = materialize(named.select("gid", "node").join(materialize(first, "firsts"), "gid").select("node", "component"), "told")
    return rows.select("doc_id", "n", "node").join(told, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _groups(links: DataFrame) -> DataFrame:
    """(v, gid) of nodes in groups of two or more."""
    return components(links).select(F.col("node").alias("v"), F.col("label").alias("gid"))


def _prefixes(nodes: DataFrame, groups: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The tokens by which nodes can meet (v, n, lacking, token), and the tokens of many nodes with their number of blocks."""
    limit = F.lit(_limit(num, den))
    grouped = nodes.select("v", "zone").join(groups, "v", "left")
    tokens = grouped.select("v", F.coalesce("gid", "v").alias("gid"), F.explode("zone").alias("token"))
    shared = tokens.groupBy("token").agg(F.min("gid").alias("g0"), F.max("gid").alias("g1"), F.count(F.lit(1)).alias("df")).filter(F.col("g0") != F.col("g1")).select("token", "df")
    matrix = materialize(tokens.join(materialize(shared, "shared"), "token"), "matrix")

    lacking = _misses(F.col("n"), num, den)
    own = nodes.select("v", "n", lacking.alias("lacking"), F.size(F.filter("zone", lambda x: x < limit)).cast("long").alias("low"))
    # one order for all nodes: the low part of the hash range by frequency, what only one group holds first; then the rest by hash
    held = matrix.groupBy("v").agg(F.array_sort(F.collect_list(F.when(F.col("token") < limit, F.struct("df", "token")))).alias("met"), F.collect_list(F.when(F.col("token") >= limit, F.col("token"))).alias("high"))
    # a node takes misses + 1 tokens; those beyond the low part are in its zone only if it needs them
    take = F.greatest(F.lit(0), F.least(F.col("lacking") + F.lit(1) - (F.col("low") - F.size("met")), F.size("met").cast("long"))).cast("int")
    posts = held.join(own, "v").select("v", "n", "lacking", F.explode(F.concat(F.transform(F.slice("met", F.lit(1), take), lambda x: x["token"]), "high")).alias("token"))
    posts = materialize(posts, "prefixes")

    often = posts.groupBy("token").agg(F.count(F.lit(1)).alias("met")).filter(F.col("met") > LIGHT)
    return posts, materialize(often.select("token", F.ceil(F.col("met") / F.lit(BLOCK)).cast("int").alias("k")), "often")


def _in_groups(posts: DataFrame, groups: DataFrame) -> DataFrame:
    return posts.join(groups, "v", "left").withColumn("gid", F.coalesce("gid", "v"))


def _meeting(posts: DataFrame, often: DataFrame, nodes: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that share a token of few nodes and that the matrix cannot rule out."""
    posts = materialize(_in_groups(posts.join(often, "token", "left_anti"), groups), "posts")
    sides = (posts.select("token", F.col("v").alias(s), F.col("gid").alias(f"g_{s}"), F.col("n").alias(f"n_{s}"), F.col("lacking").alias(f"l_{s}")) for s in "ab")
    # sets of sizes that cannot link do not meet
    fits = (F.col("n_a") * F.lit(num) <= F.col("n_b") * F.lit(den)) & (F.col("n_b") * F.lit(num) <= F.col("n_a") * F.lit(den))
    one, two = sides
    rare = one.join(two, "token").filter((F.col("g_a") < F.col("g_b")) & fits)
    pairs = materialize(rare.select("a", "b", "g_b", "l_a").distinct(), "pairs")
    # bound: buckets of a node that the union of the other's group lacks are tokens that it lacks
    asked = pairs.select("a", "g_b", "l_a").distinct()
    bits = nodes.select("v", "bits")
    union = groups.join(bits, "v").groupBy("gid").agg(*[F.bit_or(F.col("bits")[i]).alias(f"b{i}") for i in range(BUCKETS // 64)])
    union = union.select(F.col("gid").alias("g_b"), F.array(*[f"b{i}" for i in range(BUCKETS // 64)]).alias("union"))
    # a group of one is its own union and is compared as a pair
    bound = asked.join(materialize(union, "unions"), "g_b").join(bits.select(F.col("v").alias("a"), "bits"), "a")
    closed = bound.filter(_bits_in("bits", "union", "lacks") > F.col("l_a")).select("a", "g_b")
    return pairs.join(closed, ["a", "g_b"], "left_anti").select("a", "b")


def _opened(x: np.ndarray, lacking: np.ndarray, gid: np.ndarray, y: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``x`` that open a group of ``y``, rows of ``y`` in groups that are opened): rows of bits with their groups.

    A row opens a group if it has no more buckets that the union of the group's rows lacks than it can lack tokens. Where all groups are single
    rows, all are compared as pairs.
    """
    groups, of = np.unique(other, return_inverse=True)
    if len(groups) == len(y):
        return np.arange(len(x)), np.arange(len(y))
    by = np.argsort(of, kind="stable")
    union = np.maximum.reduceat(y[by], np.flatnonzero(np.diff(of[by], prepend=-1)), axis=0)
    opens = (x.sum(axis=1)[:, None] - x @ union.T <= lacking[:, None]) & (gid[:, None] != groups[None, :])
    return np.flatnonzero(opens.any(axis=1)), np.flatnonzero(opens.any(axis=0)[of])


def _in_blocks(met: DataFrame, num: int, den: int) -> DataFrame:
    """``met`` (v, n, token, k) with ``block`` and ``other``, the blocks of the token that it is compared with, itself included.

    Nodes of a token with one block are that block. Those of more are parted by size first: sizes of a class differ by a factor of den/num at
    most, so only sets of one class or of two that follow each other can link; each class has blocks of about ``BLOCK`` nodes.
    """
    width = max(math.log(den / num), 1e-4) * (1 + 1e-6)  # wider than the factor, so that rounding parts no sets that can link
    met = met.withColumn("size", F.when(F.col("k") > 1, F.floor(F.log("n") / F.lit(width))).otherwise(F.lit(0)).cast("long"))
    classes = met.filter("k > 1").groupBy("token", "size").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias("parts"))
    classes = materialize(classes, "size-classes")
    place = F.col("size") * F.lit(1 << 32)
    held = classes.withColumn("others", F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda b: place + b))
    held = held.select("token", F.explode(F.array(*[F.col("size") + d for d in (-1, 0, 1)])).alias("to"), "others")
    held = held.groupBy("token", F.col("to").alias("size")).agg(F.flatten(F.collect_list("others")).alias("others"))
    dealt = met.join(classes.join(held, ["token", "size"]), ["token", "size"], "left")
    block = F.coalesce(place + F.pmod(F.xxhash64("v"), F.col("parts")), F.lit(0))
    return dealt.withColumn("block", block).withColumn("other", F.explode(F.coalesce("others", F.array(F.lit(0).cast("long"))))).drop("k", "size", "parts", "others")


def _crowded(posts: DataFrame, often: DataFrame, nodes: DataFrame, groups: DataFrame, num: int, den: int, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that meet in a token many nodes hold, and whose rows of bits allow a link.
    With ``nearest``, for each node only the one that differs least.

    The nodes of a token are dealt to blocks by size (see ``_in_blocks``). Two blocks are compared in one task: nodes against the unions of the other
    block's groups first, then, as a product of bit matrices, with the nodes of the groups that are opened; only pairs that may link become rows.
    """

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        left, right = rows[rows["block"] == i], rows[rows["block"] == j]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x, y = (np.unpackbits(np.stack(r["bits"].to_numpy()).view(np.uint8), axis=1).astype(np.float32) for r in (left, right))
        at_x, at_y = _opened(x, left["lacking"].to_numpy(), left["gid"].to_numpy(), y, right["gid"].to_numpy())
        x, y, left, right = x[at_x], y[at_y], left.iloc[at_x], right.iloc[at_y]
        differ = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)
        (na, ga, va), (nb, gb, vb) = ([r[c].to_numpy() for c in ("n", "gid", "v")] for r in (left, right))
        may = (differ * (den + num) <= (na[:, None] + nb[None, :]) * (den - num)) & (ga[:, None] != gb[None, :])
        if nearest:
            a = np.flatnonzero(may.any(axis=1))
            b = np.where(may, differ, np.inf)[a].argmin(axis=1) if len(a) else a
        else:
            a, b = np.nonzero(may & (va[:, None] < vb[None, :]) if i == j else may)
        return pd.DataFrame({"a": np.minimum(va[a], vb[b]), "b": np.maximum(va[a], vb[b])})

    met = _in_groups(posts.join(often, "token"), groups).select("v", "gid", "n", "lacking", "token", "k")
    met = _in_blocks(met, num, den)
    met = met.join(nodes.select("v", "bits"), "v").withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return met.groupBy("token", "i", "j").applyInPandas(compare, "a long, b long").distinct()
