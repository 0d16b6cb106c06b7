"""Collocations, periodic runs and near vectors against brute force, and their edge cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from cindermap.llm import covertree, periodic, phrases

DOCS = "doc_id long, text string, lang string, phrase string, `group` int, total long, `key` string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with what operators use."""
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "k") for i, t, lang in rows], DOCS)


# collocations


def _brute_phrases(rows, least, longest, top, percent):
    import re

    counts, n = {}, Counter()
    for text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= percent * f[(q := p[i : i + m])]}
        rows = []
        for p, a in cand.items():
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if p not in inside:
                rows.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


def _texts(seed, n):
    rng = random.Random(seed)
    words = ["A", "b", "c", "É", "d\x01", "ee", "f\x00", "G"]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "en", "de", None])) for i in range(n)]


@pytest.mark.parametrize("budget", [100_000, 7])
@pytest.mark.parametrize("least,percent,top", [(3, 100, 2000), (12, 60, 9)])
def test_collocations_equal_brute_force(spark, budget, least, percent, top):
    rows = [*_texts(5, 150), (1, None, "en"), (2, "", "fr"), (3, " \n . ", None), (3, "same same same", "xx"), (3, "same same same", "xx")]
    got = phrases.collocations(docs_of(spark, rows), least=least, percent=percent, top=top, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _brute_phrases([(t, lang) for _, t, lang in rows], least, 5, top, percent)


def test_collocations_of_full_batches(spark, monkeypatch):
    # tasks hand on what they have counted several times
    monkeypatch.setattr(phrases, "LOCAL_WORDS", 3)
    monkeypatch.setattr(phrases, "LOCAL_ROWS", 10)
    rows = _texts(6, 60) + [(9, "alpha beta " * 30000, "en")]
    got = phrases.collocations(docs_of(spark, rows), least=4)
    assert sorted(map(tuple, got.collect())) == _brute_phrases([(t, lang) for _, t, lang in rows], 4, 5, 2000, 100)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, None), (2, "", "en")])).count() == 0


def test_scores_past_64_bits(spark):
    frequent = spark.createDataFrame([("en", "a b", 2, 10**15)], "lang string, phrase string, words int, a long")
    words = spark.createDataFrame([("en", "a", 2 * 10**15), ("en", "b", 3 * 10**15)], "lang string, word string, f long")
    n = spark.createDataFrame([("en", 10**16 + 7)], "lang string, n long")
    assert phrases._scored(frequent, words, n).first()["score"] == 1000 * 10**15 * (10**16 + 7) // (2 * 10**15 * 3 * 10**15)


# periodic runs


def _brute_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n, k = rng.randrange(0, 80), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for least in (2, 5, 12):
            want = _brute_runs(w, least)
            assert periodic.runs_of(w, least) == want
            assert periodic.runs_in([b"%d" % x for x in w], least) == want


def test_periodic_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, " \t\n", None), (None, "x " * 12, "en"), (4, "x " * 11, "en"), (4, "é b " * 6 + "c", "en"), (5, "a b c " * 40_000, "en"), (5, "a b c " * 40_000, "en")]
    got = periodic.periodic_runs(docs_of(spark, rows), carry=("doc_id", "phrase", "total")).collect()
    assert [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got] == [
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (None, 12, [(0, 12, 1)], "x"), (4, 11, [], "x " * 10 + "x"), (4, 7, [], ("é b " * 6 + "c")),
        (5, 120_000, [(0, 120_000, 3)], "a b c"), (5, 120_000, [(0, 120_000, 3)], "a b c"),
    ]
    assert periodic.periodic_runs(docs_of(spark, [])).count() == 0


def test_words_of_two_runs_go_once(spark):
    # two runs that overlap, and one inside the period of another
    text = "a a a a a a a a a a a a b b b b b b b b b b b b " * 2
    got = periodic.periodic_runs(docs_of(spark, [(1, text, "en")])).first()
    want = _brute_runs(text.split(), 12)
    gone = {i for s, n, p in want for i in range(s + p, s + n)}
    assert [tuple(r) for r in got["runs"]] == want and len(want) > 3
    assert got["collapsed"] == " ".join(w for i, w in enumerate(text.split()) if i not in gone)


# near vectors


def _brute_links(x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    return near


@pytest.mark.parametrize("seed", range(12))
def test_trees_find_every_pair(seed):
    rng = np.random.default_rng(seed)
    n, d, cosine = int(rng.integers(1, 500)), int(rng.choice([2, 3, 8, 32])), float(rng.choice([0.3, 0.8, 0.95, 0.999]))
    x = rng.normal(size=(n, d))
    x[: n // 2] = x[rng.integers(0, max(1, n // 10), n // 2)] + rng.normal(size=(n // 2, d)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = math.sqrt(2 - 2 * cosine)
    tree = covertree.grow(x, covertree.LEAF * near)
    leaves = [tree.order[tree.starts[k] : tree.starts[k + 1]] for k in range(len(tree.radius))]
    assert sorted(tree.order.tolist()) == list(range(n))
    for rows, radius in zip(leaves, tree.radius):
        assert np.sqrt(np.maximum(2 - 2 * x[rows] @ x[rows[0]], 0)).max() <= radius + 1e-6
    links = covertree._Links(x, np.ones(n, np.int64), cosine)
    for rows in leaves:
        links.among(rows)
    skeleton = covertree._Skeleton(x[[int(r[0]) for r in leaves]], tree.radius, tree.above)
    for a, b, whole in covertree.meeting(skeleton, skeleton, near, same=True):
        for i, j, w in zip(a, b, whole):
            links.between(leaves[i], leaves[j], bool(w))
    assert (links.count == _brute_links(x, cosine).sum(axis=1)).all()


def test_far_nodes_are_not_opened():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    x = np.repeat(centre, 30, axis=0) + rng.normal(size=(1200, 16)) * 0.02
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = math.sqrt(0.1)
    tree = covertree.grow(x, covertree.LEAF * near)
    skeleton = covertree._Skeleton(x[[int(tree.order[s]) for s in tree.starts[:-1]]], tree.radius, tree.above)
    opened = sum(len(a) for a, _, _ in covertree.meeting(skeleton, skeleton, near, same=True))
    assert len(tree.radius) < 60 and opened < 60  # of about 800 pairs of leaves, and 720,000 of vectors


@pytest.mark.parametrize("block_rows,least_blocks", [(32_768, 12), (20, 3)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block_rows, least_blocks):
    monkeypatch.setattr(covertree, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(covertree, "LEAST_BLOCKS", least_blocks)
    monkeypatch.setattr(covertree, "PIVOTS", 5)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 6))
    x[:80] = x[rng.integers(80, 100, 80)] + rng.normal(size=(80, 6)) * 0.12
    x[150:] = x[0]  # copies
    ids = [int(i) * 3 for i in rng.permutation(160)]
    odd = [(1000, None), (1001, [0.0] * 6), (1002, [float("nan")] + [1.0] * 5), (1003, [None] + [1.0] * 5), (1004, [float("inf")] + [1.0] * 5), (1005, []), (1006, [1.0, 2.0]), (1007, [-1.0, -2.0]), (1008, [2.0, 4.0]), (None, x[0].tolist())]
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + odd
    df = spark.createDataFrame([(i, v, 1, b"u", 5) for i, v in rows], "vec_id long, embedding array<double>, label int, unit binary, pid int")
    got = sorted((tuple(r) for r in covertree.near_vectors(df).collect()), key=repr)
    near = _brute_links(np.vstack([x, x[0]]), 0.95)
    all_ids = [*ids, None]
    part = list(range(161))
    for _ in range(161):
        part = [min([part[j] for j in np.flatnonzero(near[i])] + [part[i]]) for i in range(161)]
    least = {p: min(all_ids[i] for i in range(161) if part[i] == p and all_ids[i] is not None) for p in set(part)}
    want = [(all_ids[i], int(near[i].sum()), least[part[i]], all_ids[i] == least[part[i]]) for i in range(161)]
    want += [(i, 0, i, True) for i in (1000, 1001, 1002, 1003, 1004, 1005, 1007)] + [(1006, 1, 1006, True), (1008, 1, 1006, False)]
    assert got == sorted(want, key=repr)


def test_near_vectors_of_nothing(spark):
    shape = "vec_id long, embedding array<float>"
    assert covertree.near_vectors(spark.createDataFrame([], shape)).count() == 0
    assert [tuple(r) for r in covertree.near_vectors(spark.createDataFrame([(1, None), (1, [])], shape)).collect()] == [(1, 0, 1, True)] * 2
    big = spark.createDataFrame([(1, [1e308, 1e308]), (2, [1e-320, 1e-320]), (3, [-1e308, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in covertree.near_vectors(big).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
