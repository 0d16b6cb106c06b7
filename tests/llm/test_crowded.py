"""The similarity join where one token is shared by many nodes, and licence lines among unknown ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import brute_components, docs_of, words

from cindermap.llm import jaccard, licenses


@pytest.mark.parametrize("num,den", [(9, 10), (8, 10)])
def test_crowds_in_small_blocks_lose_no_link(spark, monkeypatch, num, den):
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "LIGHT", 2)
    monkeypatch.setattr(jaccard, "BANDS", 1)  # leaders miss many, so the crowded path has to find them
    rng = random.Random(num)
    texts = []
    for _ in range(2):
        base = words(rng, 90).split()
        for _ in range(60):
            copy = list(base)[: rng.randrange(60, 91)]
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(9)}"
            texts.append(" ".join(copy))
    pairs = list(enumerate(texts))
    got = sorted(tuple(r) for r in jaccard.similar(docs_of(spark, pairs), 3, num, den).collect())
    assert got == brute_components(pairs, 3, num, den)


def test_blocks_of_sizes_that_can_link_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    sizes = [1, 2, 8, 9, 10, 11, 81, 90, 100, 1000, 1111, 1234, 10**6, 1111111] * 3
    rows = [(i, n, 7, 2) for i, n in enumerate(sizes)] + [(900 + i, 50 * 3**i, 8, 1) for i in range(4)]
    met = jaccard._in_blocks(spark.createDataFrame(rows, "v long, n long, token long, k int"), 9, 10).collect()
    own = {r["v"]: r["block"] for r in met}
    others = {v: {r["other"] for r in met if r["v"] == v} for v in own}
    seven = [r for r in rows if r[2] == 7]
    for a, na, *_ in seven:
        for b, nb, *_ in seven:
            if 9 * max(na, nb) <= 10 * min(na, nb):
                assert own[b] in others[a]
            elif max(na, nb) > 2 * min(na, nb):
                assert own[b] not in others[a]
    assert all(own[900 + i] == 0 and others[900 + i] == {0} for i in range(4))


def test_groups_open_only_for_rows_they_can_hold():
    rng = np.random.default_rng(2)
    y = (rng.random((30, jaccard.BUCKETS)) < 0.02).astype(np.float32)
    y[:10] = y[0]
    other = np.array([5] * 10 + list(range(100, 120)))
    x = np.vstack([y[0], y[15], np.ones(jaccard.BUCKETS, np.float32)])
    at_x, at_y = jaccard._opened(x, np.array([3, 3, 3]), np.array([1, 2, 3]), y, other)
    assert at_x.tolist() == [0, 1] and at_y.tolist() == [*range(10), 15]
    at_x, at_y = jaccard._opened(x[:1], np.array([3]), np.array([5]), y, other)  # its own group does not open
    assert at_x.tolist() == [] and at_y.tolist() == []
    at_x, at_y = jaccard._opened(x, np.array([3, 3, 3]), np.array([1, 2, 3]), y[10:], other[10:])  # single rows: compared as pairs
    assert len(at_x) == 3 and len(at_y) == 20


def test_lines_of_no_known_licence_leave_no_row(spark):
    text = "some line\nanother line\n\nReleased under the MIT License.\nReleased under the MIT License.\n\nlast"
    rows = [(1, text), (2, "nothing\nhere"), (3, None), (4, ""), (1, text)]
    got = sorted((tuple(r) for r in licenses.scan(docs_of(spark, rows), licenses.known_licenses(spark)).collect()), key=repr)
    assert got == sorted([(1, None, "MIT", 2), (2, None, "", 0), (3, None, "", 0), (4, None, "", 0), (1, None, "MIT", 2)], key=repr)
    nothing = licenses.known_licenses(spark).limit(0)
    assert licenses.scan(docs_of(spark, rows), nothing).filter(F.col("licenses") != "").count() == 0
