"""Periodic stretches of words: squares from the last occurrences along suffix-link paths, extended to runs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12  # words of the shortest run
_K = np.uint64(0x9E3779B97F4A7C15)


class LastOccurrences:
    """A suffix automaton that grows word by word; its suffix links are a tree kept as paths of equal last occurrence.

    The states from the root to the newest prefix have all just occurred, so an access to it makes them one path. A path is a
    splay tree by depth (``low`` and ``high`` are its children, ``up`` the parent there, or at its root the state above the path); the end of the last
    occurrence stands at the root. State 0 is none, 1 the empty word.
    """

    def __init__(self):
        self.moves: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        self.low, self.high, self.up, self.last = [0, 0], [0, 0], [0, 0], [0, 0]
        self.newest, self.n = 1, 0

    def _state(self, length: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.length.append(length)
        for column in (self.link, self.low, self.high, self.up, self.last):
            column.append(0)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its path's tree; the root knows the last occurrence."""
        low, high, up = self.low, self.high, self.up
        y = up[x]
        if not y or (low[y] != x and high[y] != x):
            return
        root = y
        while (z := up[root]) and (low[z] == root or high[z] == root):
            root = z
        self.last[x] = self.last[root]
        while (y := up[x]) and (low[y] == x or high[y] == x):
            z = up[y]
            if z and (low[z] == y or high[z] == y):
                self._rotate(y if (low[z] == y) == (low[y] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        low, high, up = self.low, self.high, self.up
        y = up[x]
        z = up[y]
        if low[y] == x:
            b = low[y] = high[x]
            high[x] = y
        else:
            b = high[y] = low[x]
            low[x] = y
        if b:
            up[b] = y
        if z:
            if low[z] == y:
                low[z] = x
            elif high[z] == y:
                high[z] = x
        up[x], up[y] = z, x

    def append(self, word: int) -> Iterator[tuple[int, int]]:
        """Add a word; yields (end of the last occurrence before, longest length) of each group of suffixes that had one."""
        moves, link, length = self.moves, self.link, self.length
        self.n += 1
        new = self._state(self.n, {})
        p = self.newest
        while p and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = moves[p][word]
            if length[q] != length[p] + 1:
                # the shorter words of q become a state between it and its link, on the path of q
                part = self._state(length[p] + 1, dict(moves[q]))
                self._splay(q)
                self.low[part], self.low[q], self.up[part] = self.low[q], part, q
                if self.low[part]:
                    self.up[self.low[part]] = part
                link[part], link[q] = link[q], part
                while p and moves[p].get(word) == q:
                    moves[p][word] = part
                    p = link[p]
                q = part
            link[new] = q
        self.up[new] = link[new]
        self.newest = new

        last, high, up = self.last, self.high, self.up
        below, x = 0, new
        while x:
            self._splay(x)
            if last[x]:
                yield last[x], length[x]
            if high[x]:
                last[high[x]] = last[x]  # deeper states stay behind, on a path of their own
            high[x] = below
            below, x = x, up[x]
        last[below] = self.n


def runs_of(words: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs with ``length >= max(least, 2 * period)``, by start and period.

    Each appended word recolours the path of its suffixes. Suffixes up to length m that last ended p words earlier are, if
    p <= m, a stretch of period p at least 2p long: a square ends here. It is extended both ways once; later squares of the
    period inside the same run are known by its end. The last occurrence of a word that does not repeat itself
    inside its square lies exactly one period back, so every run is met at the end of its first square, and p is the smallest
    period.
    """
    seen, n = LastOccurrences(), len(words)
    ends: dict[int, int] = {}  # period: end of the latest run
    found = []
    for i, word in enumerate(words):
        for end, longest in seen.append(word):
            p = i + 1 - end
            if p > longest or ends.get(p, -1) >= i:
                continue
            start = i - 2 * p + 1
            while start and words[start - 1] == words[start - 1 + p]:
                start -= 1
            stop = i
            while stop + 1 < n and words[stop + 1] == words[stop + 1 - p]:
                stop += 1
            ends[p] = stop
            if stop - start + 1 >= max(least, 2 * p):
                found.append((start, stop - start + 1, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _repeated(ids: np.ndarray, least: int) -> np.ndarray:
    """Stretches (start, end) of words that all lie in windows of ``least / 2`` words which the text holds twice or more.

    In a run of length n >= max(least, 2p) each word lies in such a window: n - p >= least / 2 words are equal to those a period on.
    Windows are compared by hash, so a stretch can be too long but none is missed.
    """
    size = (least + 1) // 2
    n = len(ids) - size + 1
    if n < 2:
        return np.empty((0, 2), np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(29))) * _K + ids[i : i + n]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return np.empty((0, 2), np.int64)
    edge = np.zeros(len(ids) + 2, np.int32)
    for at in (order[1:][same], order[:-1][same]):
        edge[1 : n + 1][at] = 1
    starts = np.flatnonzero(edge)
    cover = np.zeros(len(ids) + 2, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    inside = np.concatenate([(np.cumsum(cover) > 0).astype(np.int8), [0]])
    turn = np.diff(inside)
    return np.stack([np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)], axis=1)


def runs_in(words: Sequence[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Runs of a text's words; the automaton reads only stretches in which windows repeat, as runs lie nowhere else."""
    if len(words) < least:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    found = []
    for start, end in _repeated(ids, least).tolist():
        if end - start >= least:
            found += [(start + s, n, p) for s, n, p in runs_of(ids[start:end].tolist(), least)]
    return found


def periodic_runs(docs: DataFrame, least: int = LEAST, text: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, n_words, runs and collapsed of every row.

    ``runs`` holds (start, length, period) of every stretch of words with a smallest period p and max(``least``, 2p) or more words that
    cannot be extended, by start and period. ``collapsed`` is the text with the first period of each run alone: words
    that a run contains after its first period are left out, the others joined by one space.

    Words are what ASCII white space parts. A null or empty text, and one without words, has no runs and an empty collapsed text. Whole texts are read,
    however long, in time n log n; the memory of a task is that of its longest stretch with repeats. Rows are read one by one in
    Arrow batches: nothing is shuffled, repeated rows each return, no rows give no rows. Extra columns are carried by name only.
    """
    if least < 2:
        raise ValueError("least must be 2 or more")
    chosen = docs.select(*carry, F.col(text).cast("binary").alias("__text"))
    kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:-1]] + ["n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"])
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for value in batch.column(batch.num_columns - 1):
                words = (value.as_py() or b"").split()
                found = runs_in(words, least)
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                if found:
                    kept = np.ones(len(words), bool)
                    for s, n, p in found:
                        kept[s + p : s + n] = False
                    words = [words[i] for i in np.flatnonzero(kept).tolist()]
                texts.append(b" ".join(words))
            out = {name: batch.column(i) for i, name in enumerate(batch.schema.names[:-1])}
            yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(counts, pa.int64()), "runs": pa.array(runs, pa.list_(run)), "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})

    return chosen.mapInArrow(read, kinds)
