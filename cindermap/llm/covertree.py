"""Exact pairs of vectors at a cosine threshold: cover trees of blocks, traversed two at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.llm.common import components
from cindermap.session import materialize

BLOCK_ROWS = 32_768  # vectors of a block at most, but for the chance of a hash
LEAST_BLOCKS = 12  # blocks of a small table, for its tasks
PIVOTS = 256  # roots that a bounded sample gives; more blocks share them
SAMPLE = 1_024  # vectors from which the roots are taken, far apart; all vectors are then indexed
LEAF = 0.8  # radius of a leaf, as a part of the distance at the threshold
_ROWS, _COLUMNS = 1_024, 4_096  # leaves that are compared at once
_SLACK = 1e-6  # distances of unit vectors come from products and are exact to about 1e-8


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (x @ y.T), 0.0))


def net(x: np.ndarray, radius: float) -> tuple[list[int], np.ndarray]:
    """(centres, owner of each row): centres more than ``radius`` apart that cover all rows within it; row 0 is the first centre."""
    left, owner, centres = np.arange(len(x)), np.full(len(x), -1), []
    while len(left):
        some = left[:1] if not centres else left[:256]
        near = _distance(x[some], x[some]) <= radius
        free = np.ones(len(some), bool)
        chosen = []
        for i in range(len(some)):
            if free[i]:
                chosen.append(int(some[i]))
                free &= ~near[i]
        far = _distance(x[left], x[chosen])
        at = far.argmin(axis=1)
        held = far[np.arange(len(left)), at] <= radius
        # rounding must not leave a centre without itself
        held |= np.isin(left, chosen)
        owner[left[held]] = np.asarray(chosen)[at[held]]
        centres += chosen
        left = left[~held]
    owner[centres] = centres
    return centres, owner


class Tree:
    """A cover tree of unit vectors whose leaves stand in the order of the tree.

    ``order``: rows leaf by leaf; leaf k holds ``order[starts[k]:starts[k + 1]]``, its centre first. ``above[level, k]``: number of the
    leaf's node on a level. Radii halve from level to level; a centre is also the centre of its first child, so a node's
    centre is that of its first leaf.
    """

    def __init__(self, order: np.ndarray, starts: np.ndarray, radius: np.ndarray, above: np.ndarray):
        self.order, self.starts, self.radius, self.above = order, starts, radius, above


def grow(x: np.ndarray, leaf: float) -> Tree:
    """The tree of the rows of ``x``; nodes end where their rows lie within ``leaf`` of the centre."""
    depth = max(1, math.ceil(math.log2(2.0 / leaf)) + 1)
    order, radii, paths = [], [], []
    counts = [0] * depth
    todo = [(np.arange(len(x)), 0, 2.0, [])] if len(x) else []
    while todo:
        rows, level, radius, path = todo.pop()
        reach = _distance(x[rows], x[rows[:1]])[:, 0]
        if len(rows) == 1 or float(reach.max()) <= leaf or level + 1 == depth:
            nodes = list(path)
            for deeper in range(level, depth):
                nodes.append(counts[deeper])
                counts[deeper] += 1
            order.append(rows)
            radii.append(float(reach.max()) if len(rows) > 1 else 0.0)
            paths.append(nodes)
            continue
        here = [*path, counts[level]]
        counts[level] += 1
        centres, owner = net(x[rows], radius / 2)
        by = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[by])) + 1
        groups = {int(owner[g[0]]): g for g in np.split(by, cuts)}
        # the stack turns the order round: the child with the node's own centre comes first
        for c in reversed(centres):
            g = groups[c]
            todo.append((rows[np.concatenate([[c], g[g != c]])], level + 1, radius / 2, here))
    bounds = np.concatenate([[0], np.cumsum([len(o) for o in order])]).astype(np.int64)
    above = np.asarray(paths, np.int64).reshape(-1, depth).T
    return Tree(np.concatenate(order) if order else np.empty(0, np.int64), bounds, np.asarray(radii), above)


class _Skeleton:
    """Leaf centres and covering radii of all levels of a tree."""

    def __init__(self, centre: np.ndarray, radius: np.ndarray, above: np.ndarray):
        self.centre, self.above = centre, above
        self.first, self.radii = [], []
        for nodes in above:
            first = np.concatenate([[0], np.flatnonzero(np.diff(nodes)) + 1]) if len(nodes) else np.empty(0, np.int64)
            reach = np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", centre, centre[first[nodes]]), 0.0)) + radius
            self.first.append(first)
            self.radii.append(np.maximum.reduceat(reach, first) if len(first) else reach)


def meeting(one: _Skeleton, two: _Skeleton, near: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(leaves of one, leaves of two, whether all their vectors link) of the pairs that covering radii cannot rule out.

    Both trees are gone down together: two nodes whose centres are farther apart than both radii and ``near`` hold no pair, nor
    do the nodes below them. With ``same``, a tree meets itself, each pair of different leaves once.
    """
    n, m = len(one.centre), len(two.centre)
    for s in range(0, n, _ROWS):
        for t in range(0, m, _COLUMNS):
            if same and t + _COLUMNS <= s:
                continue
            i, j = (s, min(n, s + _ROWS) - 1), (t, min(m, t + _COLUMNS) - 1)
            kept = None
            for level in range(len(one.above)):
                a = np.arange(one.above[level][i[0]], one.above[level][i[1]] + 1)
                b = np.arange(two.above[level][j[0]], two.above[level][j[1]] + 1)
                far = _distance(one.centre[one.first[level][a]], two.centre[two.first[level][b]])
                may = far <= one.radii[level][a][:, None] + two.radii[level][b][None, :] + near + _SLACK
                if kept is not None:
                    up_a = np.maximum(one.above[level - 1][one.first[level][a]] - last[0], 0)
                    up_b = np.maximum(two.above[level - 1][two.first[level][b]] - last[1], 0)
                    may &= kept[up_a][:, up_b]
                kept, last = may, (a[0], b[0])
                if not may.any():
                    break
            else:
                x, y = np.nonzero(kept)
                whole = far[x, y] + one.radii[-1][a[x]] + two.radii[-1][b[y]] <= near - _SLACK
                x, y = a[x], b[y]
                if same:
                    once = x < y
                    x, y, whole = x[once], y[once], whole[once]
                if len(x):
                    yield x, y, whole


class _Links:
    """Numbers of links, and the components of the rows of one task."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float):
        self.x, self.weight, self.cosine = x, weight, cosine
        self.count, self.root = np.zeros(len(x), np.int64), np.arange(len(x))

    def _roots(self, rows: np.ndarray) -> np.ndarray:
        r = self.root[rows]
        while (self.root[r] != r).any():
            r = self.root[r]
        self.root[rows] = r
        return r

    def _join(self, row: int, others: np.ndarray) -> None:
        roots = self._roots(np.append(others, row))
        self.root[roots] = roots.min()

    def among(self, rows: np.ndarray) -> None:
        """Rows of one leaf."""
        for s in range(0, len(rows), 2048):
            part = rows[s : s + 2048]
            for t in range(s, len(rows), 2048):
                self._compare(part, rows[t : t + 2048], s == t)

    def between(self, rows: np.ndarray, others: np.ndarray, whole: bool) -> None:
        if whole:
            self.count[rows] += self.weight[others].sum()
            self.count[others] += self.weight[rows].sum()
            self._join(int(rows[0]), np.concatenate([rows, others]))
            return
        for s in range(0, len(rows), 2048):
            for t in range(0, len(others), 2048):
                self._compare(rows[s : s + 2048], others[t : t + 2048], False)

    def _compare(self, rows: np.ndarray, others: np.ndarray, same: bool) -> None:
        hit = self.x[rows] @ self.x[others].T >= self.cosine
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.count[rows] += hit @ self.weight[others]
        if not same:
            self.count[others] += self.weight[rows] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            self._join(int(rows[i]), others[hit[i]])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, root) of the rows that are not their component's root."""
        roots = self._roots(np.arange(len(self.x)))
        rows = np.flatnonzero(roots != np.arange(len(self.x)))
        return rows, roots[rows]


def _vectors(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1) if values else np.empty((0, 0))


def unit_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, dim, unit, digest): vectors of length 1 as doubles; unit is null for those that link with nothing."""
    schema = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary()), ("digest", pa.binary())])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if v.as_py() is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8")
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    out.append((None, None, None))
                    continue
                x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                unit = (x / np.sqrt(x @ x) + 0.0).tobytes()
                out.append((len(x), unit, md5(unit).digest()))
            dims, units, digests = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(units, pa.binary()), pa.array(digests, pa.binary())], schema=schema)

    chosen = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return chosen.mapInArrow(scale, "id long, dim int, unit binary, digest binary")


def _pivots(points: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors far apart, from the ``SAMPLE`` vectors with the smallest hashes: each is the one farthest from those before it."""
    x = np.stack([np.frombuffer(r[0], "<f8") for r in points.orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE).select("unit").collect()])
    chosen, far = [0], _distance(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _in_blocks(points: DataFrame, rows: int) -> tuple[DataFrame, np.ndarray]:
    """``points`` with the number of the nearest root, the distance to it and a block of at most about ``BLOCK_ROWS``."""
    blocks = max(min(LEAST_BLOCKS, rows), math.ceil(rows / BLOCK_ROWS))
    pivots = _pivots(points, min(blocks, PIVOTS))
    schema = pa.schema([("pid", pa.int64()), ("m", pa.int64()), ("unit", pa.binary()), ("pivot", pa.int32()), ("reach", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distance(_vectors(batch.column(2)), pivots)
            at = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(far[np.arange(len(at)), at])], schema=schema)

    near = materialize(points.select("pid", "m", "unit").mapInArrow(assign, "pid long, m long, unit binary, pivot int, reach double"), "assigned")
    sizes = dict(near.groupBy("pivot").count().collect())  # one row per root
    goal, start, dealt = math.ceil(rows / blocks), 0, []
    for pivot, size in sorted(sizes.items()):
        parts = math.ceil(size / goal)
        dealt.append((pivot, start, parts))
        start += parts
    # at most PIVOTS rows
    deals = F.broadcast(near.sparkSession.createDataFrame(dealt, "pivot int, start int, parts int"))
    placed = near.join(deals, "pivot").withColumn("block", (F.col("start") + F.pmod(F.xxhash64("pid"), F.col("parts"))).cast("int"))
    return placed.select("block", "pivot", "reach", "pid", "m", "unit"), pivots


_FOUND = "kind string, block int, pivot int, reach double, leaf int, above array<int>, radius double, pid long, other long, m long, unit binary"


def _trees(placed: DataFrame, cosine: float) -> DataFrame:
    """One tree per block and the links inside it, as rows of four kinds.

    ``leaf``: leaf, its nodes above, radius and centre. ``member``: pid, m and vector of each row and its leaf. ``count``: links of a row. ``edge``:
    pid and the other end of a link path.
    """
    near = math.sqrt(2 - 2 * cosine)
    names = [f.split(" ")[0] for f in _FOUND.split(", ")]
    types = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def rows(kind: str, n: int, **columns) -> pa.Table:
        given = columns | {"kind": [kind] * n}
        return pa.Table.from_arrays([pa.array(given.get(c, [None] * n), t) for c, t in zip(names, types)], names=names)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        table = table.sort_by("pid")  # the tree does not depend on the order of arrival
        x, m, pid, units = _vectors(table["unit"]), table["m"].to_numpy(), table["pid"].to_numpy(), table["unit"].to_pylist()
        tree = grow(x, LEAF * near)
        n = len(tree.radius)
        leaves = [tree.order[tree.starts[k] : tree.starts[k + 1]] for k in range(n)]
        centres = [int(rows_[0]) for rows_ in leaves]
        links = _Links(x, m, cosine)
        for held in leaves:
            if len(held) > 1:
                links.among(held)
        skeleton = _Skeleton(x[centres], tree.radius, tree.above)
        for one, two, whole in meeting(skeleton, skeleton, near, same=True):
            for a, b, w in zip(one.tolist(), two.tolist(), whole.tolist()):
                links.between(leaves[a], leaves[b], w)
        linked, (ends, roots) = np.flatnonzero(links.count), links.edges()
        leaf_of = np.empty(len(x), np.int32)
        for k, held in enumerate(leaves):
            leaf_of[held] = k
        return pa.concat_tables(
            [
                rows("leaf", n, block=[block] * n, pivot=[table["pivot"][0].as_py()] * n, reach=[max(table["reach"].to_pylist())] * n, leaf=range(n), above=tree.above.T.tolist(), radius=tree.radius, unit=[units[c] for c in centres]),
                rows("member", len(x), block=[block] * len(x), leaf=leaf_of, pid=pid, m=m, unit=units),
                rows("count", len(linked), pid=pid[linked], m=links.count[linked]),
                rows("edge", len(ends), pid=pid[ends], other=pid[roots]),
            ]
        )

    return placed.groupBy("block").applyInArrow(build, _FOUND)


def _block_pairs(leaves: DataFrame, pivots: np.ndarray, near: float) -> DataFrame:
    """(i, j), i < j: blocks that the balls around their roots do not part."""
    blocks = materialize(leaves.groupBy("block").agg(F.first("pivot").alias("pivot"), F.max("reach").alias("reach")), "blocks")
    reach = np.full(len(pivots), -np.inf)
    for pivot, far in blocks.groupBy("pivot").agg(F.max("reach")).collect():  # one row per root
        reach[pivot] = far
    may = _distance(pivots, pivots) <= reach[:, None] + reach[None, :] + near + _SLACK
    # at most PIVOTS^2 rows
    pairs = leaves.sparkSession.createDataFrame([(int(p), int(q)) for p, q in zip(*np.nonzero(may))], "p int, q int")
    one, two = blocks.select(F.col("block").alias("i"), F.col("pivot").alias("p")), blocks.select(F.col("block").alias("j"), F.col("pivot").alias("q"))
    return one.join(pairs, "p").join(two, "q").filter("i < j").select("i", "j")


def _between(found: DataFrame, pivots: np.ndarray, cosine: float) -> DataFrame:
    """Links between blocks, as the rows ``count`` and ``edge`` of ``_trees``.

    First the skeletons of two blocks meet; only leaves that they leave open are then compared vector by vector.
    """
    near = math.sqrt(2 - 2 * cosine)
    leaves = found.filter("kind = 'leaf'").select("block", "pivot", "reach", "leaf", "above", "radius", "unit")
    pairs = materialize(_block_pairs(leaves, pivots, near), "block-pairs")
    sides = pairs.select(F.col("i").alias("block"), "i", "j").union(pairs.select(F.col("j").alias("block"), "i", "j"))

    def traverse(key: tuple, table: pa.Table) -> pa.Table:
        trees = []
        for block in key:
            side = table.filter(pc.equal(table["block"], block)).sort_by("leaf")
            trees.append(_Skeleton(_vectors(side["unit"]), side["radius"].to_numpy(), np.asarray(side["above"].to_pylist(), np.int64).T))
        open_pairs = list(meeting(*trees, near))
        a, b, whole = (np.concatenate([p[k] for p in open_pairs]) for k in range(3)) if open_pairs else ([], [], [])
        return pa.table({"i": pa.array([key[0].as_py()] * len(a), pa.int32()), "j": pa.array([key[1].as_py()] * len(a), pa.int32()), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "whole": pa.array(whole, pa.bool_())})

    met = leaves.select("block", "leaf", "above", "radius", "unit").join(sides, "block")
    met = materialize(met.groupBy("i", "j").applyInArrow(traverse, "i int, j int, a int, b int, whole boolean"), "open")
    wanted = met.select("i", "j", F.col("i").alias("block"), F.col("a").alias("leaf")).union(met.select("i", "j", F.col("j").alias("block"), F.col("b").alias("leaf"))).distinct()
    members = found.filter("kind = 'member'").select("block", "leaf", "pid", "m", "unit").join(materialize(wanted, "wanted"), ["block", "leaf"])

    def verify(key: tuple, opened: pa.Table, held: pa.Table) -> pa.Table:
        x, m, pid = _vectors(held["unit"]), held["m"].to_numpy(), held["pid"].to_numpy()
        rows: dict[tuple[int, int], list[int]] = {}
        for at, place in enumerate(zip(held["block"].to_pylist(), held["leaf"].to_pylist())):
            rows.setdefault(place, []).append(at)
        at_leaf = {place: np.asarray(r) for place, r in rows.items()}
        links, (i, j) = _Links(x, m, cosine), (k.as_py() for k in key)
        for a, b, w in zip(opened["a"].to_pylist(), opened["b"].to_pylist(), opened["whole"].to_pylist()):
            links.between(at_leaf[i, a], at_leaf[j, b], w)
        linked, (ends, roots) = np.flatnonzero(links.count), links.edges()
        none = [None] * len(linked)
        return pa.table(
            {
                "kind": pa.array(["count"] * len(linked) + ["edge"] * len(ends), pa.string()),
                "pid": pa.array(np.concatenate([pid[linked], pid[ends]]), pa.int64()),
                "other": pa.array([*none, *pid[roots].tolist()], pa.int64()),
                "m": pa.array([*links.count[linked].tolist(), *[None] * len(ends)], pa.int64()),
            }
        )

    return met.groupBy("i", "j").cogroup(members.groupBy("i", "j")).applyInArrow(verify, "kind string, pid long, other long, m long")


def near_vectors(vectors: DataFrame, num: int = 95, den: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, n_links, component_id and kept of every vector; vectors link at a cosine of num/den or more, in doubles.

    1. Vectors are scaled to length 1, where the cosine is a distance; equal ones are one point with a weight, found by their digest.
    2. Points go to the nearest of at most ``PIVOTS`` roots, which a bounded sample gives, and by roots into blocks of about ``BLOCK_ROWS``; roots with
       many points have several blocks.
    3. Each block grows a cover tree: nested centres whose radii halve, down to ``LEAF`` of the distance at the threshold. Its own
       pairs are found by going down the tree against itself.
    4. Skeletons of two blocks (leaf centres and radii, not the vectors) are gone down together. Nodes farther apart than their covering radii and the
       distance at the threshold are left out with all below them; so are blocks whose roots part them.
       Only leaves that stay open are compared on their vectors. Leaves in which all must link are counted as a whole.

    The radii are measured over all rows, so no link is lost and none is added. Tasks return numbers of links and paths through their
    components, not pairs. ``n_links`` counts the other rows linked directly, copies included; ``component_id`` is the smallest key reachable,
    its own included; ``kept`` is true where it is the key itself.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length do not link (each
    length is a run of its own). Null keys take part and name a component only where no other key is in it. Repeated
    rows and keys each return; no rows give no rows. Where no radius parts the blocks (vectors all about equally far apart), each
    skeleton meets each other one, and the shuffle of skeletons grows with the number of blocks.
    """
    cosine = num / den
    rows = materialize(unit_vectors(vectors, key, vector), "units")
    points = rows.filter(F.col("unit").isNotNull()).groupBy("digest").agg(
        F.first("unit").alias("unit"), F.first("dim").alias("dim"), F.min("id").alias("first"), F.count(F.lit(1)).alias("m")
    )
    points = materialize(points.withColumn("pid", F.monotonically_increasing_id()), "points")
    counts, edges = [], []
    for dim, n in points.groupBy("dim").count().orderBy("dim").collect():
        placed, pivots = _in_blocks(points.filter(F.col("dim") == dim), n)
        inside = materialize(_trees(placed, cosine), "trees")
        between = materialize(_between(inside, pivots, cosine), "between")
        for found in (inside, between):
            counts.append(found.filter("kind = 'count'").select("pid", F.col("m").alias("n")))
            edges.append(found.filter("kind = 'edge'").select(F.col("pid").alias("a"), F.col("other").alias("b")))
    told = points.select("digest", "pid", "first", (F.col("m") - 1).alias("copies"))
    if counts:
        linked = reduce(DataFrame.union, counts).groupBy("pid").agg(F.sum("n").alias("n"))
        labels = components(reduce(DataFrame.union, edges)).select(F.col("node").alias("pid"), "label")
        told = told.join(linked, "pid", "left").join(labels, "pid", "left")
    else:
        told = told.withColumns({"n": F.lit(0).cast("long"), "label": F.col("pid")})
    told = materialize(told.withColumns({"label": F.coalesce("label", "pid"), "n": F.coalesce("n", F.lit(0)) + F.col("copies")}).filter("n > 0"), "linked")
    least = told.groupBy("label").agg(F.min("first").alias("component"))
    named = materialize(told.join(least, "label").select("digest", "n", "component"), "named")
    component = F.coalesce("component", "id")
    return rows.join(named, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
