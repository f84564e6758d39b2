"""Vectors at least so alike by cosine: cover trees, walked in pairs (operator 11).

Unit vectors at cosine c are sqrt(2 - 2 c) apart, so a threshold of cosines is one of distances. Equal vectors are one
point. Points are dealt to blocks around pivots (a bounded sample; any dealing gives the same pairs), each task builds a
cover tree of its block: levels with radii 2, 1, 1/2, ..., each node's centre one of its own points and its parent's
centre among its children's, all centres below a node farther apart than the level's radius, levels that would not split a
node left out. A node keeps the covering radius that its points really have.

Two trees are walked together: a pair of nodes whose centres are farther apart than both radii and the threshold holds no
pair of points and ends there; where even the farthest points are near enough, all pairs are taken at once, as counts;
other pairs are replaced by those of their children. Blocks are points with a radius themselves: a tree over the blocks'
roots (in blocks again, where they are many) finds the pairs of blocks to walk, so blocks never meet all other blocks
unless the vectors make them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table
from .components import connected_components

THRESHOLD = 0.95
#: Points of a block: so many parts of all points, but at most BLOCK_POINTS and BLOCK_BYTES, at least LEAST_POINTS.
BLOCK_PARTS, BLOCK_POINTS, BLOCK_BYTES, LEAST_POINTS = 24, 4096, 1 << 22, 256
#: Pivots around which points are dealt to blocks: at most so many, and so many bytes. They are the points with the lowest digests.
PIVOTS, PIVOT_BYTES = 4096, 1 << 24
#: Blocks that one task walks against one block.
PARTNERS = 8
#: Nodes of up to so many points are leaves; their points are compared one by one.
LEAF_POINTS = 16
#: Slack of distances: bounds that are closer to the threshold decide nothing, single points are then compared by cosine.
SLACK = 1e-6
_STRIP, _NET = 512, 256


@dataclass
class Tree:
    """Points in the order of the tree: unit vectors, radii of the points (0 for vectors), weights; and nodes (first and end point, first child, number of children) with covering radii. A node's centre is its first point."""

    ids: np.ndarray
    reps: np.ndarray
    vectors: np.ndarray
    own: np.ndarray
    weights: np.ndarray
    nodes: np.ndarray
    radii: np.ndarray
    labels: np.ndarray | None = None

    def __post_init__(self):
        self.start, self.end, self.child, self.children = self.nodes.T
        self.below = np.concatenate([[0], np.cumsum(self.weights)])
        self.heft = self.below[self.end] - self.below[self.start]

    def split(self, node: int) -> np.ndarray:
        """The children of a node, or the node itself if it is a leaf."""
        n = self.children[node]
        return np.arange(self.child[node], self.child[node] + n) if n else np.array([node])


def _apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def build_tree(ids: np.ndarray, reps: np.ndarray, vectors: np.ndarray, own: np.ndarray, weights: np.ndarray) -> Tree:
    """Cover tree of at least one point; vectors have length 1."""
    n = len(ids)
    order = np.arange(n)
    root = int(np.argmax(vectors @ vectors.mean(0)))
    order[0], order[root] = order[root], order[0]
    far = _apart(vectors[order] @ vectors[order[0]])
    nodes, radii, spread = [[0, n, 0, 0]], [float((far + own[order]).max())], [float(far.max())]
    k = 0
    while k < len(nodes):
        start, end = nodes[k][:2]
        if end - start > LEAF_POINTS and spread[k] > SLACK:
            nodes[k][2] = len(nodes)
            at = start
            for part, apart in _net(vectors, order[start:end].copy(), 2.0 ** (np.ceil(np.log2(spread[k])) - 1)):
                order[at : at + part.size] = part
                nodes.append([at, at + part.size, 0, 0])
                radii.append(float((apart + own[part]).max()))
                spread.append(float(apart.max()))
                at += part.size
            nodes[k][3] = len(nodes) - nodes[k][2]
        k += 1
    return Tree(ids[order], reps[order], np.ascontiguousarray(vectors[order]), own[order], weights[order], np.array(nodes, np.int64), np.array(radii))


def _net(vectors: np.ndarray, rest: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Centres farther apart than ``radius``, the first point first, each with the points it covers that no earlier one does: (points, distances), the centre first."""
    least = 1 - radius * radius / 2
    while rest.size:
        cosine = vectors[rest[:_NET]] @ vectors[rest].T
        near, free = cosine >= least, np.ones(rest.size, bool)
        for i in range(len(cosine)):
            if free[i]:
                covered = np.flatnonzero(near[i] & free)
                free[covered] = False
                free[i] = False
                covered = np.concatenate([[i], covered[covered != i]])
                apart = _apart(cosine[i, covered])
                apart[0] = 0
                yield rest[covered], apart
        rest = rest[free]


class Links:
    """What a walk over two trees (or one) finds: linked weight of every point, links for components, and pairs of points that only their own blocks can decide."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b, self.same = a, b, a is b
        self.sums = [np.zeros(len(t.ids) + 1, np.int64) for t in ((a,) if self.same else (a, b))]
        self.whole = np.zeros(len(a.ids) + 1, np.int64)
        self.edges, self.joined, self.open = [], ([], []), []

    def nodes(self, p: np.ndarray, q: np.ndarray) -> None:
        """All pairs of points of the nodes p and q, element by element, are links."""
        a, b, last = self.a, self.b, self.sums[-1]
        alike = (p == q) if self.same else np.zeros(p.size, bool)
        np.add.at(self.whole, a.start[p[alike]], 1)
        np.add.at(self.whole, a.end[p[alike]], -1)
        np.add.at(self.sums[0], a.start[p], b.heft[q])
        np.add.at(self.sums[0], a.end[p], -b.heft[q])
        np.add.at(last, b.start[q[~alike]], a.heft[p[~alike]])
        np.add.at(last, b.end[q[~alike]], -a.heft[p[~alike]])
        self.edges.append((a.start[p], b.start[q]))
        self.joined[0].append(p)
        self.joined[1].append(q)

    def points(self, i: np.ndarray, j: np.ndarray) -> None:
        """The pairs of points i and j, element by element, are links."""
        for sums, at, add in ((self.sums[0], i, self.b.weights[j]), (self.sums[-1], j, self.a.weights[i])):
            np.add.at(sums, at, add)
            np.add.at(sums, at + 1, -add)
        self.edges.append((i, j))

    def undecided(self, i: np.ndarray, j: np.ndarray) -> None:
        self.open.append((i, j))

    def counts(self) -> list[np.ndarray]:
        """For each tree, how much weight every point is linked to, itself left out."""
        found = [np.cumsum(s[:-1]) for s in self.sums]
        found[0] -= np.cumsum(self.whole[:-1]) * self.a.weights
        return found

    def graph(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what all links connect; points of the second tree follow those of the first."""
        shift = 0 if self.same else len(self.a.ids)
        found = [(i, j + shift) for i, j in self.edges]
        for tree, nodes, add in ((self.a, self.joined[0], 0), (self.b, self.joined[1], shift)):
            nodes = np.unique(np.concatenate(nodes)) if nodes else np.zeros(0, np.int64)
            n = tree.end[nodes] - tree.start[nodes]
            first = np.repeat(tree.start[nodes], n)
            found.append((first + add, first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + add))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Pairs(Links):
    """Pairs of points themselves: ``found`` holds (i, j) of both trees."""

    def __init__(self, a: Tree, b: Tree):
        super().__init__(a, b)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def nodes(self, p: np.ndarray, q: np.ndarray) -> None:
        for x, y in zip(p.tolist(), q.tolist()):
            i, j = np.arange(self.a.start[x], self.a.end[x]), np.arange(self.b.start[y], self.b.end[y])
            i, j = np.repeat(i, j.size), np.tile(j, i.size)
            self.points(*((i[i < j], j[i < j]) if self.same and x == y else (i, j)))

    def points(self, i: np.ndarray, j: np.ndarray) -> None:
        self.found.append((i, j))


def walk(a: Tree, b: Tree, threshold: float, links: Links) -> Links:
    """Walk two trees, or one with itself, and tell ``links`` what they find."""
    t, same = float(np.sqrt(2 - 2 * threshold)), a is b
    exact = not a.own.any() and not b.own.any()
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        if not a.children[p] and not b.children[q]:
            _leaves(a, b, p, q, threshold, t, exact, links)
            continue
        rows, cols = a.split(p), b.split(q)
        alone = b.radii[cols] == 0
        for cols in (cols[alone], cols[~alone]):  # few nodes of a sparse tree have a radius: they don't loosen the bound of all others
            if not cols.size:
                continue
            to, reach = b.vectors[b.start[cols]].T, b.radii[cols].max() + t + SLACK
            for at in range(0, rows.size, _STRIP):
                part = rows[at : at + _STRIP]
                bound = a.radii[part] + reach
                cosine = a.vectors[a.start[part]] @ to
                i, j = np.nonzero(cosine >= np.where(bound < 2, 1 - bound * bound / 2, -2)[:, None])
                apart = _apart(cosine[i, j])
                i, j = part[i], cols[j]
                both = a.radii[i] + b.radii[j]
                keep = apart <= both + t + SLACK
                if same and p == q:
                    keep &= (i < j) | (i == j) & (a.end[i] - a.start[i] > 1)
                full = keep & (apart + both <= t - SLACK)
                links.nodes(i[full], j[full])
                i, j = i[keep & ~full], j[keep & ~full]
                small = (a.children[i] == 0) & (b.children[j] == 0) & ((a.end[i] - a.start[i]) * (b.end[j] - b.start[j]) <= LEAF_POINTS**2)
                _small(a, b, i[small], j[small], threshold, t, exact, links)
                stack += zip(i[~small].tolist(), j[~small].tolist())
    return links


def _small(a: Tree, b: Tree, p: np.ndarray, q: np.ndarray, threshold: float, t: float, exact: bool, links: Links) -> None:
    """Points of pairs of small leaves, many pairs at once."""
    for at in range(0, p.size, _STRIP):
        x, y = p[at : at + _STRIP], q[at : at + _STRIP]
        wide, each = b.end[y] - b.start[y], (a.end[x] - a.start[x]) * (b.end[y] - b.start[y])
        k = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(wide, each)
        i, j = np.repeat(a.start[x], each) + k // wide, np.repeat(b.start[y], each) + k % wide
        if a is b:
            once = (i < j) | np.repeat(x != y, each)
            i, j = i[once], j[once]
        cosine = np.concatenate([np.einsum("ij,ij->i", a.vectors[i[c : c + 8192]], b.vectors[j[c : c + 8192]]) for c in range(0, i.size, 8192)] or [np.zeros(0)])
        _tell(a, b, i, j, cosine, threshold, t, exact, links)


def _tell(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, cosine: np.ndarray, threshold: float, t: float, exact: bool, links: Links) -> None:
    """Decide pairs of points: vectors by their cosine, points with a radius by bounds."""
    if exact:
        near = cosine >= threshold
        links.points(i[near], j[near])
        return
    apart, both = _apart(cosine), a.own[i] + b.own[j]
    sure = apart + both <= t - SLACK
    links.points(i[sure], j[sure])
    open_ = ~sure & (apart <= both + t + SLACK)
    links.undecided(i[open_], j[open_])


def _leaves(a: Tree, b: Tree, p: int, q: int, threshold: float, t: float, exact: bool, links: Links) -> None:
    """Points of two leaves of which one holds many points at one place."""
    for at in range(a.start[p], a.end[p], _STRIP):
        i = np.arange(at, min(at + _STRIP, a.end[p]))
        cosine = a.vectors[i] @ b.vectors[b.start[q] : b.end[q]].T
        i, j = np.repeat(i, b.end[q] - b.start[q]), np.tile(np.arange(b.start[q], b.end[q]), i.size)
        once = i < j if a is b and p == q else np.ones(i.size, bool)
        _tell(a, b, i[once], j[once], cosine.ravel()[once], threshold, t, exact, links)


def components_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest point that each of ``n`` points is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_POINTS = "dim int, id long, rep long, w long, own double, vector binary"
_BLOCK = "dim int, rep long, radius double, weight long, centre binary, ids binary, reps binary, vectors binary, own binary, weights binary, nodes binary, radii binary, labels binary, counts binary, joined binary, open_a binary, open_b binary"
_FOUND = "kind string, a long, b long"
_LONGS = ("ids", "reps", "weights", "labels", "counts", "open_a", "open_b")


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _longs(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64)


def _unpack(row: dict) -> Tree:
    longs = {c: _longs(row[c]) for c in ("ids", "reps", "weights", "labels")}
    return Tree(vectors=np.frombuffer(row["vectors"]).reshape(-1, row["dim"]), own=np.frombuffer(row["own"]), nodes=_longs(row["nodes"]).reshape(-1, 4), radii=np.frombuffer(row["radii"]), **longs)


def _block(points: pa.Table, threshold: float) -> pa.Table:
    """One row: the tree of a block's points and what a walk with itself finds."""
    dim = points.column("dim")[0].as_py()
    vectors = np.frombuffer(b"".join(points.column("vector").to_pylist())).reshape(-1, dim)
    tree = build_tree(*(points.column(c).to_numpy() for c in ("id", "rep")), vectors, *(points.column(c).to_numpy() for c in ("own", "w")))
    links = walk(tree, tree, threshold, Links(tree, tree))
    i, j = links.graph()
    joined = np.zeros(len(tree.ids), bool)
    joined[i] = joined[j] = True
    open_ = [np.concatenate([tree.ids[x[k]] for x in links.open] or [np.zeros(0, np.int64)]) for k in (0, 1)]
    values = {
        "dim": dim, "rep": int(tree.reps[0]), "radius": float(tree.radii[0]), "weight": int(tree.weights.sum()), "centre": tree.vectors[0],
        **{c: getattr(tree, c) for c in ("ids", "reps", "vectors", "own", "weights", "nodes", "radii")},
        "labels": components_of(len(tree.ids), i, j), "counts": links.counts()[0], "joined": joined, "open_a": open_[0], "open_b": open_[1],
    }
    kinds = {"dim": pa.int32(), "rep": pa.int64(), "radius": pa.float64(), "weight": pa.int64()}
    return pa.table({c: pa.array([values[c] if c in kinds else np.ascontiguousarray(values[c]).tobytes()], kinds.get(c, pa.binary())) for c in _names(_BLOCK)})


def _rows(kind: str, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"kind": pa.array([kind] * len(a), pa.string()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _deal(points: DataFrame, n: int, roots: bool) -> DataFrame:
    """Points with (cell, chunk): the nearest pivot, and a part of its points where they are more than a block's."""
    dim = points.agg(F.max("dim")).first()[0] or 1
    fits = max(1, min(BLOCK_POINTS, BLOCK_BYTES // (8 * dim)))
    if roots and n <= fits:
        return points.withColumns({"cell": F.lit(0), "chunk": F.lit(0)})
    most = fits if roots else min(fits, max(LEAST_POINTS, n // BLOCK_PARTS))
    k = max(1, min(-(-n // most), PIVOTS, PIVOT_BYTES // (8 * dim)))
    sample = points.select("dim", "vector").orderBy(F.xxhash64("vector"), "vector").limit(k).collect()
    pivots = {d: np.array([np.frombuffer(r["vector"]) for r in sample if r["dim"] == d]) for d in {r["dim"] for r in sample}}
    names = [*_names(_POINTS), "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, dims = np.zeros(batch.num_rows, np.int32), batch.column(0).to_numpy()
            for d, near in pivots.items():
                at = np.flatnonzero(dims == d)
                for part in np.array_split(at, -(-at.size // 1024)) if at.size else ():
                    vectors = np.frombuffer(b"".join(batch.column(5).take(pa.array(part)).to_pylist())).reshape(-1, d)
                    cells[part] = np.argmax(vectors @ near.T, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=names)

    dealt = materialize(points.select(*_names(_POINTS)).mapInArrow(run, f"{_POINTS}, cell int"), "cover-dealt")
    sizes = dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(float(most))).cast("int").alias("chunks"))
    return dealt.join(sizes, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).drop("chunks")


def _blocks(points: DataFrame, threshold: float, roots: bool) -> tuple[DataFrame, DataFrame | None]:
    """The blocks of the points, and the blocks' roots as points; none if no two blocks can meet."""
    n = points.count()
    made = _deal(points, n, roots).groupBy("dim", "cell", "chunk").applyInArrow(lambda t: _block(t, threshold), _BLOCK)
    blocks = materialize(made.withColumn("block", F.monotonically_increasing_id()), "cover-blocks")
    count, dims = blocks.agg(F.count("*"), F.count_distinct("dim")).first()
    up = blocks.select("dim", F.col("block").alias("id"), "rep", F.col("weight").alias("w"), F.col("radius").alias("own"), F.col("centre").alias("vector"))
    return blocks, up if count > dims else None


def _told(blocks: DataFrame) -> DataFrame:
    """What the blocks' walks with themselves found, with what a layer above found for whole blocks (columns more, all)."""
    names = ["ids", "reps", "labels", "counts", "joined", "own", "open_a", "open_b", "more", "all"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = {c: _longs(row[c]) for c in _LONGS if c in row}
                label = np.zeros(len(x["ids"]), np.int64) if row["all"] else x["labels"]
                joined = np.frombuffer(row["joined"], bool) | bool(row["all"])
                joined = joined & (np.frombuffer(row["own"]) > 0)
                far = label != np.arange(len(label))
                yield from _rows("count", x["ids"], x["counts"] + row["more"]).to_batches()
                yield from _rows("edge", x["reps"][far], x["reps"][label[far]]).to_batches()
                yield from _rows("joined", x["ids"][joined], np.ones(joined.sum(), np.int64)).to_batches()
                yield from _rows("open", x["open_a"], x["open_b"]).to_batches()

    return blocks.select(*names).mapInArrow(run, _FOUND)


def _walked(blocks: DataFrame, candidates: DataFrame, threshold: float, pairs: bool = False) -> DataFrame:
    """Walk the pairs of blocks (a, b): rows of kind count, edge, joined and open, or only near pairs (kind pair). A task holds one block and PARTNERS others, about."""
    share = F.greatest(F.lit(1), F.ceil(F.count("*").over(W.partitionBy("a")) / F.lit(float(PARTNERS))))
    keyed = materialize(candidates.select("a", "b").withColumn("s", F.pmod(F.xxhash64("b"), share)), "cover-candidates")
    held = blocks.select("block", "dim", *(c for c in _names(_BLOCK) if c in ("ids", "reps", "vectors", "own", "weights", "nodes", "radii", "labels")))
    left = keyed.select("a", "s").distinct().join(held, F.col("a") == F.col("block"))
    left = left.select(*[F.col(c).alias(f"_{c}") for c in left.columns])  # names of their own for the cogroup
    right = keyed.join(held, F.col("b") == F.col("block"))

    def run(one: pa.Table, others: pa.Table) -> pa.Table:
        if not one.num_rows:
            return _rows("count", [], [])
        one = one.rename_columns([c[1:] for c in one.column_names])
        a, place, out = _unpack(one.to_pylist()[0]), one.column("block")[0].as_py(), []
        total = np.zeros(len(a.ids), np.int64)
        for k in range(others.num_rows):
            row = others.slice(k, 1).to_pylist()[0]
            b = a if row["block"] == place else _unpack(row)
            if pairs:
                links = walk(a, b, threshold, Pairs(a, b))
                out += [_rows("pair", a.ids[i], b.ids[j]) for i, j in links.found + links.open]
                continue
            links = walk(a, b, threshold, Links(a, b))
            counts = links.counts()
            total += counts[0]
            some = np.flatnonzero(counts[1])
            out.append(_rows("count", b.ids[some], counts[1][some]))
            i, j = links.graph()
            ids, reps = np.concatenate([a.ids, b.ids]), np.concatenate([a.reps, b.reps])
            if a.own.any() or b.own.any():
                joined = np.unique(np.concatenate([i, j]))
                out.append(_rows("joined", ids[joined], np.ones(joined.size, np.int64)))
            label = np.concatenate([a.labels, b.labels + len(a.ids)])
            ends = np.unique(np.sort(np.stack([label[i], label[j]]), 0), axis=1)
            ends = ends[:, ends[0] != ends[1]]
            out += [_rows("edge", reps[ends[0]], reps[ends[1]]), *(_rows("open", a.ids[i], b.ids[j]) for i, j in links.open)]
        some = np.flatnonzero(total)
        return pa.concat_tables([_rows("count", a.ids[some], total[some]), *out])

    return left.groupBy("_a", "_s").cogroup(right.groupBy("a", "s")).applyInArrow(run, _FOUND)


def search(points: DataFrame, threshold: float = THRESHOLD, roots: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of points (dim, id, rep, w, own, vector): found (id, n, joined), edges (a, b) and open (a, b).

    ``n`` is the weight that each point is linked to, ``joined`` tells that all vectors under a point with a radius are
    connected, edges are between class ids ``rep`` and connect what the links connect, and open are pairs of points with
    radii that are neither near nor apart as a whole.
    """
    blocks, up = _blocks(points, threshold, roots)
    if up is None:
        out = _told(blocks.withColumns({"more": F.lit(0).cast("long"), "all": F.lit(False)}))
    else:
        found, edges, candidates = search(up, threshold, True)
        out = _told(blocks.join(found.select(F.col("id").alias("block"), F.col("n").alias("more"), F.col("joined").alias("all")), "block"))
        out = out.unionByName(_walked(blocks, candidates, threshold)).unionByName(edges.select(F.lit("edge").alias("kind"), "a", "b"))
    out = materialize(out, "cover-found")
    found = out.where("kind in ('count', 'joined')").groupBy(F.col("a").alias("id"))
    found = found.agg(F.sum(F.when(F.col("kind") == "count", F.col("b")).otherwise(0)).alias("n"), F.bool_or(F.col("kind") == "joined").alias("joined"))
    return found, out.where("kind = 'edge'").select("a", "b"), out.where("kind = 'open'").select("a", "b")


def search_pairs(points: DataFrame, threshold: float = THRESHOLD, roots: bool = False) -> DataFrame:
    """All pairs (a, b) of ids of points that are near, or, of points with radii, not apart."""
    blocks, up = _blocks(points, threshold, roots)
    candidates = blocks.select(F.col("block").alias("a"), F.col("block").alias("b"))
    if up is not None:
        candidates = candidates.unionByName(search_pairs(up, threshold, True))
    return materialize(_walked(blocks, candidates, threshold, pairs=True), "cover-pairs").select("a", "b")


def unit_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Rows (vec_id, digest, dim, vector): the vector as a unit vector of doubles, and a digest that equal vectors share; null for vectors that can link with nothing."""
    number = F.col("_v").cast("array<double>")
    valid = (F.size(number) > 0) & F.forall(number, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(number, lambda x: x != 0)
    source = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("_v")).select("vec_id", F.when(valid, number).alias("vector"))
    schema = source.select("vec_id", F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("dim"), F.lit(None).cast("binary").alias("vector")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, dims, units = [], [], []
            for value in batch.column(1):
                if not value.is_valid:
                    digests.append(None), dims.append(0), units.append(None)
                    continue
                x = value.values.to_numpy() + 0.0  # one zero
                digests.append(blake2b(x.tobytes(), digest_size=20).digest())
                x = x / np.abs(x).max()
                dims.append(x.size), units.append((x / np.sqrt((x * x).sum())).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=schema.names)

    return source.mapInArrow(run, schema)


def vector_classes(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Written tables of members (vec_id, digest) and of classes of equal vectors (digest, low, points' columns): ``low`` is the smallest id."""
    rows = materialize(unit_vectors(df, vec_id, vector), "cover-vectors")
    classes = rows.where("digest is not null").groupBy("digest", "dim").agg(F.min("vec_id").alias("low"), F.count("*").alias("w"), F.first("vector").alias("vector"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "cover-classes")
    return rows.select("vec_id", "digest"), classes.select("digest", "low", "dim", "id", F.col("id").alias("rep"), "w", F.lit(0.0).alias("own"), "vector")


#: Classes with more than this part of all rows are broadcast to their members (fewer classes than its inverse); the others are joined by key.
HOT_PART = 10_000


def vector_links(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links (other rows at least so alike), component_id (smallest vec_id reachable) and kept (vec_id = component_id).

    Null and zero vectors and those with null or non-finite components link with nothing, and vectors of different
    lengths not with each other. Every row counts, also one that repeats an id; null ids come after all others. An empty
    table gives no rows. Vectors are compared in double precision.
    """
    members, classes = vector_classes(df, vec_id, vector)
    found, edges, _ = search(classes, threshold)
    roots = connected_components(edges, "a", "b")
    named = classes.select("digest", "low", "id", "w").join(found.select("id", "n"), "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = materialize(named, "cover-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    result = materialize(named.join(lowest, "root").select("digest", "w", (F.col("n") + F.col("w") - 1).alias("n_links"), "component_id"), "cover-result")
    hot = F.broadcast(result.where(F.col("w") > members.count() // HOT_PART + 256).drop("w"))
    valid = members.where("digest is not null")
    out = valid.join(hot, "digest").unionByName(valid.join(hot, "digest", "left_anti").join(result.drop("w"), "digest"))
    alone = members.where("digest is null").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    return out.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def vector_pairs(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The pairs themselves: (a, b) between class ids, each once, and membership (vec_id, class_id); equal vectors are one class and not a pair."""
    members, classes = vector_classes(df, vec_id, vector)
    return search_pairs(classes, threshold), members.join(classes.select("digest", F.col("id").alias("class_id")), "digest").select("vec_id", "class_id")


def op11_cover_tree(spark, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = {
    "op11_cover_tree": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = vec_id"""
}
