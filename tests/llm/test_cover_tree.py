"""Links of vectors against all pairs: one block and many, layers of blocks, copies, odd vectors."""

import duckdb
import numpy as np
import pytest

from gaugewright.llm import cover_tree as ct
from gaugewright.llm import queries


def _vectors(rng, n, d, groups, noise=0.5):
    x = rng.normal(size=(n, d))
    for _ in range(groups):
        at = rng.choice(n, int(rng.integers(2, max(3, n // 4))), replace=False)
        x[at] = x[at[0]] + rng.normal(size=(at.size, d)) * noise * rng.random()
    return x


def brute(ids, vectors, threshold=0.95):
    """vec_id -> (n_links, component_id, kept); None for a vector that links with nothing."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.abs(v).max() if good else None for v, good in zip(vectors, ok)]
    unit = [v if v is None else v / np.linalg.norm(v) for v in unit]
    links = [[j for j in range(len(ids)) if j != i and ok[i] and ok[j] and unit[i].size == unit[j].size and unit[i] @ unit[j] >= threshold] for i in range(len(ids))]
    root = list(range(len(ids)))
    for start in range(len(ids)):
        reach, todo = {start}, [start]
        while todo:
            new = [j for j in links[todo.pop()] if j not in reach]
            reach.update(new)
            todo += new
        root[start] = min(ids[j] for j in reach)
    return sorted((ids[i], len(links[i]), root[i], ids[i] == root[i]) for i in range(len(ids)))


@pytest.mark.parametrize("d", [2, 3, 64])
def test_walks_of_trees(d):
    rng = np.random.default_rng(d)
    for _ in range(15):
        n = int(rng.integers(2, 300))
        x = _vectors(rng, n, d, int(rng.integers(0, 4)) if n > 3 else 0)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = np.triu(x @ x.T >= 0.95, 1)
        both, w = near | near.T, rng.integers(1, 4, n)
        cut = int(rng.integers(1, n))
        trees = [ct.build_tree(np.arange(a, b), np.arange(a, b), x[a:b], np.zeros(b - a), w[a:b]) for a, b in ((0, n), (0, cut), (cut, n))]
        counts, pairs, i, j = np.zeros(n, np.int64), set(), [], []
        for a, b in ((trees[1], trees[1]), (trees[2], trees[2]), (trees[1], trees[2])):
            links = ct.walk(a, b, 0.95, ct.Links(a, b))
            for tree, c in zip((a, b), links.counts()):
                counts[tree.ids] += c
            ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
            g = links.graph()
            i, j = [*i, *ids[g[0]]], [*j, *ids[g[1]]]
            found = ct.walk(a, b, 0.95, ct.Pairs(a, b)).found
            got = [tuple(sorted(p)) for x_, y_ in found for p in zip(a.ids[x_].tolist(), b.ids[y_].tolist())]
            assert len(got) == len(set(got))
            pairs.update(got)
        assert (counts == (both * w).sum(1)).all()
        assert pairs == set(zip(*(k.tolist() for k in np.nonzero(near))))
        assert (ct.components_of(n, np.array(i, int), np.array(j, int)) == ct.components_of(n, *np.nonzero(both))).all()
        for tree in trees:
            for k, (s, e) in enumerate(zip(tree.start, tree.end)):
                assert ct._apart(tree.vectors[s:e] @ tree.vectors[s]).max() <= tree.radii[k] + ct.SLACK


@pytest.mark.parametrize("most,fan", [(4096, 8), (20, 8), (7, 2)])
def test_links_and_pairs_over_blocks_and_layers(spark, monkeypatch, most, fan):
    """Small blocks make layers of roots; results are those of all pairs."""
    rng = np.random.default_rng(most)
    d = 8
    vectors = [v.tolist() for v in _vectors(rng, 150, d, 6)]
    vectors += [vectors[0]] * 9 + [[2 * x for x in vectors[1]]] * 2 + [[1.0, 0.0], [1.0, 0.0], [1.0, 0.01], [1e200, 1e200], [5e-324, 5e-324]]
    vectors += [None, [], [0.0] * d, [None] * d, [float("nan")] * d, [float("inf")] + [0.0] * (d - 1), [0.0, -0.0]]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    monkeypatch.setattr(ct, "BLOCK_POINTS", most)
    monkeypatch.setattr(ct, "PARTNERS", fan)
    monkeypatch.setattr(ct, "LEAST_POINTS", most)
    df = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids))), "vec_id long, embedding array<double>, n_links string").repartition(3)
    got = sorted(tuple(r) for r in ct.vector_links(df).collect())
    assert got == brute(ids, vectors)
    pairs, members = ct.vector_pairs(df)
    of = {}
    for r in members.collect():
        of.setdefault(r["class_id"], []).append(r["vec_id"])
    by = dict(zip(ids, vectors))
    links = {i: sum(len(of[c]) - 1 for c in of if i in of[c]) for i in ids}
    seen = [tuple(sorted(r)) for r in pairs.collect()]
    assert len(seen) == len(set(seen)) and all(a != b and by[of[a][0]] != by[of[b][0]] for a, b in seen)
    for a, b in seen:
        for i in of[a]:
            links[i] += len(of[b])
        for i in of[b]:
            links[i] += len(of[a])
    assert links == {r[0]: r[1] for r in got}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(7, [1.0]), (7, [1.0]), (None, [2.0])]])
def test_empty_null_and_repeated(spark, rows):
    got = sorted((tuple(r) for r in ct.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    assert got == {0: [], 1: [(1, 0, 1, True)], 3: [(7, 2, 7, True), (7, 2, 7, True), (None, 2, 7, False)]}[len(rows)]


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(ct.ORACLE_SQL["op11_cover_tree"]).fetchall())
    assert sorted(tuple(r) for r in queries.QUERIES["op11_cover_tree"](spark, sf).select("vec_id", "n_links", "component_id", "kept").collect()) == want
