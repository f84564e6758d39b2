"""Merkle manifests against a tree built leaf by leaf."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gaugewright.llm import merkle, queries

UPPER_TO_LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([_h(*row[i : i + 8]) for i in range(0, len(row), 8)])
    return levels


def _path(levels, i):
    out = []
    for row in levels[:-1]:
        start = i - i % 8
        out.append((i % 8, row[start:i] + row[i + 1 : start + 8]))
        i //= 8
    return out


def brute(rows):
    """doc_id -> manifest row, for rows (doc_id, source, lang, n_chars, text) with distinct ids."""
    leaf = {r[0]: _h(*map(_field, r)) for r in rows}
    by = {}
    for r in sorted(rows):
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _tree([leaf[r[0]] for r in by[x]]) for x in langs}
    top = _tree([trees[x][-1][0] for x in langs])
    out = {}
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            path = _path(trees[x], i) + _path(top, k)
            d = leaf[r[0]]
            if zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                d = _h(*map(_field, (*r[:4], r[4].translate(UPPER_TO_LOWER))))
            for place, others in path:
                d = _h(*others[:place], d, *others[place:])
            out[r[0]] = (leaf[r[0]], trees[x][-1][0], top[-1][0], _h(*sum((o for _, o in path), [])), d, d == top[-1][0])
    return out


def _got(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def _query(df):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.leaf_digest(*fields, F.translate("text", merkle.UPPER, merkle.LOWER)))
    return merkle.merkle_manifest(df, "lang", ("doc_id",), merkle.leaf_digest(*fields, F.col("text")), tampered, keep=("doc_id",))


def test_whole_documents_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert _got(queries.QUERIES["op13_merkle_manifest"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("parts", [1, 7])
def test_any_number_of_ranges_groups_and_nulls(spark, parts):
    rng = random.Random(parts)
    langs = [None, "", "-", "é", "z", *(f"l{i}" for i in range(70))]
    rows = [(i, rng.choice([None, "s"]), rng.choice(langs if i % 3 else [None]), rng.choice([None, 5]), rng.choice([None, "", "Ab c", "x" * 30_000])) for i in range(-400, 800)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = _got(_query(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
    assert _got(_query(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))) == brute(rows)


def test_repeated_rows_are_leaves_and_names_are_free(spark):
    rows = [(1, "a", "x", 0)] * 20 + [(None, "b", "x", 1), (2, "c", None, 2)]
    df = spark.createDataFrame(rows, "g long, leaf string, pid string, _row int").repartition(3)
    out = merkle.merkle_manifest(df, "pid", ("g",), merkle.leaf_digest(F.col("g"), F.col("leaf")), keep=("g", "leaf", "_row")).collect()
    assert len(out) == 22 and all(r["verified"] for r in out) and len({r["root"] for r in out}) == 1


def test_partial_parents():
    """What ranges resolve and leave open is together the whole tree, wherever the cuts are."""
    leaves = [_h(str(i)) for i in range(777)]
    whole, sizes = _tree(leaves), merkle._sizes(777)
    for cuts in ([0, 777], [0, 1, 9, 64, 65, 512, 776, 777], [0, 300, 777]):
        families, nodes = {}, {}
        for a, b in zip(cuts, cuts[1:]):
            got, open_ = merkle._combine(a, leaves[a:b], sizes)
            families |= got
            nodes |= {(lv, i): d for lv, i, d in open_}
        for (lv, p), kids in families.items():
            assert kids == whole[lv][8 * p : 8 * p + 8]
        assert all(whole[lv][i] == d for (lv, i), d in nodes.items())
        assert sum(map(len, families.values())) + len(nodes) >= 777
