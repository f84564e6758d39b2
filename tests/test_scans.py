"""Work over one large group, dealt to ranges and blocks, against the same work in one task."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugewright.operators import scans, statistics


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(scans, "RANGE_ROWS", 30)
    monkeypatch.setattr(statistics, "BLOCK_VALUES", 40)


def test_places_of_one_group(spark, small_ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None]), rng.randrange(40), i) for i in range(500)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "g string, o int, i int").repartition(3)
    ranged = scans.in_ranges(df, ["g"], ["o", "i"])
    assert ranged.groupBy("_range").count().agg(F.max("count")).first()[0] <= 2 * scans.RANGE_ROWS
    got = scans.places(df, ["g"], ["o", "i"]).collect()
    for g in ("a", None, "b"):
        want = sorted((o, i) for x, o, i in rows if x == g)
        own = sorted((r["_place"], r["o"], r["i"], r["_n"]) for r in got if r["g"] == g)
        assert own == [(k, o, i, len(want)) for k, (o, i) in enumerate(want)]


def test_one_value_is_split_too(spark, small_ranges):
    df = spark.range(300).select(F.lit("a").alias("g"), F.lit(1).alias("o"))
    assert scans.in_ranges(df, ["g"], ["o"]).groupBy("_range").count().agg(F.max("count")).first()[0] <= 2 * scans.RANGE_ROWS
    assert sorted(r["_place"] for r in scans.places(df, ["g"], ["o"]).collect()) == list(range(300))


def test_signed_ranks_of_one_cell(spark, small_ranges):
    rng = np.random.default_rng(2)
    d = np.round(rng.normal(size=700), 2)
    rows = [("a", float(x)) for x in d] + [(None, 1.0), (None, -2.0), ("b", 0.0)]
    got = {r["c"]: r for r in statistics.signed_ranks(spark.createDataFrame(rows, "c string, d double"), ["c"], "d").collect()}
    x = d[d != 0]
    size = np.abs(x)
    ranks = np.array([(size < s).sum() + ((size == s).sum() + 1) / 2 for s in size])
    ties = sum(k**3 - k for k in np.unique(size, return_counts=True)[1].tolist())
    assert (got["a"]["n"], got["a"]["w_plus"], got["a"]["w_minus"], got["a"]["tie_term"]) == (x.size, ranks[x > 0].sum(), ranks[x < 0].sum(), ties)
    assert (got[None]["n"], got[None]["w_plus"], got[None]["w_minus"]) == (2, 1.0, 2.0) and "b" not in got


def test_adjusted_probabilities_of_one_family(spark, small_ranges):
    rng = random.Random(3)
    rows = [("f", i, rng.choice([None, round(rng.random(), 2), rng.random()])) for i in range(600)] + [(None, 1, 0.5), (None, 2, 0.1)]
    got = statistics.bh_adjust(spark.createDataFrame(rows, "f string, i int, p double"), ["f"], "p", ["i"]).collect()
    assert len(got) == len(rows)
    for family in ("f", None):
        ps = sorted((p, i) for f, i, p in rows if f == family and p is not None)
        want, low = {}, 1.0
        for k in range(len(ps), 0, -1):
            low = min(low, ps[k - 1][0] * len(ps) / k)
            want[ps[k - 1][1]] = low
        for r in got:
            if r["f"] == family:
                assert (r["p_bh"] is None) == (r["p"] is None) and (r["p"] is None or math.isclose(r["p_bh"], want[r["i"]], rel_tol=1e-12))


def _by_cell(df):
    return {r["c"]: r for r in df.collect()}


def test_exact_intervals_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(c, i, float(rng.normal() + (i % 3)), float(rng.normal() + i % 5)) for c, n in (("a", 333), (None, 95), ("s", 7)) for i in range(n)]
    rows += [("flat", i, 2.0, float(i)) for i in range(90)] + [("rare", i, float(i == 50), float(i % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "c string, i int, x double, y double").repartition(4)
    one = _by_cell(statistics.bootstrap_ci(df, ["c"], "x", ["i"], 60)), _by_cell(statistics.pearson_ci(df, ["c"], "x", "y", ["i"], 60))
    monkeypatch.setattr(statistics, "BLOCK_VALUES", 40)
    monkeypatch.setattr(statistics, "_DRAWN", 17)
    many = _by_cell(statistics.bootstrap_ci(df, ["c"], "x", ["i"], 60)), _by_cell(statistics.pearson_ci(df, ["c"], "x", "y", ["i"], 60))
    for want, got in zip(one, many):
        assert want.keys() == got.keys()
        for c in want:
            for a, b in zip(list(want[c])[1:], list(got[c])[1:]):
                assert a is b is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (c, want[c], got[c])
