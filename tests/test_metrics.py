"""Paired metrics against hand-computed cases and a plain-Python model over random records."""

import random

import pytest
from pyspark.sql import functions as F

from gaugewright.functions.influence import adjustment_rate, anchor_proximity, classify_shift, gold_answer, implied_weight, rational_ceiling, recovery_rate
from gaugewright.operators import analysis, metrics, paired, statistics
from gaugewright.schemas import CORE, CORE_ANCHORED

SCHEMA = "m string, item string, condition string, pos int, answer int, anchor int, gold int, parsed_ok boolean, stage1 int"


def cells(spark, rows, **more):
    return {r["m"]: r for r in metrics.unified_metrics(spark.createDataFrame(rows, SCHEMA), ["m"], **more).collect()}


def test_hand_case(spark):
    rows = [("a", "i", "control", 0, 50, None, 52, True, None), ("a", "i", "plausible_high", 1, 55, 60, 52, True, None), ("a", "i", "plausible_low", 2, 51, 52, 52, True, None), ("a", "i", "irrelevant_low", 3, 55, 40, 52, True, None)]
    r = cells(spark, rows)["a"]
    assert (r["uai_plausible_high"], r["uai_plausible_low"], r["uai_irrelevant_low"]) == (0.5, None, -0.5)
    assert (r["uai_plaus"], r["n_uai_plaus"], r["uai_irr"], r["disc_delta"]) == (0.5, 1, -0.5, 1.0)
    assert (r["tar_plaus"], r["tar_irr"], r["mae"], r["acc10"], r["parse_rate"]) == (1.0, 0.0, 2.0, 1.0, 1.0)


def test_later_unparsed_row_does_not_erase(spark):
    rows = [("a", "i", "control", 0, 50, None, 50, True, None), ("a", "i", "control", 1, None, None, 50, False, None), ("a", "i", "plausible_low", 2, 40, 40, 50, True, None), ("a", "i", "plausible_low", 3, 45, 40, 50, True, None)]
    r = cells(spark, rows)["a"]
    assert (r["uai_plaus"], r["parse_rate"], r["n_items"], r["n_records"]) == (0.5, 0.75, 1, 4)


def test_empty_and_unparsed(spark):
    assert cells(spark, []) == {}
    r = cells(spark, [("a", "i", "control", 0, None, None, 1, False, None)])["a"]
    assert (r["n_items"], r["parse_rate"], r["uai_plaus"], r["mae"]) == (0, 0.0, None, None)


def test_random_records_and_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), str(rng.randint(0, 30)), rng.choice(CORE), i, rng.choice([None, *range(101)]), None, 50, rng.random() < 0.8, None) for i in range(800)]
    rows = [(*r[:5], None if r[2] == "control" else rng.randint(0, 100), *r[6:]) for r in rows]
    last = {}
    for r in rows:
        if r[7]:
            last[r[0], r[1], r[2]] = r
    want = {}
    for (m, i, c), r in last.items():
        y = last.get((m, i, "control"))
        if c in CORE_ANCHORED and y and y[4] is not None and r[4] is not None and abs(r[5] - y[4]) >= 3:
            want.setdefault((m, c), []).append((r[4] - y[4]) / (r[5] - y[4]))
    rng.shuffle(rows)
    got = cells(spark, rows)
    for (m, c), v in want.items():
        assert got[m][f"uai_{c}"] == pytest.approx(sum(v) / len(v))


def test_grouping_sets_agree_with_breakdowns(spark):
    rng = random.Random(3)
    items = {str(i): (rng.choice([15, 25, None]), rng.choice(["easy", "hard"])) for i in range(20)}
    rows = [("a", i, c, k, rng.randint(0, 100), None if c == "control" else rng.randint(0, 100), 50, True, None, *items[i]) for k, (i, c) in enumerate((i, c) for i in items for c in CORE)]
    df = spark.createDataFrame(rows, SCHEMA + ", offset int, difficulty string")
    sets = metrics.metrics_grouping_sets(df, ["m"], ["offset", "difficulty"])
    by = {(r["offset"], round(r["uai_plaus"], 9)) for r in metrics.metrics_by(df, ["m"], "offset").collect()}
    assert by == {(r["offset"], round(r["uai_plaus"], 9)) for r in sets.where("level = 'offset'").collect()}
    assert sets.where("level = 'total'").count() == 1 and sets.where("level = 'difficulty'").count() == 2


def test_formulas(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert v(adjustment_rate(lit(60), lit(40), lit(55))) == 0.75 and v(recovery_rate(lit(60), lit(40), lit(55))) == 0.75
    assert v(adjustment_rate(lit(60), lit(60), lit(55))) is None
    assert v(classify_shift(lit(10), lit(20), lit(30))) == "harmful" and v(classify_shift(lit(25), lit(20), lit(30))) == "helpful" and v(classify_shift(lit(40), lit(20), lit(30))) == "neutral"
    assert v(anchor_proximity(lit(29), lit(20), lit(30))) == "closer" and v(anchor_proximity(lit(40), lit(20), lit(30))) == "equidistant"
    assert v(rational_ceiling(lit(1.0), lit(5))) == 1 / 6 and v(rational_ceiling(lit(1.0), lit(0))) == 1.0
    assert v(implied_weight(lit(0.5), lit(5))) == 5.0 and v(implied_weight(lit(1.0), lit(5))) is None and v(implied_weight(lit(-0.1), lit(5))) == 0.0
    a = lambda *x: F.array(*map(lit, x)).cast("array<int>")
    assert v(gold_answer(a())) == 0 and v(gold_answer(a(60, 70, 80), "median")) == 70 and v(gold_answer(a(1, 2))) == 2 and v(gold_answer(a(0, 1))) == 0
    assert v(gold_answer(a(60, 70, 80), "weighted_mean", F.array(lit(1.0), lit(1.0), lit(2.0)))) == 72


def test_statistics(spark):
    p = statistics.signed_rank_probability
    assert p(8, 36, 0, 0) == pytest.approx(2 / 256) and p(6, 21, 0, 0) == pytest.approx(2 / 64) and p(5, 15, 0, 0) is None
    d = spark.createDataFrame([("a", float(x)) for x in (0, 0, 1, 2, 3, 4, 5, 6)] + [("z", 0.0)], "c string, d double")
    assert [(r["c"], r["n"], round(r["p"], 9)) for r in statistics.wilcoxon(d, ["c"], "d").collect()] == [("a", 6, 2 / 64)]
    b = spark.createDataFrame([("f", i, x) for i, x in enumerate((0.01, 0.04, 0.03, 0.2, None))], "f string, i int, p double")
    got = {r["i"]: r["p_bh"] for r in statistics.bh_adjust(b, ["f"], "p", ["i"]).collect()}
    assert [round(got[i], 4) if got[i] is not None else None for i in range(5)] == [0.04, 0.0533, 0.0533, 0.2, None]


def test_bootstrap_forms(spark):
    rows = [("a", i, float(i % 2)) for i in range(40)] + [("k", i, 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "c string, i int, v double")
    one = {r["c"]: r for r in statistics.bootstrap_ci(df, ["c"], "v", ["i"], 200).collect()}
    many = {r["c"]: r for r in statistics.bootstrap_ci(df, ["c"], "v", ["i"], 200, method="poisson").collect()}
    assert (one["k"]["mean"], one["k"]["lo"], one["k"]["hi"]) == (3.0, 3.0, 3.0)
    assert one["a"]["mean"] == many["a"]["mean"] == 0.5 and abs(one["a"]["lo"] - many["a"]["lo"]) < 0.1 and abs(one["a"]["hi"] - many["a"]["hi"]) < 0.1
    assert one["a"] == {r["c"]: r for r in statistics.bootstrap_ci(df.repartition(3), ["c"], "v", ["i"], 200).collect()}["a"]


def test_curve_counts_repeats(spark):
    rows = [("m", "a", "control", 0, 50, None, 0, True, None), ("m", "a", "x", 1, 51, 52, 0, True, None), ("m", "b", "control", 2, 50, None, 0, True, None), ("m", "b", "x", 3, 55, 60, 0, True, None), ("m", "b", "x", 4, 55, 60, 0, True, None)]
    got = analysis.curve(spark.createDataFrame(rows, SCHEMA), ["m"], F.when(F.col("condition") == "x", "x")).first()
    assert (got["uai"], got["n"]) == (0.5, 2)


def test_tasks_and_baselines(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item string")
    conds = spark.createDataFrame([("control",), ("x",)], "condition string")
    done = spark.createDataFrame([("a", "x"), ("a", "x")], "item string, condition string")
    assert paired.open_tasks(paired.tasks(items, conds), done, ["item", "condition"]).count() == 3
    recs = spark.createDataFrame([("p", "control"), ("q", "control_twostage"), ("r", "x")], "m string, condition string")
    assert {r["m"]: r["baseline"] for r in paired.baseline_choice(recs, ["m"]).collect()} == {"p": "control", "q": "control_twostage", "r": "control"}
