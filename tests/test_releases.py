"""Digests of releases, records read without a shuffle, scoring rules and SQL functions."""

import pytest
from pyspark.sql import functions as F

from gaugewright.functions import influence
from gaugewright.functions.registry import register_functions
from gaugewright.operators import generation, metrics, paired
from gaugewright.schemas import CORE
from gaugewright.sources import files


def test_only_changed_ranges_are_compared(spark, monkeypatch):
    monkeypatch.setattr(generation, "DIGEST_RANGES", 64)
    old = [(i, f"t{i}") for i in range(400)] + [(7, "t7"), (None, None), (None, None)]
    new = [(i, f"t{i}" if i != 9 else "other") for i in range(1, 401)] + [(None, None)]
    a, b = (spark.createDataFrame(x, "_range int, text string").repartition(3) for x in (old, new))
    got = sorted((tuple(r) for r in generation.stale_rows(a, b).collect()), key=repr)
    want = [(0, "t0", -1), (7, "t7", -1), (9, "t9", -1), (None, None, -1), (9, "other", 1), (400, "t400", 1)]
    assert got == sorted(want, key=repr)
    stored = generation.range_digests(a).cache()
    assert sorted((tuple(r) for r in generation.stale_rows(a, b, stored).collect()), key=repr) == got
    assert 0 < generation.changed_ranges(stored, generation.range_digests(b)).count() <= 6
    assert generation.stale_rows(a, a.repartition(5)).count() == 0
    # sums of parts are the whole's
    parts = generation.range_digests(a.where("_range < 50")).unionByName(generation.range_digests(a.where("_range >= 50 or _range is null")))
    whole = parts.groupBy("_range").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    assert generation.changed_ranges(whole, stored).count() == 0


def _exchanges_below(df, table):
    """Exchanges on the way from a table's scan up to the first join or aggregate that ends the stored side."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "Scan" in x and table in x)
    depth, out = lines[at].index("Scan"), 0
    for x in reversed(lines[:at]):
        inner = len(x) - len(x.lstrip(" :+-*()0123456789"))
        if inner < depth:
            depth = inner
            if "Join" in x:
                break
            out += "Exchange" in x
    return out


def test_stored_records_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("m", f"i{k % 40}", CORE[k % 5], k, k % 100, 40 if k % 5 else None, 50, True) for k in range(300)]
        df = spark.createDataFrame(rows, "m string, item string, condition string, pos long, answer int, anchor int, gold int, parsed_ok boolean")
        done = files.write_bucketed(df, "gw_done", ["item", "condition"], 4)
        wanted = spark.createDataFrame([(f"i{k}", c) for k in range(50) for c in CORE], "item string, condition string")
        left = paired.open_tasks(wanted, done, ["item", "condition"])
        assert _exchanges_below(left, "gw_done") == 0
        assert left.count() == 250 - df.select("item", "condition").distinct().count()
        cells = files.write_bucketed(df, "gw_cells", ["m", "item"], 4)
        for got in (paired.last_wins(cells, ["m"]), paired.item_table(cells, ["m"])):
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert metrics.unified_metrics(cells, ["m"]).collect() == metrics.unified_metrics(df, ["m"]).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for t in ("gw_done", "gw_cells"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_an_added_rule_works_in_answers_and_checks(spark):
    influence.register_rule("highest", lambda values, weights: F.array_max(values).cast("double"))
    try:
        grid = generation.grid_over(spark.range(60).withColumnRenamed("id", "global_idx"), "EXT")
        specs = generation.itemspecs(grid, rule="highest")
        assert specs.where(F.col("y_star") != F.array_max(generation.visible(F.col("evidence")))).count() == 0
        assert generation.validate_specs(specs).count() == 0
        assert generation.validate_specs(specs.withColumn("rule", F.lit("median"))).count() > 0
        with pytest.raises(ValueError, match="already"):
            influence.register_rule("mean", None)
    finally:
        del influence.RULES["highest"]


def test_functions_in_sql_text(spark):
    names = register_functions(spark, "t_")
    assert "t_item_uai" in names
    cols = [("item_uai", influence.item_uai, "acn"), ("toward_anchor", influence.toward_anchor, "acn"), ("classify_shift", influence.classify_shift, "acn"), ("adjustment_rate", influence.adjustment_rate, "acn"), ("recovery_rate", influence.recovery_rate, "acn"), ("rational_ceiling", influence.rational_ceiling, "wn"), ("implied_weight", influence.implied_weight, "wn")]
    df = spark.createDataFrame([(a, c, n, w) for a in (None, 10, 50) for c in (None, 50, 12) for n in (None, 10, 13, 0) for w in (None, -0.5, 0.4, 1.0, float("nan"))], "a int, c int, n int, w double")
    for name, f, args in cols:
        both = df.select(F.expr(f"t_{name}({', '.join(args)})").alias("x"), f(*[F.col(x) for x in args]).alias("y"))
        assert both.where(~F.col("x").eqNullSafe(F.col("y"))).count() == 0, name
    lists = spark.createDataFrame([([],), ([60, 70, 80],), ([1, 2],), ([0, 1, 5, 9],)], "v array<int>").withColumn("w", F.array(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(4.0)))
    for rule in ("mean", "median", "weighted_mean"):
        own = lists.select(influence.gold_answer(F.col("v"), rule, F.col("w")).alias("y"), F.expr(f"t_gold_{rule}(v{', w' if rule == 'weighted_mean' else ''})").alias("x"))
        assert own.where("x != y or x is null").count() == 0, rule
