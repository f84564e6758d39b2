"""Suites, their checks under corruption, item preparation and release, strict sources, extended metrics by hand."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugewright.operators import checks, extended, generation, paired, reports, statistics, suites
from gaugewright.sources import files

REC = "cell string, item string, condition string, pos int, answer int, anchor int, gold int, parsed_ok boolean"


def one_suite(spark, name, n=2):
    specs = suites.suite_specs(spark, name, n_per_cell=n, domains=["snacks", "travel"]).cache()
    return specs, suites.suite_views(specs, name).cache()


def errors(specs, views, name, **more):
    return {r["error"] for r in checks.validate_suite(specs, views, name, **more).collect()}


@pytest.mark.parametrize("name", ["icl_dist", "tool"])
def test_corrupt_views_are_found(spark, name):
    specs, views = one_suite(spark, name)
    item, name_is = [r["item_id"] for r in specs.select("item_id").orderBy("item_id").collect()], lambda c: F.col("condition") == c
    hit = lambda k, c=None: (F.col("item_id") == item[k]) & (F.lit(True) if c is None else name_is(c))
    bad = views.where(~hit(0, "plausible_low") & ~hit(1, "control"))
    bad = bad.unionByName(views.where(hit(2, "control")))
    bad = bad.withColumn("evidence_text", F.when(hit(3, "plausible_low"), "- edited: 1").otherwise(F.col("evidence_text")))
    bad = bad.withColumn("anchor_value", F.when(hit(4, "plausible_low"), F.col("anchor_value") + 1).when(hit(5, "control"), 3).otherwise(F.col("anchor_value")))
    bad = bad.withColumn("prompt_text", F.when(hit(6), F.concat("prompt_text", F.lit("!"))).otherwise(F.col("prompt_text")))
    bad = bad.withColumn("condition", F.when(hit(7, "irrelevant_low"), "placebo_low").otherwise(F.col("condition")))
    bad = bad.withColumn("prompt_hash", F.when(hit(8), "same").otherwise(F.col("prompt_hash")))
    found = {}
    wrong = generation.manifest(views).withColumn("n_items", F.lit(5))
    for r in checks.validate_suite(specs, bad, name, wrong).collect():
        found.setdefault(r["key"].split("/")[0], set()).add(r["error"])
    assert found == {
        item[0]: {"base condition missing"}, item[1]: {"control missing"}, item[2]: {"view repeated"}, item[3]: {"differs from control"}, item[4]: {"anchors unequal"},
        item[5]: {"control has an anchor"}, item[6]: {"hash wrong"}, item[7]: {"base condition missing", "condition unexpected", "relevance unexpected"},
        item[8]: {"hash wrong", "prompts equal"}, "manifest": {"item count", "view count"},
    }


def test_corrupt_specs_are_found(spark):
    specs, views = one_suite(spark, "history")
    assert errors(specs, views, "history") == set()
    assert "gold differs" in errors(specs.withColumn("y_star", F.col("y_star") % 7), views, "history")
    assert "item repeated" in errors(specs.unionByName(specs), views, "history")
    assert "theta out of range" in errors(specs.withColumn("theta", F.lit(5)), views, "history")
    assert "one scenario for all" in errors(specs.withColumn("scenario_idx", F.lit(3)), views, "history")
    assert "difficulties uneven" in errors(specs.where("difficulty = 'easy' or n = 1"), views, "history")
    for rule in ("median", "weighted_mean"):
        assert checks.payload_errors(specs, "history").count() == 0
        assert generation.validate_specs(suites.suite_specs(spark, "external", n_per_cell=2, rule=rule)).count() == 0


def test_suites_differ_by_payload(spark):
    specs, views = one_suite(spark, "rag")
    r = {x["condition"]: x for x in views.where(F.col("item_id") == specs.first()["item_id"]).collect()}
    assert len(r) == 17 and r["plausible_low_order_first"]["components"]["anchor_rank"] == "1" and r["plausible_low_order_last"]["components"]["retrieved_doc_ids"].endswith("plausible_low")
    for x in r.values():
        if x["anchor_value"] is not None:
            at = x["anchor_start"]
            assert x["prompt_text"][at : at + len(str(x["anchor_value"]))] == str(x["anchor_value"])
    ranked = suites.suite_views(specs, "rag_realism").where("condition = 'plausible_high_rank5_distract'").first()
    assert ranked["components"]["anchor_rank"] == "5" and "[Document 5 | relevance=0.48]" in ranked["prompt_text"]
    h = one_suite(spark, "history")[1].where("condition = 'plausible_low'").first()
    assert h["anchor_value"] is None and h["components"]["stage2_user_message"] in h["prompt_text"]
    with pytest.raises(PySparkException):
        suites.suite_views(specs, "rag", suites.templates(spark, ["snacks"])).count()


def test_offsets_and_mirrored_ratings(spark):
    s = suites.suite_specs(spark, "external", n_per_cell=3)
    flipped = F.size(F.filter("evidence", lambda e: (e["value"] != e["value_raw"]) & ~e["missing"]))
    assert s.where((F.col("difficulty") == "easy") & (flipped != 0)).count() == 0
    assert s.where((F.col("difficulty") == "hard") & (flipped <= 1)).count() == s.where("difficulty = 'hard'").count()
    h = suites.suite_specs(spark, "history", n_per_cell=3).select((F.col("anchor_high") - F.col("theta")).alias("d"), "item_id")
    assert h.where("d = 25").count() == h.count() and h.where(F.col("item_id").contains("-off")).count() == 0


def test_strict_lines_fail_for_any_columns(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n{broken\n\n{"a": 2, "b": "y"}\n')
    df = files.read_jsonl(spark, f"file://{tmp_path}", "a int, b string")
    for use in (lambda d: d.count(), lambda d: d.groupBy("b").count().collect(), lambda d: d.select("a").collect(), lambda d: d.agg(F.max("b")).collect()):
        with pytest.raises(PySparkException, match="malformed line"):
            use(df)
    assert files.read_jsonl(spark, f"file://{tmp_path}", "a int, b string", strict=False).count() == 3


def test_last_line_of_a_key_wins(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text("".join(f'{{"item_id": "i{i % 3}", "condition": "c", "prompt_text": "t{i}"}}\n' for i in range(10)))
    got = files.read_prompt_views(spark, f"file://{tmp_path}", "item_id string, condition string, prompt_text string").collect()
    assert {r["item_id"]: r["prompt_text"] for r in got} == {"i0": "t9", "i1": "t7", "i2": "t8"}


def test_missing_specs_are_errors(spark):
    specs, views = one_suite(spark, "external")
    half = specs.where("n = 1")
    for use in (lambda d: d.count(), lambda d: d.groupBy("domain").count().collect(), lambda d: d.select("item_id").collect()):
        with pytest.raises(PySparkException, match="no spec"):
            use(generation.export_rows(views, half))
        with pytest.raises(PySparkException, match="no spec"):
            use(paired.prepare_items(views, half.select("item_id", "theta"), ["control"], ["domain"]))
    assert paired.prepare_items(views, specs.select("item_id", "theta"), ["control", "plausible_low"], ["domain"]).count() == specs.count()


def test_strict_baseline_and_panels(spark, tmp_path):
    rows = spark.createDataFrame([("a", "control"), ("b", "control_twostage"), ("c", "plausible_low")], "cell string, condition string")
    assert {r["cell"]: r["baseline"] for r in paired.baseline_choice(rows, ["cell"]).collect()} == {"a": "control", "b": "control_twostage", "c": "control"}
    with pytest.raises(PySparkException, match="no baseline"):
        paired.baseline_choice(rows, ["cell"], strict=True).count()
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "x.json").write_text('{"suite": "s", "uai": 0.5, "uai_n": 3}')
    (tmp_path / "s" / "y.json").write_text("{not json")
    got = files.read_optional_summaries(spark, f"file://{tmp_path}/s", "suite string, uai double, uai_n long")
    assert sorted((r["broken"], r["uai"]) for r in got.collect()) == [(False, 0.5), (True, None)]
    panel = spark.createDataFrame([("s",), ("t",)], "suite string")
    assert {r["suite"]: r["uai"] for r in files.panel(panel, got.where("not broken"), ["suite"]).collect()} == {"s": 0.5, "t": None}
    assert [tuple(r) for r in files.curves(got.where("not broken"), ["suite"], ["uai"]).collect()] == [("s", "uai", 0.5, 3)]
    live = spark.createDataFrame([("m", 0.0, 2.0), ("k", 1.0, 1.0)], "model string, price_in double, price_out double")
    kept = spark.createDataFrame([("m", 5.0, 6.0)], "model string, price_in double, price_out double")
    assert sorted(tuple(r) for r in files.merged_prices(live, kept).collect()) == [("k", 1.0, 1.0), ("m", 5.0, 2.0)]


def test_extended_metrics_by_hand(spark):
    rng, rows = random.Random(4), []
    for i in range(12):
        rows.append(("a", f"i{i}", "control", 0, 50, None, 52, True))
        for c, anchor, pull in (("plausible_low", 30, 0.5), ("plausible_high", 70, 0.6), ("irrelevant_low", 30, 0.1), ("irrelevant_high", 70, 0.2), ("placebo_low", 30, 0.0)):
            rows.append(("a", f"i{i}", c, 1, round(50 + pull * (anchor - 50)) + rng.choice([0, 1]), anchor, 52, True))
    rows.append(("a", "i0", "plausible_mild_low", 9, 20, 30, 52, True))  # replaces plausible_low of the same direction
    got = {r["vector"]: r for r in extended.extended_metrics(spark.createDataFrame(rows, REC), ["cell"], n_boot=200).collect()}
    assert {v: r["n"] for v, r in got.items()} == {"uai_plausible": 24, "uai_irrelevant": 24, "uai_placebo": 12, "disc_delta": 24, "mae": 12}
    assert got["mae"]["ci"]["mean"] == 2.0 and got["mae"]["ci"]["lo"] == 2.0 and got["mae"]["p"] is None
    assert got["uai_plausible"]["p"] < 1e-3 and got["uai_plausible"]["p_bh"] >= got["uai_plausible"]["p"]
    wide = extended.wide(spark.createDataFrame(list(got.values())), ["cell"]).first()
    assert wide["uai_plausible_n"] == 24 and wide["uai_authority_ci"] is None


def test_poisson_intervals_agree_with_resampling(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(2, 1, 400)
    rows = [("a", i, float(v), float(2 * v + rng.normal())) for i, v in enumerate(x)] + [(None, 0, 1.0, 1.0), ("b", 1, None, 2.0)]
    df = spark.createDataFrame(rows, "cell string, i int, x double, y double").repartition(3)
    exact = {r["cell"]: r for r in statistics.bootstrap_ci(df, ["cell"], "x", ["i"], 800).collect()}
    fold = {r["cell"]: r for r in statistics.bootstrap_ci(df, ["cell"], "x", ["i"], 800, method="poisson").collect()}
    for k in ("mean", "lo", "hi"):
        assert fold["a"][k] == pytest.approx(exact["a"][k], abs=0.02)
    r1, r2 = (statistics.pearson_ci(df.where("cell = 'a'"), ["cell"], "x", "y", ["i"], 800, method=m).first() for m in ("exact", "poisson"))
    assert r1["r"] == pytest.approx(r2["r"]) and r1["lo"] == pytest.approx(r2["lo"], abs=0.01) and r1["lo"] < r1["r"] < r1["hi"]


def test_maps_suffixes_and_orders(spark):
    df = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3})], "m map<string,int>, n map<string,int>")
    assert df.select(suites.merged(F.col("m"), F.col("n"))).first()[0] == {"a": 1, "b": 3}
    with pytest.raises(PySparkException, match="unknown suffix"):
        suites.with_suffix(spark.createDataFrame([("t",)], "prompt_text string"), "none").count()
    assert suites.flag_suffix(True, False, True).count("\n\n") == 2
    got = reports.ordered(spark.createDataFrame([("x",), ("b",), ("a",)], "s string"), "s", ["b", "a"]).collect()
    assert [r["s"] for r in got] == ["b", "a", "x"]
    assert files.suite_file(["itemspecs.jsonl", "promptviews_core.jsonl"], "promptviews", full=True) == "promptviews_core.jsonl"
