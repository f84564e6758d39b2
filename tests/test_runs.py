"""Whole runs with a fake model, the fallback hook, routing, and partitioned streaming."""

import pytest
from pyspark.sql import functions as F

from gaugewright.operators import inference, paired, runs, suites
from gaugewright.sources import files


def specs(spark, suite, n=1):
    return suites.suite_specs(spark, suite, n_per_cell=n, domains=["snacks"])


def test_suites_run_and_resume(spark, tmp_path):
    s = specs(spark, "external")
    got = runs.run_suite(s, "external", inference.fake_backend, "m").cache()
    assert got.count() == 6 * 9 and got.where("parsed_ok").count() == got.count()
    assert runs.run_suite(s, "external", inference.fake_backend, "m", got).count() == 0
    m = runs.suite_metrics(got, "external")
    assert (m.first()["n_items"], m.first()["parse_rate"]) == (6, 1.0)
    runs.finish(got.drop("components"), m, f"file://{tmp_path}/run")
    assert spark.read.json(f"file://{tmp_path}/run/summaries/all").first()["n_items"] == 6
    two = runs.run_suite(specs(spark, "history"), "history", inference.fake_backend, "m")
    r = {x["condition"]: x for x in two.where("item_id like '%-001'").collect()}
    assert r["plausible_low"]["anchor_value"] == r["plausible_low"]["stage1_answer"] and r["control"]["stage1_answer"] is None
    assert runs.suite_metrics(two, "history", two_stage=True).first()["n_records"] == 12


def test_probes(spark):
    s = specs(spark, "external")
    by = {r["mitigation"]: r["count"] for r in runs.run_strategies(s, "external", inference.fake_backend, "m", ["baseline", "cot"]).groupBy("mitigation").count().collect()}
    assert by == {"baseline": 54, "cot": 54}
    assert runs.run_sampling(s, "external", inference.fake_backend, "m", [0.0, 0.7], [1, 2]).count() == 54 * 3
    part = runs.run_variant(s, "uncertain", inference.fake_backend, "m")
    assert {r["k"]: r["n_records"] for r in runs.partial_evidence_metrics(part).collect()} == {1: 30, 2: 30, 3: 30}
    rag = specs(spark, "rag")
    core = runs.run_suite(rag, "rag", inference.fake_backend, "m")
    levels = {r["level"] for r in runs.variant_curve(runs.run_variant(rag, "rag_realism", inference.fake_backend, "m", core), "rag_realism").collect()}
    assert levels == {"baseline", "rank1", "rank5", "rank5_distract"}


def test_fallback_is_asked_for_failed_texts_only(spark):
    asked = []
    df = spark.createDataFrame([(1, "My final answer is 7."), (2, "no idea " * 400), (3, None), (4, "dunno")], "i int, raw_text string").withColumn("prompt_text", F.lit("p"))
    got = {r["i"]: r for r in inference.parsed_records(df, fallback=lambda ps: ["it is 42" if "..." in p else "NONE" for p in ps]).collect()}
    assert [(got[i]["answer_int"], got[i]["parse_strategy"]) for i in (1, 2, 3, 4)] == [(7, "final_answer"), (42, "llm_fallback"), (None, "failed"), (None, "failed")]
    assert not asked


def test_routing(spark):
    df = spark.createDataFrame([("google/gemma-x", "vllm", True), ("a/api", None, False), ("b", "openrouter", None)], "model_id string, backend string, supports_tools boolean")
    r = {x["model_id"]: x for x in inference.plain_tool_prompts(inference.routed(df, ["openrouter"], ["a/api"])).collect()}
    assert [r[k]["is_hosted"] for k in ("google/gemma-x", "a/api", "b")] == [False, True, True]
    assert [r[k]["plaintext"] for k in ("google/gemma-x", "a/api", "b")] == [True, True, False]


def test_small_texts(spark, tmp_path):
    assert [files.number(*a, **k) for a, k in (((None,), {}), ((0.125,), {}), ((0.5,), {"signed": True}), ((0.256,), {"percent": True}))] == ["-", "0.12", "+0.50", "26%"]
    with pytest.raises(ValueError, match="more than 3"):
        files.markdown(spark.range(9), ["id"], most=3)
    assert files.read_or_empty(spark, f"file://{tmp_path}/none.jsonl", "suite string, a int").count() == 0


def echo(tools_sent=True):
    """A model that says what it was given: the temperature and seed as a number, or how many messages and tools. (Made here: workers don't import tests.)"""

    class Echo:
        supports_tools = tools_sent

        def __call__(self, prompts, settings=None):
            return [f"My final answer is {round(100 * s['temperature']) % 50 + s['seed_idx'] if s else 99}." for s in settings or [None] * len(prompts)]

        def chat(self, messages, settings, tools=None):
            assert all(m[0]["role"] == "system" and "tool_call_id" not in m[0] for m in messages)
            return [f"My final answer is {10 * len(m) + len(tools or [])}." for m in messages]

    return Echo()


def test_settings_reach_the_backend(spark):
    got = runs.run_sampling(specs(spark, "external"), "external", echo(), "m", [0.0, 0.7], [1, 2, 3])
    by = {r["tag"]: r["a"] for r in got.groupBy("tag").agg(F.collect_set("answer_int").alias("a")).collect()}
    assert by == {"greedy": [0], "t0.7_s1": [21], "t0.7_s2": [22], "t0.7_s3": [23]}
    assert {tuple(r) for r in got.select("temperature", "seed_idx", "top_p").distinct().collect()} == {(0.0, 0, 1.0), *((0.7, s, 0.9) for s in (1, 2, 3))}


def test_tool_views_are_asked_as_messages_or_plain(spark):
    s = specs(spark, "tool")
    answers = lambda **k: {r[0] for r in runs.run_suite(s, "tool", **k).select("answer_int").distinct().collect()}
    assert answers(backend=echo(), model_id="m") == {62}
    assert answers(backend=echo(), model_id="m", plain_tools=True) == answers(backend=echo(), model_id="x/Gemma-2") == {99}
    assert answers(backend=echo(False), model_id="m") == {99}
    assert inference.sends_plain_tools("m", inference.fake_backend)


def test_spliced_runs_don_t_depend_on_arrival(spark, tmp_path):
    schema = "model_id string, suite string, item_id string, condition string, answer_int int, anchor_value int, y_star int, parsed_ok boolean, place long"
    line = lambda c, a, place: ("m", "s", "i", c, a, 40 if c != "control" else None, 50, True, place)
    core = spark.createDataFrame([line("control", 5, 0), line("control", 90, 7)], schema)
    new = spark.createDataFrame([line("control", 10, 3), line("plausible_low", 25, 4)], schema)
    for a in (core, core.orderBy(F.desc("place"))):
        for n in (new, new.repartition(2), new.orderBy("place")):
            m = runs.suite_metrics(paired.splice(a, n), "external").first()
            assert (m["mae"], m["uai_plaus"], m["n_records"]) == (40.0, 0.5, 4)
    assert runs.suite_metrics(paired.splice(core, new, ("plausible_low",)), "external").first()["mae"] == 40.0
    assert runs.suite_metrics(core, "external").first()["mae"] == 40.0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_jsonl(spark, f"file://{tmp_path}/core.jsonl", schema)


def test_first_rows(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 5, "w")], "k string, place int, v string")
    assert {(r["k"], r["v"]) for r in paired.keep_first(df, ["k"], ["place"]).collect()} == {("a", "y"), (None, "z")}
