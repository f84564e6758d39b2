import json

import pytest

from gaugewright.schemas import RECORDS
from gaugewright.sources import files
from gaugewright.streaming.incremental import latest_metrics, recompute_on_arrival


def line(**x):
    return json.dumps({"item_id": "i", "condition": "control", "answer_int": 5, "parsed_ok": True} | x) + "\n"


def test_result_tree(spark, tmp_path):
    for p in ("ext/m1", "ext/m2/greedy", "_old/m1"):
        (tmp_path / p).mkdir(parents=True)
        (tmp_path / p / "results.jsonl").write_text(line(model_id=p) + "\n" + line(answer_int=None))
    got = {(r["suite"], r["slug"], r["variant"]) for r in files.read_results(spark, str(tmp_path)).collect()}
    assert got == {("ext", "m1", None), ("ext", "m2", "greedy")}
    reg = spark.createDataFrame([("m1", "Model One")], "slug string, short string")
    names = {r["slug"]: r["short"] for r in files.display_names(files.read_results(spark, str(tmp_path)), reg).collect()}
    assert names == {"m1": "Model One", "m2": "m2"}


def test_malformed_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(line() + "{broken\n")
    with pytest.raises(Exception, match="malformed line in .*a.jsonl"):
        files.read_jsonl(spark, str(tmp_path), RECORDS).collect()
    rows = files.read_jsonl(spark, str(tmp_path), RECORDS, strict=False).collect()
    assert [r["_corrupt_record"] for r in rows if r["item_id"] is None] == ["{broken"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(x for p in (tmp_path / "j").glob("*.json") for x in p.read_text().split()) == ['{"a":1}', '{"a":2,"b":0.5}']
    assert files.markdown(df, ["a"]).splitlines()[2] == "| 1 | - |"
    files.write_report(df, str(tmp_path / "r"), ["a"])
    assert files.checksums(spark, f"file://{tmp_path}/r").count() >= 1
    best = files.prefer(spark.createDataFrame([("k", 1, "full"), ("k", 2, "core")], "k string, rank int, v string"), ["k"], "rank").first()
    assert best["v"] == "full"


def test_stream(spark, tmp_path):
    schema = "m string, item string, condition string, pos int, answer int, anchor int, gold int, parsed_ok boolean"
    src = tmp_path / "in"
    src.mkdir()
    spark.createDataFrame([("a", "i", "plausible_low", 1, 45, 40, 50, True)], schema).write.mode("append").json(str(src))
    args = (str(tmp_path / "store"), str(tmp_path / "out"), ["m"], str(tmp_path / "ck"))
    recompute_on_arrival(spark.readStream.schema(schema).json(str(src)), *args).awaitTermination()
    assert latest_metrics(spark, args[1], ["m"]).first()["uai_plaus"] is None
    spark.createDataFrame([("a", "i", "control", 2, 50, None, 50, True)], schema).write.mode("append").json(str(src))
    recompute_on_arrival(spark.readStream.schema(schema).json(str(src)), *args).awaitTermination()
    assert latest_metrics(spark, args[1], ["m"]).first()["uai_plaus"] == 0.5


def test_unified_summaries_and_offsets(spark, tmp_path):
    from pyspark.sql import functions as F

    from gaugewright.functions.influence import offset_of

    (tmp_path / "a.json").write_text('[{"model": "m", "uai": 0.5}, {"model": "n", "uai": null}]')
    (tmp_path / "b.json").write_text('{"model": "o", "uai": 0.1}')
    got = files.read_summaries(spark, [f"file://{tmp_path}/a.json", f"file://{tmp_path}/b.json"], "model string, uai double")
    assert {r["model"]: r["uai"] for r in got.collect()} == {"m": 0.5, "n": None, "o": 0.1}
    ids = spark.createDataFrame([("EXT-d-e-off25-001", None), ("EXT-d-e-off25-001", 40), ("HIST-d-e-001", None)], "item_id string, anchor int")
    assert [r[0] for r in ids.select(offset_of(F.col("item_id"), F.col("anchor"))).collect()] == [25, 40, None]
