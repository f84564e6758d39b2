"""Lines named in errors, files listed without being read, runs that appear as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from gaugewright.sources import committed, files


def _lines(tmp_path, n=2000, bad=None, text='{"a": 1, "b": "%s"'):
    lines = [json.dumps({"a": i, "b": "é" * (i % 40)}, ensure_ascii=False) if i % 7 else "" for i in range(n)]
    if bad is not None:
        lines[bad] = text
    (tmp_path / "x.jsonl").write_text("\n".join(lines), encoding="utf-8")
    return lines


def test_ranges_of_a_file_give_every_line_once(spark, tmp_path):
    lines = _lines(tmp_path)
    got = committed.read_numbered(spark, str(tmp_path), "a int, b string", split=1000)
    assert got.rdd.getNumPartitions() > 20
    rows = got.orderBy("place").collect()
    assert [r["a"] for r in rows] == [i for i, x in enumerate(lines) if x] and rows[5]["b"] == "é" * (rows[5]["a"] % 40)
    assert {r["source_path"] for r in rows} == {str(tmp_path / "x.jsonl")}
    assert committed.read_numbered(spark, f"file://{tmp_path}/x.jsonl", "a int", split=999).agg(F.sum("a")).first()[0] == sum(r["a"] for r in rows)


@pytest.mark.parametrize("bad,text", [(0, "{broken"), (1501, '{"a": 1}}'), (1999, '{"a": '), (1234, "[1]")])
def test_malformed_line_is_named(spark, tmp_path, bad, text):
    _lines(tmp_path, bad=bad, text=text)
    df = committed.read_numbered(spark, str(tmp_path), "a int, b string", split=1000)
    for action in (df.count, df.select("a").collect):
        with pytest.raises(Exception, match=rf"x\.jsonl:{bad + 1}: malformed JSON"):
            action()


def test_lines_of_other_shapes_are_fine(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"a": 1}\r\n  {"a": "x", "c": [1, {"d": null}]}  \n\n{"a": null}')
    assert [r["a"] for r in committed.read_numbered(spark, str(tmp_path), "a string").orderBy("place").collect()] == ["1", "x", None]
    (tmp_path / "empty.jsonl").write_text("")
    assert committed.read_numbered(spark, str(tmp_path / "empty.jsonl"), "a int").count() == 0
    with pytest.raises(Exception, match="none.jsonl"):
        committed.read_numbered(spark, str(tmp_path / "none.jsonl"), "a int").count()


def test_listing_reads_no_content(spark, tmp_path):
    for p in ("rag/z", "ext/m2/greedy", "ext/m1", "ext", "ext/a/b/c", "old/m1"):
        (tmp_path / p).mkdir(parents=True, exist_ok=True)
        (tmp_path / p / "results.jsonl").write_text("{not json")
    (tmp_path / "ext/m1/other.jsonl").write_text("x")
    registry = spark.createDataFrame([("m1", "Model One")], "slug string, short string")
    got = files.list_results(spark, str(tmp_path), ("rag", "ext"), registry)
    rows = [tuple(r)[:4] for r in got.orderBy("ord").collect()]
    assert rows == [(0, "rag", "z", "z"), (1, "ext", "m1", "Model One"), (2, "ext", "m2", "m2")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan or "content" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_run_appears_as_a_whole(spark, tmp_path):
    path = tmp_path / "run"
    df = spark.createDataFrame([("m/1", "s", 0.5), ("m2", None, None)], "model string, suite string, uai double").repartition(3)
    committed.write_run(df, str(path), ["model", "suite"], {"backend": "api"})
    config = json.loads((path / "run_config.json").read_text())
    assert config["backend"] == "api" and {"timestamp", "revision", "version"} <= config.keys()
    assert json.loads((path / "cells/model=m%2F1/suite=s/summary.json").read_text()) == {"model": "m/1", "suite": "s", "uai": 0.5}
    assert (path / "cells/model=m2/suite=__HIVE_DEFAULT_PARTITION__/summary.json").exists()
    assert {r["model"] for r in spark.read.json(str(path / "all")).collect()} == {"m/1", "m2"}
    # a task fails: the earlier run stays as it is and nothing else is left
    broken = df.withColumn("uai", F.when(F.col("model") == "m2", F.raise_error(F.lit("lost"))).otherwise(F.col("uai")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        committed.write_run(broken, str(path), ["model", "suite"])
    assert json.loads((path / "run_config.json").read_text()) == config and sorted(p.name for p in tmp_path.iterdir()) == ["run"]
    # a rerun replaces all of it
    committed.write_run(df.where("model = 'm2'"), str(path), ["model"])
    assert not (path / "cells/model=m%2F1").exists() and spark.read.json(str(path / "all")).count() == 1
