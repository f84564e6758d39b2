"""The stream's metrics from keyed state against the batch query."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from gaugewright.operators.metrics import unified_metrics
from gaugewright.schemas import CORE
from gaugewright.streaming import keyed

SCHEMA = "m string, item string, condition string, pos long, answer int, anchor int, gold int, parsed_ok boolean"


def _records(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for pos in range(n):
        condition = rng.choice([*CORE, "placebo_low"])
        anchor = None if condition == "control" else rng.choice([None, 10, 40, 90])
        rows.append((rng.choice(["a", "b", None]), f"i{rng.randrange(25)}", condition, pos, rng.choice([None, *range(0, 101, 7)]), anchor, rng.choice([None, 50]), rng.choice([True, True, True, False, None])))
    return rows


def _run(spark, src, out, ck):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    keyed.fold_on_arrival(stream, out, ["m"], ck).awaitTermination()
    got = keyed.folded_metrics(spark, out, ["m"]).collect()
    return {r["m"]: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in got}


def _batch(spark, rows):
    got = unified_metrics(spark.createDataFrame(rows, SCHEMA), ["m"]).collect()
    return {r["m"]: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()} for r in got}


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_arrival_equals_the_batch_query(spark, tmp_path, seed):
    rows = _records(seed)
    arrival = rows[:]
    random.Random(seed + 9).shuffle(arrival)  # controls come late, older rows after newer ones
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(3):
        spark.createDataFrame(arrival[k * 100 : (k + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    assert _run(spark, src, out, ck) == _batch(spark, arrival[:300])
    spark.createDataFrame(arrival[300:], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    assert _run(spark, src, out, ck) == _batch(spark, rows)
    # another start without new files changes nothing
    assert _run(spark, src, out, ck) == _batch(spark, rows)


def test_replayed_batch_changes_nothing_and_stores_compact(spark, tmp_path):
    rows = _records(3, 120)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for k in range(2):
        spark.createDataFrame(rows[k * 60 : (k + 1) * 60], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    want = _run(spark, src, out, ck)
    # the last batch is lost between its output and its commit: it runs again from the state before it
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "ck" / "commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / f"batch={last}")
    assert _run(spark, src, out, ck) == want == _batch(spark, rows)
    keyed.compact(spark, out, str(tmp_path / "small"), ["m"])
    got = keyed.folded_metrics(spark, str(tmp_path / "small"), ["m"])
    assert {r["m"]: r["n_records"] for r in got.collect()} == {m: v["n_records"] for m, v in want.items()}


def test_a_batch_reads_its_own_rows_only(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = _records(4, 300)
    spark.createDataFrame(rows[:280], SCHEMA).coalesce(1).write.parquet(src)
    _run(spark, src, out, ck)
    spark.createDataFrame(rows[280:], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    q = keyed.fold_on_arrival(stream, out, ["m"], ck)
    q.awaitTermination()
    read = [p.numInputRows for p in q.recentProgress if p.numInputRows]
    assert read == [20]
    touched = spark.read.parquet(out).groupBy("batch").agg(F.sum("n_records").alias("n")).orderBy("batch").collect()
    assert [r["n"] for r in touched if r["n"]] == [280, 20]


def test_items_of_a_bucket_pass_through_one_call(spark, tmp_path):
    """State and Python were called once an item, which a large batch could not afford."""
    rows = _records(5, 300)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    differences = keyed.cell_differences(stream, ["m"], buckets=2)
    q = differences.writeStream.format("memory").queryName("differences").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("differences").groupBy("m").agg(F.count("*").alias("calls"), F.sum("n_records").alias("n"), F.sum("n_items").alias("items")).collect()
    want = _batch(spark, rows)
    assert {r["m"]: (r["n"], r["items"]) for r in got} == {m: (v["n_records"], v["n_items"]) for m, v in want.items()}
    assert all(r["calls"] <= 2 for r in got)
