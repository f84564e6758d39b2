"""Generated suites over tables of any size: rare items, spread of the work."""

import re

from pyspark.sql import functions as F

from gaugewright.operators import checks, generation, suites


def test_history_items_whose_visible_ratings_are_equal_have_two_pairs(spark):
    """Customers 3068 and 8554 of sf0.1 draw three equal visible ratings; both directions took the same pair."""
    rows = spark.createDataFrame([(3068,), (8554,), (9118,), (0,)], "global_idx long")
    specs = suites.specs_over(generation.grid_over(rows, "HIST", offsets=None), "history").cache()
    flat = specs.where("array_size(array_distinct(transform(filter(evidence, e -> not e.missing), e -> e.value))) = 1")
    assert flat.count() == 3
    assert specs.where(F.col("subset_low.place") == F.col("subset_high.place")).count() == 0
    assert checks.item_errors(suites.suite_views(specs, "history"), "history").count() == 0


def test_a_small_table_of_items_is_dealt_to_every_core(spark, tmp_path):
    """Customers are one file of one row group; views of all items were one task's, or by domain (six of them) after a shuffle."""
    from gaugewright.plans import report_queries

    spark.range(500).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    specs = report_queries._suite_specs(spark, str(tmp_path), "rag")
    dealt = specs.groupBy(F.input_file_name().alias("f")).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 100
    views = suites.suite_views(specs, "rag")
    assert "Exchange hashpartitioning" not in views._jdf.queryExecution().executedPlan().toString()
    assert views.count() == 500 * 17


def test_tasks_of_vectors_grow_with_the_lines(spark, monkeypatch):
    """A task's groups and sorts were bounded by the number of shuffle partitions only."""
    from gaugewright.operators import extended
    from gaugewright.sources import adapters

    sf = "/root/testdata/sf0.001"
    want = {tuple(r) for r in extended.uai_vectors(adapters.records(spark, sf), adapters.CELL, merge=True).collect()}
    monkeypatch.setattr(adapters, "LINES_A_TASK", 500)
    lines = adapters.table(spark, sf, "lineitem").count()
    tasks = adapters.line_tasks(spark, sf)
    assert tasks == -(-lines // 500) > 4
    assert extended.last_answers(adapters.records(spark, sf), adapters.CELL, tasks).rdd.getNumPartitions() == tasks
    assert {tuple(r) for r in extended.uai_vectors(adapters.records(spark, sf), adapters.CELL, merge=True, tasks=tasks).collect()} == want


def test_tasks_that_count_document_ids_grow_with_the_items(spark, tmp_path, monkeypatch):
    """Ids were counted per task of the files read, then in as many tasks as there are shuffle partitions; both grew with the table."""
    from gaugewright.plans import report_queries

    ids = spark.range(500).union(spark.range(1))  # customer 0 occurs twice: its documents count twice, their ids once
    ids.select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(report_queries, "ITEMS_A_TASK", 20)
    got = report_queries.rag_corpus(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    dealt = re.split(r"Exchange hashpartitioning\(doc_id#\d+, 26\), REPARTITION_BY_NUM", plan)
    assert len(dealt) == 2 and "HashAggregate" in dealt[0] and "HashAggregate" not in dealt[1]
    assert plan.count("Exchange RoundRobinPartitioning(26)") == 3 and "FileScan parquet [item_id" not in plan
    per_item = {("core", "none"): 1, ("filler", "none"): 1, ("anchor_slot", "none"): 1, ("anchor_slot", "irrelevant"): 4, ("anchor_slot", "plausible"): 2, ("anchor_slot", "authority"): 2}
    anchored = lambda relevance: relevance != "none"
    want = {(d, r, 501 * k, 500 * k, 501 * k * anchored(r), 501 * k) for (d, r), k in per_item.items()}
    assert {tuple(r) for r in got.collect()} == want


def test_tasks_that_count_items_of_views_grow_with_the_items(spark, tmp_path, monkeypatch):
    """Views' items were counted like documents' ids: per task of the files read, then in shuffle partitions."""
    from gaugewright.plans import report_queries

    spark.range(100).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(report_queries, "ITEMS_A_TASK", 4)
    for name, parts in (("variant_views", 5), ("suite_manifests", 6), ("medical_weighted_manifest", 1)):
        plan = getattr(report_queries, name)(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(item_id#\d+, 25\), REPARTITION_BY_NUM", plan)) == parts, name


def test_views_are_checked_in_one_pass_without_a_shuffle_of_views(spark, tmp_path, monkeypatch):
    """Views were rendered for each group of checks, multiplied by the number of counted parts with all their texts, and shuffled by item."""
    from gaugewright.plans import report_queries

    spark.range(100).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(report_queries, "ITEMS_A_TASK", 4)
    monkeypatch.setattr(report_queries, "SUITE_NAMES", ("icl_dist",))
    plan = report_queries.suite_errors(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "FileScan parquet [item_id" not in plan
    by_item = re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\), (\w+)", plan)
    assert {(n, why) for key, n, why in by_item if "item_id" in key} == {("25", "REPARTITION_BY_NUM")}
    assert len(re.findall(r"sha2\([^)]*\), 256\), 1, 16\)\) AS prompt_hash", plan)) == 1
    specs = report_queries._specs_by_id(spark, str(tmp_path), "icl_dist")
    assert suites.suite_views(specs, "icl_dist").count() == 500


def test_views_checked_with_their_items_are_counted_with_repeats(spark):
    """The one pass finds what the two do, a repeated view's errors as often as it is there."""
    specs = suites.suite_specs(spark, "tool", n_per_cell=1, domains=["snacks"]).cache()
    views = suites.suite_views(specs, "tool")
    items = [r["item_id"] for r in specs.select("item_id").orderBy("item_id").collect()]
    odd = views.where((F.col("item_id") == items[0]) & (F.col("condition") == "control")).withColumn("condition", F.lit("odd"))
    bad = views.unionByName(odd).unionByName(odd).withColumn("relevance", F.when((F.col("item_id") == items[1]) & (F.col("condition") == "plausible_low"), "strange").otherwise(F.col("relevance"))).cache()
    found = sorted(map(tuple, checks.view_and_item_errors(bad, "tool").collect()))
    assert found == sorted(map(tuple, checks.view_errors(bad).unionByName(checks.item_errors(bad, "tool")).collect()))
    assert found == sorted(
        [("item", items[0], e) for e in ("condition unexpected", "prompts equal", "view repeated")]
        + [("view", f"{items[0]}/odd", "anchor missing")] * 2
        + [("view", f"{items[1]}/plausible_low", e) for e in ("relevance unexpected", "relevance unknown")]
    )
