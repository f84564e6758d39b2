"""Generated items and views are clean, repeatable, and each check finds its fault."""

from pyspark.sql import functions as F

from gaugewright.operators import generation as g
from gaugewright.operators.inference import fake_backend, run_single_stage, run_two_stage, unfinished_cells


def made(spark):
    specs = g.itemspecs(g.item_grid(spark, "EXT", 2)).cache()
    return specs, g.render_views(specs).cache()


def test_clean_and_repeatable(spark):
    specs, views = made(spark)
    assert specs.count() == 6 * 2 * 3 * 2 and views.count() == 5 * specs.count()
    assert g.validate_specs(specs).count() == 0 and g.validate_views(views).count() == 0
    assert specs.exceptAll(g.itemspecs(g.item_grid(spark, "EXT", 2).repartition(3))).count() == 0
    bad = views.where("anchor_value is not null and substring(prompt_text, anchor_start + 1, length(anchor_value)) <> cast(anchor_value as string)")
    assert bad.count() == 0
    assert g.manifest(views).first()["conditions_per_item"] == 5
    assert g.export_rows(views, specs).where("anchor_polarity is null").count() == specs.count()


def test_each_fault_is_found(spark):
    specs, views = made(spark)
    one = specs.first()["item_id"]
    mine = F.col("item_id") == one
    errors = lambda df: {r["error"] for r in df.where(mine).collect()}
    assert errors(g.validate_specs(specs.withColumn("y_star", F.when(mine, F.col("y_star") + 1).otherwise(F.col("y_star"))))) == {"gold differs"}
    assert errors(g.validate_specs(specs.withColumn("theta", F.when(mine, 5).otherwise(F.col("theta"))))) == {"theta out of range"}
    assert errors(g.validate_views(views.where(~(mine & (F.col("condition") == "control"))))) == {"condition missing"}
    assert "view repeated" in errors(g.validate_views(views.unionByName(views.where(mine))))
    assert "differs from control" in errors(g.validate_views(views.withColumn("evidence_text", F.when(mine & (F.col("condition") == "plausible_low"), "x").otherwise(F.col("evidence_text")))))
    assert "anchors unequal" in errors(g.validate_views(views.withColumn("anchor_value", F.when(mine & (F.col("condition") == "plausible_low"), 1).otherwise(F.col("anchor_value")))))
    assert g.stale_rows(specs.select("item_id", "theta"), specs.where(~mine).select("item_id", "theta")).count() == 1


def test_runs(spark):
    _, views = made(spark)
    recs = run_single_stage(views, fake_backend, "fake")
    assert recs.where("parsed_ok").count() == views.count()
    assert run_single_stage(views, fake_backend, "fake", done=views.limit(7)).count() == views.count() - 7
    two = spark.createDataFrame([("a", "control", "p1", None), ("a", "plausible_low", "first", "second"), ("b", "plausible_low", None, "second")], "item_id string, condition string, stage1_prompt string, stage2_prompt string")
    got = {(r["item_id"], r["condition"]): r for r in run_two_stage(two, fake_backend, "fake").collect()}
    assert got["a", "plausible_low"]["anchor_value"] == len("first") and got["a", "control"]["stage1_answer"] is None
    assert got["b", "plausible_low"]["raw_text"] == "MISSING_STAGE_COMPONENTS" and not got["b", "plausible_low"]["parsed_ok"]
    cells = spark.createDataFrame([("a",), ("b",)], "m string")
    assert [r["m"] for r in unfinished_cells(cells, cells.where("m = 'a'"), ["m"]).collect()] == ["b"]
