"""Evaluation tables made from the test tables, so that every operator has something of any size to run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Condition by line number.
LINE_CONDITIONS = ("control", "irrelevant_low", "irrelevant_high", "plausible_low", "plausible_high", "control_twostage", "placebo_low")
CELL = ["suite", "model"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Records that one task groups and sorts.
LINES_A_TASK = 250_000


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for the records of order lines by their number, which Parquet footers give."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as evaluation records: orders are items, line numbers conditions; later lines repeat earlier ones."""
    return records_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def records_of(li: DataFrame, o: DataFrame) -> DataFrame:
    """Records of lines (a table or a stream) and their orders."""
    names = F.array(*map(F.lit, LINE_CONDITIONS))
    condition = F.element_at(names, F.col("l_linenumber"))
    item = o.select(
        F.col("o_orderkey").alias("item"),
        F.col("o_orderstatus").alias("suite"),
        F.col("o_orderpriority").alias("model"),
        (F.floor("o_totalprice") % 101).cast("int").alias("gold"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("difficulty"),
        F.element_at(F.array(F.lit(15), F.lit(25), F.lit(40), F.lit(None)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("offset"),
        (F.col("o_custkey") % 7).cast("int").alias("domain"),
    )
    rows = li.select(
        F.col("l_orderkey").alias("item"),
        condition.alias("condition"),
        # order by part, then by price in cents, as one long (prices under 2.7 billion)
        (F.col("l_partkey") * (1 << 38) + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("pos"),
        F.floor(F.col("l_quantity") * 2).cast("int").alias("answer"),
        F.when(~condition.startswith("control"), (F.col("l_partkey") % 101).cast("int")).alias("anchor"),
        (F.col("l_suppkey") % 101).cast("int").alias("stage1"),
        (F.col("l_returnflag") != "R").alias("parsed_ok"),
        F.floor("l_extendedprice").cast("long").alias("prompt_tokens"),
        F.when(F.col("l_tax") > 0.01, F.floor("l_quantity").cast("long")).alias("completion_tokens"),
    )
    return rows.join(item, "item")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as items to generate, numbered by their keys (from 0)."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("global_idx"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers of daily runs: users are items, event types conditions."""
    e = table(spark, sf_dir, "events")
    return e.select(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("run"), F.col("user_id").alias("item"), F.col("event_type").alias("condition"), F.struct("ts", "event_id").alias("pos"), F.least(F.lit(100), F.greatest(F.lit(0), F.floor("value"))).cast("int").alias("answer"), F.get_json_object("props", "$.k").try_cast("int").alias("anchor"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's quantities as ratings in line order, returned lines missing."""
    li = table(spark, sf_dir, "lineitem")
    rating = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.floor("l_quantity").cast("int").alias("value"), (F.col("l_returnflag") == "R").alias("missing"))
    got = li.groupBy(F.col("l_orderkey").alias("item")).agg(F.array_sort(F.collect_list(rating)).alias("ratings"))
    return got.withColumn("visible", F.transform(F.filter("ratings", lambda r: ~r["missing"]), lambda r: r["value"]))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer texts in the shape of every tier, composed from order lines."""
    li = table(spark, sf_dir, "lineitem")
    q, p = F.floor("l_quantity").cast("int").cast("string"), (F.col("l_partkey") % 140).cast("string")
    shape = F.col("l_suppkey") % 8
    raw = (
        F.when(shape == 0, F.concat(F.lit("After thought <answer>"), q, F.lit(".5</answer>")))
        .when(shape == 1, F.concat(F.lit("The ratings were mixed.\nMy final answer is "), p))
        .when(shape == 2, q)
        .when(shape == 3, F.concat(F.lit("First 12 then 30.\nI settle on "), q))
        .when(shape == 4, F.concat(F.lit("It could be 20 or "), p, F.lit(" or 35, hard to say")))
        .when(shape == 5, F.lit("No number here"))
        .when(shape == 6, F.concat(F.lit('{"name": "lookup", "value": '), q, F.lit("}")))
        .otherwise(F.concat(F.lit("**"), q, F.lit("**")))
    )
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))
