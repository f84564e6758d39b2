"""The engine's own queries over the test tables. Doubles are rounded to 6 places so that both engines' sums compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as tx
from ..functions.influence import gold_answer
from ..functions.registry import register_functions
from ..operators import analysis, generation, metrics, paired, statistics
from ..schemas import CORE, CORE_ANCHORED, TWO_STAGE
from ..sources import adapters
from ..session import work_path
from ..sources.adapters import CELL
from ..streaming import keyed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BASE_METRICS = ["uai_irr", "uai_plaus", "tar_irr", "tar_plaus", "disc_delta", "mae", "acc10", "parse_rate"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def _items(spark, sf, conditions=CORE):
    domain = {"domain": F.first("domain")}
    return paired.item_table(adapters.records(spark, sf), CELL, conditions, domain)


def _cells(spark, sf, cell=CELL):
    return metrics.unified_metrics(adapters.records(spark, sf), cell)


def _long(spark, sf):
    return paired.long_effects(_items(spark, sf), CELL)


@query
def dedup_last_wins(spark, sf):
    return paired.last_wins(adapters.records(spark, sf), CELL).select(*CELL, "item", "condition", "answer", "anchor")


@query
def uai_by_cell(spark, sf):
    return r6(_cells(spark, sf).select(*CELL, *[f"uai_{c}" for c in CORE_ANCHORED], "uai_irr", "uai_plaus", "n_uai_irr", "n_uai_plaus"))


@query
def tar_by_cell(spark, sf):
    return r6(_cells(spark, sf).select(*CELL, "tar_irr", "tar_plaus"))


@query
def unified_metrics(spark, sf):
    return r6(_cells(spark, sf).select(*CELL, "n_records", "n_items", "n_uai_irr", "n_uai_plaus", *BASE_METRICS))


@query
def metrics_by_offset(spark, sf):
    return r6(metrics.metrics_by(adapters.records(spark, sf), CELL, "offset").select(*CELL, "offset", "n_records", "n_items", *BASE_METRICS))


@query
def metrics_by_difficulty(spark, sf):
    return r6(metrics.metrics_by(adapters.records(spark, sf), CELL, "difficulty").select(*CELL, "difficulty", "n_records", "n_items", *BASE_METRICS))


@query
def metrics_grouping_sets(spark, sf):
    got = metrics.metrics_grouping_sets(adapters.records(spark, sf), CELL, ["offset", "difficulty"])
    return r6(got.select("level", *CELL, "offset", "difficulty", "n_records", "n_items", *BASE_METRICS))


@query
def parse_rate_by_condition(spark, sf):
    return r6(metrics.parse_rates(adapters.records(spark, sf), CELL))


@query
def mae_acc10_control(spark, sf):
    return r6(_cells(spark, sf).select(*CELL, "mae", "acc10"))


@query
def acr_rr_history(spark, sf):
    return r6(metrics.history_adjustment(_items(spark, sf), CELL))


@query
def baseline_choice(spark, sf):
    """Baselines per day and event type stand-in: which control each (suite, model, offset) has."""
    return paired.baseline_choice(adapters.records(spark, sf), [*CELL, "difficulty"], TWO_STAGE)


@query
def complete_items_semijoin(spark, sf):
    return paired.complete_items(adapters.records(spark, sf), CORE, CELL)


@query
def item_condition_cross(spark, sf):
    items = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"))
    conds = spark.createDataFrame([(c, i) for i, c in enumerate(CORE)], "condition string, ord int")
    return paired.tasks(items, conds)


@query
def pending_tasks_antijoin(spark, sf):
    done = adapters.records(spark, sf).where("parsed_ok")
    return paired.open_tasks(item_condition_cross(spark, sf), done, ["item", "condition"])


@query
def pair_join_plaus_irr(spark, sf):
    """Plausible minus irrelevant pull of the same item and direction: number and mean per cell."""
    items = paired.effects(_items(spark, sf))
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), (F.col(f"uai_plausible_{d}") - F.col(f"uai_irrelevant_{d}")).alias("d")) for d in ("low", "high")])).alias("p")
    rows = items.select(*CELL, pairs).where("p.d is not null")
    return r6(rows.groupBy(*CELL, F.col("p.direction").alias("direction")).agg(F.count("*").alias("n"), F.avg("p.d").alias("mean_diff")))


@query
def gold_shift_items(spark, sf):
    return analysis.gold_shift(_long(spark, sf)).select(*CELL, "item", "condition", "shift", "proximity", "relevance", "d_error")


@query
def gold_shift_rollup(spark, sf):
    return r6(analysis.shift_rollup(analysis.gold_shift(_long(spark, sf)), "suite"))


@query
def gold_shift_strata(spark, sf):
    s = analysis.gold_shift(_long(spark, sf))
    return r6(s.groupBy("suite", "relevance", "proximity").agg(*analysis.shares()))


def _effect_sizes(spark, sf):
    items = _items(spark, sf)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"{c}.answer").alias("a")) for c in CORE_ANCHORED])).alias("r")
    rows = items.select(*CELL, F.col("control.answer").alias("y"), each).select(*CELL, "y", "r.*")
    return statistics.cohens_d(rows, [*CELL, "condition"], "a", "y")


@query
def cohens_d_paired(spark, sf):
    return r6(_effect_sizes(spark, sf))


@query
def cohens_d_pooled(spark, sf):
    return r6(statistics.pooled_d(_effect_sizes(spark, sf), ["suite", "model"]))


@query
def strategy_deltas(spark, sf):
    """Difficulty stands for the strategy, ``easy`` for the baseline."""
    cells = metrics.metrics_by(adapters.records(spark, sf), CELL, "difficulty")
    return r6(analysis.strategy_effects(cells, CELL, "difficulty", "easy"))


@query
def greedy_vs_sampled(spark, sf):
    """Domains 1 to 6 stand for seeds, domain 0 for the greedy run."""
    cells = metrics.metrics_by(adapters.records(spark, sf), CELL, "domain")
    return r6(analysis.greedy_vs_sampled(cells, CELL, F.col("domain") == 0, "uai_plaus"))


@query
def intensity_curve(spark, sf):
    c = F.col("condition")
    level = F.when(c.startswith("placebo"), "placebo").when(c.startswith("irrelevant"), "irrelevant").when(c.startswith("plausible"), "plausible")
    return r6(analysis.curve(adapters.records(spark, sf), CELL, level))


@query
def monotone_check(spark, sf):
    return analysis.monotone(intensity_curve(spark, sf), CELL, ["placebo", "irrelevant", "plausible"])


@query
def uncertain_curve(spark, sf):
    """Pull per number of visible ratings beside the ceiling for that number."""
    k = adapters.evidence(spark, sf).select("item", F.least(F.lit(3), F.greatest(F.lit(1), F.size("visible"))).alias("k"))
    long = _long(spark, sf).join(k, "item")
    return r6(long.groupBy("suite", "k").agg(F.avg("uai").alias("uai"), F.count("uai").alias("n"), F.avg((F.abs(F.col("control") - F.col("gold")) <= 10).cast("double")).alias("acc10")).withColumn("ceiling", 1 / (F.col("k") + 1.0)))


@query
def bayesian_bound(spark, sf):
    cells = _cells(spark, sf).select(*CELL, "uai_irr", "uai_plaus")
    return r6(analysis.bayesian_bound(cells, F.lit(5)))


@query
def suite_summary_top3(spark, sf):
    cells = analysis.bayesian_bound(_cells(spark, sf).select(*CELL, "uai_plaus"), F.lit(5))
    return r6(analysis.suite_summary(cells, "suite", "model", 5))


@query
def case_studies_topk(spark, sf):
    return r6(analysis.case_studies(_items(spark, sf), CELL, "domain"))


@query
def leaderboard(spark, sf):
    return r6(analysis.leaderboard(r6(_cells(spark, sf)), "suite", "model"))


@query
def model_suite_pivot(spark, sf):
    return r6(analysis.pivot_means(_cells(spark, sf), "model", "suite", ["F", "O", "P"], "uai_plaus"))


@query
def token_usage(spark, sf):
    return analysis.token_usage(adapters.records(spark, sf), CELL, "prompt_tokens", "completion_tokens")


@query
def cost_rollup(spark, sf):
    prices = adapters.table(spark, sf, "nation").where("n_nationkey < 4").select(F.element_at(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])), F.col("n_nationkey").cast("int") + 1).alias("model"), (F.col("n_nationkey") + 1.0).alias("price_in"), (F.col("n_nationkey") * 2 + 3.0).alias("price_out"))
    return r6(analysis.costs(token_usage(spark, sf), prices, "model", 100_000))


@query
def slug_intersection(spark, sf):
    """Items that both an open and a fulfilled order line tree have, with answers from both."""
    r = adapters.records(spark, sf).where("parsed_ok")
    a = r.where("condition = 'control'").groupBy("item").agg(F.max_by("answer", "pos").alias("a"))
    b = r.where("condition = 'control_twostage'").groupBy("item").agg(F.max_by("answer", "pos").alias("b"))
    return a.join(b, "item").withColumn("delta", F.col("b") - F.col("a"))


@query
def splice_core_union(spark, sf):
    r = adapters.records(spark, sf)
    got = paired.splice(r.where(F.col("condition").isin(*CORE)), r.where("condition = 'placebo_low'"), ["control", "plausible_low"])
    return got.groupBy("part", "condition").agg(F.count("*").alias("n"), F.sum("answer").alias("answers"))


def _differences(spark, sf):
    return _long(spark, sf).where("condition = 'plausible_high'").withColumn("d", F.col("answer") - F.col("control"))


@query
def wilcoxon_signed_rank(spark, sf):
    return r6(statistics.signed_ranks(_differences(spark, sf), CELL, "d"))


@query
def wilcoxon_p(spark, sf):
    return r6(statistics.wilcoxon(_differences(spark, sf), CELL, "d"))


@query
def bh_adjust(spark, sf):
    """Families of suites; part sizes in place of probabilities."""
    p = adapters.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).cast("int").alias("family"), F.when(F.col("p_partkey") % 11 != 0, F.round((F.col("p_partkey") * 7919 % 1000) / 1000.0, 3)).alias("p"))
    return r6(statistics.bh_adjust(p, ["family"], "p", ["id"]))


@query
def bootstrap_ci(spark, sf):
    return statistics.bootstrap_ci(_long(spark, sf), CELL, "uai", ["item", "condition"])


@query
def pearson_r(spark, sf):
    long = _long(spark, sf)
    return r6(long.groupBy(*CELL).agg(F.count("*").alias("n"), F.corr("answer", "anchor").alias("r")))


@query
def gold_answer_rules(spark, sf):
    e = adapters.evidence(spark, sf)
    w = F.array(*map(F.lit, (1.0, 1.0, 1.5, 1.5, 2.0)))
    few = F.slice("visible", 1, 5)
    return e.select("item", gold_answer(F.col("visible")).alias("mean_gold"), gold_answer(F.col("visible"), "median").alias("median_gold"), gold_answer(few, "weighted_mean", w).alias("weighted_gold"))


@query
def evidence_summary(spark, sf):
    e = adapters.evidence(spark, sf)
    return r6(e.select("item", *[c.alias(k) for k, c in generation.evidence_summary(F.col("visible")).items()]))


@query
def subset_argmin(spark, sf):
    e = adapters.evidence(spark, sf).withColumn("s", generation.nearest_subset(F.col("visible"), F.lit(20.0)))
    return e.where("s is not null").select("item", "s.distance", "s.i", "s.j", F.col("s.mean").alias("mean"))


@query
def prompt_hash(spark, sf):
    return adapters.table(spark, sf, "benchmark").select("item_id", tx.prompt_hash(F.col("text")).alias("prompt_hash"))


@query
def document_hashes(spark, sf):
    return adapters.table(spark, sf, "documents").select("doc_id", tx.prompt_hash(F.col("text")).alias("prompt_hash"))


def _parsed(spark, sf, name, f):
    c = adapters.completions(spark, sf)
    return c.groupBy("raw").agg(F.count("*").alias("n")).withColumn(name, f(F.col("raw")))


@query
def parse_xml(spark, sf):
    return _parsed(spark, sf, "answer", parsing.parse_xml)


@query
def parse_last_number(spark, sf):
    return _parsed(spark, sf, "answer", parsing.parse_last_number)


@query
def parse_declared(spark, sf):
    return _parsed(spark, sf, "answer", parsing.parse_final_answer)


@query
def parse_cascade(spark, sf):
    c = adapters.completions(spark, sf)
    rows = c.groupBy("raw").agg(F.count("*").alias("n")).withColumn("p", parsing.parse_response(F.col("raw"), F.lit("Ratings: 20 and 35")))
    return rows.select("raw", "n", "p.answer", "p.ok", "p.strategy")


@query
def parse_strategy_histogram(spark, sf):
    return parse_cascade(spark, sf).groupBy("strategy").agg(F.sum("n").alias("n"), F.count_if("ok").alias("n_texts_ok"))


@query
def runs_by_day(spark, sf):
    """Events by day: last answer of each user and type, and mean answers."""
    rows = adapters.runs(spark, sf).groupBy("run", "item", "condition").agg(F.max_by(F.struct("answer", "anchor"), "pos").alias("r"))
    return r6(rows.groupBy("run", "condition").agg(F.count("*").alias("n"), F.avg("r.answer").alias("mean_answer"), F.sum("r.anchor").alias("anchors")))


@query
def two_stage_flatten(spark, sf):
    t = adapters.table(spark, sf, "conversations")
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.size("turns").alias("n_turns"), F.sha2(tx.flatten_turns(F.col("turns")), 256).alias("flat_sha256"))


@query
def doc_rank_insert(spark, sf):
    """Customers' segments: orders' priorities in key order with a document put in at a clamped rank."""
    o = adapters.table(spark, sf, "orders")
    docs = o.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("docs"))
    got = docs.withColumn("docs", tx.insert_at_rank(F.col("docs"), F.lit("ANCHOR"), (F.col("o_custkey") % 9).cast("int")))
    return got.select("o_custkey", tx.document_block(F.col("docs")).alias("block"))


@query
def tool_reference_json(spark, sf):
    s = adapters.table(spark, sf, "supplier")
    value = F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") % 101)
    return s.select("s_suppkey", tx.reference_json(F.col("s_name"), value, F.lit("for information")).alias("reference"))


@query
def slugs(spark, sf):
    return adapters.table(spark, sf, "customer").select("c_custkey", tx.slug(F.col("c_name")).alias("slug"))


def _specs(spark, sf):
    return generation.itemspecs(generation.grid_over(adapters.items(spark, sf), "EXT"))


@query
def generated_manifest(spark, sf):
    return generation.manifest(generation.render_views(_specs(spark, sf)))


@query
def generated_errors(spark, sf):
    """Items and errors of data generated over customers: no errors."""
    specs = _specs(spark, sf)
    errors = generation.validate_specs(specs).unionByName(generation.validate_views(generation.render_views(specs)))
    return specs.agg(F.count("*").alias("n_items")).crossJoin(errors.agg(F.count("*").alias("n_errors")))


@query
def exported_rows(spark, sf):
    specs = _specs(spark, sf)
    rows = generation.export_rows(generation.render_views(specs), specs)
    return rows.groupBy("domain", "condition", "relevance", "split").agg(F.count("*").alias("n"), F.count("anchor_value").alias("n_anchored"), F.count("anchor_polarity").alias("n_polarity"))


@query
def stale_export(spark, sf):
    """Rows that differ between two releases of the part table."""
    p = adapters.table(spark, sf, "part").select("p_partkey", "p_name")
    return generation.stale_rows(p.where("p_partkey % 100 != 3"), p.where("p_partkey % 100 != 7"))


@query
def domain_balance(spark, sf):
    return generation.imbalance(adapters.table(spark, sf, "orders"), "o_orderpriority")


@query
def streamed_metrics(spark, sf):
    """The metrics of cells after the order lines have arrived as a stream."""
    out, checkpoint = work_path(spark, "streamed"), work_path(spark, "streamed-checkpoint")
    lines = spark.readStream.schema(adapters.table(spark, sf, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    keyed.fold_on_arrival(adapters.records_of(lines, adapters.table(spark, sf, "orders")), out, CELL, checkpoint).awaitTermination()
    return r6(keyed.folded_metrics(spark, out, CELL).select(*CELL, "n_records", "n_items", "n_uai_irr", "n_uai_plaus", *BASE_METRICS))


@query
def interval_means(spark, sf):
    """Centres of the exact intervals: what SQL can say of them."""
    long = _long(spark, sf)
    means = statistics.bootstrap_ci(long, CELL, "uai", ["item", "condition"], n_boot=50).select(*CELL, F.lit("mean").alias("of"), "n", F.col("mean").alias("value"))
    return r6(means.unionByName(statistics.pearson_ci(long, CELL, "answer", "anchor", ["item", "condition"], n_boot=50).select(*CELL, F.lit("r").alias("of"), "n", F.col("r").alias("value"))))


@query
def pull_by_sql_text(spark, sf):
    """Pull and direction per cell by a SQL text over registered functions."""
    register_functions(spark, "gw_")
    _long(spark, sf).createOrReplaceTempView("gw_effects")
    return spark.sql("""SELECT suite, model, count(gw_item_uai(answer, control, anchor)) AS n, round(avg(gw_item_uai(answer, control, anchor)), 6) AS uai,
        round(avg(gw_toward_anchor(answer, control, anchor)), 6) AS tar, round(max(gw_implied_weight(gw_item_uai(answer, control, anchor), 5)), 6) AS weight,
        count_if(gw_classify_shift(answer, control, gold) = 'harmful') AS n_harmful FROM gw_effects GROUP BY suite, model""")


@query
def anchor_gold_by_sql_text(spark, sf):
    """Gold answers of orders' visible ratings by each registered rule."""
    register_functions(spark, "gw_")
    adapters.evidence(spark, sf).createOrReplaceTempView("gw_evidence")
    return spark.sql("SELECT item, gw_gold_mean(v) AS gold_mean, gw_gold_median(v) AS gold_median, gw_gold_weighted_mean(v, array(1D, 1D, 1.5D, 1.5D, 2D)) AS gold_weighted FROM (SELECT item, slice(visible, 1, 5) AS v FROM gw_evidence)")
