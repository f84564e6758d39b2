"""Queries of extended metrics, item preparation, report tables and generated suites."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.influence import implied_weight
from ..operators import analysis, checks, extended, generation, metrics, paired, reports, statistics, suites
from ..operators.generation import manifest
from ..schemas import CORE, CORE_ANCHORED, OFFSETS, TWO_STAGE
from ..session import spread, tasks_for, written
from ..sources import adapters
from ..sources.adapters import CELL
from .queries import BASE_METRICS, _cells, _effect_sizes, _items, _long, query, r6


@query
def tar_by_condition(spark, sf):
    return r6(_cells(spark, sf).select(*CELL, *[f"tar_{c}" for c in CORE_ANCHORED]))


@query
def metrics_over_own_baseline(spark, sf):
    """Metrics of cells (suite, domain) over their own baseline; domain 0 has lost its plain control."""
    rows = adapters.records(spark, sf).where("not (domain = 0 and condition = 'control')")
    cell = ["suite", "domain"]
    own = paired.with_baseline(rows, cell, stored=True)
    return r6(metrics.unified_metrics(own, cell).select(*cell, "n_records", *BASE_METRICS).join(own.select(*cell, "baseline").distinct(), cell))


@query
def metrics_by_known_difficulty(spark, sf):
    """Domains 5 and 6 lose their difficulty: they are ``unknown``."""
    rows = adapters.records(spark, sf).withColumn("difficulty", F.when(F.col("domain") < 5, F.col("difficulty")))
    return r6(metrics.by_difficulty(rows, CELL).select(*CELL, "difficulty", "n_records", "n_items", *BASE_METRICS))


@query
def uai_vectors(spark, sf):
    v = extended.uai_vectors(adapters.records(spark, sf), CELL, merge=True, tasks=adapters.line_tasks(spark, sf))
    return r6(v.groupBy(*CELL, "grp", "direction").agg(F.count("*").alias("n"), F.avg("uai").alias("mean_uai")))


@query
def vector_summary(spark, sf):
    """Number and mean of each vector of the extended metrics."""
    v = extended.vectors(adapters.records(spark, sf), CELL, tasks=adapters.line_tasks(spark, sf))
    return r6(v.groupBy(*CELL, "vector").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query
def extended_metrics(spark, sf):
    got = extended.extended_metrics(adapters.records(spark, sf), CELL, tasks=adapters.line_tasks(spark, sf))
    return r6(got.select(*CELL, "vector", "n", "ci.mean", "ci.lo", "ci.hi", "p", "p_bh"))


@query
def poisson_ci(spark, sf):
    return r6(statistics.bootstrap_ci(_long(spark, sf), CELL, "uai", ["item", "condition"], method="poisson"))


@query
def pearson_ci(spark, sf):
    return r6(statistics.pearson_ci(_long(spark, sf), CELL, "answer", "anchor", ["item", "condition"], n_boot=500))


@query
def prepared_items(spark, sf):
    """Items with all five core conditions and their specs."""
    r = adapters.records(spark, sf).select(F.col("item").alias("item_id"), "condition", "suite", "difficulty", "domain")
    specs = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("owner"))
    return paired.prepare_items(r, specs, CORE, ["suite", "difficulty", "domain"]).select("item_id", "suite", "difficulty", "domain", "spec.owner")


@query
def seeded_items(spark, sf):
    items = adapters.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item"))
    return paired.seeded_items(items, 100)


@query
def ablation_split(spark, sf):
    core, rest = paired.split_ablations(adapters.records(spark, sf), CORE)
    counts = [df.groupBy("condition").agg(F.count("*").alias("n")).withColumn("part", F.lit(p)) for p, df in (("core", core), ("ablation", rest))]
    return counts[0].unionByName(counts[1])


@query
def visible_count_slices(spark, sf):
    """Conditions that name a number of visible ratings, sliced and renamed."""
    r = adapters.records(spark, sf)
    named = r.withColumn("condition", F.when(F.col("domain") < 3, F.concat(F.lit("uncertain_p"), (F.col("domain") + 1).cast("string"), F.lit("_"), "condition")).otherwise(F.col("condition")))
    return paired.by_visible_count(named).groupBy("k", "condition").agg(F.count("*").alias("n"), F.sum("answer").alias("answers"))


@query
def realism_curve(spark, sf):
    """Pull per realism variant: domains 0 to 2 have a rank suffix in their conditions' names."""
    suffix = F.element_at(F.array(F.lit("_rank1"), F.lit("_rank5"), F.lit("_rank5_distract"), F.lit("")), F.least(F.col("domain"), F.lit(3)) + 1)
    name = F.when(F.col("condition").isin(*CORE_ANCHORED), F.concat("condition", suffix)).otherwise(F.col("condition"))
    r = adapters.records(spark, sf).withColumn("condition", name)
    level = paired.realism_of(F.col("condition"), ["rank1", "rank5", "rank5_distract"])
    return r6(analysis.curve(r, ["suite"], level))


def _variant_cells(spark, sf):
    return metrics.metrics_by(adapters.records(spark, sf), CELL, "difficulty").select(*CELL, "difficulty", "uai_irr", "uai_plaus", "disc_delta", "mae")


@query
def strategy_effect_means(spark, sf):
    """Mean change of discrimination by strategy, lowest first; a null error counts as 0."""
    got = analysis.strategy_effects(_variant_cells(spark, sf), CELL, "difficulty", "easy")
    return r6(reports.mean_effects(got, "difficulty", "d_disc_delta"))


@query
def reasoning_pairs(spark, sf):
    """Easy runs stand for the baseline, hard ones for runs with reasoning."""
    return r6(reports.run_pairs(_variant_cells(spark, sf), CELL, "difficulty", "easy", "hard", ["uai_plaus", "mae"]))


@query
def reasoning_summary(spark, sf):
    pairs = reports.run_pairs(_variant_cells(spark, sf), CELL, "difficulty", "easy", "hard", ["uai_plaus"])
    return r6(reports.effect_summary(pairs, "suite", "d_uai_plaus", "uai_plaus_hard"))


def _domain_cells(spark, sf, names):
    r = adapters.records(spark, sf).where(F.col("domain").isin(*names))
    return metrics.unified_metrics(r, CELL).select(*CELL, "uai_irr", "uai_plaus")


@query
def rule_changes(spark, sf):
    """Domains 0 to 2 are runs under one scoring rule, 3 to 6 under the other."""
    return r6(reports.rule_changes(_domain_cells(spark, sf, (0, 1, 2)), _domain_cells(spark, sf, (3, 4, 5, 6)), CELL, ["uai_irr", "uai_plaus"]))


@query
def rule_change_means(spark, sf):
    got = reports.rule_changes(_domain_cells(spark, sf, (0, 1, 2)), _domain_cells(spark, sf, (3, 4, 5, 6)), CELL, ["uai_irr", "uai_plaus"])
    return r6(reports.column_means(got, ["d_uai_irr", "d_uai_plaus"]))


def _families(spark, sf):
    business = _domain_cells(spark, sf, (1, 2)).where("suite != 'P'")
    return reports.families(_domain_cells(spark, sf, (0,)), business, _domain_cells(spark, sf, (3,)), CELL, ["uai_irr", "uai_plaus"])


@query
def domain_families(spark, sf):
    return r6(_families(spark, sf))


@query
def domain_family_means(spark, sf):
    return r6(reports.family_means(_families(spark, sf), "suite", ["uai_irr", "uai_plaus"]))


@query
def experiment_cells(spark, sf):
    """Regions as tiers, suppliers as models, market segments as suites, in the order of their names."""
    named = lambda t, c: adapters.table(spark, sf, t).select(F.col(c).alias("name")).distinct().withColumn("ord", F.row_number().over(W.orderBy("name")) - 1)
    return reports.cells_over(named("region", "r_name"), named("supplier", "s_name"), named("customer", "c_mktsegment"), 2)


@query
def panel_summaries(spark, sf):
    """A fixed panel with cells that have no summary."""
    panel = reports.experiment_cells(spark, ["1-URGENT", "2-HIGH", "9-NONE"], ["F", "O", "X"]).select("model", "suite")
    return r6(panel.join(_cells(spark, sf).select(*CELL, "uai_plaus"), ["suite", "model"], "left"))


@query
def placebo_bias(spark, sf):
    v = extended.uai_vectors(adapters.records(spark, sf), CELL, merge=True, tasks=adapters.line_tasks(spark, sf))
    cells = v.groupBy(*CELL).agg(F.avg(F.when(F.col("grp") == "placebo", F.col("uai"))).alias("uai_placebo"))
    return reports.count_over(cells, "uai_placebo", 0.05, ["suite"])


@query
def mean_effect_size(spark, sf):
    return r6(_effect_sizes(spark, sf).groupBy("suite").agg(F.avg(F.abs("d_z")).alias("mean_abs_d"), F.count("d_z").alias("n")))


@query
def pooled_rounded_d(spark, sf):
    return r6(statistics.pooled_d(_effect_sizes(spark, sf), CELL, digits=3))


def _bounds(spark, sf):
    cells = analysis.bayesian_bound(_cells(spark, sf).select(*CELL, "uai_irr", "uai_plaus"), F.lit(5))
    return reports.certain_excess(cells, "uai_irr", 5).withColumn("implied_w_lo", implied_weight(F.col("uai_irr"), F.lit(5)))


@query
def bound_headline(spark, sf):
    """Over all suites but P; irrelevant pulls stand for the intervals' low ends."""
    return r6(reports.headline(_bounds(spark, sf), F.col("suite") == "P", 5))


@query
def certain_excess(spark, sf):
    return r6(_bounds(spark, sf).select(*CELL, "uai_irr", "surely_above", "implied_w_lo"))


@query
def dose_response(spark, sf):
    c = F.col("condition")
    level = F.when(c.startswith("irrelevant"), "mild").when(c.startswith("plausible"), "strong")
    return r6(reports.dose_response(analysis.curve(adapters.records(spark, sf), CELL, level), "suite", "mild", "strong"))


@query
def shift_breakdowns(spark, sf):
    """Shares by relevance, by proximity, and by model and relevance, in one pass."""
    got = reports.group_shares(analysis.gold_shift(_long(spark, sf)), [["relevance"], ["proximity"], ["model", "relevance"]])
    return r6(got.select("grouping", "model", "relevance", "proximity", "n", "n_harmful", "pct_harmful", "mean_d_error"))


@query
def curves_with_mean(spark, sf):
    c = F.col("condition")
    level = F.when(c.startswith("irrelevant"), "irrelevant").when(c.startswith("plausible"), "plausible")
    curve = analysis.curve(adapters.records(spark, sf), CELL, level)
    wide = curve.groupBy(*CELL).agg(*[F.max(F.when(F.col("level") == x, F.col("uai"))).alias(x) for x in ("irrelevant", "plausible")])
    return r6(reports.rows_with_mean(wide, "model", ["irrelevant", "plausible"]))


def _usage(spark, sf):
    r = adapters.records(spark, sf)
    details = F.struct(F.when(F.col("stage1") > 50, F.col("stage1").cast("long")).alias("reasoning_tokens"))
    cached = F.struct((F.col("answer") % 7).cast("long").alias("cached_tokens"))
    cost = F.when(F.col("model") == "1-URGENT", 0.25).otherwise(0.0)
    usage = F.struct("prompt_tokens", "completion_tokens", cost.alias("cost"), details.alias("completion_tokens_details"), cached.alias("prompt_tokens_details"))
    rows = r.withColumns({"api_usage": usage, "model_id": F.when(F.col("parsed_ok"), F.concat(F.lit("vendor/"), "model"))})
    return reports.detailed_usage(rows, CELL)


@query
def detailed_usage(spark, sf):
    return r6(_usage(spark, sf))


@query
def bill(spark, sf):
    prices = spark.createDataFrame([("1-URGENT", 1.0, 3.0), ("2-HIGH", 2.0, 5.0), ("5-LOW", 4.0, 9.0), ("none", 1.0, 1.0)], "model string, price_in double, price_out double")
    return r6(reports.bill(_usage(spark, sf), prices, "model", "suite", 100_000))


@query
def high_low_effects(spark, sf):
    got = reports.high_low_effect(adapters.records(spark, sf), CELL, "plausible")
    return r6(statistics.cohens_d(got, CELL, "high", "low"))


@query
def effect_over_two_stage(spark, sf):
    """Effect sizes of plausible answers against each cell's own baseline, the two-stage control first."""
    own = paired.with_baseline(adapters.records(spark, sf), CELL, TWO_STAGE)
    rows = paired.item_table(own, CELL).select(*CELL, F.col("control.answer").alias("y"), F.col("plausible_high.answer").alias("a"))
    return r6(statistics.cohens_d(rows, CELL, "a", "y"))


@query
def case_study_texts(spark, sf):
    """Cases with the first 200 characters of a stand-in for their control view."""
    cases = analysis.case_studies(_items(spark, sf), CELL, "domain")
    views = adapters.table(spark, sf, "orders").where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("item_id"), F.lit("control").alias("condition"), F.repeat(F.concat("o_orderpriority", F.lit(" ")), 30).alias("prompt_text"))
    return r6(reports.case_texts(cases, views).select(*CELL, "item", "rank", "text"))


#: A customer's item has up to 17 views of some hundred characters.
ITEMS_A_TASK = 25_000
SUITE_NAMES = ("external", "history", "icl", "icl_dist", "rag", "tool")


def _dealt_specs(spark, sf, name, domains="business", rule="mean"):
    """A suite's items over customers, ITEMS_A_TASK a task: for queries that pass over them once."""
    grid = generation.grid_over(spread(adapters.items(spark, sf), ITEMS_A_TASK), suites.PREFIXES[name], suites.domains_of(domains), offsets=None if name == "history" else OFFSETS)
    return suites.specs_over(grid, name, rule=rule)


def _suite_specs(spark, sf, name, **more):
    """A suite's items over customers, written once. Tasks that read them back take files by bytes, so their items grow with the table."""
    return written(_dealt_specs(spark, sf, name, **more), f"{name}-specs")


def _by_id(spark, sf, rows, key):
    """Rows of items shuffled by an id to tasks that grow in number with the items: ids hardly repeat, so counting distinct ones holds them all."""
    return rows.repartition(tasks_for(adapters.items(spark, sf), ITEMS_A_TASK), key)


def _specs_by_id(spark, sf, name):
    """A suite's items over customers, dealt by their ids: a task makes all views of its items, so grouping them by item shuffles none."""
    grid = generation.grid_over(spread(adapters.items(spark, sf), ITEMS_A_TASK), suites.PREFIXES[name], offsets=None if name == "history" else OFFSETS)
    return suites.specs_over(_by_id(spark, sf, grid, "item_id"), name)


def _manifest(spark, sf, views):
    return manifest(_by_id(spark, sf, views.select("item_id", "domain", "condition"), "item_id"))


def _suite(spark, sf, name, **more):
    specs = _suite_specs(spark, sf, name, **more)
    return specs, suites.suite_views(specs, name)


@query
def suite_manifests(spark, sf):
    """Counts of every suite over customers as items."""
    out = None
    for name in SUITE_NAMES:
        one = _manifest(spark, sf, suites.suite_views(_dealt_specs(spark, sf, name), name)).select(F.lit(name).alias("suite"), "n_items", "n_views", "conditions_per_item", "domains")
        out = one if out is None else out.unionByName(one)
    return out


@query
def suite_errors(spark, sf):
    """Errors of every suite over customers: none but of balance."""
    out = None
    for name in SUITE_NAMES:
        specs = _specs_by_id(spark, sf, name)
        views = suites.suite_views(specs, name)
        one = checks.validate_suite(specs, views, name, manifest(views)).agg(F.count("*").alias("n_errors")).withColumn("suite", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def medical_weighted_manifest(spark, sf):
    specs, views = _suite(spark, sf, "external", domains="medical", rule="weighted_mean")
    return _manifest(spark, sf, views).crossJoin(checks.validate_suite(specs, views, "external").agg(F.count("*").alias("n_errors")))


@query
def variant_views(spark, sf):
    """Views of the realism, intensity and partial-evidence variants."""
    out = None
    for kind, (suite, _) in suites.VARIANTS.items():
        v = suites.suite_views(_dealt_specs(spark, sf, suite), kind).select("item_id", "condition", "anchor_value", "anchor_start")
        one = _by_id(spark, sf, v, "item_id").groupBy("condition").agg(F.count("*").alias("n"), F.count("anchor_value").alias("n_anchored"), F.count("anchor_start").alias("n_marked"), F.count_distinct("item_id").alias("n_items")).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query
def rag_corpus(spark, sf):
    """The retrieval corpus of all items by type and relevance."""
    specs = _dealt_specs(spark, sf, "rag")
    docs = suites.rag_corpus(suites.suite_views(specs, "rag"), specs, suites.templates(spark))
    docs = _by_id(spark, sf, docs.select("doc_id", "doc_type", "relevance", "anchor_value", F.col("text").isNotNull().alias("has_text")), "doc_id")
    return docs.groupBy("doc_type", "relevance").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids"), F.count("anchor_value").alias("n_anchored"), F.count_if("has_text").alias("n_texts"))


@query
def tool_message_counts(spark, sf):
    specs = _suite_specs(spark, sf, "tool")
    m = suites.tool_messages(suites.suite_views(specs, "tool_realism")).select("condition", F.explode("messages").alias("m"))
    return m.groupBy("condition", "m.role").agg(F.count("*").alias("n"), F.count("m.tool").alias("n_calls"), F.count("m.content").alias("n_contents"))


@query
def suffixed_prompts(spark, sf):
    b = adapters.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("prompt_text"), F.element_at(F.array(*map(F.lit, suites.SUFFIXES)), (F.length("text") % len(suites.SUFFIXES) + 1).cast("int")).alias("name"))
    return suites.with_suffix(b, F.col("name")).select("item_id", "name", F.md5("prompt_text").alias("prompt_md5"))


@query
def subset_of_five(spark, sf):
    """Of orders with at least five lines, the pair of the first five ratings nearest to 20, missing ones left out."""
    rating = F.transform(F.slice("ratings", 1, 5), lambda r: F.struct(r["value"].alias("value"), r["missing"].alias("missing")))
    e = adapters.evidence(spark, sf).where(F.size("ratings") >= 5).withColumn("s", suites.subset_for(rating, F.lit(20.0)))
    return r6(e.select("item", "s.gap", "s.i", "s.j", F.col("s.mean").cast("double").alias("mean")))


@query
def balance_checks(spark, sf):
    """Suite-level checks over orders as items: which suites are uneven in domains."""
    o = adapters.table(spark, sf, "orders")
    sizes = o.groupBy(F.col("o_orderstatus").alias("suite"), F.col("o_orderpriority").alias("domain")).count()
    return sizes.groupBy("suite").agg((F.max("count") > 2 * F.min("count")).alias("uneven"), F.max("count").alias("largest"), F.min("count").alias("smallest"))


@query
def item_set_errors(spark, sf):
    """The checks of whole suites over orders as items: items that repeat, uneven domains and difficulties, indices that never vary."""
    o = adapters.table(spark, sf, "orders")
    level = F.element_at(F.array(*map(F.lit, ("easy", "medium", "hard"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    specs = o.select(
        F.concat_ws("-", "o_orderstatus", "o_custkey", "o_orderpriority").alias("item_id"), F.col("o_orderstatus").alias("suite"), F.col("o_orderpriority").alias("domain"), level.alias("difficulty"),
        F.col("o_orderkey").alias("scenario_idx"), (F.col("o_orderkey") * 2).alias("question_idx"), F.col("o_custkey").alias("label_idx"), F.col("o_custkey").alias("phrasing_idx"),
    )
    return checks.set_errors(specs)
