"""Report tables over per-cell metrics: joins of panels and runs, and the aggregates that reports state.

Inputs are tables of cells (one row per model, suite and variant), so all of these are small joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.influence import rational_ceiling


def both(a: Column, b: Column) -> Column:
    """``b`` less ``a``; null unless both are numbers."""
    return F.when(a.isNotNull() & b.isNotNull(), b - a)


def run_pairs(cells: DataFrame, keys: Sequence[str], variant: str, first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """Keys that have both variants, with ``<m>_<variant>`` of each and ``d_<m>``, second less first."""
    pick = lambda v, m: F.max(F.when(F.col(variant) == v, F.col(m)))
    picks = [pick(v, m).alias(f"{m}_{v}") for m in metrics for v in (first, second)]
    got = cells.groupBy(*keys).agg(*[F.bool_or(F.col(variant) == v).alias(f"_has{i}") for i, v in enumerate((first, second))], *picks).where("_has0 and _has1")
    return got.select(*keys, *[F.col(f"{m}_{v}") for m in metrics for v in (first, second)], *[both(F.col(f"{m}_{first}"), F.col(f"{m}_{second}")).alias(f"d_{m}") for m in metrics])


def effect_summary(pairs: DataFrame, by: str, change: str, level: str, label: str = "ALL") -> DataFrame:
    """Per group and over all: rows, how many fall, mean change, and how many keep a level above 0 (a null level counts as 0)."""
    aggs = [F.count("*").alias("n"), F.count_if(F.col(change) < 0).alias("n_lower"), F.avg(change).alias("mean_change"), F.count_if(F.coalesce(level, F.lit(0.0)) > 0).alias("n_above_zero"), F.avg(level).alias("mean_level")]
    got = pairs.rollup(by).agg(F.grouping(by).alias("_all"), *aggs)
    return got.withColumn(by, F.when(F.col("_all") == 1, label).otherwise(F.col(by))).drop("_all")


def mean_effects(changes: DataFrame, strategy: str, change: str) -> DataFrame:
    """Mean change of each strategy over its non-null rows, with its place from the lowest on."""
    got = changes.groupBy(strategy).agg(F.avg(change).alias("mean_change"), F.count(change).alias("n"))
    return got.withColumn("place", F.row_number().over(W.orderBy(F.col("mean_change").asc_nulls_last(), strategy)))


def rule_changes(first: DataFrame, second: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Cells of both runs with each metric's change; null unless both have it."""
    other = second.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    return first.join(other, list(keys)).select(*keys, *[both(F.col(m), F.col(f"_{m}")).alias(f"d_{m}") for m in metrics])


def preferred_summary(unified: DataFrame, plain: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Summaries of both kinds, metric by metric the unified one where it has a value."""
    other = plain.select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    return unified.join(other, list(keys), "full").select(*keys, *[F.coalesce(m, f"_{m}").alias(m) for m in metrics])


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (column, mean, n) per column over its non-null values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(each.alias("_r")).groupBy("_r.column").agg(F.avg("_r.value").alias("mean"), F.count("_r.value").alias("n"))


def families(extension: DataFrame, business: DataFrame, medical: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Extension cells beside the same cells of the business and medical domains; absent sides are null."""
    out = extension.select(*keys, *[F.col(m).alias(f"extension_{m}") for m in metrics])
    for name, side in (("business", business), ("medical", medical)):
        out = out.join(side.select(*keys, *[F.col(m).alias(f"{name}_{m}") for m in metrics]), list(keys), "left")
    return out


def family_means(cells: DataFrame, by: str, metrics: Sequence[str], names: Sequence[str] = ("extension", "business", "medical")) -> DataFrame:
    """(by, metric, family, mean, n) over the non-null values of ``families`` rows."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(f).alias("family"), F.col(f"{f}_{m}").alias("value")) for m in metrics for f in names]))
    return cells.select(by, each.alias("_r")).groupBy(by, "_r.metric", "_r.family").agg(F.avg("_r.value").alias("mean"), F.count("_r.value").alias("n"))


def experiment_cells(spark: SparkSession, models: Sequence[str], suites: Sequence[str], tiers: Sequence[str] = ("",), slots: int = 1) -> DataFrame:
    """Tier x model x suite with a running number and the slot that the model's place in its list gives it."""
    dims = [spark.createDataFrame([(x, i) for i, x in enumerate(names)], "name string, ord long") for names in (tiers, models, suites)]
    return cells_over(*dims, slots)


def cells_over(tiers: DataFrame, models: DataFrame, suites: DataFrame, slots: int = 1) -> DataFrame:
    """The same over dimension tables (name, ord from 0 without gaps); their product is the result, so none of them is large."""
    t, m, s = (d.select(F.col("name").alias(name), F.col("ord").cast("long").alias(f"_{name}")) for d, name in ((tiers, "tier"), (models, "model"), (suites, "suite")))
    sizes = models.agg(F.count("*").alias("_models")).crossJoin(suites.agg(F.count("*").alias("_suites")))
    got = t.crossJoin(m).crossJoin(s).crossJoin(sizes)
    ord_ = (F.col("_tier") * F.col("_models") + F.col("_model")) * F.col("_suites") + F.col("_suite")
    return got.select("tier", "model", "suite", F.pmod("_model", F.lit(slots)).cast("int").alias("slot"), ord_.cast("int").alias("ord"))


def dose_response(curves: DataFrame, by: str, low: str, high: str, level: str = "level", value: str = "uai") -> DataFrame:
    """Mean of the ``high`` level less that of the ``low`` one, per group; null if either mean is."""
    pick = lambda v: F.avg(F.when(F.col(level) == v, F.col(value)))
    return curves.groupBy(by).agg(pick(low).alias("low"), pick(high).alias("high")).withColumn("change", both(F.col("low"), F.col("high")))


def headline(bounds: DataFrame, excluded: Column, n_evidence: int) -> DataFrame:
    """One row over the cells with a pull that are not excluded: number and share above the ceiling, median implied weights
    (of pulls, and of intervals' low ends where ``implied_w_lo`` is there; 0 without any), how many weigh more than the evidence."""
    rows = bounds.where(~excluded & F.col("uai_plaus").isNotNull())
    low = F.coalesce(F.median("implied_w_lo"), F.lit(0.0)) if "implied_w_lo" in bounds.columns else F.lit(0.0)
    return rows.agg(
        F.count("*").alias("n"), F.count_if("above").alias("n_above"), F.coalesce(F.try_divide(F.count_if("above"), F.count("*")), F.lit(0.0)).alias("share_above"),
        F.median("implied_w").alias("median_w"), low.alias("median_w_lo"), F.count_if(F.col("implied_w") > n_evidence).alias("n_over_evidence"),
    )


def certain_excess(bounds: DataFrame, lower: str, n_evidence: int, w_ref: float = 1.0) -> DataFrame:
    """Add ``surely_above``: whether even the interval's low end is over the ceiling; null without an interval."""
    return bounds.withColumn("surely_above", F.col(lower) > rational_ceiling(F.lit(w_ref), F.lit(n_evidence)))


def count_over(cells: DataFrame, column: str, limit: float, by: Sequence[str] = ()) -> DataFrame:
    """How many rows have the column over the limit, a null counting as 0."""
    return cells.groupBy(*by).agg(F.count_if(F.coalesce(column, F.lit(0.0)) > limit).alias("n_over"), F.count("*").alias("n"))


def group_shares(shifts: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Shift shares of several groupings in one pass; ``grouping`` names each row's columns, others are null."""
    from .analysis import shares

    columns = [*dict.fromkeys(c for s in sets for c in s)]
    got = shifts.groupingSets([[F.col(c) for c in s] for s in sets], *map(F.col, columns)).agg(F.grouping_id().alias("_g"), *shares())
    names = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): "+".join(s) for s in sets}
    return got.withColumn("grouping", F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("_g").cast("int")]).drop("_g")


def rows_with_mean(cells: DataFrame, row: str, metrics: Sequence[str], label: str = "MEAN") -> DataFrame:
    """Metrics per row and a footer of their means over all cells, nulls left out."""
    got = cells.rollup(row).agg(F.grouping(row).alias("_foot"), *[F.avg(m).alias(m) for m in metrics])
    return got.withColumn(row, F.when(F.col("_foot") == 1, label).otherwise(F.col(row))).drop("_foot")


def detailed_usage(records: DataFrame, cell: Sequence[str], usage: str = "api_usage") -> DataFrame:
    """Sums of token counts and reported cost (null counts as 0), distinct items, and the model of the last record that has one."""
    parts = {"prompt_tokens": "prompt_tokens", "completion_tokens": "completion_tokens", "reasoning_tokens": "completion_tokens_details.reasoning_tokens", "cached_tokens": "prompt_tokens_details.cached_tokens", "cost": "cost"}
    sums = [F.sum(F.coalesce(F.col(f"{usage}.{p}"), F.lit(0))).alias(n) for n, p in parts.items()]
    return records.groupBy(*cell).agg(*sums, F.count_distinct("item").alias("n_items"), F.max_by("model_id", F.when(F.col("model_id").isNotNull(), F.col("pos"))).alias("model_id"))


def bill(usage: DataFrame, prices: DataFrame, model: str, suite: str, full_items: int) -> DataFrame:
    """Per model and for ``TOTAL``: suites, tokens, cost (as reported if that isn't 0, else by prices per million tokens) and
    its extrapolation to ``full_items`` items. Models without a price are left out. Prices are a dimension of a few rows."""
    got = usage.groupBy(model).agg(F.array_join(F.array_sort(F.collect_set(suite)), ",").alias("suites"), *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost", "n_items")])
    got = got.join(prices, model)
    priced = (F.col("prompt_tokens") * F.col("price_in") + F.col("completion_tokens") * F.col("price_out")) / 1e6
    got = got.withColumn("cost", F.when(F.col("cost") != 0, F.col("cost")).otherwise(priced)).withColumn("full_cost", F.col("cost") * F.lit(full_items) / F.greatest("n_items", F.lit(1)))
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "cost", "full_cost")]
    total = got.agg(*sums).select(F.lit("TOTAL").alias(model), F.lit(None).cast("string").alias("suites"), "prompt_tokens", "completion_tokens", "cost", "full_cost")
    return got.select(model, "suites", "prompt_tokens", "completion_tokens", "cost", "full_cost").unionByName(total)


def high_low_effect(records: DataFrame, cell: Sequence[str], prefix: str) -> DataFrame:
    """Per item the answers under the first present high and low condition (by name) of a relevance: (cell, item, high, low)."""
    ok = records.where("parsed_ok and answer is not null").where(F.col("condition").startswith(prefix))
    first = {d: F.min(F.when(F.col("condition").endswith(d), F.col("condition"))) for d in ("high", "low")}
    chosen = ok.groupBy(*cell).agg(*[c.alias(f"_{d}") for d, c in first.items()])
    last = ok.groupBy(*cell, "item", "condition").agg(F.max_by("answer", "pos").alias("answer")).join(chosen, list(cell))
    return last.groupBy(*cell, "item").agg(*[F.max(F.when(F.col("condition") == F.col(f"_{d}"), F.col("answer"))).alias(d) for d in ("high", "low")])


def case_texts(cases: DataFrame, views: DataFrame, key: str = "item", text: str = "prompt_text", chars: int = 200) -> DataFrame:
    """Cases with the first ``chars`` characters of their control view; empty where there is none."""
    seen = views.where("condition = 'control'").groupBy(F.col("item_id").alias(key)).agg(F.max(text).alias("_t"))
    return cases.join(seen, key, "left").withColumn("text", F.substring(F.coalesce("_t", F.lit("")), 1, chars)).drop("_t")


def ordered(df: DataFrame, column: str, order: Sequence[str], *then: str) -> DataFrame:
    """Rows in a fixed order of one column's values (others last, by value)."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column, *then)
