"""Derived analyses over item tables and cell metrics: shifts, curves, bounds, panels, cases, costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.influence import anchor_proximity, classify_shift, implied_weight, item_uai, rational_ceiling, relevance_of
from ..schemas import CONTROL, EPSILON

BOUND_WEIGHTS = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0)


def gold_shift(long: DataFrame) -> DataFrame:
    """Classify each row of long effects: shift, proximity, relevance and the change of its error."""
    y, c, g = F.col("answer"), F.col("control"), F.col("gold")
    rows = long.where("gold is not null")
    return rows.withColumns({"shift": classify_shift(y, c, g), "proximity": anchor_proximity(F.col("anchor"), c, g), "relevance": relevance_of(F.col("condition")), "d_error": F.abs(y - g) - F.abs(c - g)})


def shares() -> list[Column]:
    kinds = ("harmful", "helpful", "neutral")
    out = [F.count("*").alias("n")] + [F.count_if(F.col("shift") == k).alias(f"n_{k}") for k in kinds]
    return out + [F.coalesce(F.try_divide(F.count_if(F.col("shift") == k) * 100.0, F.count("*")), F.lit(0.0)).alias(f"pct_{k}") for k in kinds] + [F.coalesce(F.avg("d_error"), F.lit(0.0)).alias("mean_d_error")]


def shift_rollup(shifts: DataFrame, by: str) -> DataFrame:
    """Shares per group and over all rows (``ALL``)."""
    got = shifts.rollup(by).agg(F.grouping(by).alias("_all"), *shares())
    return got.withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def curve(records: DataFrame, cell: Sequence[str], level: Column, baseline: str = CONTROL, epsilon: float = EPSILON) -> DataFrame:
    """Mean pull and number per level; the control is each item's last parsed one, anchored rows count as often as they occur.

    Rows whose level is null are left out. The control is attached by a window-free aggregate and an equi-join on the item.
    """
    ok = records.where(F.col("parsed_ok") & F.col("answer").isNotNull())
    control = ok.where(F.col("condition") == baseline).groupBy(*cell, "item").agg(F.max_by("answer", "pos").alias("control"))
    rows = ok.withColumn("level", level).where(F.col("level").isNotNull() & F.col("anchor").isNotNull())
    rows = rows.join(control, [*cell, "item"]).withColumn("uai", item_uai(F.col("answer"), F.col("control"), F.col("anchor"), epsilon))
    return rows.groupBy(*cell, "level").agg(F.avg("uai").alias("uai"), F.count("uai").alias("n"))


def bayesian_bound(cells: DataFrame, n_evidence: Column, w_ref: float = 1.0) -> DataFrame:
    """Implied weight, ceilings over a grid of weights, and the excess over the reference ceiling, per cell."""
    n, u = n_evidence, F.col("uai_plaus")
    grid = {f"ceiling_{str(w).replace('.', '_')}": rational_ceiling(F.lit(w), n) for w in BOUND_WEIGHTS}
    top = rational_ceiling(F.lit(w_ref), n)
    return cells.withColumns({"implied_w": implied_weight(u, n), **grid, "excess": u - top, "above": u > top})


def suite_summary(bounds: DataFrame, suite: str, name: str, n_evidence: int, w_ref: float = 1.0, top: int = 3) -> DataFrame:
    """Per suite: means, the exact median of implied weights, counts above limits, and the ``top`` names by weight."""
    w = F.col("implied_w")
    agg = bounds.groupBy(suite).agg(F.count("*").alias("n_cells"), F.avg("uai_plaus").alias("mean_uai"), F.median("implied_w").alias("median_w"), F.count_if(w > w_ref).alias("above_ref"), F.count_if(w > n_evidence).alias("above_n"), F.count_if("above").alias("above_ceiling"))
    place = F.row_number().over(W.partitionBy(suite).orderBy(F.desc("implied_w"), name))
    best = bounds.where(w.isNotNull()).withColumn("_r", place).where(F.col("_r") <= top)
    names = best.groupBy(suite).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(name).alias("m")))), lambda x: x["m"]), ",").alias("top"))
    return agg.join(names, suite, "left")


def leaderboard(cells: DataFrame, suite: str, name: str, metric: str = "uai_plaus") -> DataFrame:
    """Rank in each suite by the metric, descending; a null metric counts as 0."""
    order = W.partitionBy(suite).orderBy(F.coalesce(metric, F.lit(0.0)).desc(), name)
    return cells.select(suite, name, metric, F.row_number().over(order).alias("rank"))


def deltas(cells: DataFrame, keys: Sequence[str], variant: str, baseline: str, metrics: Sequence[str]) -> DataFrame:
    """Metrics of every other variant minus those of the baseline variant with the same keys; null where either is null."""
    base = cells.where(F.col(variant) == baseline).select(*keys, *[F.col(m).alias(f"_{m}") for m in metrics])
    got = cells.where(F.col(variant) != baseline).join(base, list(keys))
    return got.select(*keys, variant, *[(F.col(m) - F.col(f"_{m}")).alias(f"d_{m}") for m in metrics])


def strategy_effects(cells: DataFrame, keys: Sequence[str], strategy: str, baseline: str) -> DataFrame:
    """Change of discrimination and error by strategy, with verdicts; rows without discrimination go, a null error counts as 0."""
    got = deltas(cells.where("disc_delta is not null").withColumn("mae", F.coalesce("mae", F.lit(0.0))), keys, strategy, baseline, ["disc_delta", "mae"])
    a, b = verdict(F.col("d_disc_delta"), F.col("d_mae"))
    return got.withColumns({"disc_verdict": a, "mae_verdict": b})


def verdict(d_disc: Column, d_mae: Column) -> tuple[Column, Column]:
    return (F.when(d_disc > 0.01, "better").when(d_disc < -0.01, "worse").otherwise("same"), F.when(d_mae < -0.5, "better").when(d_mae > 0.5, "worse").otherwise("same"))


def greedy_vs_sampled(cells: DataFrame, keys: Sequence[str], greedy: Column, metric: str) -> DataFrame:
    """Mean and population spread of sampled runs beside the greedy one; keys without either are left out."""
    got = cells.groupBy(*keys).agg(F.avg(F.when(greedy, F.col(metric))).alias("greedy"), F.avg(F.when(~greedy, F.col(metric))).alias("sampled_mean"), F.stddev_pop(F.when(~greedy, F.col(metric))).alias("sampled_std"), F.count(F.when(~greedy, F.col(metric))).alias("n_sampled"))
    return got.where("greedy is not null and sampled_mean is not null").withColumn("delta", F.col("sampled_mean") - F.col("greedy"))


def case_studies(items: DataFrame, cell: Sequence[str], domain: str, k: int = 3) -> DataFrame:
    """The ``k`` items per cell with the widest gap between plausible and irrelevant pull, best of each domain first."""
    y = F.col(f"{CONTROL}.answer")
    dp, di = F.abs(F.col("plausible_high.answer") - y), F.abs(F.col("irrelevant_high.answer") - y)
    margin = dp - di
    rows = items.select(*cell, "item", domain, margin.alias("margin"), (dp * (1 + margin / F.lit(30.0))).alias("score")).where("margin > 0")
    in_domain = F.row_number().over(W.partitionBy(*cell, domain).orderBy(F.desc("score"), "item"))
    # at most k rows of a domain can be chosen, so only those go on to the cell's ranking
    rows = rows.withColumn("_d", in_domain).where(F.col("_d") <= k)
    order = W.partitionBy(*cell).orderBy((F.col("_d") > 1), F.desc("score"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_d")


def token_usage(records: DataFrame, cell: Sequence[str], prompt: str, completion: str) -> DataFrame:
    return records.groupBy(*cell).agg(F.sum(F.coalesce(prompt, F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce(completion, F.lit(0))).alias("completion_tokens"), F.count_distinct("item").alias("n_items"))


def costs(usage: DataFrame, prices: DataFrame, model: str, full_items: int) -> DataFrame:
    """Cost per model from token sums and prices per million, and its extrapolation to ``full_items``; unknown models go."""
    got = usage.groupBy(model).agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "n_items")])
    got = got.join(prices, model)
    cost = (F.col("prompt_tokens") * F.col("price_in") + F.col("completion_tokens") * F.col("price_out")) / 1e6
    return got.select(model, "prompt_tokens", "completion_tokens", cost.alias("cost"), (cost * F.lit(full_items) / F.greatest("n_items", F.lit(1))).alias("full_cost"))


def monotone(curves: DataFrame, cell: Sequence[str], order: Sequence[str], level: str = "level", value: str = "uai") -> DataFrame:
    """Whether each cell's values never fall along ``order``; cells that miss a level or value are null."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(level))
    before = F.lag(value).over(W.partitionBy(*cell).orderBy("_at"))
    rows = curves.withColumn("_at", at).where(F.col("_at") > 0).withColumn("_falls", F.col(value) < before)
    full = (F.count(value) == len(order))
    return rows.groupBy(*cell).agg(F.when(full, ~F.coalesce(F.bool_or("_falls"), F.lit(False))).alias("monotone"))


def pivot_means(cells: DataFrame, row: str, column: str, values: Sequence[str], metric: str) -> DataFrame:
    """Rows by columns of mean metrics, with a footer row ``MEAN`` over all rows; one pass over the cells."""
    got = cells.rollup(row).agg(F.grouping(row).alias("_foot"), *[F.avg(F.when(F.col(column) == v, F.col(metric))).alias(v) for v in values])
    return got.withColumn(row, F.when(F.col("_foot") == 1, "MEAN").otherwise(F.col(row))).drop("_foot")
