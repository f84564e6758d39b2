"""Metrics per cell from item tables: pull, direction, discrimination, accuracy, adjustment, with breakdowns in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.influence import adjustment_rate, recovery_rate
from ..schemas import CONTROL, CORE_ANCHORED, EPSILON
from .paired import effects, item_table

IRR, PLS = CORE_ANCHORED[:2], CORE_ANCHORED[2:]


def pooled(prefix: str, conditions: Sequence[str]) -> Column:
    """Mean over the values of several conditions together."""
    total = sum((F.coalesce(F.sum(f"{prefix}_{c}"), F.lit(0.0)) for c in conditions), F.lit(0.0))
    n = sum((F.count(f"{prefix}_{c}") for c in conditions), F.lit(0))
    return F.try_divide(total, n)


def unified_aggregates(baseline: str = CONTROL) -> list[Column]:
    error = F.abs(F.col(f"{baseline}.answer") - F.col(f"{baseline}.gold"))
    out = [
        F.sum("n_records").alias("n_records"),
        F.count_if("has_parsed").alias("n_items"),
        F.coalesce(F.try_divide(F.sum("n_answered"), F.sum("n_records")), F.lit(0.0)).alias("parse_rate"),
        F.avg(error).alias("mae"),
        F.avg((error <= 10).cast("double")).alias("acc10"),
    ]
    out += [F.avg(f"{p}_{c}").alias(f"{p}_{c}") for p in ("uai", "tar") for c in CORE_ANCHORED]
    for name, group in (("irr", IRR), ("plaus", PLS)):
        out.append(pooled("uai", group).alias(f"uai_{name}"))
        out.append(sum((F.count(f"uai_{c}") for c in group), F.lit(0)).alias(f"n_uai_{name}"))
        out.append(pooled("tar", group).alias(f"tar_{name}"))
    out.append((pooled("uai", PLS) - pooled("uai", IRR)).alias("disc_delta"))
    return out


def unified_metrics(records: DataFrame, cell: Sequence[str], baseline: str = CONTROL, epsilon: float = EPSILON) -> DataFrame:
    """All base metrics per cell in full precision; one shuffle to items, one small one to cells."""
    return effects(item_table(records, cell), baseline, epsilon=epsilon).groupBy(*cell).agg(*unified_aggregates(baseline))


def metrics_by(records: DataFrame, cell: Sequence[str], by: str, baseline: str = CONTROL, epsilon: float = EPSILON) -> DataFrame:
    """Base metrics per cell and ``by``; rows without a value of it are left out (``by_difficulty`` names them instead)."""
    return unified_metrics(records.where(F.col(by).isNotNull()), [*cell, by], baseline, epsilon)


def by_difficulty(records: DataFrame, cell: Sequence[str], baseline: str = CONTROL, epsilon: float = EPSILON) -> DataFrame:
    """Base metrics per cell and difficulty; rows without one are ``unknown``."""
    return unified_metrics(records.withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown"))), [*cell, "difficulty"], baseline, epsilon)


def metrics_grouping_sets(records: DataFrame, cell: Sequence[str], by: Sequence[str], baseline: str = CONTROL, epsilon: float = EPSILON) -> DataFrame:
    """Totals and one-level breakdowns together; ``level`` names the breakdown, so null keys are not mistaken for totals.

    As in the single breakdowns, rows without a difficulty are ``unknown`` and groups without another key are left out.
    """
    if "difficulty" in by:
        records = records.withColumn("difficulty", F.coalesce("difficulty", F.lit("unknown")))
    items = effects(item_table(records, [*cell, *by]), baseline, epsilon=epsilon)
    keys = [F.col(c) for c in cell]
    sets = [keys, *[[*keys, F.col(b)] for b in by]]
    got = items.groupingSets(sets, *keys, *[F.col(b) for b in by]).agg(F.grouping_id().alias("gid"), *unified_aggregates(baseline))
    bits = {(1 << len(by)) - 1: "total"} | {((1 << len(by)) - 1) ^ (1 << (len(by) - 1 - i)): b for i, b in enumerate(by)}
    level = F.create_map(*[F.lit(x) for k, v in bits.items() for x in (k, v)])
    got = got.withColumn("level", level[F.col("gid").cast("int")]).drop("gid")
    return got.where((F.col("level") == "total") | F.create_map(*[x for b in by for x in (F.lit(b), F.col(b).isNotNull())])[F.col("level")])


def parse_rates(records: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Share of answered rows per cell and condition, before any dedup; rows without a condition are ``unknown``."""
    ok = F.col("parsed_ok") & F.col("answer").isNotNull()
    return records.groupBy(*cell, F.coalesce("condition", F.lit("unknown")).alias("condition")).agg(F.count("*").alias("n"), (F.count_if(ok) / F.count("*")).alias("parse_rate"))


def history_adjustment(items: DataFrame, cell: Sequence[str]) -> DataFrame:
    """Mean adjustment and recovery rates of plausible two-stage answers per cell."""
    rates = {"acr": adjustment_rate, "rr": recovery_rate}
    each = {f"{n}_{c}": f(F.col(f"{c}.gold"), F.col(f"{c}.stage1"), F.col(f"{c}.answer")) for n, f in rates.items() for c in PLS}
    return items.withColumns(each).groupBy(*cell).agg(*[pooled(n, PLS).alias(n) for n in rates], sum((F.count(f"acr_{c}") for c in PLS), F.lit(0)).alias("n_acr"))
