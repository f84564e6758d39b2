"""Per-row formulas as Columns: pull towards a reference, direction, adjustment, ceilings, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EPSILON, RELEVANCES


def item_uai(answer: Column, control: Column, anchor: Column, epsilon: float = EPSILON) -> Column:
    """Share of the way from the control answer to the anchor; null where they are less than ``epsilon`` apart."""
    return F.when(F.abs(anchor - control) >= epsilon, (answer - control) / (anchor - control).cast("double"))


def toward_anchor(answer: Column, control: Column, anchor: Column) -> Column:
    """1.0 if the answer moved from control in the anchor's direction, else 0.0; null if any is null."""
    moved = (answer - control) * (anchor - control)
    return F.when(moved.isNotNull(), F.when(moved > 0, 1.0).otherwise(0.0))


def adjustment_rate(gold: Column, first: Column, second: Column) -> Column:
    """Part of the distance from the first answer to gold that the second answer covers; null within 1 of gold."""
    return F.when(F.abs(gold - first) >= 1, (second - first) / (gold - first).cast("double"))


def recovery_rate(gold: Column, first: Column, second: Column) -> Column:
    return F.when(F.abs(gold - first) >= 1, 1 - F.abs(second - gold) / F.abs(first - gold).cast("double"))


def classify_shift(answer: Column, control: Column, gold: Column, tolerance: float = 0) -> Column:
    change = F.abs(answer - gold) - F.abs(control - gold)
    return F.when(change > tolerance, "harmful").when(change < -tolerance, "helpful").when(change.isNotNull(), "neutral")


def anchor_proximity(anchor: Column, control: Column, gold: Column) -> Column:
    """Whether the anchor lies closer to gold than the control answer does."""
    a, c = F.abs(anchor - gold), F.abs(control - gold)
    return F.when(a < c, "closer").when(a > c, "farther").when(a.isNotNull() & c.isNotNull(), "equidistant")


def rational_ceiling(weight: Column, n: Column) -> Column:
    """Most pull that one extra observation of ``weight`` justifies beside ``n`` pieces of evidence."""
    return F.when(n <= 0, 1.0).when(weight < 0, 0.0).otherwise(weight / (n + weight))


def implied_weight(uai: Column, n: Column) -> Column:
    """Weight at which ``uai`` would be the rational pull; null for null, NaN and 1 or more, 0 for 0 or less."""
    return F.when(uai.isNull() | F.isnan(uai) | (uai >= 1), None).when(uai <= 0, 0.0).otherwise(uai * n / (1 - uai))


def relevance_of(condition: Column) -> Column:
    """Group of a condition's name, by substring and precedence; null for controls."""
    out = None
    for name in RELEVANCES:
        out = F.when(condition.contains(name), name) if out is None else out.when(condition.contains(name), name)
    return out


def direction_of(condition: Column) -> Column:
    return F.substring_index(condition, "_", -1)


def offset_of(item_id: Column, *given: Column) -> Column:
    """First non-null of the given offsets, else the ``-off<n>-`` part of the item id."""
    return F.coalesce(*given, F.regexp_extract(item_id, r"-off(\d+)-", 1).try_cast("int"))


def half_even(value: Column) -> Column:
    """Nearest whole number, halves to even."""
    return F.bround(value, 0).cast("int")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _median(values: Column, weights: Column | None) -> Column:
    n, s = F.size(values), F.array_sort(values)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return (low + high) / F.lit(2.0)


def _weighted_mean(values: Column, weights: Column | None) -> Column:
    w = F.slice(weights, F.lit(1), F.size(values))
    return _sum(F.zip_with(values, w, lambda x, y: x * y)) / _sum(w)


#: Scoring rules by name: from the visible values (not empty) and their weights to a score. ``register_rule`` adds to them.
RULES: dict[str, Callable[[Column, Column | None], Column]] = {"mean": lambda values, weights: _sum(values) / F.size(values), "median": _median, "weighted_mean": _weighted_mean}


def register_rule(name: str, rule: Callable[[Column, Column | None], Column]) -> None:
    """Add a scoring rule for generated items, their gold answers and the checks of both."""
    if name in RULES:
        raise ValueError(f"scoring rule {name} is there already")
    RULES[name] = rule


def gold_answer(values: Column, rule: str = "mean", weights: Column | None = None) -> Column:
    """Half-even rounded score of the visible values (array<int>) by one of RULES; 0 if there are none.

    Weights are taken from the front, one per visible value, whatever positions are missing.
    """
    if rule not in RULES:
        raise ValueError(f"unknown scoring rule {rule}")
    return F.when(F.size(values) > 0, half_even(RULES[rule](values, weights))).otherwise(0)
