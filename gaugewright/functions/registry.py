"""Extension points: scoring rules by name, and the formulas as SQL functions for queries written as text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schemas import EPSILON

#: Signature and body of each function; Spark puts the body in place of a call, so nothing leaves the JVM.
FUNCTIONS = {
    "item_uai": (f"answer DOUBLE, control DOUBLE, anchor DOUBLE, epsilon DOUBLE DEFAULT {EPSILON}D", "DOUBLE", "CASE WHEN abs(anchor - control) >= epsilon THEN (answer - control) / (anchor - control) END"),
    "toward_anchor": ("answer DOUBLE, control DOUBLE, anchor DOUBLE", "DOUBLE", "CASE WHEN (answer - control) * (anchor - control) IS NOT NULL THEN IF((answer - control) * (anchor - control) > 0, 1D, 0D) END"),
    "adjustment_rate": ("gold DOUBLE, first DOUBLE, second DOUBLE", "DOUBLE", "CASE WHEN abs(gold - first) >= 1 THEN (second - first) / (gold - first) END"),
    "recovery_rate": ("gold DOUBLE, first DOUBLE, second DOUBLE", "DOUBLE", "CASE WHEN abs(gold - first) >= 1 THEN 1 - abs(second - gold) / abs(first - gold) END"),
    "classify_shift": ("answer DOUBLE, control DOUBLE, gold DOUBLE, tolerance DOUBLE DEFAULT 0D", "STRING", "CASE WHEN abs(answer - gold) - abs(control - gold) > tolerance THEN 'harmful' WHEN abs(answer - gold) - abs(control - gold) < -tolerance THEN 'helpful' WHEN answer + control + gold IS NOT NULL THEN 'neutral' END"),
    "rational_ceiling": ("weight DOUBLE, n DOUBLE", "DOUBLE", "CASE WHEN n <= 0 THEN 1D WHEN weight < 0 THEN 0D ELSE weight / (n + weight) END"),
    "implied_weight": ("uai DOUBLE, n DOUBLE", "DOUBLE", "CASE WHEN uai IS NULL OR isnan(uai) OR uai >= 1 THEN NULL WHEN uai <= 0 THEN 0D ELSE uai * n / (1 - uai) END"),
    "gold_mean": ("v ARRAY<INT>", "INT", "IF(size(v) > 0, CAST(bround(aggregate(v, 0D, (s, x) -> s + x) / size(v), 0) AS INT), 0)"),
    "gold_median": ("v ARRAY<INT>", "INT", "IF(size(v) > 0, CAST(bround((get(array_sort(v), CAST(floor((size(v) - 1) / 2) AS INT)) + get(array_sort(v), CAST(floor(size(v) / 2) AS INT))) / 2D, 0) AS INT), 0)"),
    "gold_weighted_mean": ("v ARRAY<INT>, w ARRAY<DOUBLE>", "INT", "IF(size(v) > 0, CAST(bround(aggregate(zip_with(v, slice(w, 1, size(v)), (x, y) -> x * y), 0D, (s, x) -> s + x) / aggregate(slice(w, 1, size(v)), 0D, (s, x) -> s + x), 0) AS INT), 0)"),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Make the formulas temporary SQL functions of the session; their names, with the prefix."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({arguments}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in FUNCTIONS]
