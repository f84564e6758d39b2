"""Running sums, places and minima over groups of any size: no task sees more than a range of rows.

Rows are ordered by ranges of (group, order), one written table. Inside a range a window does the work; what lies before or
behind comes from one row per range and group: totals are carried forward, minima backward.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written

#: Most rows of a range: with more, rows are dealt to more ranges.
RANGE_ROWS = 1_000_000


def in_ranges(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int | None = None) -> DataFrame:
    """The rows with ``_range`` and ``_row`` (a number that breaks ties), written in ranges of (group, order) of ``most`` rows, about."""
    most = most or RANGE_ROWS
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    while True:
        got = written(rows.repartitionByRange(parts, *group, *order, "_row").withColumn("_range", F.spark_partition_id()), "ranges")
        held = got.groupBy("_range").count().agg(F.max("count"), F.sum("count")).first()
        if not held[0] or held[0] <= 2 * most or parts >= held[1]:
            return got
        rows, parts = got.drop("_range"), max(2 * parts, -(-held[1] // most))


def carried(ranged: DataFrame, group: Sequence[str], totals: dict[str, Column], carries: dict[str, Column]) -> DataFrame:
    """The rows with columns of ``carries``, windows' results over one row (``_range``, ``totals``) per range of a group.

    In a carry, ``totals`` stand for a range's own and windows are ``before()``, ``behind()`` and ``whole()`` of ``group``.
    """
    each = ranged.groupBy(*group, "_range").agg(*[c.alias(name) for name, c in totals.items()])
    each = each.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], *[c.alias(name) for name, c in carries.items()])
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return ranged.join(each, on).drop("_r", *[f"_g{i}" for i in range(len(group))])


def before(group: Sequence[str]):
    """The ranges of a group before this one."""
    return W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)


def behind(group: Sequence[str]):
    """The ranges of a group behind this one."""
    return W.partitionBy(*group).orderBy("_range").rowsBetween(1, W.unboundedFollowing)


def whole(group: Sequence[str]):
    return W.partitionBy(*group)


def inside(group: Sequence[str], order: Sequence[str]):
    """Window of a range's rows of a group, in order."""
    return W.partitionBy(*group, "_range").orderBy(*order, "_row")


def places(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int | None = None) -> DataFrame:
    """Add ``_place``, the row's number in its group from 0, and ``_n``, the group's rows."""
    ranged = in_ranges(df, group, order, most)
    got = carried(ranged, group, {"_held": F.count("*")}, {"_first": F.coalesce(F.sum("_held").over(before(group)), F.lit(0)), "_n": F.sum("_held").over(whole(group))})
    return got.withColumn("_place", F.col("_first") + F.row_number().over(inside(group, order)) - 1).drop("_first", "_row", "_range")
