"""Incremental metrics: newly arrived records recompute the cells they touch.

A record's pull needs the control of its item, which may arrive later, so each micro-batch appends its records and
recomputes the touched cells from all records so far. The store is partitioned by cell and a batch reads the partitions of
its own cells only. A batch id that was applied before changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import unified_metrics


#: Cells that a batch may name in its partition filter; a batch that touches more recomputes all cells.
MOST_CELLS = 200


def recompute_on_arrival(stream: DataFrame, store: str, out: str, cell: Sequence[str], checkpoint: str, dedup: Sequence[str] = (), watermark: tuple[str, str] | None = None) -> StreamingQuery:
    """Start the query: records go to ``<store>/<cell>=.../arrived=<id>``, metrics of touched cells to ``<out>/batch=<id>``.

    ``watermark`` (column, delay) with ``dedup`` keys drops records that arrive twice within the delay.
    """
    if watermark:
        stream = stream.withWatermark(*watermark)
        if dedup:
            stream = stream.dropDuplicatesWithinWatermark(list(dedup))

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("arrived", F.lit(batch_id)).persist()
        # a batch that runs again replaces its own partitions and no others
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cell, "arrived").parquet(store)
        touched = rows.select(*cell).distinct().limit(MOST_CELLS + 1).collect()
        rows.unpersist()
        if not touched:
            return
        known = spark.read.schema(rows.schema).parquet(store).where(F.col("arrived") <= batch_id)
        if len(touched) <= MOST_CELLS:
            known = known.where(reduce(or_, (reduce(and_, (F.col(c).eqNullSafe(F.lit(r[c])) for c in cell)) for r in touched)))
        unified_metrics(known.drop("arrived"), cell).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_metrics(spark: SparkSession, out: str, cell: Sequence[str]) -> DataFrame:
    """Each cell's metrics from the last batch that touched it."""
    df = spark.read.parquet(out)
    rest = [c for c in df.columns if c not in (*cell, "batch")]
    return df.groupBy(*cell).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*cell, "r.*")
