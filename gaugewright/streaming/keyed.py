"""Metrics of a record stream from keyed state: a batch reads its own rows and the state of their items' buckets, nothing else.

State is kept per (cell, item): the last parsed row of each condition, and row counts. A cell's items are dealt to buckets by
hash, and a bucket's items are one value of the state store: Python is called, and state passed, once a bucket and batch, not
once an item. When rows of an item arrive, in any order, its part in the cell's sums is computed anew and the difference to what it was before is passed on; a control that
comes late so repairs every pull that waited for it. Differences are summed by cell inside the batch and appended as one
small file a batch, named by the batch, so a batch that runs again replaces its own. A cell's metrics are a sum of its
differences; ``compact`` folds old batches into one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.metrics import IRR, PLS
from ..schemas import CONTROL, CORE_ANCHORED, EPSILON

#: Conditions whose last rows the state keeps, in this order.
KEPT = (CONTROL, *CORE_ANCHORED)
#: Sums of a cell: counts of rows and items, errors of the control, pull and direction of each anchored condition.
COUNTS = ("n_records", "n_items", "n_answered", "n_error", "within10", *(f"n_{p}_{c}" for p in ("uai", "tar") for c in CORE_ANCHORED))
TOTALS = ("error", *(f"{p}_{c}" for p in ("uai", "tar") for c in CORE_ANCHORED))
_PLACE = {c: k for k, c in enumerate(KEPT)}
_LAST = ("pos", "answer", "anchor", "gold")
#: Buckets of a cell, fixed for the life of a checkpoint. More of them read less state for small batches and call Python more often for large ones.
BUCKETS = 1024
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def item_sums(state: tuple | None, epsilon: float = EPSILON) -> dict[str, float]:
    """What one item adds to its cell's sums."""
    out: dict[str, float] = dict.fromkeys((*COUNTS, *TOTALS), 0)
    if state is None:
        return out
    n_records, n_answered, has_parsed, _, answers, anchors, golds = state
    out |= {"n_records": n_records, "n_answered": n_answered, "n_items": int(has_parsed)}
    control = answers[0]
    if control is None:
        return out
    if golds[0] is not None:
        off = abs(control - golds[0])
        out |= {"n_error": 1, "error": float(off), "within10": int(off <= 10)}
    for name, answer, anchor in zip(CORE_ANCHORED, answers[1:], anchors[1:]):
        if answer is None or anchor is None:
            continue
        out[f"n_tar_{name}"], out[f"tar_{name}"] = 1, float((answer - control) * (anchor - control) > 0)
        if abs(anchor - control) >= epsilon:
            out[f"n_uai_{name}"], out[f"uai_{name}"] = 1, (answer - control) / (anchor - control)
    return out


class ItemFold(StatefulProcessor):
    """Folds rows into the state of their bucket's items and gives the difference that they make to the cell's sums."""

    def __init__(self, cell: Sequence[str], epsilon: float):
        self.cell, self.epsilon = list(cell), epsilon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "items binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        old = self.state.get()
        items = pickle.loads(old[0]) if old else {}
        before: dict[Any, tuple | None] = {}
        place = None
        for row in rows:
            if place is None:
                place = [row.__fields__.index(x) for x in ("item", "condition", "parsed_ok", *_LAST)]
            item, condition, parsed_ok, *values = [row[i] for i in place]
            if item not in before:
                had = before[item] = items.get(item)
                n_records, n_answered, has_parsed, *last = had or (0, 0, False, *([None] * len(KEPT) for _ in _LAST))
                items[item] = [n_records, n_answered, has_parsed, *map(list, last)]
            own = items[item]
            own[0] += 1
            if not parsed_ok:
                continue
            own[1] += values[1] is not None
            own[2] = True
            pos, k = values[0], _PLACE.get(condition)
            if k is not None and pos is not None and (own[3][k] is None or pos >= own[3][k]):
                for kept, x in zip(own[3:], values):
                    kept[k] = x
        change: dict[str, float] = dict.fromkeys((*COUNTS, *TOTALS), 0)
        for item, had in before.items():
            new = item_sums(items[item], self.epsilon)
            for x, v in new.items():
                change[x] += v
            if had is not None:
                for x, v in item_sums(had, self.epsilon).items():
                    change[x] -= v
        self.state.update((pickle.dumps(items, pickle.HIGHEST_PROTOCOL),))
        yield Row(*self.cell, *COUNTS, *TOTALS)(*key[: len(self.cell)], *(change[x] for x in COUNTS), *(float(change[x]) for x in TOTALS))

    def close(self) -> None:
        pass


def cell_differences(stream: DataFrame, cell: Sequence[str], epsilon: float = EPSILON, buckets: int = BUCKETS) -> DataFrame:
    """One row per bucket of items and batch: how its rows change the sums of its cell. ``pos`` has to be a whole number."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.select(*cell, F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("_bucket"), "item", "condition", "parsed_ok", *[F.col(x).cast("long") for x in _LAST])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*cell).schema.fields), *(f"{x} long" for x in COUNTS), *(f"{x} double" for x in TOTALS)])
    return rows.groupBy(*cell, "_bucket").transformWithState(ItemFold(cell, epsilon), fields, "Append", "None")


def fold_on_arrival(stream: DataFrame, out: str, cell: Sequence[str], checkpoint: str, dedup: Sequence[str] = (), watermark: tuple[str, str] | None = None, epsilon: float = EPSILON) -> StreamingQuery:
    """Start the query; each batch writes the differences of the cells that it touches to ``<out>/batch=<id>``.

    ``watermark`` (column, delay) with ``dedup`` keys drops records that arrive twice within the delay.
    """
    if watermark:
        stream = stream.withWatermark(*watermark)
        if dedup:
            stream = stream.dropDuplicatesWithinWatermark(list(dedup))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*cell).agg(*_summed()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return cell_differences(stream, cell, epsilon).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _summed() -> list[Column]:
    return [F.sum(x).alias(x) for x in (*COUNTS, *TOTALS)]


def folded_metrics(spark: SparkSession, out: str, cell: Sequence[str]) -> DataFrame:
    """Metrics of every cell so far, those of ``unified_metrics`` over all records that have arrived."""
    sums = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch").groupBy(*cell).agg(*_summed())

    def mean(p: str, conditions: Sequence[str]) -> Column:
        return F.try_divide(sum((F.col(f"{p}_{c}") for c in conditions), F.lit(0.0)), sum((F.col(f"n_{p}_{c}") for c in conditions), F.lit(0)))

    got = [
        *cell, "n_records", "n_items", F.coalesce(F.try_divide("n_answered", "n_records"), F.lit(0.0)).alias("parse_rate"),
        F.try_divide("error", "n_error").alias("mae"), F.try_divide("within10", "n_error").alias("acc10"), *[mean(p, [c]).alias(f"{p}_{c}") for p in ("uai", "tar") for c in CORE_ANCHORED],
    ]
    for name, group in (("irr", IRR), ("plaus", PLS)):
        got += [mean("uai", group).alias(f"uai_{name}"), sum((F.col(f"n_uai_{c}") for c in group), F.lit(0)).alias(f"n_uai_{name}"), mean("tar", group).alias(f"tar_{name}")]
    return sums.select(*got, (mean("uai", PLS) - mean("uai", IRR)).alias("disc_delta"))


def compact(spark: SparkSession, out: str, target: str, cell: Sequence[str]) -> None:
    """Fold all batches of ``out`` into one batch (-1) of the new folder ``target``, for a store that goes on there."""
    sums = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch").groupBy(*cell).agg(*_summed())
    sums.write.mode("overwrite").parquet(f"{target}/batch=-1")
