"""Cross-entropy difference of matched target and background n-gram models over one vocabulary.

Tokens are the 256 bytes of UTF-8, the vocabulary of both models. The target model counts the n-grams of the target
documents, the background model those of all documents, thinned in expectation to the target's size: counts are scaled and
types weighed by their chance to survive, so both models are as large and as smooth as each other. Each order is
interpolated with the next lower one by its number of types (Witten-Bell), down to the uniform distribution. A document's
score is the mean over its tokens of target loss minus background loss: the lower, the more like the target.

Counts are kept in two folds and every document is scored by the models of the other fold, so no text vouches for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytebpe import IntTable
from .common import chunks, flagged, materialize, table

ORDER = 5
#: Context before a text's first byte.
LEAD = b"\n" * (ORDER - 1)
#: n-grams whose losses may be broadcast (40 bytes each); beyond it each chunk of texts gets its own slice of the model.
BROADCAST_GRAMS = 1_000_000
#: Bytes of text that share a slice of a model too large to broadcast.
CHUNK_BYTES = 16_000_000
#: Distinct n-grams that one task gathers before it passes counts on.
HELD_GRAMS = 2_000_000
_CHUNK_BYTES = 3_000_000
COUNTS = ("t0", "t1", "b0", "b1")
LOSSES = ("lt0", "lb0", "lt1", "lb1")


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, as an integer, and the texts' sizes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(x for t in texts for x in (LEAD, t)), np.uint8).astype(np.int64)
    gram = np.zeros(max(0, flat.size - ORDER + 1), np.int64)
    for i in range(ORDER):
        gram = gram << 8 | flat[i : flat.size - ORDER + 1 + i]
    own = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(texts)), sizes) * (ORDER - 1)
    return gram[own], sizes


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def gram_counts(background: DataFrame, target: DataFrame) -> DataFrame:
    """(gram, t0, t1, b0, b1): counts in target and all texts of each fold, of rows (text, fold). Tasks count their texts before the shuffle."""
    schema = "gram long, t0 long, t1 long, b0 long, b1 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(counts[:, k]) for k in range(4))], names=["gram", *COUNTS])

        for batch in batches:
            texts = _binary(batch.column(0))
            kinds = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in chunks(texts, list(map(len, texts)), _CHUNK_BYTES):
                gram, sizes = grams_of(texts[a:b])
                place, found = _factorize(gram)
                by_kind = np.bincount(place * 4 + np.repeat(kinds[a:b], sizes), minlength=4 * found.size).reshape(-1, 4)
                place, keys_ = _factorize(np.concatenate([keys, found]))
                both = np.zeros((keys_.size, 4), np.int64)
                both[place[: keys.size]] = counts
                both[place[keys.size :]] += by_kind
                keys, counts = keys_, both
                if keys.size > HELD_GRAMS:
                    yield out()
                    keys, counts = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)
        if keys.size:
            yield out()

    # the place of each row's counts among COUNTS
    rows = target.select("text", F.col("fold").cast("long").alias("kind")).unionByName(background.select("text", (F.col("fold") + 2).cast("long").alias("kind")))
    partial = rows.mapInArrow(run, schema)
    return partial.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _factorize(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    import pandas as pd

    return pd.factorize(values)


def gram_losses(counts: DataFrame) -> DataFrame:
    """(gram, lt0, lb0, lt1, lb1): natural-log losses of each n-gram's last byte under the models of each fold.

    ``counts`` is read several times: pass a written table. Every n-gram of the corpus is in it, so every one has losses.
    """
    totals = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).first()
    kept = [totals[f"t{f}"] / totals[f"b{f}"] if totals[f"b{f}"] else 0.0 for f in (0, 1)]
    model = None
    for n in range(1, ORDER + 1):
        rows = counts.groupBy(F.col("gram").bitwiseAND((1 << 8 * n) - 1).alias("g")).agg(*[F.sum(c).alias(c) for c in COUNTS])
        for f in (0, 1):
            rows = rows.withColumns({f"xt{f}": F.col(f"t{f}").cast("double"), f"yt{f}": (F.col(f"t{f}") > 0).cast("double"), f"xb{f}": F.col(f"b{f}") * kept[f], f"yb{f}": 1 - F.pow(F.lit(1 - kept[f]), F.col(f"b{f}"))})
        names = ("t0", "b0", "t1", "b1")
        rows = rows.withColumn("h", F.shiftright("g", 8))
        heads = rows.groupBy("h").agg(*[F.sum(f"{s}{m}").alias(f"{s}h{m}") for m in names for s in "xy"])
        rows = rows.join(heads, "h")
        if model is None:
            lower: dict[str, Column] = {m: F.lit(1 / 256) for m in names}
        else:
            rows = rows.join(model.withColumnRenamed("g", "s"), F.col("g").bitwiseAND((1 << 8 * (n - 1)) - 1) == F.col("s"))
            lower = {m: F.col(f"p{m}") for m in names}
        p = {m: F.when(F.col(f"xh{m}") > 0, (F.col(f"x{m}") + F.col(f"yh{m}") * lower[m]) / (F.col(f"xh{m}") + F.col(f"yh{m}"))).otherwise(lower[m]) for m in names}
        model = materialize(rows.select("g", *[p[m].alias(f"p{m}") for m in names]), f"lm-order{n}")
    return model.select(F.col("g").alias("gram"), *[(-F.log(F.col(f"p{c[1:]}"))).alias(c) for c in LOSSES])


ADDED = {"n_tokens": "long", "ce_target": "double", "ce_background": "double", "score": "double"}


class _Model:
    """Losses of some n-grams, and the sums of a list of texts under them."""

    def __init__(self, grams: np.ndarray, loss: np.ndarray):
        self.at, self.loss = IntTable(grams.size), loss
        self.at.put(grams, np.arange(grams.size, dtype=np.int32))

    def columns(self, texts: list[bytes], fold: np.ndarray) -> list[pa.Array]:
        """The columns of ADDED; every n-gram of the texts must be known."""
        gram, sizes = grams_of(texts)
        row, other = self.at.get(gram), 2 * (1 - np.repeat(fold, sizes))
        doc, n = np.repeat(np.arange(len(texts)), sizes), np.maximum(sizes, 1)
        t, b = (np.bincount(doc, self.loss[row, other + k], len(texts)) / n for k in (0, 1))
        return [pa.array(sizes, pa.int64()), *(pa.array(x, pa.float64(), mask=sizes == 0) for x in (t, b, t - b))]


def _scored(batch: pa.RecordBatch, model: _Model) -> Iterator[pa.RecordBatch]:
    """Scores of a batch of (doc, text, fold), a bounded number of bytes at a time."""
    fold = batch.column(2).to_numpy(zero_copy_only=False)
    for a, b in chunks(range(batch.num_rows), pc.fill_null(pc.binary_length(batch.column(1).cast(pa.binary())), 0).to_pylist(), _CHUNK_BYTES):
        columns = model.columns(_binary(batch.column(1).slice(a, b - a)), fold[a:b])
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc", *ADDED])


def _score_by_broadcast(rows: DataFrame, losses: DataFrame) -> DataFrame:
    """Scores by a table of all losses on every executor; its size has been checked."""
    found = losses.select("gram", *LOSSES).toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((found["gram"].to_numpy(), np.stack([found[c].to_numpy() for c in LOSSES], 1)))
    del found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _Model(*shared.value)
        for batch in batches:
            yield from _scored(batch, model)

    return rows.select("doc", "text", "fold").mapInArrow(run, _scored_schema(rows))


def _scored_schema(rows: DataFrame):
    return rows.select("doc", *[F.lit(None).cast(t).alias(n) for n, t in ADDED.items()]).schema


def _score_by_slices(rows: DataFrame, losses: DataFrame) -> DataFrame:
    """The same scores where the model is too large to broadcast: each chunk of texts gets the losses of its own n-grams.

    A chunk is a run of texts of CHUNK_BYTES bytes (or one longer text). Its distinct n-grams are joined to the model, and
    its slice of the model and its texts meet in one shuffle, sorted so that the slice comes first.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    schema = rows.select("doc", "text", "fold", F.lit(0).cast("long").alias("chunk")).schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, 0
        for batch in batches:
            out = []
            for row, n in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if chunk is None or held + n > CHUNK_BYTES:
                    chunk, held = row, 0
                held += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=["doc", "text", "fold", "chunk"])

    numbered = rows.select("doc", "text", "fold", F.monotonically_increasing_id().alias("row"), size.alias("size"))
    numbered = materialize(numbered.mapInArrow(number, schema), "lm-chunks", compression="zstd")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, grams = None, np.zeros(0, np.int64)
        for batch in batches:
            texts = _binary(batch.column(1))
            for chunk, a, b in _runs(batch.column(0).to_numpy()):
                if chunk != at and grams.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(grams.size, at)), pa.array(grams)], names=["chunk", "gram"])
                    grams = np.zeros(0, np.int64)
                at = chunk
                grams = np.union1d(grams, grams_of(texts[a:b])[0])
        if grams.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(grams.size, at)), pa.array(grams)], names=["chunk", "gram"])

    slices = numbered.select("chunk", "text").mapInArrow(wanted, "chunk long, gram long").join(losses, "gram")
    both = slices.select("chunk", "gram", *LOSSES).unionByName(numbered, allowMissingColumns=True)
    both = both.select("doc", "text", "fold", "chunk", "gram", *LOSSES).repartition("chunk").sortWithinPartitions("chunk", F.col("gram").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model, parts = None, None, []
        for batch in batches:
            for chunk, a, b in _runs(batch.column(3).to_numpy()):
                if chunk != at:
                    at, model, parts = chunk, None, []
                part = batch.slice(a, b - a)
                told = part.num_rows - part.column(4).null_count
                if told:
                    parts.append((part.column(4)[:told].to_numpy(), np.stack([part.column(5 + k)[:told].to_numpy() for k in range(len(LOSSES))], 1)))
                if told < part.num_rows:
                    if model is None:
                        # a chunk that two tasks read asked for some n-grams twice
                        grams, first = np.unique(np.concatenate([g for g, _ in parts] or [np.zeros(0, np.int64)]), return_index=True)
                        loss = np.concatenate([x for _, x in parts] or [np.zeros((0, len(LOSSES)))])[first]
                        model, parts = _Model(grams, loss), []
                    yield from _scored(part.slice(told).select([0, 1, 2]), model)

    return both.mapInArrow(run, _scored_schema(rows))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, stop) of runs of equal values."""
    cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), values.size] if values.size else []
    for a, b in zip(cuts, cuts[1:]):
        yield int(values[a]), a, b


def cross_entropy_difference(df: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Add n_tokens (bytes), ce_target, ce_background and score (nats per token) to ``df`` without its text.

    ``target`` holds those rows of ``df`` that make up the target (id and text are read). Null and empty texts have no
    tokens and null scores. Without any target text both models are uniform and scores are 0. Rows that repeat are counted
    as often as they occur; rows without an id are in one fold; an empty table gives none. Columns of the new names are
    replaced, all other names are free. ``df`` is read twice, once to count and once to score, and its texts are neither
    shuffled nor written. ``broadcast_grams`` picks how losses reach the texts; scores are the same bit for bit.
    """
    fold = F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 2, F.lit(0)).alias("fold")
    own = F.col(f"`{text}`").alias("text")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ADDED and c != text]).alias("doc"), own, fold)
    losses = gram_losses(materialize(gram_counts(rows, target.select(own, fold)), "lm-counts"))
    score = _score_by_broadcast if losses.count() <= broadcast_grams else _score_by_slices
    return score(rows, losses).select("doc.*", *ADDED)


def op1_ce_difference(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents against those labelled good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # only texts that may be the target's meet the labels, in the same way at every size
    target = flagged(docs, good, "doc_id").where("maybe").drop("maybe").join(good.hint("merge"), "doc_id")
    return cross_entropy_difference(docs, target)
