"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces of the product of their probabilities, computed by the forward algorithm over a batch's
distinct words at once; a text's is the product over its words that hold letters. Piece probabilities are fitted by
expectation maximisation (forward-backward) on a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bytebpe import presplit, ragged, range_hash, spelled, vocabulary
from .common import CHUNK_CHARS, chunks, materialize, table, vocabulary_path

UNKNOWN = "und"
#: Labelled texts per language that the fit uses: those with the smallest hash of their id. Prediction covers all texts.
SAMPLE_PER_LANGUAGE = 400
#: Languages, and sampled ids, that may be broadcast to the texts; with more (hundreds of languages) the join shuffles.
BROADCAST_IDS = 100_000
#: Languages whose dense piece tables are held at a time; a model with more is scored block by block, with the same results.
LANGUAGE_BLOCK = 16
ROUNDS = 3
SMOOTHING = 0.01
#: Bytes of word scores that one task remembers between batches; emptied beyond it (results don't change).
REMEMBERED_BYTES = 32_000_000


@lru_cache(maxsize=2)
def _pieces(path: str):
    vocab = vocabulary(path)
    trie, ends = vocab.trie([i for i, t in enumerate(vocab.token_bytes) if t and i != vocab.special_id])
    return vocab, trie, ends


class Lattice:
    """All pieces at all places of a list of words, ordered by where they end."""

    def __init__(self, buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, path: str):
        _, trie, ends = _pieces(path)
        self.size = stop - start
        data = buffer[ragged(start, self.size)]
        offset = np.cumsum(self.size) - self.size
        word = np.repeat(np.arange(self.size.size), self.size)
        place = np.arange(data.size) - offset[word]
        at, length, piece = spelled(trie, ends, data, self.size[word] - place) if data.size else [np.zeros(0, np.int64)] * 3
        end = place[at] + length
        order = np.lexsort((at, end))
        self.begin = (at + word[at])[order]  # one slot for each prefix of a word, the empty one included
        self.end = self.begin + length[order]
        self.piece, self.place, self.start_place = piece[order], end[order], place[at][order]
        self.first = offset + np.arange(self.size.size)
        self.last = self.first + self.size
        self.slots = data.size + self.size.size

    def _sweep(self, log_p: np.ndarray, source: np.ndarray, to: np.ndarray, rounds: list[np.ndarray], origin: np.ndarray) -> np.ndarray:
        """Log of the summed products of all paths from the origin slots to each slot; log_p has a row per piece."""
        out = np.full((self.slots, log_p.shape[1]), -np.inf)
        out[origin] = 0.0
        for rows in rounds:
            rows = rows[np.argsort(to[rows], kind="stable")]
            target = to[rows]
            head = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            step = out[source[rows]] + log_p[self.piece[rows]]
            top = np.maximum.reduceat(step, head)
            top = np.where(np.isfinite(top), top, 0.0)
            step = np.exp(step - np.repeat(top, np.diff(np.append(head, rows.size)), axis=0))
            with np.errstate(divide="ignore"):
                out[target[head]] = np.log(np.add.reduceat(step, head)) + top
        return out

    @staticmethod
    def _by(value: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(value, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(value[order])) + 1) if value.size else []

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        """(slots, languages): log probability of every prefix."""
        return self._sweep(log_p, self.begin, self.end, self._by(self.place), self.first)

    def word_log_likelihood(self, log_p: np.ndarray) -> np.ndarray:
        """(words, languages)."""
        return self.forward(log_p)[self.last]

    def expected_counts(self, log_p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (a vector) under one language's probabilities, words counted ``weight`` times."""
        p = log_p[:, None]
        ahead = self._sweep(p, self.begin, self.end, self._by(self.place), self.first)
        back = self._sweep(p, self.end, self.begin, self._by(-self.start_place), self.last)
        whole = np.repeat(ahead[self.last, 0], self.size + 1)
        times = np.repeat(weight, self.size + 1)
        gamma = np.exp(ahead[self.begin, 0] + log_p[self.piece] + back[self.end, 0] - whole[self.begin])
        return np.bincount(self.piece, gamma * times[self.begin], log_p.size)


def _words(texts: list[str]):
    """Distinct lower-cased words with letters: (words, rows of a sample, text of each occurrence, index of each occurrence)."""
    w = presplit([t.lower() for t in texts])
    if not w.start.size:
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    keep = np.flatnonzero(w.letters)
    hashes, sample, back = np.unique(range_hash(w.buffer, w.start, w.stop)[keep], return_index=True, return_inverse=True)
    order = np.argsort(sample)  # by first occurrence: hashes differ between processes
    rank = np.empty(order.size, np.int64)
    rank[order] = np.arange(order.size)
    return w, keep[sample[order]], w.doc[keep], rank[back], hashes[order]


def fit_pieces(texts: list[str], path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of each piece of the vocabulary in these texts; every piece has some."""
    vocab = _pieces(path)[0]
    w, sample, _, back, _ = _words(texts)
    weight = np.bincount(back, minlength=sample.size).astype(float)
    lattice = Lattice(w.buffer, w.start[sample], w.stop[sample], path)
    times = np.repeat(weight, lattice.size + 1)
    counts = np.bincount(lattice.piece, times[lattice.begin], vocab.size) if lattice.piece.size else np.zeros(vocab.size)
    for k in range(rounds + 1):
        total = counts.sum() + SMOOTHING * vocab.size
        log_p = np.log((counts + SMOOTHING) / total)
        if k < rounds and lattice.piece.size:
            counts = lattice.expected_counts(log_p, weight)
    return log_p


def _held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


#: A fitted language: its name, its pieces with a count (ids, log probabilities), and the log probability of any other.
Language = tuple[str, np.ndarray, np.ndarray, float]


def fit_language_model(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, path: str | None = None) -> list[Language]:
    """Every language of the rows, in order of names, fitted on at most ``per_language`` whole texts of each.

    Rows with null text, language or id are not learned from. The sample is chosen on the id and language columns alone,
    then its texts are read. An empty table gives no languages. What reaches the driver are the pieces that the sample
    uses: it grows with the number of languages, not of documents.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))
    ids = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang")).where("id is not null and lang is not null")
    # of a language some 2 * per_language rows of the lowest hashes reach the window, however many rows or tasks there are
    sizes = materialize(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    low = (F.xxhash64("id").cast("double") + 2.0**63) / 2.0**64 < 2.0 * per_language / F.col("n")
    ids = ids.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes, "lang").where(low).drop("n")
    picked = ids.withColumn("h", F.xxhash64("id")).withColumn("r", rank).where(F.col("r") <= per_language)
    sample = picked.select("lang", "id").distinct()
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
    small = sample.count() <= BROADCAST_IDS
    rows = rows.join(F.broadcast(sample) if small else sample, ["id", "lang"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        log_p = fit_pieces(sorted(t for t in pdf["text"] if isinstance(t, str)), path)
        other = log_p.min()
        held = np.flatnonzero(log_p > other)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "pieces": [held], "log_p": [log_p[held]], "other": [other]})

    found = rows.groupBy("lang").applyInPandas(fit, "lang string, pieces array<int>, log_p array<double>, other double").toArrow()
    return sorted((r["lang"], np.array(r["pieces"], np.int32), np.array(r["log_p"], float), r["other"]) for r in found.to_pylist())


class Scorer:
    """Scores texts; remembers the words it has met."""

    def __init__(self, model: list[Language], path: str):
        self.model, self.path, self.size = model, path, _pieces(path)[0].size
        self.one_block = self._dense(model) if len(model) <= LANGUAGE_BLOCK else None
        self._forget()

    def _dense(self, languages: list[Language]) -> np.ndarray:
        out = np.empty((self.size, len(languages)))
        for k, (_, pieces, log_p, other) in enumerate(languages):
            out[:, k] = other
            out[pieces, k] = log_p
        return out

    def _forget(self) -> None:
        self.known, self.value = np.zeros(0, np.uint64), np.zeros((0, len(self.model)))

    def _words_log_likelihood(self, lattice: Lattice) -> np.ndarray:
        if self.one_block is not None:
            return lattice.word_log_likelihood(self.one_block)
        blocks = (self._dense(self.model[k : k + LANGUAGE_BLOCK]) for k in range(0, len(self.model), LANGUAGE_BLOCK))
        return np.concatenate([lattice.word_log_likelihood(b) for b in blocks], 1)

    def log_likelihood(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) log likelihoods, and the number of words with letters of each text."""
        w, sample, doc, back, hashes = _words(texts)
        if self.value.nbytes > REMEMBERED_BYTES:
            self._forget()
        place = np.minimum(np.searchsorted(self.known, hashes), max(self.known.size - 1, 0))
        met = self.known[place] == hashes if self.known.size else np.zeros(hashes.size, bool)
        new = sample[~met]
        if new.size:
            value = self._words_log_likelihood(Lattice(w.buffer, w.start[new], w.stop[new], self.path))
            known = np.concatenate([self.known, hashes[~met]])
            order = np.argsort(known)
            self.known, self.value = known[order], np.concatenate([self.value, value])[order]
        value, place = self.value, np.searchsorted(self.known, hashes)[back]
        out = np.stack([np.bincount(doc, value[place, k], len(texts)) for k in range(value.shape[1])], 1)
        return out, np.bincount(doc, minlength=len(texts))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.model:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        ll, words = self.log_likelihood(texts)
        best = ll.argmax(1)
        score = 1.0 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
        none = words == 0
        return [UNKNOWN if n else self.model[b][0] for n, b in zip(none, best)], np.where(none, 0.0, score).tolist()


def predict_language(df: DataFrame, model: list[Language], text: str = "text", path: str | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the posterior of the predicted language under equal priors (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as all are if the model has no languages. Only the
    text is looked at, whole; ties go to the first name; columns of the new names are replaced, others stay. Map-side only.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    rest = [c for c in df.columns if c not in ("lang_pred", "score")]
    source = df.select(*[F.col(f"`{c}`") for c in rest])
    schema = source.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    place, limit = rest.index(text), CHUNK_CHARS * LANGUAGE_BLOCK // max(LANGUAGE_BLOCK, len(model))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, path)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_pylist()
            for a, b in chunks(range(batch.num_rows), sizes, limit):
                part = batch.slice(a, b - a)
                lang, score = scorer.predict([x or "" for x in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from."""
    return docs.where(~_held_out("doc_id"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = fit_language_model(learnable(docs))
    rows = docs.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "text")
    return predict_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")
