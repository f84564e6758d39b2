"""Token counts by rank-synchronous array merging.

A batch's distinct pre-split words are one ragged array of symbols. Each round finds, for every word at once, its
lowest-rank adjacent pair, merges all that pair's occurrences (from the left where they overlap), and drops finished
words; what survives is counted. Ranks of a word only rise, so a word takes at most as many rounds as merges it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteVocabulary, IntTable, presplit, ragged, range_hash, vocabulary
from .common import chunks, table, vocabulary_path

NONE = np.int32(2**31 - 1)
#: Distinct words whose counts one task remembers between batches; the memory is emptied beyond it (results don't change).
REMEMBERED_WORDS = 1_000_000


def surviving_symbols(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray, vocab: ByteVocabulary, ranks: IntTable) -> np.ndarray:
    """Number of tokens of each byte range."""
    out = np.zeros(start.size, np.int64)
    size = stop - start
    word = np.repeat(np.arange(start.size), size)
    sym = vocab.byte_id[buffer[ragged(start, size)]].astype(np.int64)
    merged = vocab.merges[:, 2].astype(np.int64)

    def rank_of(left, right):
        return ranks.get(left << 32 | right, int(NONE))

    rank = np.full(sym.size, NONE, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = rank_of(sym[inner], sym[inner + 1])
    while sym.size:
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(head, sym.size))
        low = np.minimum.reduceat(rank, head)
        done = low == NONE
        if done.any():
            out[word[head[done]]] = count[done]
            keep = np.repeat(~done, count)
            word, sym, rank = word[keep], sym[keep], rank[keep]
            low, count = low[~done], count[~done]
            if not sym.size:
                break
        hit = rank == np.repeat(low, count)
        at = np.flatnonzero(hit)
        # overlapping occurrences stand side by side: take every other one, from the left
        lead = np.append(True, np.diff(at) != 1)
        nth = np.arange(at.size) - np.maximum.accumulate(np.where(lead, np.arange(at.size), 0))
        at = at[nth % 2 == 0]
        sym[at] = merged[rank[at]]
        keep = np.ones(sym.size, bool)
        keep[at + 1] = False
        changed = np.zeros(sym.size, bool)
        changed[at] = True
        word, sym, rank, changed = word[keep], sym[keep], rank[keep], changed[keep]
        changed[:-1] |= changed[1:]
        new = np.flatnonzero(changed)
        rank[new] = NONE
        new = new[new + 1 < sym.size]
        new = new[word[new] == word[new + 1]]
        rank[new] = rank_of(sym[new], sym[new + 1])
    return out


class TokenCounter:
    """Counts tokens of texts; remembers the counts of words it has met."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.ranks = self.vocab.rank_table()
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        w = presplit(texts, self.vocab.special)
        if not w.start.size:
            return np.zeros(len(texts), np.int64)
        distinct, sample, back = np.unique(range_hash(w.buffer, w.start, w.stop), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(self.known.size - 1, 0))
        met = self.known[place] == distinct if self.known.size else np.zeros(distinct.size, bool)
        n = np.zeros(distinct.size, np.int64)
        n[met] = self.counts[place[met]] if self.known.size else 0
        new = sample[~met]
        n[~met] = surviving_symbols(w.buffer, w.start[new], w.stop[new], self.vocab, self.ranks)
        if self.known.size + new.size > REMEMBERED_WORDS:
            self.known, self.counts = distinct, n
        else:
            known = np.concatenate([self.known, distinct[~met]])
            order = np.argsort(known)
            self.known, self.counts = known[order], np.concatenate([self.counts, n[~met]])[order]
        per_word = n[back]
        per_word[w.special] = 1
        return np.bincount(w.doc, per_word, len(texts)).astype(np.int64)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, token_column: str = "n_tokens") -> DataFrame:
    """Add ``token_column``, the number of byte-level BPE tokens of ``text``; every other column stays.

    A null or empty text has 0 tokens. Special strings in texts are one token. Repeated rows stay; an existing column of
    that name is replaced. Map-side only: no shuffle.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    rest = [c for c in df.columns if c != token_column]
    place = rest.index(text)
    schema = df.select(*[F.col(f"`{c}`") for c in rest], F.lit(0).cast("long").alias(token_column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(place).to_pylist()]
            parts = [counter.count(texts[a:b]) for a, b in chunks(texts, [len(x) for x in texts])]
            n = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*rest, token_column])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(run, schema)


#: Context length that `over_limit` compares with.
TOKEN_LIMIT = 1024


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
