"""BPE encoding and decoding with a deterministic token automaton compiled from the merges.

The automaton reads tokens and accepts exactly the sequences that BPE yields. It begins with one state that loops on all
bytes. Each merge ``u v -> w``, in rank order, adds one gadget: the state that ``u`` leads to is copied without its
``v`` arc and ``u`` is redirected to the copy, while ``w`` becomes a label wherever ``u`` is one and leads where ``v`` led.
A pre-split word's tokens are the one path of the automaton whose labels spell the word; a table (state, label) -> state
drives the search over all words of a batch at once. Decoding writes out the labels of the arcs.

Which arcs a state kept follows from the gadgets alone: an arc ``t`` is gone after token ``a`` if a merge of some token on
``a``'s right spine with some token on ``t``'s left spine came while both were whole. Arcs enter the transition table
when a word first needs them, so the table stays as small as the text's variety.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteVocabulary, IntTable, presplit, ragged, range_hash, spelled, vocabulary
from .common import chunks, table, vocabulary_path

NEVER = np.int32(2**31 - 1)
DEAD = -2
#: Bytes of distinct words' ids that one task remembers between batches; emptied beyond it (results don't change).
REMEMBERED_BYTES = 48_000_000
#: Arcs that a process keeps in its transition table (some 24 bytes each) between batches; emptied beyond it.
TABLE_ARCS = 2_000_000


class MergeAutomaton:
    """States, targets and arcs of one vocabulary; `delta` is its transition table."""

    def __init__(self, vocab: ByteVocabulary):
        self.vocab, self.ranks = vocab, vocab.rank_table()
        n = vocab.size
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.made = np.full(n, -1, np.int32)
        m = vocab.merges
        self.left[m[:, 2]], self.right[m[:, 2]], self.made[m[:, 2]] = m[:, 0], m[:, 1], np.arange(len(m))
        self.live = np.zeros(n, bool)
        self.live[vocab.byte_id[vocab.byte_id >= 0]] = True
        open_at_merge = self._kept(m[:, 0], m[:, 1], np.arange(len(m), dtype=np.int32))
        self.target = np.zeros(n, np.int32)  # state that each label leads to
        self.states = 1
        self._compile(m.tolist(), open_at_merge.tolist())
        self.example = np.full(self.states, -1, np.int32)  # a token that leads to the state
        alive = np.flatnonzero(self.live)
        self.example[self.target[alive]] = alive
        self.example[0] = -1
        self.table = IntTable(1 << 18)
        self._labels()

    def _compile(self, merges: list, open_at_merge: list) -> None:
        target, live = self.target, self.live
        for (u, v, w), is_open in zip(merges, open_at_merge):
            if not (is_open and live[u] and live[v]):
                continue  # no path has u and v side by side at this merge: the gadget is empty
            after_v = target[v]
            target[u] = self.states
            target[w] = after_v
            live[w] = True
            self.states += 1

    def _kept(self, a: np.ndarray, t: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the arc t is still there after token a (considering merges before the given rank only)."""
        ok = np.ones(a.size, bool)
        x, x_until = a.astype(np.int64), np.full(a.size, NEVER, np.int32) if before is None else before.copy()
        act_x = np.arange(a.size)
        while act_x.size:
            y, act = t[act_x].astype(np.int64), act_x
            until = np.full(act.size, NEVER, np.int32)
            xs, xu = x[act], x_until[act]
            while act.size:
                r = self.ranks.get(xs << 32 | y, int(NEVER))
                bad = (r < xu) & (r <= until) & (r < NEVER)
                ok[act[bad]] = False
                until, y = self.made[y], self.left[y].astype(np.int64)
                go = (y >= 0) & ~bad
                act, y, until, xs, xu = act[go], y[go], until[go], xs[go], xu[go]
            made = self.made[x[act_x]]
            x_until[act_x] = np.minimum(x_until[act_x], np.where(made < 0, NEVER, made))
            x[act_x] = self.right[x[act_x]]
            act_x = act_x[(x[act_x] >= 0) & ok[act_x]]
        return ok

    def delta(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Next states; DEAD where the state has no such arc."""
        key = state.astype(np.int64) << 32 | label
        out = self.table.get(key)
        unknown = np.flatnonzero(out == -1)
        if unknown.size:
            new = np.unique(key[unknown])
            s, t = new >> 32, (new & 0xFFFFFFFF).astype(np.int32)
            kept = self.live[t].copy()
            later = np.flatnonzero(kept & (self.example[s] >= 0))
            kept[later] = self._kept(self.example[s[later]], t[later])
            self.table.put(new, np.where(kept, self.target[t], DEAD).astype(np.int32))
            out[unknown] = self.table.get(key[unknown])
        return out

    def _labels(self) -> None:
        labels = self.vocab.token_bytes
        self.label_size = np.fromiter(map(len, labels), np.int64, len(labels))
        self.label_start = np.cumsum(self.label_size) - self.label_size
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        # the labels as a trie, so that all labels at all positions are found step by step
        self.trie, self.ends = self.vocab.trie(np.flatnonzero(self.live))

    def encode_words(self, buffer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the byte ranges, one after another, and the number of each."""
        if not start.size:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = stop - start
        data = buffer[ragged(start, size)]
        word_start = np.cumsum(size) - size
        word = np.repeat(np.arange(size.size), size)
        place = np.arange(data.size) - word_start[word]
        at, length, label = spelled(self.trie, self.ends, data, size[word] - place)
        # slots: each word has one for every prefix, the empty one included
        slot = at + word[at]
        ends = place[at] + length
        order = np.argsort(ends, kind="stable")
        slot, length, label, ends = slot[order], length[order], label[order], ends[order]
        cuts = np.flatnonzero(np.append(True, ends[1:] != ends[:-1])).tolist() + [ends.size]
        state = np.full(data.size + size.size, DEAD, np.int32)
        state[word_start + np.arange(size.size)] = 0
        token = np.full(state.size, -1, np.int32)
        for a, b in zip(cuts, cuts[1:]):
            here, t = slot[a:b], label[a:b]
            from_ = state[here]
            on = np.flatnonzero(from_ >= 0)
            next_ = self.delta(from_[on], t[on])
            ok = on[next_ >= 0]
            to = here[ok] + length[a:b][ok]
            state[to] = next_[next_ >= 0]
            token[to] = t[ok]
        # walk back from the words' ends; the visited slots, in order, hold the tokens
        visited = np.zeros(state.size, bool)
        first = word_start + np.arange(size.size)
        cur = first + size
        todo = np.flatnonzero(size > 0)
        while todo.size:
            visited[cur[todo]] = True
            cur[todo] -= self.label_size[token[cur[todo]]]
            todo = todo[cur[todo] > first[todo]]
        place = np.flatnonzero(visited)
        slot_word = np.searchsorted(first, place, "right") - 1
        return token[place], np.bincount(slot_word, minlength=size.size)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the labels, one after another."""
        return self.label_bytes[ragged(self.label_start[ids], self.label_size[ids])]

    def decoded(self, packed: pa.Array) -> pa.Array:
        """Texts of packed ids; null is none."""
        parts = [np.frombuffer(x.as_buffer() or b"", "<u4") for x in packed]
        flat = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        data = self.decode(flat).tobytes()
        ends = np.append(0, np.cumsum(self.label_size[flat]))[np.cumsum([x.size for x in parts], dtype=np.int64)].tolist()
        return pa.array([data[i:j].decode("utf-8", "replace") for i, j in zip([0, *ends], ends)], pa.string())


@lru_cache(maxsize=2)
def automaton(path: str) -> MergeAutomaton:
    return MergeAutomaton(vocabulary(path))


class Encoder:
    """Encodes texts; remembers the ids of words it has met."""

    def __init__(self, path: str):
        self.auto = automaton(path)
        self.vocab = self.auto.vocab
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        w = presplit(texts, self.vocab.special)
        if not w.start.size:
            return [np.zeros(0, np.int32) for _ in texts]
        if self.known.nbytes + self.at.nbytes + self.n.nbytes + self.store.nbytes > REMEMBERED_BYTES:
            self._forget()
        if self.auto.table.used > TABLE_ARCS:
            self.auto.table = IntTable(1 << 18)
        distinct, sample, back = np.unique(range_hash(w.buffer, w.start, w.stop), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, distinct), max(self.known.size - 1, 0))
        met = self.known[place] == distinct if self.known.size else np.zeros(distinct.size, bool)
        new = sample[~met]
        ids, n = self.auto.encode_words(w.buffer, w.start[new], w.stop[new])
        known = np.concatenate([self.known, distinct[~met]])
        order = np.argsort(known)
        self.known = known[order]
        self.at = np.concatenate([self.at, self.store.size + np.cumsum(n) - n])[order]
        self.n = np.concatenate([self.n, n])[order]
        self.store = np.concatenate([self.store, ids])
        place = np.searchsorted(self.known, distinct)
        at, n = self.at[place][back], self.n[place][back]
        n[w.special] = 1
        ids = self.store[ragged(at, n)]
        if w.special.any():
            ids[(np.cumsum(n) - n)[w.special]] = self.vocab.special_id
        per_text = np.bincount(w.doc, n, len(texts)).astype(np.int64)
        return np.split(ids, np.cumsum(per_text)[:-1])


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, ids_column: str = "ids", n_column: str = "n_tokens", decoded_column: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` as packed little-endian unsigned 32-bit integers (``ids_column``) and their number.

    ``decoded_column`` adds the text that these ids decode to, by the same worker and automaton. A null or empty text has
    no ids and decodes to an empty text, an empty table has no rows. Special strings in texts become their one id. Other
    columns stay, and columns of the new names are replaced. Texts are taken whole; repeated rows stay. A word of any
    length is one path of the automaton: memory grows with a chunk's longest word and its distinct arcs. Map-side only.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    added = {ids_column: F.lit(b""), n_column: F.lit(0).cast("long")} | ({decoded_column: F.lit("")} if decoded_column else {})
    rest = [c for c in df.columns if c not in added]
    source = df.select(*[F.col(f"`{c}`") for c in rest])
    schema = source.select("*", *[v.alias(n) for n, v in added.items()]).schema
    place = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for a, b in chunks(range(batch.num_rows), pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_pylist()):
                part = batch.slice(a, b - a)
                ids = encoder.encode([x or "" for x in part.column(place).to_pylist()])
                new = [_packed(ids), pa.array(map(len, ids), pa.int64())]
                if decoded_column:
                    new.append(encoder.auto.decoded(new[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return source.mapInArrow(run, schema)


def _packed(ids: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
    ends = np.cumsum([0, *(4 * x.size for x in ids)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def decode_ids(df: DataFrame, ids: str = "ids", path: str | None = None, text_column: str = "decoded") -> DataFrame:
    """Replace packed ids by the text that their labels spell (``text_column``); null ids give an empty text.

    Byte sequences that are no UTF-8 decode to replacement characters. Other columns stay.
    """
    path = path or vocabulary_path("byte_bpe_50k.json")
    rest = [c for c in df.columns if c not in (ids, text_column)]
    schema = df.select(*[F.col(f"`{c}`") for c in rest], F.lit("").alias(text_column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            for a, b in chunks(range(batch.num_rows), pc.fill_null(pc.binary_length(batch.column(len(rest))), 0).to_pylist()):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], auto.decoded(part.column(len(rest)))], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in [*rest, ids]]).mapInArrow(run, schema)


def op7_bpe_automaton(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    encoded = encode_texts(docs.select("doc_id", "text"), decoded_column="decoded")
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
