"""Byte-level BPE vocabularies as arrays: reading, pre-splitting whole batches of texts, hashing words, integer hash tables."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
APOSTROPHE, BLANK = 0x27, 0x20
_MIX = np.uint64(0x9E3779B97F4A7C15)


class IntTable:
    """Open-addressing map from non-negative int64 keys to int32 values, probed for whole arrays at once."""

    def __init__(self, capacity: int = 1 << 16):
        bits = max(4, int(capacity * 3).bit_length())
        self.shift, self.mask, self.used = np.uint64(64 - bits), (1 << bits) - 1, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray, default: int = -1) -> np.ndarray:
        """Values of ``keys``; ``default`` where absent."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], default).astype(np.int32)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[open_]
        while open_.size:
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            rest = ~hit & (found != -1)
            open_, slot = open_[rest], slot[rest]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Insert distinct keys that are absent."""
        if (self.used + keys.size) * 2 > self.mask:
            old = self.keys >= 0
            k, v = self.keys[old], self.values[old]
            self.__init__((self.used + keys.size) * 2)
            self.put(k, v)
        self.used += keys.size
        slot, todo = self._slot(keys), np.arange(keys.size)
        while todo.size:
            free = self.keys[slot] == -1
            cand = np.flatnonzero(free)
            # several keys may want one slot: the last write wins it, the others move on
            self.keys[slot[cand]] = keys[todo[cand]]
            won = np.zeros(todo.size, bool)
            won[cand] = self.keys[slot[cand]] == keys[todo[cand]]
            self.values[slot[won]] = values[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point in the split pattern: letter, number, white space, other."""
    table = np.zeros(0x110000, np.uint8)
    # classes as the tokenizer library's own pattern engine has them: Unicode versions differ between packages
    splits = [(kind, Split(Regex(pattern), "removed", invert=True)) for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"))]
    for first in range(0, 0x110000, 0x800):
        if first == 0xD800:
            continue  # surrogates are no characters
        text = "".join(map(chr, range(first, first + 0x800)))
        for kind, split in splits:
            for _, (a, b) in split.pre_tokenize_str(text):
                table[first + a : first + b] = kind
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[c] = SPACE
    return table


class Words:
    """Pre-split tokens of a batch: byte buffer, ranges, the text of each, which are special tokens and which hold letters.

    ``doc[i]`` is the text that word i belongs to; words stand in text order.
    """

    __slots__ = ("buffer", "start", "stop", "doc", "special", "letters")

    def __init__(self, buffer, start, stop, doc, special, letters):
        self.buffer, self.start, self.stop, self.doc, self.special, self.letters = buffer, start, stop, doc, special, letters


def presplit(texts: list[str], special: str | None = None) -> Words:
    """Split texts as the pattern of byte-level BPE does (contractions, blank-led runs of letters, numbers, others; white space).

    ``special``: a string that stands for one token of its own wherever it occurs.
    """
    segments, owner, is_special = texts, None, None
    if special and any(special in t for t in texts):
        segments, owner, is_special = [], [], []
        for d, text in enumerate(texts):
            for k, part in enumerate(text.split(special)):
                if k:
                    segments.append(special), owner.append(d), is_special.append(True)
                if part:
                    segments.append(part), owner.append(d), is_special.append(False)
    joined = "".join(segments)
    buffer = np.frombuffer(joined.encode("utf-8"), np.uint8)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = cp.size
    if not n:
        none = np.zeros(0, np.int64)
        return Words(buffer, none, none, none, np.zeros(0, bool), np.zeros(0, bool))
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    seg_start = np.cumsum(lengths) - lengths
    seg_start_full = seg_start[lengths > 0]
    kind = class_table()[cp]
    first = np.zeros(n + 1, bool)
    first[seg_start_full] = True
    first[n] = True  # so that the end counts as another text's start
    space = kind == SPACE
    run = np.ones(n, bool)
    run[1:] = kind[1:] != kind[:-1]
    run |= first[:n]
    begin = np.zeros(n + 1, bool)
    after_blank = np.zeros(n, bool)
    after_blank[1:] = cp[:-1] == BLANK
    begin[:n] = run & (space | ~after_blank | first[:n])
    # the last white space before a word of the same text starts a token: alone, or as the word's leading blank
    last_space = space[:-1] & ~space[1:] & ~first[1:n]
    begin[:-2][last_space] = True
    # contractions: an apostrophe that starts a token and is followed by s t m d, or re ve ll
    at = np.flatnonzero((cp[:-1] == APOSTROPHE) & (kind[1:] == LETTER) & begin[: n - 1] & ~first[1:n])
    if at.size:
        one, two = cp[at + 1], np.zeros(at.size, np.uint32)
        inside = (at + 2 < n) & ~first[np.minimum(at + 2, n)]
        two[inside] = cp[at[inside] + 2]
        single = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        double = ((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)
        begin[at[single | double] + 1] = False
        begin[at[single] + 2] = True
        begin[at[double] + 3] = True
    if is_special is not None:
        marks = np.array(is_special)
        for s, m in zip(seg_start[marks], lengths[marks]):
            begin[s + 1 : s + m] = False
    begin[n] = False
    char_start = np.flatnonzero(begin[:n])
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    offset = np.cumsum(width, dtype=np.int64) - width
    start = offset[char_start]
    stop = np.append(start[1:], buffer.size)
    segment = np.searchsorted(seg_start_full, char_start, "right") - 1
    segment = np.flatnonzero(lengths > 0)[segment]
    letters = np.logical_or.reduceat(kind == LETTER, char_start)
    if owner is None:
        return Words(buffer, start, stop, segment, np.zeros(start.size, bool), letters)
    return Words(buffer, start, stop, np.array(owner)[segment], np.array(is_special)[segment], letters)


@lru_cache(maxsize=4)
def _multipliers(n: int) -> np.ndarray:
    """Random odd multipliers, one per place, secret to the process: no text can be made to collide with another."""
    return np.random.Generator(np.random.PCG64(_secret())).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _secret() -> int:
    return int.from_bytes(os.urandom(16), "big")


def range_hash(buffer: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, good inside this process; the ranges cover the buffer without gaps. Equal bytes, equal hash."""
    if not start.size:
        return np.zeros(0, np.uint64)
    size = stop - start
    place = np.arange(buffer.size, dtype=np.int64) - np.repeat(start, size)
    factor = _multipliers(1 << int(size.max()).bit_length())
    h = np.add.reduceat((buffer.astype(np.uint64) + np.uint64(1)) * factor[place], start)
    h ^= size.astype(np.uint64) * _MIX
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the ranges, one after another."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - size), size)


def byte_symbols() -> dict[str, int]:
    """Printable character that stands for each byte in byte-level vocabularies, as character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """Tokens and merges of a byte-level BPE file: token bytes by id, ids of single bytes, merges (left, right, merged) by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = byte_symbols()
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.token_bytes[i] = bytes(symbol[c] for c in text) if all(c in symbol for c in text) else text.encode()
        self.special = next((t["content"] for t in spec.get("added_tokens", []) if t.get("special")), None)
        self.special_id = next((t["id"] for t in spec.get("added_tokens", []) if t.get("special")), -1)
        if self.special is not None:
            self.token_bytes[self.special_id] = self.special.encode()
        self.byte_id = np.full(256, -1, np.int32)
        for c, b in symbol.items():
            if c in vocab:
                self.byte_id[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)
        self.size = size

    def trie(self, ids) -> tuple[IntTable, np.ndarray]:
        """The given tokens as a trie over bytes: (node * 256 + byte -> child, token that ends at each node or -1)."""
        child: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i in ids:
            node = 0
            for b in self.token_bytes[i]:
                key = (node, b)
                if key not in child:
                    child[key] = len(ends)
                    ends.append(-1)
                node = child[key]
            ends[node] = int(i)
        table = IntTable(len(child))
        table.put(np.fromiter((n << 8 | b for n, b in child), np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))
        return table, np.array(ends, np.int32)

    def rank_table(self) -> IntTable:
        """(left, right) -> rank."""
        t = IntTable(len(self.merges))
        t.put(self.merges[:, 0].astype(np.int64) << 32 | self.merges[:, 1], np.arange(len(self.merges), dtype=np.int32))
        return t


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteVocabulary:
    return ByteVocabulary(path)


def spelled(trie: IntTable, ends: np.ndarray, data: np.ndarray, room: np.ndarray) -> list[np.ndarray]:
    """Start, size and token of every occurrence of a trie's tokens in the bytes; room: bytes left in its word at each byte."""
    at = np.arange(data.size, dtype=np.int64)
    node = np.zeros(data.size, np.int64)
    found, depth = [], 0
    while at.size:
        node = trie.get(node << 8 | data[at + depth]).astype(np.int64)
        depth += 1
        on = node >= 0
        at, node = at[on], node[on]
        token = ends[node]
        hit = token >= 0
        found.append((at[hit], np.full(int(hit.sum()), depth, np.int64), token[hit]))
        on = room[at] > depth
        at, node = at[on], node[on]
    return [np.concatenate(x) for x in zip(*found)]
