"""Periodic runs of words in linear time from Lyndon arrays, after Ellert and Fischer (operator 12).

Every run (a stretch with a smallest period p, at least 2 p long, that can't be extended) holds a Lyndon word of length p
that starts inside its first p positions and is the longest Lyndon word there, in the alphabet's order or in the reverse
order. So the Lyndon arrays of both orders name all candidates (i, j): ``j`` is the next smaller suffix of ``i``. How far
the words after i and after j agree is known from the array's making; the words before them are compared once per run.

The arrays are made from left to right by comparing words alone: no suffix array or tree, no fingerprints. A comparison
takes over what earlier ones matched: inside a stretch that was found to repeat an earlier one, the comparisons made there
hold again, and from the extensions of (c, i) and (b, c) follows that of (b, i) unless they are equal. So no word is ever
found equal twice, and the work is linear in the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

MIN_LENGTH = 12
#: Words are runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_array(w: list) -> tuple[list[int], list[int], int]:
    """Next smaller suffixes of ``w``, a list of values of any order that ends in one smaller than all others; the extensions (how many
    words suffix i and its next smaller one share); and the number of words that were found equal, at most one per word.

    From left to right: suffix i meets the suffixes c that nothing smaller has followed yet, nearest first; those that are
    larger get i as their next smaller suffix, and the first smaller one ends the search.
    """
    n = len(w) - 1
    smaller, shared = [n] * (n + 1), [0] * (n + 1)
    previous, previous_shared = [-1] * (n + 1), [0] * (n + 1)
    back = until = steps = 0  # the words before ``until`` repeat those ``back`` words earlier, from the last suffix that was compared there
    for i in range(1, n):
        x, c = w[i], i - 1
        if i >= until:
            while w[c] > x:
                smaller[c] = i
                c = previous[c]
            if w[c] < x:  # also where c is -1: there is the end's value
                previous[i] = c
                continue
            e = 0
        else:
            # the same comparisons were made ``back`` words earlier; their results hold if they ended before ``until``
            m = i - back
            while smaller[c - back] == m and i + shared[c - back] < until:
                smaller[c], shared[c] = i, shared[c - back]
                c = previous[c]
            if smaller[c - back] != m and i + previous_shared[m] < until:
                previous[i], previous_shared[i] = c, previous_shared[m]
                continue
            e = until - i
        while True:
            began = e
            while w[c + e] == w[i + e]:
                e += 1
            steps += e - began
            until, back = i + e, i - c
            if w[c + e] < w[i + e]:
                previous[i], previous_shared[i] = c, e
                break
            # c and the one before it share f words: so i shares the lesser of e and f with that, if they differ
            smaller[c], shared[c] = i, e
            f, c = previous_shared[c], previous[c]
            while f > e:
                smaller[c], shared[c] = i, e
                f, c = previous_shared[c], previous[c]
            if f < e:
                previous[i], previous_shared[i] = c, f
                break
    return smaller, shared, steps


#: A word's bytes (UTF-8 has none above 0xF4) in reverse order; 0xFF, which is above them, ends a reversed word.
_REVERSED = bytes(max(0xFE - b, 0) for b in range(256))


def runs_of(words: list[bytes], least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``least`` words, by start, then period. Words are UTF-8 and not empty; they are only compared with each other."""
    n = len(words)
    if n < max(least, 2):
        return []
    found = set()
    values = np.empty(n, object)
    values[:] = words
    for own in (words, [x.translate(_REVERSED) + b"\xff" for x in words]):
        smaller, shared, _ = lyndon_array([*own, b""])
        i, j, r = np.arange(n), np.array(smaller[:n]), np.array(shared[:n])
        before = np.zeros(n, bool)
        before[1:] = values[:-1] == values[j[1:] - 1]
        # the words before i and j, at most p - 1 of them, have to give what is missing
        keep = (before | (r >= j - i)) & (r + 2 * (j - i) > least)
        until: dict[int, int] = {}  # by period: the end of the last run found, whose other Lyndon words give it again
        for i, j, r in zip(i[keep].tolist(), j[keep].tolist(), r[keep].tolist()):
            p = j - i
            if j + r == until.get(p):
                continue
            a, b = i - 1, j - 1
            stop = max(i - p, 0)
            while a >= stop and words[a] == words[b]:
                a -= 1
                b -= 1
            length = j + r - a - 1
            if length >= 2 * p and length >= least:
                found.add((a + 1, length, p))
                until[p] = j + r
    return sorted(found)


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that lie in some run after that run's first period."""
    delta = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        delta[start + period] += 1
        delta[start + length] -= 1
    return np.cumsum(delta[:n]) > 0


def with_runs(df: DataFrame, text: str = "text", least: int = MIN_LENGTH, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """Add all runs of words of each whole text, ``array<struct<start,length,period>>`` by start, then period, and the text
    without their repetitions: the words that no run holds behind its first period, joined by a space.

    Words lie between ASCII white space. Null and empty texts and texts without words have no runs and collapse to an empty
    text. Existing columns of the two names are replaced. Map-side only; a task holds one text's words at a time.
    """
    rest = [c for c in df.columns if c not in (runs, collapsed)]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("_text"))
    kind = "array<struct<start:bigint,length:bigint,period:bigint>>"
    schema = source.drop("_text").select("*", F.lit(None).cast(kind).alias(runs), F.lit(None).cast("string").alias(collapsed)).schema
    row = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, left = [], []
            for value in batch.column(len(rest)):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                own = runs_of(words, least)
                if own:
                    words = [words[k] for k in np.flatnonzero(~dropped(len(words), own))]
                found.append(own)
                left.append(b" ".join(words))
            flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(row))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), items)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], lists, pa.array(left, pa.binary()).cast(pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def _made_periodic(doc_id: str, text: str) -> Column:
    """The text of one document in ten (by its id) with words from some place on repeated: word i >= a becomes word a + (i - a) % p."""
    h = F.crc32(F.col(doc_id).cast("string"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), (F.ceil((n - a) / p)).cast("int")))
    made = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (F.regexp_count(text, F.lit(WORD)) > 0), F.array_join(made, " ")).otherwise(F.col(text))


def op12_lyndon_runs(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _made_periodic("doc_id", "text").alias("text"))
    got = with_runs(docs)
    # greatest length, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    got = got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period = -F.col("best.p")
    return got.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
