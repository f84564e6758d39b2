"""Runs of words against brute force; the linear bound on awkward texts; the query against a plain computation."""

import random
import re
import zlib
from hashlib import sha256
from itertools import chain

import pytest
from pyspark.sql import functions as F

from gaugewright.llm import queries, runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    n, found = len(words), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(least, 2 * p) and not any(all(words[k] == words[k + q] for k in range(start, start + length - q)) for q in range(1, p)):
                found.append((start, length, p))
            i += i == start
    return sorted(found)


def test_all_runs_of_random_texts():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.choice(["a", "b", "ab", "é", "\x00", "a\x00"][: rng.choice([1, 2, 3, 6])]) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.5 and len(w) > 4:
            w = w[: len(w) // 3] + w[: rng.randint(1, 6)] * rng.randint(2, 6) + w[len(w) // 3 :]
        w *= rng.choice([1, 1, 2])
        for least in (2, 12):
            assert runs.runs_of([x.encode() for x in w], least) == brute(w, least)


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def _nested(n):
    s, k = [0], 1
    while len(s) < n:
        s, k = [*s, *s, k], k + 1
    return s[:n]


def test_no_word_is_matched_twice():
    n = 30_000
    texts = [[0] * n, [0, 1] * (n // 2), _fibonacci(n), _fibonacci(n)[::-1], [i.bit_count() & 1 for i in range(n)], [(i & -i).bit_length() for i in range(1, n)], _nested(n), list(chain.from_iterable([0] * k + [1] for k in range(240)))]
    for text in texts:
        for numbers in (text, [max(text) - x for x in text]):
            smaller, shared, steps = runs.lyndon_array([*numbers, -1])
            assert steps <= n
            for i in random.Random(2).sample(range(len(numbers)), 50):
                j, e = smaller[i], shared[i]
                end = [*numbers, -1]
                assert end[i : i + e] == end[j : j + e] and (i + e >= len(numbers) or end[i + e] > end[j + e])


def plain(doc_id, text):
    """The query's row for one document."""
    w = WORDS.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = brute(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    texts = "".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *head, *(sha256(t.encode()).hexdigest() for t in texts))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "x", "a b c d " * 9, " x y " * 20, "w " * 4000, "  lead\x0btail\x0c \r\n" * 7]
    rows = []
    for i in range(400):
        text = texts[i] if i < len(texts) else " ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 3, 30, 200])))
        rows.append((i, text, "own"))
    rows += rows[:20]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op12_lyndon_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain(i, t) for i, t, _ in rows), key=repr)


def test_some_documents_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_lyndon_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        if len((r["text"] or "").split()) < 120:
            assert got[r["doc_id"]] == plain(r["doc_id"], r["text"])


@pytest.mark.parametrize("rows", [[], [(1, "a " * 30, 5), (1, "a " * 30, 5), (None, None, 6)]])
def test_names_ties_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows, "runs long, `the text` string, collapsed int")
    out = runs.with_runs(df, "the text", runs="collapsed", collapsed="left").collect()
    assert [tuple(r)[:2] for r in out] == [r[:2] for r in rows]
    assert [([tuple(x) for x in r["collapsed"]], r["left"]) for r in out] == [([(0, 30, 1)], "a") if r[1] else ([], "") for r in rows]
