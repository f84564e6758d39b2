"""Text operators against libraries and brute force, on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from test_near import kept as near_kept
from tokenizers import Tokenizer

import corpus_pipeline
from gaugewright.llm import iblt, language, lm_scoring, mixing, queries, simhash
from gaugewright.llm.common import vocabulary_path

WORDS = "the cat sat on a mat with no hat and it's we'll 12 345 naïve größe 猫 😀 <|endoftext|> x" .split()


def sentence(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  ", ", ", "\t"]) for _ in range(n))


def make_docs():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "word", "two words", "two words", "x" * 5000, "ab " * 4000]
    texts += [sentence(rng, rng.randint(1, 300)) for _ in range(60)]
    texts += [t for t in texts[10:20]] + [t + " end" for t in texts[20:30]] + [texts[30]] * 30
    ids = [i * 3 for i in range(len(texts))]
    langs, sources = [None if i % 9 == 0 else "ab"[i % 2] for i in ids], [None if i % 10 == 0 else f"s{i % 4}" for i in range(len(ids))]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": langs, "source": sources, "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    pq.write_table(make_docs(), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(0, 150, 3), pa.int64()), "quality": [1, 0] * 25, "toxic": [0] * 50}), d / "labels.parquet")
    return str(d)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    pq.write_table(make_docs().slice(0, 0), d / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int64()), "toxic": pa.array([], pa.int64())}), d / "labels.parquet")
    return str(d)


def docs():
    return {i: t or "" for i, t in zip(*make_docs().select(["doc_id", "text"]).to_pydict().values())}


@pytest.mark.parametrize("name", ["op1_ce_difference", "op3_iblt_fingerprints", "op4_pareto_mixing", "op5_token_counts", "op6_simhash", "op7_bpe_automaton", "op8_language_id", "op10_telephony"])
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_tokens(spark, sf):
    t = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    n = {r["doc_id"]: r for r in queries.QUERIES["op5_token_counts"](spark, sf).collect()}
    e = {r["doc_id"]: r for r in queries.QUERIES["op7_bpe_automaton"](spark, sf).collect()}
    for i, text in docs().items():
        ids = t.encode(text, add_special_tokens=False).ids
        assert (n[i]["n_bytes"], n[i]["n_tokens"], n[i]["over_limit"]) == (len(text.encode()), len(ids), len(ids) > 1024)
        assert e[i]["n_tokens"] == len(ids) and e[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert e[i]["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def pieces(text):
    return set(re.findall(r"[^ \t\n\x0b\f\r]+(?:[ \t]+[^ \t\n\x0b\f\r]+){0,15}", text))


def test_iblt(spark, sf):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_iblt_fingerprints"](spark, sf).collect()}
    order = sorted(docs().items(), reverse=True)
    seen = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert r["near_edited"] == pytest.approx(like(pieces(text), pieces(edited))) and r["near_next"] == pytest.approx(like(pieces(text), pieces(after)))
        assert seen.setdefault(text, r["fingerprint"]) == r["fingerprint"]


def test_iblt_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c"), (2, None)], "doc_id long, text string")
    assert iblt.edited_fingerprints(df).count() == 4


def test_iblt_retries_until_whole(spark, monkeypatch):
    monkeypatch.setattr(iblt, "RETRIES", 1)
    monkeypatch.setattr(iblt, "FAN", 2)
    a, b = "\n".join(f"line {i}" for i in range(400)), "\n".join(f"line {i}" for i in range(200, 500))
    df = spark.createDataFrame([(1, a, b)], "doc_id long, a string, b string").select("doc_id", *[iblt.paragraph_digests(F.col(c)).alias(c) for c in "ab"])
    r = iblt.fingerprints(df, {"p": ("a", "b")}).first()
    assert (r["a_n"], r["b_n"], r["p_plus"], r["p_minus"]) == (400, 300, 200, 100)
    sides = df.first()
    again = iblt.fingerprints(df, {"p": ("a", "b")}, recover=True).first()
    assert again["p_plus_digests"] == sorted({*sides["a"]} - {*sides["b"]}) and again["p_minus_digests"] == sorted({*sides["b"]} - {*sides["a"]})


def brute_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def components(prints, bits=2):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, sf):
    prints = {i: brute_simhash(t) for i, t in docs().items()}
    want = components(prints)
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_simhash"](spark, sf).collect()}
    assert {i: (f"{prints[i]:016x}", want[i]) for i in prints} == {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()}


@pytest.mark.parametrize("bucket", [0, 48])
def test_simhash_links_of_one_bit(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", bucket)
    rng = random.Random(1)
    prints = sorted({97, 96, 65, 32} | {rng.getrandbits(6) << rng.choice([0, 20]) for _ in range(40)})
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, simhash long")
    got = df.join(simhash.simhash_groups(df, bits=1), "simhash").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(dict(enumerate(prints)), 1)


@pytest.mark.parametrize("bucket", [0, 48])
def test_simhash_links(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", bucket)
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(8)]
    prints = {i: base[i % 8] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for i in range(150)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "doc_id long, simhash long")
    got = df.join(simhash.simhash_groups(df), "simhash").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == components(prints)


def test_near_dedup_keeps_columns_and_rows_whole(spark):
    df = spark.createDataFrame([(1, "a b c d", "p", 5), (1, "a b c d", "q", 5), (2, "A b c d", "r", 6), (7, "other text at all here", "s", 7), (None, None, "t", 8)], "doc_id long, text string, root string, simhash int")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns and sorted((r["doc_id"] or 0, r["simhash"]) for r in out.collect()) == [(0, 8), (1, 5), (7, 7)]


def test_mixing(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE_SQL['op4_pareto_mixing']}) q").fetchall()}
    rows = queries.QUERIES["op4_pareto_mixing"](spark, sf).collect()
    used = Counter()
    for r in rows:
        assert want[r["doc_id"]][:2] == (r["size"], r["source_size"]) and want[r["doc_id"]][3] == r["taken"] and want[r["doc_id"]][2] == pytest.approx(r["target"])
        assert r["taken"] <= 2 * r["size"]
        used[r["source_size"], r["target"]] += r["taken"]
    left = {k: k[1] - n for k, n in used.items()}
    assert all(x > -1e-6 for x in left.values())
    for r in rows:  # what is left out doesn't fit, or its source misses next to nothing
        k = r["source_size"], r["target"]
        assert r["taken"] or not r["size"] or r["size"] > left[k] or left[k] <= 0.001 * k[1]
    mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet").withColumn("target", F.lit("own")).withColumn("size", F.lit(1)).withColumn("weight", F.lit(2)).withColumn("mix_size", F.lit("old")))
    assert mixed.where("target = 'own' and size = 1 and weight = 2").count() == len(rows) and mixed.columns.count("mix_size") == 1


def test_mixing_draws_with_unequal_odds(spark):
    rows = [(i, "s" if i % 2 else "t", "w " * (2 if i % 3 else 40)) for i in range(3000)]
    rows += [(1, "s", "w " * 2)] * 2 + [(None, None, None), (None, None, "x y"), (7000, "s", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix(df, weights=(1,), budget=0.7).collect()
    assert len(out) == len(rows)
    for source in "st":
        mean = [np.mean([r["mix_copies"] for r in out if r["source"] == source and r["mix_size"] == n]) for n in (2, 40)]
        assert mean[1] > 1.5 * mean[0] > 0  # weights 2 and 6
    again = sorted((r["doc_id"] or -1, r["mix_copies"]) for r in mixing.mix(df.repartition(7), weights=(1,), budget=0.7).collect())
    assert again == sorted((r["doc_id"] or -1, r["mix_copies"]) for r in out)


def test_language(spark, sf):
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_language_id"](spark, sf).collect()}
    for i, text in docs().items():
        letters = any(c.isalpha() for c in text)
        assert (got[i]["lang_pred"] != "und") == letters and 0 <= got[i]["score"] <= 1
    real = queries.QUERIES["op8_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id")
    held = real.where("held_out and lang is not null and length(text) > 40")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()


def test_forward_sums_all_segmentations():
    path = vocabulary_path("byte_bpe_50k.json")
    vocab, _, _ = language._pieces(path)
    rng = np.random.default_rng(1)
    log_p = np.log(rng.random(vocab.size) + 0.01)
    by_bytes = {b: log_p[i] for i, b in enumerate(vocab.token_bytes) if b and i != vocab.special_id}

    def total(word):
        return 1.0 if not word else sum(math.exp(by_bytes[word[:k]]) * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in by_bytes)

    words = [b"hat", b" the", "größe".encode()]
    ends = np.cumsum([len(w) for w in words])
    lattice = language.Lattice(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends, path)
    assert lattice.word_log_likelihood(log_p[:, None])[:, 0] == pytest.approx([math.log(total(w)) for w in words])


def brute_losses(texts, target, fold):
    n = lm_scoring.ORDER
    grams = {f: {"t": Counter(), "b": Counter()} for f in (0, 1)}
    for text, is_t, f in zip(texts, target, fold):
        data = lm_scoring.LEAD + text.encode()
        for k in range(n, len(data) + 1):
            g = data[k - n : k]
            grams[f]["b"][g] += 1
            grams[f]["t"][g] += is_t
    out = {}
    for f in (0, 1):
        total_t, total_b = sum(grams[f]["t"].values()), sum(grams[f]["b"].values())
        keep = total_t / total_b if total_b else 0
        for m in "tb":
            levels = []
            for k in range(1, n + 1):
                c = Counter()
                for g, v in grams[f][m].items():
                    c[g[-k:]] += v
                x = {g: (v if m == "t" else v * keep) for g, v in c.items()}
                y = {g: (float(v > 0) if m == "t" else 1 - (1 - keep) ** v) for g, v in c.items()}
                hx, hy = Counter(), Counter()
                for g in x:
                    hx[g[:-1]] += x[g]
                    hy[g[:-1]] += y[g]
                levels.append((x, hx, hy))

            def p(g, levels=levels):
                value = 1 / 256
                for k, (x, hx, hy) in enumerate(levels, 1):
                    s = g[-k:]
                    if hx.get(s[:-1], 0) > 0:
                        value = (x.get(s, 0) + hy[s[:-1]] * value) / (hx[s[:-1]] + hy[s[:-1]])
                return value

            out[f, m] = p
    return out


def test_lm_scores(spark, monkeypatch):
    texts = ["good words here", "good words there", "bad stuff now", "", None, "good bad", "good words here", "a long one " * 300]
    rows = [(i, t, i in (0, 1, 5), "own", i, "own") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, good boolean, score string, fold int, doc string")
    a = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, df.where("good")).collect()}
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 30)
    b = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(df, df.where("good"), broadcast_grams=0).collect()}
    assert a == b and all(r["fold"] == i and r["doc"] == "own" for i, r in a.items())
    import zlib

    fold = [zlib.crc32(str(i).encode()) % 2 for i in range(len(texts))]
    models = brute_losses([t or "" for t in texts], [r[2] for r in rows], fold)
    for i, t in enumerate(texts):
        if not t:
            assert a[i]["score"] is None and b[i]["score"] is None and a[i]["n_tokens"] == b[i]["n_tokens"] == 0
            continue
        data = lm_scoring.LEAD + t.encode()
        loss = {m: np.mean([-math.log(models[1 - fold[i], m](data[k - lm_scoring.ORDER : k])) for k in range(lm_scoring.ORDER, len(data) + 1)]) for m in "tb"}
        for got in (a, b):
            assert got[i]["ce_target"] == pytest.approx(loss["t"], rel=1e-9) and got[i]["ce_background"] == pytest.approx(loss["b"], rel=1e-9)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, d, sf)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in docs().items() if any(c.isalpha() for c in t)}
    alone = corpus_pipeline.simhash_near_dedup(spark, kept, sf)
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert {r["doc_id"] for r in alone.collect()} == {ids[i] for i in near_kept([docs()[i] for i in ids])}
    copies = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, alone, sf).collect())
    want = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(alone).collect() if r["mix_copies"]}
    assert copies == want
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in out) == copies
    assert all(r["decoded_sha256"] == hashlib.sha256(docs()[r["doc_id"]].encode()).hexdigest() for r in out)
