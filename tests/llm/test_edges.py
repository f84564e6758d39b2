"""Nulls, clashing names, repeats, very long words and many languages, operator by operator."""

import gzip
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gaugewright.llm import bpe_automaton, chat, iblt, language, mixing, simhash, token_counts, warc
from gaugewright.llm.common import vocabulary_path


def test_tokens_of_clashing_columns_repeats_and_long_words(spark):
    rng = random.Random(2)
    word = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    rows = [(1, "a b", 7, b"x"), (1, "a b", 7, b"x"), (2, None, 8, b"y"), (3, word, 9, b"z"), (4, " ".join([word[:3000]] * 3), 1, b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids binary")
    lib = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    counted = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in token_counts.count_tokens(df).collect())
    encoded = bpe_automaton.encode_texts(df, decoded_column="decoded")
    assert encoded.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    got = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in encoded.collect())
    want = []
    for i, text, _, own in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), np.array(ids, "<u4").tobytes(), text or ""))
    assert got == sorted(want) and [c[:2] for c in counted] == [w[:2] for w in sorted(want)]
    assert [r["decoded"] for r in bpe_automaton.decode_ids(encoded.where("doc_id = 2").drop("decoded")).collect()] == [""]


def test_260_languages_are_all_learned(spark):
    rng = random.Random(3)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4)] for k in range(260)}
    rows = [(k * 4 + i, f"l{k:03d}", " ".join(rng.choices(words[k], k=12)), "own", 1.5) for k in range(260) for i in range(4)]
    df = spark.createDataFrame([*rows, (-1, None, "12 34", "own", 0.0), (-2, "l000", None, "own", 0.0)], "doc_id long, lang string, text string, lang_pred string, score double").repartition(3)
    model = language.fit_language_model(df)
    assert [m[0] for m in model] == sorted({r[1] for r in rows})
    out = language.predict_language(df, model)
    assert out.columns == ["doc_id", "lang", "text", "lang_pred", "score"]
    got = {r["doc_id"]: r["lang_pred"] for r in out.collect()}
    assert {got[r[0]] == r[1] for r in rows} == {True} and got[-1] == got[-2] == "und"


def test_blocks_of_languages_score_alike(monkeypatch):
    path = vocabulary_path("byte_bpe_50k.json")
    texts = {"a": ["the cat sat on the mat"], "b": ["der Hund lief weg"], "c": ["le chat dort ici"]}
    model = []
    for name, t in texts.items():
        log_p = language.fit_pieces(t, path)
        held = np.flatnonzero(log_p > log_p.min())
        model.append((name, held.astype(np.int32), log_p[held], log_p.min()))
    sample = [*sum(texts.values(), []), "", "cat chat Hund"]
    whole = language.Scorer(model, path).predict(sample)
    monkeypatch.setattr(language, "LANGUAGE_BLOCK", 2)
    monkeypatch.setattr(language, "REMEMBERED_BYTES", 0)
    parts = language.Scorer(model, path)
    assert parts.one_block is None and parts.predict(sample) == whole and parts.predict(sample) == whole


def test_fingerprints_of_clashing_names_and_long_texts(spark):
    long = "\n".join(f"line {i}" for i in range(3000))
    df = spark.createDataFrame([(1, long, "p", 1, None), (2, None, "q", 2, None), (2, "x y\nx y", "r", 3, [5])], "doc_id long, text string, _row string, a_n int, b array<bigint>")
    df = df.withColumn("a", iblt.paragraph_digests(F.col("text")))
    out = iblt.fingerprints(df, {"p": ("a", "b")})
    got = {r["_row"]: r for r in out.collect()}
    assert {c for c in out.columns} == {"doc_id", "text", "_row", "a_sketch", "a_n", "b_sketch", "b_n", "p_plus", "p_minus"}
    assert [(got[k]["a_n"], got[k]["p_plus"], got[k]["p_minus"]) for k in "pqr"] == [(3000, 3000, 0), (0, 0, 0), (1, 1, 1)]


def test_chat_of_empty_and_null_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_windows(empty).count() == 0
    one = spark.createDataFrame([(None, None, None, None), (None, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    rows = chat.format_windows(one).collect()
    assert rows and all(r["conv_id"] is None for r in rows)


def test_pipeline_of_empty_and_clashing_tables(spark, tmp_path):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([], schema), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    extra = ("fp", "n", "root", "row", "maybe", "mix_copies", "size", "share", "lang_pred", "simhash")
    df = spark.createDataFrame([(i, f"some words for text number {i} of a few", "en", "s", 5, *["own"] * len(extra)) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, df, "")
        assert set(out.columns) >= {*df.columns} - {"lang_pred", "mix_copies"} and out.where("row = 'own' and share = 'own'").count() == out.count() > 0


def test_bitmap_never_loses_a_key(spark):
    df = spark.range(3000).withColumn("k", F.col("id") * 7919)
    keys = df.where("id % 10 = 3").select("k")
    kept = simhash.without(df, keys, "k")
    assert kept.count() == 2700 and kept.where("id % 10 = 3").count() == 0


def test_archives_of_clashing_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x", "own"), (2, None, None, "own")], "page_id long, url string, html string, digest string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    assert warc.read_transactions(spark, f"file://{tmp_path}/w").count() == 2


def test_mixing_ties(spark):
    df = spark.createDataFrame([(5, "s", "a b c", "x")] * 6 + [(None, "s", "a b c", "y")] * 2, "doc_id long, source string, text string, mix_target string")
    out = mixing.mix(df, weights=(1,), budget=0.5).collect()
    assert len(out) == 8 and len({r["mix_copies"] for r in out if r["doc_id"] == 5}) == 1


def _meets_targets(rows):
    """No document above twice its size; every source's taken words within the longest document of its target that can be left out."""
    by = {}
    for r in rows:
        assert r["mix_copies"] in (0, 1, 2)
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        taken, target = sum(r["mix_size"] * r["mix_copies"] for r in own), own[0]["mix_target"]
        assert taken <= target + 1e-6
        left = [r["mix_size"] for r in own if r["mix_copies"] < 2 and r["mix_size"]]
        assert target - taken <= max(left, default=0) + 0.001 * target + 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_mixing_random_sources_with_full_partial_and_empty_classes(spark, seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for s in range(rng.randint(3, 9)):
        for _ in range(rng.choice([1, 2, 5, 30, 120])):
            i += 1
            rows.append((i, f"s{s}" if s else None, " ".join(["w"] * rng.choice([0, 1, 3, 7, 8, 60, 200, 900]))))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    _meets_targets(mixing.mix(df).collect())


def test_mixing_of_the_documents_meets_every_target(spark):
    rows = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    _meets_targets(rows)
    assert len(rows) == 1000


def test_archive_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 40_000)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 60)
    rng = random.Random(8)
    sizes = [0, 1, 1999, 2000, 2001, 16_000, 16_001, 70_000, 300_000, *(rng.choice([10, 1500, 5000, 20_000]) for _ in range(120))]
    rows = [(i, f"http://h/{i}", f"{i} " + "".join(rng.choice("abcdef ") for _ in range(n))) for i, n in enumerate(sizes)] + [(900, None, None)]
    path = tmp_path / "w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{path}")
    held = [len(gzip.decompress(p.read_bytes())) for p in path.glob("*.gz")]
    assert len(held) > 12 and sorted(held)[-3] <= 40_000 + 60 * 800 and max(held) <= 300_000 + 4_000
    got = {r["metadata"]["fields"]["page-id"]: r["response"]["block"] for r in warc.read_transactions(spark, f"file://{path}").collect()}
    assert len(got) == len(rows) and all(bytes(got[str(i)]).endswith((html or "").encode()) for i, _, html in rows)
