"""Archives, chats and audio: exact round trips and scalar reference decoders."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gaugewright.llm import chat, queries, telephony, warc


@pytest.fixture(scope="module")
def sf(tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    html = ["<p>a</p>", "<p>a</p>", None, "", "x\r\n\r\ny\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é😀" * 3000, "<p>a</p>", "z\0"]
    pq.write_table(pa.table({"page_id": pa.array(range(len(html)), pa.int64()), "url": [f"http://x/{i}\r\n" if i != 3 else None for i in range(len(html))], "html": html}), d / "pages.parquet")
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}), d / "none.parquet")
    turns = [(1, 0, "system", "be brief <|end|> <\\|x"), (1, 1, "user", "hi"), (1, 2, "assistant", "a" * 9000), (1, 3, "user", None), (1, 4, "assistant", "yes\\"), (2, 0, "assistant", ""), (2, 0, None, "odd"), (None, 0, "user", "lost")]
    turns += [(3, k, "assistant" if k % 2 else "user", f"turn {k} " + "word " * 300) for k in range(40)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*turns))))), d / "conversations.parquet")
    return str(d), html, turns


def test_warc(spark, sf):
    d, html, _ = sf
    got = {r["page_id"]: r for r in queries.QUERIES["op2_warc_transactions"](spark, d).collect()}
    assert len(got) == len(html)
    import base64

    for i, x in enumerate(html):
        body = (x or "").encode()
        last = max(j for j, y in enumerate(html) if (y or "").encode() == body)
        want = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if last == i else "revisit", None if last == i else last)
        assert tuple(got[i][c] for c in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want


def test_warc_records(spark, sf, tmp_path):
    d, html, _ = sf
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{d}/pages.parquet"), path)
    rows = warc.read_transactions(spark, path).collect()
    assert all(r["request"] and r["metadata"] for r in rows)
    assert all(r["response"]["computed_digest"] == r["response"]["payload_digest"] for r in rows if r["response"]["record_type"] == "response")
    named = {r["record_id"] for r in rows if r["response"]["record_type"] == "response"}
    assert {r["response"]["refers_to"] for r in rows if r["response"]["record_type"] == "revisit"} <= named
    with pytest.raises(ValueError, match="ends after"):
        list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    warc.write_archives(spark.read.parquet(f"{d}/none.parquet"), f"{path}-none")
    assert warc.read_transactions(spark, f"{path}-none").count() == 0


def test_warc_repeated_and_null_ids(spark, tmp_path):
    rows = [(1, "u", "same", 0), (1, "u", "same", 0), (2, "u", "same", 0), (2, "u", "same", 0), (None, "v", "same", 0), (None, "v", "alone", 0), (5, None, "alone", 0)]
    spark.createDataFrame(rows, "page_id long, url string, html string, digest int").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r["page_id"], r["record_type"], r["refers_to"]) for r in queries.QUERIES["op2_warc_transactions"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(1, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (None, "revisit", 2), (None, "revisit", 5), (5, "response", None)], key=str)


def test_chat(spark, sf):
    d, _, turns = sf
    got = {r["conv_id"]: r for r in queries.QUERIES["op9_chat_windows"](spark, d).collect()}
    rows = turns + chat.CONTROL_CONVERSATION
    for conv in {t[0] for t in rows}:
        own = sorted((t for t in rows if t[0] == conv), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        if conv == 2:
            own = [own[0], own[1]]
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_windows_keep_to_the_budget(spark, sf):
    d, _, _ = sf
    rows = chat.format_windows(spark.read.parquet(f"{d}/conversations.parquet").where("conv_id = 3")).collect()
    assert len(rows) > 3 and all(r["n_tokens"] <= chat.WINDOW_TOKENS for r in rows)
    assert any(r["fresh_from"] > 0 for r in rows) and all(s["start"] >= r["fresh_from"] for r in rows for s in r["loss"])
    for x in ("<|end|>", "<\\|end|>", "<\\\\|a", "\\", "<|", "plain"):
        assert chat.unescape(chat.escape(x)) == x and "<|" not in chat.escape(x)


def scalar_adpcm(block):
    sample, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            diff = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            sample = max(-32768, min(32767, sample - diff if nibble & 8 else sample + diff))
            index = max(0, min(88, index + int(telephony.INDEX_CHANGE[nibble])))
            out.append(sample)
    return out


def test_audio_decoders():
    blocks = np.random.default_rng(2).integers(0, 256, (20, 192), np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [scalar_adpcm(bytes(b)) for b in blocks]
    mu, a = telephony.expansion(telephony.MULAW), telephony.expansion(telephony.ALAW)
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    tone = (8000 * np.sin(np.arange(400) * 0.2)).astype(np.int16)
    one, two = telephony.resample_double([tone, tone[:7]])
    assert one.size == 800 and two.size == 14 and (one[::2] == tone).all() and np.abs(one[21:780:2] - 8000 * np.sin((np.arange(10, 390) + 0.5) * 0.2)).max() < 40


def test_audio_round_trip(spark, tmp_path):
    texts = [None, "", "a", "b" * 192, "é" * 100, "x" * 400_000, "a"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_telephony"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
    assert got[2]["feature"] == got[6]["feature"] and re.match(r"\w+;rate=16000;", got[3]["feature"])
    df = telephony.with_media(spark.createDataFrame([(1, "a", "own")], "doc_id long, text string, codec string"))
    r = telephony.decode_media(df).withColumn("n", F.octet_length("pcm")).first()
    assert r["n"] > 0 and r["codec"] in ("mulaw", "alaw", "ima_adpcm")
