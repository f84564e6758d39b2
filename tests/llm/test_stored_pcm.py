"""The telephony query delivers the resampled samples of every clip, decoded from the stored form, and its feature agrees with them."""

import zlib

import pyarrow as pa
import pyarrow.parquet as pq

from gaugewright.llm import queries, telephony


def test_query_delivers_every_clip(spark, tmp_path):
    texts = [None, "", "a", "b" * 192, "é" * 100, "x" * 40_000, "a"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    queries.QUERIES["op10_telephony"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    got = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r["doc_id"]: r for r in telephony.decode_media(telephony.with_media(spark.read.parquet(f"{tmp_path}/documents.parquet"))).collect()}
    pcm = {i: bytes(r["pcm"]) for i, r in got.items()}
    assert pcm == {i: bytes(r["pcm"]) for i, r in want.items()} and all(len(x) > 0 for x in pcm.values())
    for i, text in enumerate(texts):
        payload = (text or "").encode()
        media = telephony.wav(payload.ljust(max(1, -(-len(payload) // 192)) * 192), (telephony.MULAW, telephony.ALAW, telephony.IMA_ADPCM)[zlib.crc32(payload.ljust(max(1, -(-len(payload) // 192)) * 192)) % 3])
        clip = telephony.resample_double(telephony.expand([telephony.unwav(media)]))[0]
        assert pcm[i] == clip.astype("<i2").tobytes() and got[i]["rate"] == 2 * telephony.RATE
        assert got[i]["feature"].endswith(f"pcm={zlib.crc32(pcm[i]):08x}") and f"samples={len(pcm[i]) // 4};" in got[i]["feature"]
