"""Telephony audio columns: WAV containers of mu-law, A-law and IMA ADPCM, expanded and resampled to 16-bit PCM.

Mu-law and A-law codes are expanded by lookup tables; ADPCM is decoded nibble by nibble for all blocks of a batch at once;
resampling doubles the rate with an integer half-band filter, all clips of a batch in one array with silence between.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, table

ALAW, MULAW, IMA_ADPCM = 6, 7, 0x11
NAMES = {ALAW: "alaw", MULAW: "mulaw", IMA_ADPCM: "ima_adpcm"}
RATE = 8000
#: Bytes of an ADPCM block: a 4-byte header with the first sample, then two samples a byte.
BLOCK = 192
#: Taps of the half-band filter on each side of a new sample.
HALF_TAPS = 4
_CHUNK_BYTES = 1_500_000

# Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


@lru_cache(maxsize=2)
def expansion(codec: int) -> np.ndarray:
    """16-bit sample of each 8-bit code, by the rules of G.711."""
    code = np.arange(256)
    if codec == MULAW:
        c = ~code & 0xFF
        size = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
        return np.where(c & 128, -size, size).astype(np.int16)
    c = code ^ 0x55
    exponent, size = c >> 4 & 7, ((c & 15) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent - 1, 0), size)
    return np.where(c & 128, size, -size).astype(np.int16)


@lru_cache(maxsize=1)
def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample and next index, by index * 16 + nibble."""
    index, nibble = np.divmod(np.arange(89 * 16), 16)
    step = STEPS[index]
    change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
    return np.where(nibble & 8, -change, change).astype(np.int32), np.clip(index + INDEX_CHANGE[nibble], 0, 88).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, bytes) -> (blocks, 2 * bytes - 7) samples; a header's index over 88 counts as 88."""
    change, next_index = _adpcm_tables()
    n, width = blocks.shape
    out = np.empty((2 * width - 7, n), np.int16)
    sample = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = sample
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for shift in (0, 4):
            key = index * 16 + (data[k] >> shift & 15)
            sample = np.clip(sample + change[key], -32768, 32767)
            index = next_index[key]
            out[2 * k + 1 + (shift > 0)] = sample
    return out.T


@lru_cache(maxsize=1)
def half_band() -> np.ndarray:
    """Windowed-sinc weights of the new sample half-way between two old ones, as parts of 32768."""
    t = np.arange(-HALF_TAPS, HALF_TAPS) + 0.5
    h = np.sinc(t) * np.cos(np.pi * t / (2 * HALF_TAPS)) ** 2
    return np.rint(h / h.sum() * 32768).astype(np.int32)


def resample_double(clips: list[np.ndarray]) -> list[np.ndarray]:
    """Clips at twice their rate; silence is assumed around a clip."""
    sizes = [c.size for c in clips]
    gap = np.zeros(HALF_TAPS, np.int16)
    flat = np.concatenate([x for c in clips for x in (c, gap)] or [gap])
    padded = np.concatenate([gap, flat, gap]).astype(np.int32)
    mid = np.full(flat.size, 1 << 14, np.int32)
    for k, w in enumerate(half_band().tolist()):
        mid += padded[k + 1 : k + 1 + flat.size] * np.int32(w)
    both = np.empty(2 * flat.size, np.int16)
    both[0::2], both[1::2] = flat, np.clip(mid >> 15, -32768, 32767)
    starts = np.cumsum([0, *(s + HALF_TAPS for s in sizes)])[: len(sizes)].tolist()
    return [both[2 * a : 2 * (a + s)] for a, s in zip(starts, sizes)]


def wav(payload: bytes, codec: int, rate: int = RATE) -> bytes:
    """A mono WAV file that holds the payload's bytes as the codec's codes."""
    if codec == IMA_ADPCM:
        align, bits, extra, samples = BLOCK, 4, struct.pack("<HH", 2, 2 * BLOCK - 7), len(payload) // BLOCK * (2 * BLOCK - 7)
        second = rate * BLOCK // (2 * BLOCK - 7)
    else:
        align, bits, extra, samples, second = 1, 8, struct.pack("<H", 0), len(payload), rate
    fmt = struct.pack("<HHIIHH", codec, 1, rate, second, align, bits) + extra
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block bytes, payload) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate, align = 12, 0, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return codec, rate, align, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(parts: list[tuple[int, int, int, bytes]]) -> list[np.ndarray]:
    """16-bit samples of each parsed clip; all ADPCM blocks of one size are decoded together. A broken last block is left out."""
    out: list[np.ndarray | None] = [None] * len(parts)
    by_align: dict[int, list[int]] = {}
    for i, (codec, _, align, payload) in enumerate(parts):
        if codec in (ALAW, MULAW):
            out[i] = expansion(codec)[np.frombuffer(payload, np.uint8)]
        elif codec == IMA_ADPCM and align > 4:
            by_align.setdefault(align, []).append(i)
        else:
            raise ValueError(f"unknown codec {codec}")
    for align, members in by_align.items():
        arrays = [np.frombuffer(parts[i][3], np.uint8) for i in members]
        arrays = [a[: a.size // align * align].reshape(-1, align) for a in arrays]
        decoded = decode_adpcm(np.concatenate(arrays))
        ends = np.cumsum([len(a) for a in arrays])
        for i, samples in zip(members, np.split(decoded, ends[:-1])):
            out[i] = samples.reshape(-1)
    return out


def with_media(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``media``: each whole text's UTF-8 bytes, blanks appended up to a positive multiple of BLOCK, as a WAV file.

    The checksum of the payload picks the codec, so equal texts have equal media. A null text is empty. Other columns but
    the text stay; columns of the new names are replaced.
    """
    rest = [c for c in df.columns if c not in ("n_bytes", "media", text)]
    schema = df.select(*[F.col(f"`{c}`") for c in rest], F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(rest)).cast(pa.binary())
            for a, b in chunks(range(batch.num_rows), pc.fill_null(pc.binary_length(column), 0).to_pylist(), 8 * _CHUNK_BYTES):
                sizes, media = [], []
                for x in column.slice(a, b - a):
                    raw = x.as_py() or b""
                    sizes.append(len(raw))
                    payload = raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK)
                    media.append(wav(payload, (MULAW, ALAW, IMA_ADPCM)[zlib.crc32(payload) % 3]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in [*rest, text]]).mapInArrow(run, schema)


def pcm_feature(codec: str, rate: int, pcm: bytes) -> str:
    """Feature of resampled 16-bit samples; every second one, from the first, is a sample of the expanded clip."""
    clip = np.frombuffer(pcm, "<i2")[::2]
    wide = clip.astype(np.int64)
    rms = int(np.sqrt((wide * wide).sum() / max(1, wide.size)) * 1000) / 1000
    crossings = int(np.count_nonzero((clip[1:] < 0) != (clip[:-1] < 0)))
    return f"{codec};rate={rate};samples={clip.size};rms={rms:.3f};peak={int(np.abs(wide).max(initial=0))};zc={crossings};pcm={zlib.crc32(pcm):08x}"


def decode_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Decode a WAV column: payload digests and sizes, codec, features and the resampled 16-bit samples.

    Columns added: payload_bytes, payload_sha256, tail_crc32 (last 16 bytes), codec, feature, and rate (twice the stored
    one) with pcm (little-endian 16-bit at that rate). Null media give nulls, an empty table gives none. The feature lists
    codec, samples, root mean square, peak and zero crossings of the expanded clip and the checksum of the resampled one.
    Repeated rows stay, as do other columns but the media; columns of the new names are replaced. Map-side only.
    """
    added = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "codec": "string", "feature": "string", "rate": "long", "pcm": "binary"}
    rest = [c for c in df.columns if c not in added and c != media]
    schema = df.select(*[F.col(f"`{c}`") for c in rest], *[F.lit(None).cast(t).alias(n) for n, t in added.items()]).schema
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def features(blobs: list[bytes]) -> list[dict]:
        parts = [unwav(x) for x in blobs]
        clips = expand(parts)
        out = []
        for (codec, rate, _, payload), doubled in zip(parts, resample_double(clips)):
            pcm = doubled.astype("<i2").tobytes()
            text = pcm_feature(NAMES[codec], 2 * rate, pcm)
            sha256, tail = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])
            out.append({"payload_bytes": len(payload), "payload_sha256": sha256, "tail_crc32": tail, "codec": NAMES[codec], "feature": text, "rate": 2 * rate, "pcm": pcm})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(len(rest))
            for a, b in chunks(range(batch.num_rows), pc.fill_null(pc.binary_length(blobs), 0).to_pylist(), _CHUNK_BYTES):
                held = [x.as_py() for x in blobs.slice(a, b - a)]
                got = iter(features([x for x in held if x is not None]))
                rows = [next(got) if x is not None else {} for x in held]
                new = [pa.array([r.get(n) for r in rows], types[t]) for n, t in added.items()]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(rest)], *new], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in [*rest, media]]).mapInArrow(run, schema)


def op10_telephony(spark, sf_dir: str) -> DataFrame:
    """The clips' 8-bit form is written and read back; the resampled PCM is a column of the result, stored wherever that is written."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = materialize(with_media(docs), "telephony", compression="zstd")
    stored = stored.withColumn("media_bytes", F.octet_length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    return decode_media(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rate", "pcm")
