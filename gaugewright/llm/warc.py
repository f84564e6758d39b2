"""WARC archives: writing captures, reading records back, and assembling transactions.

Each capture is a request, a response (or a revisit, which names the response of the equal payload in WARC-Refers-To) and
a metadata record; request and metadata name the response in WARC-Concurrent-To. Archives are written by Spark's text sink,
one record a row and the record terminator as line separator, and read once through its binary source, so any file system
that Spark knows will do. Each written file is one gzip stream of bounded size: captures are written by classes of their
payload's size, large ones with fewer records a file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, table

END = "\r\n"
CAPTURE_DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 0
#: Bytes of payloads that one file holds at most (a larger payload has a file for itself), and records of a file.
FILE_BYTES, RECORDS_PER_FILE = 64_000_000, 6_000
#: Records of one capture, of which one holds the payload; and the ratio of sizes inside a class.
CAPTURE_RECORDS, SIZE_CLASS = 3, 8
#: Repeated payloads whose digests may be broadcast while archives are written; with more of them the join shuffles.
BROADCAST_DIGESTS = 50_000
_BATCH_BYTES = 8_000_000

RECORD_SCHEMA = (
    "record_type string, record_id string, concurrent_to string, target_uri string, date string, content_type string, "
    "payload_digest string, payload_bytes long, computed_digest string, refers_to string, fields map<string,string>, block binary"
)


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: 20 bits at a time, as digits to base 32."""
    digest = F.sha1(text)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    parts = [F.lit(f"WARC/1.1{END}WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit(f"{END}WARC-Date: {CAPTURE_DATE}{END}")]
    for name, value in headers:
        parts.append(F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit(END))))
    parts += [F.lit(f"Content-Type: {content_type}{END}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END * 2), block]
    return F.concat(*parts)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write one capture per row of ``pages`` to gzip archives under ``path``.

    The payload is ``html`` in UTF-8, empty where null. Of equal payloads of at least ``min_revisit_bytes`` bytes that with
    the largest page id is the response and the others revisit it; rows that repeat that id with that payload are
    responses too, and payloads that only rows without an id have are all responses. A null URL is empty and line breaks
    in it are percent-encoded. Only digests are aggregated; payloads are not shuffled unless very many repeat.
    """
    rows = pages.select(F.col(page_id).alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload")), "size": F.octet_length("payload"), "capture": F.expr("uuid()")})
    rows = materialize(rows, "warc-captures", compression="zstd")  # identifiers are drawn once
    repeats = rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.max("page").alias("keeper"), F.max_by("capture", "page").alias("kept"), F.count("*").alias("n"))
    repeats = materialize(repeats.where("n > 1").select("digest", "keeper", "kept"), "warc-repeats")
    small = repeats.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(repeats) if small else repeats, "digest", "left")
    revisit = F.coalesce(F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper")), F.lit(False)) & (F.col("size") >= min_revisit_bytes)
    rows = rows.withColumn("revisit", revisit)
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = F.concat(F.lit("<urn:uuid:"), F.col("capture"), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END * 2))

    def side(name: str) -> list[tuple[str, Column]]:
        return [("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("capture"), F.lit(f"#{name}>"))), ("WARC-Concurrent-To", own), ("WARC-Target-URI", uri)]

    response = _record(
        F.when(F.col("revisit"), "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", own),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:uuid:"), F.col("kept"), F.lit(">")))),
            ("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ],
        "application/http;msgtype=response",
        F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("payload"))),
    )
    request = _record("request", side("request"), "application/http;msgtype=request", F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{END * 2}")))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("page").cast("string"), F.lit(END)), F.lit(""))
    metadata = _record("metadata", side("metadata"), "application/warc-fields", about)
    # the first class has payloads of which a full file's records stay within its bytes, each further one SIZE_CLASS times those
    smallest = FILE_BYTES * CAPTURE_RECORDS // RECORDS_PER_FILE
    held = rows.select(_size_class(F.col("size"), smallest).alias("c")).distinct().collect()  # a class per power of SIZE_CLASS
    for i, c in enumerate(sorted(r["c"] for r in held) or [0]):
        most = max(CAPTURE_RECORDS, RECORDS_PER_FILE // SIZE_CLASS**c // CAPTURE_RECORDS * CAPTURE_RECORDS)
        part = rows.where(_size_class(F.col("size"), smallest) == c).select(F.explode(F.array(request, response, metadata)).alias("value"))
        part.write.mode("append" if i else "errorifexists").option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _size_class(size: Column, smallest: int) -> Column:
    """0 for sizes up to ``smallest``, 1 up to SIZE_CLASS times that, and so on."""
    out = F.lit(0)
    for _ in range(12):
        out = out + (size > smallest).cast("int")
        smallest *= SIZE_CLASS
    return out


def _headers(stream: io.BufferedIOBase) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def parse_archive(data: bytes, types: set[str] | None = None) -> Iterator[dict]:
    """Records of one archive (gzip members or plain) in file order, by Content-Length; a broken tail ends it with an error."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if data[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = _headers(stream)
        size = int(head.get("content-length", 0))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError(f"record {head.get('warc-record-id')} ends after {len(block)} of {size} bytes")
        kind = head.get("warc-type")
        if types is not None and kind not in types:
            continue
        digest = head.get("warc-payload-digest")
        digest = digest.removeprefix("sha1:") if digest else None
        n, computed, fields = None, None, {}
        if head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            n = len(payload)
            if kind == "revisit":
                n = next((int(m) for m in re.findall(rb"(?i)\ncontent-length: *(\d+)", http)), n)
            elif kind == "response":
                computed = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            fields = {"start-line": http.split(b"\r\n", 1)[0].decode("utf-8", "replace")}
        elif head.get("content-type") == "application/warc-fields":
            fields = _headers(io.BytesIO(block))
        yield {
            "record_type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
            "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "content_type": head.get("content-type"),
            "payload_digest": digest, "payload_bytes": n, "computed_digest": computed, "refers_to": head.get("warc-refers-to"), "fields": list(fields.items()), "block": block,
        }


def read_archives(spark: SparkSession, path: str, types: list[str] | None = None, blocks: bool = True) -> DataFrame:
    """Records of all archives under ``path`` (RECORD_SCHEMA): those of the given types, with their blocks or without."""
    text = ("record_type", "record_id", "concurrent_to", "target_uri", "date", "content_type", "payload_digest")
    schema = pa.schema([
        *((n, pa.string()) for n in text), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("refers_to", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()),
    ])
    wanted = set(types) if types else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse_archive(content.as_py(), wanted):
                    held += len(r["block"])
                    rows.append(r if blocks else r | {"block": None})
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per response or revisit record: (record_id, request, response, metadata), the partners nested or null.

    Partners are the request and metadata records whose WARC-Concurrent-To names the response; records join it under that
    identifier in one shuffle. Of several records of one kind, or of one identifier, that with the smallest identifier (or
    an arbitrary equal one) stays. Records that name no response of the input give no row; null identifiers join nothing.
    """
    capture = F.coalesce("concurrent_to", "record_id")
    member = F.struct(*records.columns)

    def one(*kinds: str) -> Column:
        return F.min_by(member, F.when(F.col("record_type").isin(*kinds), F.col("record_id")))

    got = records.where(capture.isNotNull()).groupBy(capture.alias("record_id")).agg(*[one(*k).alias(n) for n, k in (("request", ("request",)), ("response", ("response", "revisit")), ("metadata", ("metadata",)))])
    return got.where("response is not null")


def read_transactions(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The archives' captures, one nested row each; archives are read once."""
    return assemble(read_archives(spark, path, blocks=blocks))


def resolve_revisits(captures: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``original``: a struct of ``keys`` of the capture that a row's ``refers_to`` names, null where it names none.

    ``captures`` has columns record_id, refers_to and the keys, and is read several times: pass a written table. Only
    captures that some revisit names are joined; there is one of them for each repeated payload, however often it repeats.
    """
    named = captures.where("refers_to is not null").select(F.col("refers_to").alias("record_id")).distinct()
    named = materialize(captures.join(named, "record_id", "left_semi").select(F.col("record_id").alias("refers_to"), F.struct(*keys).alias("original")), "warc-originals")
    return captures.join(F.broadcast(named) if named.count() <= BROADCAST_DIGESTS else named, "refers_to", "left")


def op2_warc_transactions(spark, sf_dir: str) -> DataFrame:
    """The pages' captures, read back; a revisit's payload is that of the response that it refers to. Digests are computed
    from payloads read back, and one that differs from its record's header is an error."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    got = read_transactions(spark, path, blocks=False).select(
        "record_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        *[F.col(f"response.{c}").alias(c) for c in ("record_type", "payload_bytes", "payload_digest", "computed_digest", "refers_to")],
    )
    got = resolve_revisits(materialize(got, "warc-transactions"), ["page_id", "payload_bytes", "computed_digest"])
    digest = F.coalesce("computed_digest", "original.computed_digest")
    same = F.when(digest.eqNullSafe(F.col("payload_digest")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("wrong payload digest in "), "record_id")).cast("boolean"))
    return got.where(same).select("page_id", F.coalesce("original.payload_bytes", "payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", F.col("original.page_id").alias("refers_to"))


def _oracle() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"substr('{alphabet}', ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {digits} AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM q"""


ORACLE_SQL = {"op2_warc_transactions": _oracle()}
