"""Near-duplicates: SimHash fingerprints that share a block, with verified Hamming distance (operator 6).

``near_dedup``, the pipeline's stage, takes the operator's links as its first candidates and then every pair of texts whose
shingle sets share a block in the sense of the pigeonhole principle (one of the first fifth of their shingles); a bitmap of
each set bounds the difference of two sets by a Hamming distance, and what passes is held to exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import chunks, flagged, materialize, table, without
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 2
BLOCKS = 5
#: Buckets of up to so many distinct fingerprints are compared pair by pair, larger ones through common midpoints.
PAIRWISE_BUCKET = 48
SEED = 42
_SLICE = 200_000
#: Near copies of the pipeline share NEAR_PART of NEAR_WHOLE (0.8) of their distinct shingles of so many words, at least.
NEAR_WORDS = 5
NEAR_PART, NEAR_WHOLE = 4, 5
#: Bits of the bitmap of each shingle set, as so many longs of 64 bits.
SKETCH_LONGS = 8
#: Shingles in more than COMMON_COUNT of one text in COMMON_SAMPLE come last in the order of shingles, COMMON_MOST of them at
#: most. Any order gives the same links; this one keeps texts that only share a common passage out of each other's buckets.
COMMON_SAMPLE, COMMON_COUNT, COMMON_MOST = 16, 4, 100_000


def _shingle_digests(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one text in slices; a text of fewer words than a shingle is one shingle."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), _SLICE):
        yield np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in zip(starts[at : at + _SLICE], ends[at : at + _SLICE])]), ">i8")


def shingle_set(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Sorted distinct digests (signed) of one text's shingles."""
    found = list(_shingle_digests(text, words))
    return np.unique(np.concatenate(found).astype(np.int64)) if found else np.zeros(0, np.int64)


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of one text as a signed integer: a bit is 1 if set in over half of the shingles' XXH64."""
    ones, n = np.zeros(64, np.int64), 0
    for part in _shingle_digests(text, words):
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        n += part.size
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True)


def with_simhash(df: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, column: str = "simhash") -> DataFrame:
    """Add the fingerprint (long) of each whole text; an existing ``column`` is replaced. Map-side only.

    Null, empty and blank texts have fingerprint 0; a text of fewer words than a shingle is one shingle.
    """
    rest = [c for c in df.columns if c != column]
    source = df.select(*[F.col(f"`{c}`") for c in rest])
    schema = source.select("*", F.lit(0).cast("long").alias(column)).schema
    place = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [simhash(x.as_py(), words) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block_masks(bits: int = MAX_BITS, blocks: int = BLOCKS) -> list[int]:
    """Masks of every choice of ``blocks - bits`` blocks: two fingerprints at most ``bits`` apart agree under one at least."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(block, blocks - bits)]


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked_fingerprints(prints: DataFrame, column: str = "simhash", bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``bits`` (1 or 2) apart, whose components are those of all such links.

    ``prints`` holds distinct non-null fingerprints. Each goes to one bucket per choice of blocks. Buckets of up to
    ``PAIRWISE_BUCKET`` are joined and the pairs verified, all of them reported. In a larger bucket every fingerprint is
    sent to itself and its one-bit neighbours outside the shared blocks; two fingerprints at most 2 apart meet at a
    midpoint, all that meet there are at most 2 apart, and each is linked to the smallest: exact, and linear in the bucket.
    For 1 bit a fingerprint is linked to those of its one-bit neighbours that exist.
    """
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    masks = block_masks(bits, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col(column).bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = prints.select(F.col(column).alias("fp"), F.explode(keys).alias("x")).select("fp", "x.k", "x.key")
    crowded = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(crowded, ["k", "key"]), "simhash-buckets")
    small = shared.where(F.col("n") <= PAIRWISE_BUCKET).select("k", "key", "fp")
    left, right = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    pairs = left.join(right, (left.k == right.k) & (left.key == right.key) & (F.col("a") < F.col("b")) & (_distance("a", "b") <= bits)).select("a", "b")
    large = shared.where(F.col("n") > PAIRWISE_BUCKET)
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks])
    met = large.select("fp", F.explode(F.get(flips, F.col("k"))).alias("flip"))
    met = met.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).distinct()
    if bits == 1:
        there = large.select(F.col("fp").alias("mid")).distinct()
        return pairs.unionByName(met.where("fp < mid").join(there, "mid").select(F.col("fp").alias("a"), F.col("mid").alias("b"))).distinct()
    lowest = met.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = met.join(lowest, "mid").select(F.col("fp").alias("a"), "b").where("a != b")
    stars = stars.where(_distance("a", "b") <= bits)
    return pairs.unionByName(stars).distinct()


def simhash_groups(df: DataFrame, doc_id: str = "doc_id", column: str = "simhash", bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per distinct fingerprint of ``df``: (fingerprint, root, component_id).

    ``root`` names the component (its smallest fingerprint); ``component_id`` is the smallest document id in it, null if it
    has none. Exact copies share a fingerprint and are never compared with each other.
    """
    first = df.groupBy(F.col(column).alias("fp")).agg(F.min(doc_id).alias("first_id"))
    first = materialize(first, "simhash-distinct")
    linked = connected_components(linked_fingerprints(first.select("fp"), "fp", bits, blocks), "a", "b")
    linked = materialize(first.join(linked, F.col("fp") == F.col("node")).select("fp", "first_id", "root"), "simhash-linked")
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    grouped = linked.join(lowest, "root").select("fp", "root", "component_id")
    alone = first.join(linked, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first_id").alias("component_id"))
    return alone.unionByName(grouped).withColumnRenamed("fp", column)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialize(with_simhash(docs).drop("text"), "simhash")
    groups = simhash_groups(prints)
    return prints.join(groups, "simhash").select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def _map_sets(df: DataFrame, text: str, added: dict[str, str], build) -> DataFrame:
    """Replace the text by the columns that ``build`` makes of a list of shingle sets. Map-side only."""
    rest = [c for c in df.columns if c != text]
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`"))
    schema = source.select(*[F.col(f"`{c}`") for c in rest], *[F.lit(None).cast(t).alias(n) for n, t in added.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(range(batch.num_rows), pc.fill_null(pc.utf8_length(batch.column(len(rest))), 0).to_pylist()):
                part = batch.slice(a, b - a)
                sets = [shingle_set(x.as_py()) for x in part.column(len(rest))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], *build(sets)], names=schema.names)

    return source.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(x.size for x in arrays)]), pa.int32()), pa.array(np.concatenate(arrays)))


def _fp(x: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(x.tobytes(), SEED), "big", signed=True)


def _set_simhash(x: np.ndarray) -> int:
    ones = np.unpackbits(x.astype(">i8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > x.size).tobytes(), "big", signed=True)


def _sketch(x: np.ndarray) -> np.ndarray:
    """Bitmap of a set: a bit is 1 if an odd number of the digests fall on it. Sets that differ in d digests differ in d bits at most."""
    bits = np.bincount(x & (64 * SKETCH_LONGS - 1), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def with_shingles(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by ``shingles``, the sorted distinct digests of its shingles."""
    return _map_sets(df, text, {"shingles": "array<bigint>"}, lambda sets: [_lists(sets)])


def with_prefixes(df: DataFrame, text: str, common: np.ndarray) -> DataFrame:
    """Replace the text by ``fp`` (digest of its shingle set), ``n`` (size of the set), ``simhash``, ``sketch`` and ``prefix``.

    The prefix holds the first ``n - ceil(n * part / whole) + 1`` shingles in one order for all sets, the ``common`` ones
    (sorted) last: two sets with NEAR_PART of NEAR_WHOLE shingles in common share one of their prefixes' shingles.
    """

    def prefix(x: np.ndarray) -> np.ndarray:
        if not x.size:
            return x
        late = common[np.minimum(np.searchsorted(common, x), common.size - 1)] == x if common.size else np.zeros(x.size, bool)
        return np.concatenate([x[~late], x[late]])[: x.size + 1 - -(-x.size * NEAR_PART // NEAR_WHOLE)]

    def build(sets: list[np.ndarray]) -> list[pa.Array]:
        return [
            pa.array([_fp(x) for x in sets], pa.int64()), pa.array([x.size for x in sets], pa.int32()), pa.array([_set_simhash(x) for x in sets], pa.int64()),
            _lists([_sketch(x) for x in sets]), _lists([prefix(x) for x in sets]),
        ]

    return _map_sets(df, text, {"fp": "bigint", "n": "int", "simhash": "bigint", "sketch": "array<bigint>", "prefix": "array<bigint>"}, build)


def common_shingles(df: DataFrame, text: str) -> np.ndarray:
    """Sorted frequent shingles of a sample of the texts; at most COMMON_MOST reach the driver."""
    sample = df.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(COMMON_SAMPLE)) == 0).select(F.col(f"`{text}`").alias("text")).distinct()
    found = with_shingles(sample).select(F.explode("shingles").alias("shingle")).groupBy("shingle").count()
    found = found.where(F.col("count") > COMMON_COUNT).orderBy(F.desc("count"), "shingle").limit(COMMON_MOST)
    return np.sort(np.array(found.select("shingle").toPandas()["shingle"], np.int64))


def _apart(a: str, b: str) -> Column:
    """Hamming distance of two bitmaps."""
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_LONGS)), F.lit(0))


def _few_differ(a: str, b: str) -> Column:
    """Whether the bitmaps allow two sets to be near: sets with Jaccard similarity p / w differ in (w - p) / (w + p) of their sizes' sum."""
    return _apart(a, b) * (NEAR_PART + NEAR_WHOLE) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (NEAR_WHOLE - NEAR_PART)


def _may_be_near(a: str, b: str) -> Column:
    """Whether two sets that share no earlier shingle than this one can still have enough in common."""
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.place"), F.col(f"{b}.n") - F.col(f"{b}.place"))
    return most * (NEAR_PART + NEAR_WHOLE) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * NEAR_PART


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are near, by their whole texts; ``texts`` has a row (fp, text) for each distinct set."""
    ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "near-ends")
    few = flagged(texts, ends, "fp").where("maybe").drop("maybe").join(ends, "fp")
    few = materialize(few, "near-texts", compression="zstd")
    both = pairs.join(few.select(F.col("fp").alias("a"), F.col("text").alias("x")), "a").join(few.select(F.col("fp").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = shingle_set(x.as_py()), shingle_set(y.as_py())
                both = np.intersect1d(x, y, assume_unique=True).size
                keep.append(both * (NEAR_PART + NEAR_WHOLE) >= (x.size + y.size) * NEAR_PART)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far; a node that ``roots`` lacks is its own."""
    for end in "ab":
        at = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        pairs = pairs.join(at, end, "left")
    return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _simhash_pairs(sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of operator 6: sets whose SimHash fingerprints are equal or at most MAX_BITS apart."""
    first = materialize(sets.groupBy("simhash").agg(F.min("fp").alias("first")), "near-simhash")
    same = sets.select("fp", "simhash").join(first, "simhash").where("fp != first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    links = linked_fingerprints(first.select("simhash"))
    for end in "ab":
        links = links.join(first.select(F.col("simhash").alias(end), F.col("first").alias(f"{end}_fp")), end)
    return same.unionByName(links.select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")))


def near_groups(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of the components of all pairs of distinct sets with Jaccard similarity 0.8 or more. Exact.

    ``sets`` has (fp, n, simhash, sketch, prefix) and ``texts`` (fp, text), a row for each distinct set. Candidates are
    operator 6's links and the sets that meet where their prefixes share a shingle; all of such a bucket are first compared
    with its smallest. Each set's most alike candidate is verified first, then only pairs of different components so far:
    a large group of near copies costs about its size and not its square.
    """
    bucket, member = W.partitionBy("shingle").orderBy("fp"), F.struct("fp", "n", "place")
    keyed = sets.select("fp", "n", F.posexplode("prefix").alias("place", "shingle"))
    first = F.first(member).over(bucket.rowsBetween(W.unboundedPreceding, W.currentRow))
    shared = keyed.select("shingle", member.alias("b"), first.alias("a"), F.lead("fp").over(bucket).alias("next"))
    shared = shared.where(F.col("next").isNotNull() | (F.col("a.fp") != F.col("b.fp")))
    star = F.when((F.col("a.fp") != F.col("b.fp")) & _may_be_near("a", "b"), F.col("a.fp"))
    shared = materialize(shared.select("shingle", "b.fp", "b.n", "b.place", star.alias("first")), "near-buckets", compression="zstd")
    pairs = shared.where("first is not null").select(F.col("first").alias("a"), F.col("fp").alias("b")).unionByName(_simhash_pairs(sets)).distinct()
    known = F.struct("n", "sketch")
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("fp").alias(end), known.alias(f"{end}_set")), end)
    pairs = materialize(pairs.where(_few_differ("a_set", "b_set")).select("a", "b", _apart("a_set", "b_set").alias("apart")), "near-pairs")
    best = pairs.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b")
    links = materialize(_near(best, texts), "near-links")
    roots = materialize(connected_components(links, "a", "b"), "near-roots")
    rest = materialize(_roots(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), roots), "near-pairs")
    links = links.unionByName(materialize(_near(rest, texts), "near-links"))
    roots = materialize(connected_components(links, "a", "b"), "near-roots")
    members = shared.withColumnRenamed("fp", "node").join(roots, "node", "left").select("shingle", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    members = materialize(members, "near-members", compression="zstd")
    mixed = members.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("shingle")
    held = members.join(mixed, "shingle", "left_semi").join(sets.select(F.col("fp").alias("node"), "sketch"), "node")
    side = [held.select("shingle", F.col("root").alias(f"{s}_root"), F.struct(F.col("node").alias("fp"), "n", "place", "sketch").alias(s)) for s in "ab"]
    more = side[0].join(side[1], "shingle").where((F.col("a_root") != F.col("b_root")) & (F.col("a.fp") < F.col("b.fp")) & _may_be_near("a", "b") & _few_differ("a", "b"))
    more = more.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return connected_components(links.unionByName(_near(materialize(more, "near-pairs"), texts)), "a", "b")


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Keep one row of each group of near copies: one with its smallest document id (rows without an id only where none has one).

    Near copies are texts whose distinct 5-word shingles have Jaccard similarity 0.8 or more, and a group is a component
    of such pairs; texts with the same shingles are never compared, and texts without words are one group. Columns stay as
    they are, whatever their names. Rows are written once; only texts that may have a near copy, and rows that may have to
    go, are shuffled.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    marked = with_prefixes(rows, "text", common_shingles(df, text)).withColumn("row", F.monotonically_increasing_id())
    marked = materialize(marked, "near-rows", compression="zstd")
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col("row").alias("row"))
    first = materialize(marked.groupBy("fp").agg(F.min(place).alias("first")), "near-first")
    copies = materialize(marked.select("row").join(first.select("first.row"), "row", "left_anti"), "near-copies")
    sets = without(marked.select("row", "fp", "n", "simhash", "sketch", "prefix"), copies, "row").drop("row")
    texts = without(marked.select("row", "fp", F.col("doc").getField(text).alias("text")), copies, "row").drop("row")
    groups = materialize(near_groups(sets, texts), "near-groups").withColumnRenamed("node", "fp")
    low = groups.join(first, "fp").groupBy("root").agg(F.min("first").alias("low"))
    gone = groups.join(low, "root").join(first, "fp").where("first.row != low.row").select("first.row")
    return without(marked.select("row", "doc"), materialize(copies.unionByName(gone), "near-gone"), "row").select("doc.*")
