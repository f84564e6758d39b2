"""Merkle manifests: roots of groups, the root over the groups, and a proof for every leaf (operator 13).

Leaves are put in order by a range shuffle, so a range holds consecutive leaves of one or several groups. A task combines
what it has, event by event: a partial parent gathers its children's digests by index until it has as many as the group's
size says (ARITY, fewer at the end of a level), is hashed at once and counts as a child itself. Children whose parent lies
across ranges stay unresolved; only they are shuffled, by the key of their parent, level by level. The families (all
children of a parent) found there go back along reverse links to the ranges below them, which combine their leaves once
more, write each leaf's siblings and fold a claimed digest up to the root.

The root over the groups is made by the same steps: the groups' roots, in order, are the leaves of one more group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, table

ARITY = 8
#: Leaves of a range, about: a task holds one range's digests at a time.
RANGE_LEAVES = 100_000
#: Levels over the largest table that a long can count.
MOST_LEVELS = 21
#: Leaves with their proofs that a task passes on at once.
_BATCH = 20_000


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values: each ``-`` if null, else its UTF-8 byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def parent_digest(kids: list[str]) -> str:
    return sha256("".join(kids).encode()).hexdigest()


def _sizes(n: int) -> list[int]:
    """Number of nodes of each level over ``n`` leaves, down to one."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def _combine(first: int, digests: list[str], sizes: list[int]) -> tuple[dict, list]:
    """Combine consecutive leaves from index ``first``: families {(level, parent): kids} that are whole here, and unresolved nodes (level, idx, digest); a group's root is unresolved."""
    families, unresolved = {}, []
    for level, (size, above) in enumerate(zip(sizes, sizes[1:])):
        last = first + len(digests)
        begin, end = -(-first // ARITY), above if last == size else last // ARITY
        made = []
        for parent in range(begin, end):
            kids = families[level, parent] = digests[parent * ARITY - first : (parent + 1) * ARITY - first]
            made.append(parent_digest(kids))
        alone = [*range(begin * ARITY - first), *range(end * ARITY - first, len(digests))] if made else range(len(digests))
        unresolved += [(level, first + k, digests[k]) for k in alone]
        if not made:
            return families, unresolved
        first, digests = begin, made
    return families, [*unresolved, (len(sizes) - 1, first, digests[0])]


@dataclass
class Forest:
    """Trees over a table of leaves. ``leaves`` has (pid, g, _row, order columns, digest, others), ``ranges`` one row (pid, g, first, n, held) per range and group, ``families`` the families across ranges (g, level, parent, kids), ``roots`` one row (g, n, root) per group."""

    leaves: DataFrame
    ranges: DataFrame
    families: DataFrame
    roots: DataFrame
    order: tuple[str, ...]
    digest: str


def _read(forest: Forest, heads: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Rows (pid, g, head, columns): a range's leaves in order behind one row that holds its ``head``; a task has whole ranges."""
    place = F.struct(F.col("_row").isNotNull().alias("leaf"), *[F.col(f"`{c}`") for c in forest.order], F.col(forest.digest), "_row")
    leaves = forest.leaves.select("pid", "g", place.alias("_place"), *[c.alias(name) for name, c in columns.items()])
    kinds = {f.name: f.dataType for f in leaves.schema.fields}
    first = heads.select("pid", "g", "head", F.struct(F.lit(False).alias("leaf"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kinds["_place"].fields[1:]]).alias("_place"), *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    rows = first.unionByName(leaves.withColumn("head", F.lit(None).cast(heads.schema["head"].dataType)))
    return rows.repartition("pid", "g").sortWithinPartitions("pid", "g", "_place").select("pid", "g", "head", *columns)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, dict, list[list]]]:
    """(group, head, columns of the leaves) of each range."""
    group = head = held = None
    for batch in batches:
        starts = [i for i, valid in enumerate(batch.column(2).is_valid().to_pylist()) if valid]
        for a, b in zip([0, *starts], [*starts, batch.num_rows]):
            part = [c.slice(a, b - a).to_pylist() for c in batch.columns]
            if b > a and part[2][0] is not None:
                if held and held[0]:
                    yield group, head, held
                group, head, held = part[1][0], part[2][0], [c[1:] for c in part[3:]]
            elif b > a:
                for mine, more in zip(held, part[3:]):
                    mine += more
    if held and held[0]:
        yield group, head, held


_NODE = "g string, n long, top int, level int, idx long, digest string"


def merkle_forest(leaves: DataFrame, order: tuple[str, ...], digest: str = "leaf") -> Forest:
    """Trees over the leaves of each group ``g`` (a string, not null), in the order of ``order``, then of the digest; leaves with equal digests can be exchanged.

    One shuffle of the leaves by range; what is shuffled besides are rows per range, and unresolved nodes, at most 7 per
    level at each end of a range. Each step is a written table: a lost executor costs a task.
    """
    spark = leaves.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), leaves.count() // RANGE_LEAVES + 1)
    keyed = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, "g", *order, digest, "_row")
    keyed = materialize(keyed.withColumn("pid", F.spark_partition_id()), "merkle-leaves")
    ranges = keyed.groupBy("pid", "g").agg(F.count("*").alias("held"))
    group = W.partitionBy("g")  # one row per range
    ranges = ranges.withColumn("first", F.sum("held").over(group.orderBy("pid")) - F.col("held")).withColumn("n", F.sum("held").over(group))
    ranges = materialize(ranges, "merkle-ranges")
    forest = Forest(keyed, ranges, None, None, order, digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, head, (digests,) in _ranges(batches):
            sizes = _sizes(head["n"])
            rows = [(g, head["n"], len(sizes) - 1, *node) for node in _combine(head["first"], digests, sizes)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    heads = ranges.select("pid", "g", F.struct("first", "n").alias("head"))
    schema = spark.createDataFrame([], _NODE).schema
    kinds, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.names
    nodes = materialize(_read(forest, heads, {"digest": F.col(digest)}).mapInArrow(run, _NODE), "merkle-unresolved")

    levels = len(_sizes(ranges.agg(F.max("n")).first()[0] or 1)) - 1
    families, tops, ready = [], nodes.where("level = top"), nodes.where("level = 0")
    for level in range(levels):
        parents = ready.where("level < top").groupBy("g", "n", "top", F.floor(F.col("idx") / ARITY).alias("parent")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        arity = F.least(F.lit(ARITY), F.ceil(F.col("n") / float(ARITY**level)) - F.col("parent") * ARITY)
        found = parents.where(F.size("kids") == arity).select("g", "n", "top", F.lit(level).alias("level"), "parent", F.transform("kids", lambda k: k["digest"]).alias("kids"))
        families.append(materialize(found, "merkle-families"))
        made = families[-1].select("g", "n", "top", (F.col("level") + 1).alias("level"), F.col("parent").alias("idx"), F.sha2(F.array_join("kids", ""), 256).alias("digest"))
        tops = tops.unionByName(made.where("level = top"))
        ready = nodes.where(F.col("level") == level + 1).unionByName(made)
    forest.roots = materialize(tops.select("g", "n", F.col("digest").alias("root")), "merkle-roots")
    forest.families = spark.createDataFrame([], "g string, level int, parent long, kids array<string>")
    for found in families:
        forest.families = forest.families.unionByName(found.select("g", "level", "parent", "kids"))
    return forest


def proofs(forest: Forest, claimed: Column | None = None, keep: dict[str, Column] | None = None, above: DataFrame | None = None, siblings: bool = False) -> DataFrame:
    """One row per leaf: the ``keep`` columns, g, idx, proof_sha256, folded and, if asked, ``siblings`` (a list per level).

    ``folded`` is the root recomputed from ``claimed`` (the digest itself where that is null) and the leaf's siblings.
    ``above`` has a row (g, places, lists) with the position and siblings of each group's root in the tree over the
    groups, from its leaf level up; they follow in the proof, and other text columns of it in the result. A leaf without
    siblings has the digest of an empty text.
    """
    keep = keep or {}
    ranges = forest.ranges
    below = ranges.select("pid", "g", "n", "first", (F.col("first") + F.col("held") - 1).alias("last"), F.explode(F.sequence(F.lit(0), F.lit(MOST_LEVELS))).alias("level"))
    width = F.pow(F.lit(float(ARITY)), F.col("level"))
    below = below.where(width < F.col("n")).select("pid", "g", "level", F.explode(F.array_distinct(F.transform(F.array("first", "last"), lambda i: F.floor(i / width / ARITY)))).alias("parent"))
    links = below.join(forest.families, ["g", "level", "parent"]).groupBy("pid", "g").agg(F.collect_list(F.struct("level", "parent", "kids")).alias("links"))
    heads = ranges.join(links, ["pid", "g"], "left")
    if above is None:
        heads = heads.withColumns({"places": F.lit(None).cast("array<int>"), "lists": F.lit(None).cast("array<array<string>>")})
    else:
        heads = heads.join(above, "g", "left")
    ends = [c for c in heads.columns if c not in (*ranges.columns, "links", "places", "lists")]
    heads = materialize(heads.select("pid", "g", F.struct("first", "n", "links", "places", "lists", *ends).alias("head")), "merkle-links")
    columns = {"digest": F.col(forest.digest), "claimed": (claimed if claimed is not None else F.lit(None)).cast("string"), **{f"_{k}": c for k, c in keep.items()}}
    source = _read(forest, heads, columns)
    out = source.select(*[F.col(f"_{k}").alias(k) for k in keep], *[F.lit("").alias(c) for c in ends], "g", F.lit(0).cast("long").alias("idx"), F.lit("").alias("proof_sha256"), F.lit("").alias("folded"), *([F.lit(None).cast("array<array<string>>").alias("siblings")] if siblings else []))
    kinds, names = [to_arrow_type(f.dataType) for f in out.schema.fields], out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, head, (digests, claims, *kept) in _ranges(batches):
            first, sizes = head["first"], _sizes(head["n"])
            families = _combine(first, digests, sizes)[0] | {(x["level"], x["parent"]): x["kids"] for x in head["links"] or []}
            upper = list(zip(head["places"] or [], head["lists"] or []))
            for at in range(0, len(digests), _BATCH):
                part = slice(at, at + _BATCH)
                made = [_prove(first + at + k, claim or d, len(sizes) - 1, families, upper) for k, (d, claim) in enumerate(zip(digests[part], claims[part]))]
                cols = [*[k[part] for k in kept], *[[head[c]] * len(made) for c in ends], [g] * len(made), [*range(first + at, first + at + len(made))], [sha256("".join(map("".join, m[0])).encode()).hexdigest() for m in made], [m[1] for m in made]]
                cols += [[m[0] for m in made]] if siblings else []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return source.mapInArrow(run, out.schema)


def _prove(idx: int, digest: str, top: int, families: dict, upper: list) -> tuple[list[list[str]], str]:
    """The siblings of a leaf, a list per level, and the root that ``digest`` folds to."""
    lists = []
    for level in range(top):
        idx, place = divmod(idx, ARITY)
        kids = families[level, idx]
        lists.append(kids[:place] + kids[place + 1 :])
        digest = parent_digest([*kids[:place], digest, *kids[place + 1 :]])
    for place, others in upper:
        lists.append(others)
        digest = parent_digest([*others[:place], digest, *others[place:]])
    return lists, digest


def _places(idx: str, levels: Column) -> Column:
    """Position among its siblings of a leaf's ancestors at each level."""
    each = F.sequence(F.lit(0), F.lit(MOST_LEVELS))
    return F.slice(F.transform(each, lambda k: F.pmod(F.floor(F.col(idx) / F.pow(F.lit(float(ARITY)), k)), F.lit(ARITY)).cast("int")), 1, levels)


def merkle_manifest(df: DataFrame, group: str, order: tuple[str, ...], leaf: Column, claimed: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Manifest of ``df``: ``keep`` columns, ``leaf``, ``subroot`` of its group, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``.

    Groups are the values of ``group`` as text, null first, then bytewise. Leaves of a group ascend by ``order`` (nulls
    first), rows that repeat it by digest: each row is a leaf. ``claimed`` is the digest to be verified against the proof
    (null: the leaf's own). Names of ``df`` are free. An empty table gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    places = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)]
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]).alias("_kept")
    rows = df.select(key.alias("g"), *places, kept, leaf.alias("leaf"), (claimed if claimed is not None else F.lit(None)).cast("string").alias("_claimed"))
    rows = materialize(rows.withColumn("_claimed", F.when(F.col("_claimed") != F.col("leaf"), F.col("_claimed"))), "merkle-digests")
    forest = merkle_forest(rows, tuple(f"_o{i}" for i in range(len(order))))
    groups = merkle_forest(forest.roots.select(F.lit("").alias("g"), F.col("g").alias("_o0"), F.col("root").alias("leaf")), ("_o0",))
    paths = proofs(groups, keep={"name": F.col("_o0"), "subroot": F.col("leaf")}, siblings=True)
    paths = materialize(paths.select(F.col("name").alias("g"), "subroot", F.col("folded").alias("root"), _places("idx", F.size("siblings")).alias("places"), F.col("siblings").alias("lists")), "merkle-groups")
    proven = proofs(forest, F.col("_claimed"), {"_kept": F.col("_kept"), "leaf": F.col("leaf")}, paths)
    named = [F.col(f"_kept._{i}").alias(c) for i, c in enumerate(keep)]
    return proven.select(*named, "leaf", "subroot", "root", "proof_sha256", F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


#: A-Z and a-z, for lower-casing ASCII letters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf_digest(*fields, F.translate("text", UPPER, LOWER)))
    return merkle_manifest(docs, "lang", ("doc_id",), leaf_digest(*fields, F.col("text")), tampered, keep=("doc_id",))
