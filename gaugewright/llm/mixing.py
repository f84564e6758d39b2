"""Mixing sources to target weights: water-filled targets, certain whole copies, then a Pareto order sample of the rest.

Within a source a document's expected copies grow with its length: they are the source's level times the number of binary
digits of its size in words, at most ``max_copies``, and the level is solved so that the expected words meet the source's
target. ``floor`` of the copies is taken for certain. The remaining fraction ``p``, which differs between documents, is
sampled: documents are ranked by the odds of a reproducible uniform number divided by the odds of their inclusion ``p``,
and taken from the lowest rank until the source's remaining words are used up, so the sample's size in words is fixed. A
document that no longer fits ends a pass; later passes offer what is left to the next documents in rank order that fit,
until a source misses at most TOLERANCE of its target or nothing fits.

Sums over ranks come from bins of the rank (partial sums, then one window inside each bin), so no task sees a whole
source. What is kept of a source is one row per length class (64 at most), with the highest taken rank of each pass.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_COPIES = 2
#: Part of its target that a source may miss; passes end where no source misses more or nothing fits.
TOLERANCE = 0.001
SEED = "mix"
#: Bins of the rank in each source. The work is the same for any number; more bins give smaller windows.
RANK_BINS = 4096
#: Rows of the plan (sources times length classes) that may be broadcast; with more the join is left to Spark.
BROADCAST_ROWS = 50_000


def word_count(text: str | Column) -> Column:
    """Number of words, runs without ASCII white space; null texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, budget: float = BUDGET, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source: (source, source_size, target).

    Sources in code point order, null last, take the weights in turn and share ``budget`` times all sizes. A target stops at
    ``max_copies`` times its source's size; the excess is shared again by weight until none is above. The windows run
    over the sources, not over documents.
    """
    n = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    n = n.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))) + 1).cast("double"))
    n = n.withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    n = n.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    n = n.withColumn("level", (budget * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    n = n.withColumn("is_open", F.col("level") * F.col("weight") < F.col("cap"))
    n = n.withColumn("first_open", F.min(F.when(F.col("is_open"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level").alias("level")))).over(every))
    target = F.when(F.coalesce(F.col("first_open.level") * F.col("weight") < F.col("cap"), F.lit(False)), F.col("first_open.level") * F.col("weight")).otherwise(F.col("cap"))
    return n.select("source", "source_size", target.alias("target"))


def _draw(doc_id: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def _ranked(df: DataFrame, doc_id: str, seed: str) -> DataFrame:
    """Add the draw and the rank value: random odds over inclusion odds (null where nothing is to be sampled)."""
    u = (F.conv(F.substring("_draw", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    df = df.withColumn("_draw", _draw(doc_id, seed)).withColumn("_u", u)
    return df.withColumn("_rank", F.when(F.col("share") > 0, (F.col("_u") / (1 - F.col("_u"))) / (F.col("share") / (1 - F.col("share")))))


def _key() -> Column:
    return F.struct(F.col("_rank").alias("r"), F.col("_draw").alias("d"))


def _in_pass(k: int) -> Column:
    """Whether pass k takes the row, if no earlier one did (where pass k takes nothing of a source, ``upto`` is null). Rows without a share have no rank and are never taken."""
    return F.coalesce((F.col("share") > 0) & (F.col("size") <= F.col(f"room{k}")) & (_key() <= F.col(f"upto{k}")), F.lit(False))


def _taken(k: int) -> Column:
    out = F.lit(False)
    for i in range(k):
        out = out | _in_pass(i)
    return out


def length_weight(size: str | Column) -> Column:
    """Weight of a document of so many words: the number of its size's binary digits, at most 64."""
    return F.length(F.bin(size))


def class_copies(sizes: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source and length class: (source, weight, source_size, target, whole, share, room0).

    Copies are ``least(max_copies, level * weight)``; the level is that of the heaviest class that it leaves below
    ``max_copies`` once all heavier ones are there. ``room0`` are the words that whole copies leave to the sample. The
    windows run over a source's classes, 64 rows at most.
    """
    c = sizes.groupBy("source", length_weight("size").alias("weight")).agg(F.sum("size").alias("words"))
    down, all_ = W.partitionBy("source").orderBy(F.desc("weight")), W.partitionBy("source")
    c = c.withColumn("full", F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("double"))
    c = c.withColumn("rest", F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(W.currentRow, W.unboundedFollowing)).cast("double"))
    c = c.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    c = c.withColumn("level", F.try_divide(F.col("target") - max_copies * F.col("full"), F.col("rest")))
    is_open = F.col("level") * F.col("weight") < max_copies
    c = c.withColumn("level", F.max(F.when(is_open, F.struct("weight", "level"))).over(all_)["level"])
    copies = F.when(F.col("source_size") > 0, F.coalesce(F.least(F.col("level") * F.col("weight"), F.lit(float(max_copies))), F.lit(float(max_copies)))).otherwise(0.0)
    c = c.withColumn("copies", copies).withColumn("whole", F.floor("copies")).withColumn("share", F.col("copies") - F.col("whole"))
    c = c.withColumn("room0", F.col("target") - F.sum(F.col("whole") * F.col("words")).over(all_))
    return c.select("source", "weight", "source_size", "target", "whole", "share", "room0")


def _join_plan(df: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    small = plan.withColumnsRenamed({"source": "_source", "weight": "_weight"})
    on = F.col("source").eqNullSafe(F.col("_source")) & (length_weight("size") == F.col("_weight"))
    return df.join(F.broadcast(small) if few else small, on).drop("_source", "_weight")


def mixing_plan(sizes: DataFrame, seed: str = SEED, weights=WEIGHTS, budget: float = BUDGET, max_copies: int = MAX_COPIES) -> tuple[DataFrame, bool, int]:
    """One row per source and length class with target, whole copies, share to sample and highest taken rank of each pass; whether it is small enough to broadcast; and the number of passes.

    ``sizes`` has columns doc_id, source, size and is read once a pass: pass a written table. Every pass takes a document
    of each source that still misses over TOLERANCE of its target and has one that fits, and what fits gets rarer fast.
    """
    plan = class_copies(sizes, source_targets(sizes, weights=weights, budget=budget, max_copies=max_copies), max_copies)
    plan = materialize(plan, "mix-targets")
    few = plan.count() <= BROADCAST_ROWS
    for k in count():
        rows = _ranked(_join_plan(sizes, plan, few), "doc_id", seed)
        rows = rows.where((F.col("share") > 0) & (F.col("size") > 0) & (F.col("size") <= F.col(f"room{k}")) & (F.col(f"room{k}") > F.col("target") * TOLERANCE) & ~_taken(k))
        rows = rows.withColumn("bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * RANK_BINS)).select("source", "bin", "size", f"room{k}", "_rank", "_draw")
        bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
        below = F.sum("in_bin").over(W.partitionBy("source").orderBy("bin")) - F.col("in_bin")  # RANK_BINS rows a source at most
        bins = bins.select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), below.alias("below"))
        # sums up to a rank include all rows of that rank: repeated rows are taken together or not at all
        rows = rows.withColumn("inside", F.sum("size").over(W.partitionBy("source", "bin").orderBy("_rank", "_draw")))
        rows = rows.join(bins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin")))
        fits = rows.where(F.col("below") + F.col("inside") <= F.col(f"room{k}"))
        best = fits.groupBy(F.col("source").alias("_source")).agg(F.max(_key()).alias(f"upto{k}"), F.sum("size").alias("_used"))
        plan = plan.join(best, F.col("source").eqNullSafe(F.col("_source")), "left")
        plan = plan.withColumn(f"room{k + 1}", F.col(f"room{k}") - F.coalesce(F.col("_used"), F.lit(0))).drop("_source", "_used")
        plan = materialize(plan, "mix-plan")
        if plan.where(F.col(f"upto{k}").isNotNull()).isEmpty():
            return plan, few, k


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED, weights=WEIGHTS, budget: float = BUDGET, max_copies: int = MAX_COPIES) -> DataFrame:
    """All rows of ``df`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` (0 to ``max_copies``).

    Null sources are one source, the last; null texts have size 0. A row without words is copied as often as whole copies
    of the shortest texts of its source. Rows that repeat a document id and size draw the same number and are taken
    together or not at all. No row is dropped, a rerun gives the same copies, and an empty table gives no rows. Columns of
    the four new names are replaced, all other names are free.
    """
    df = df.drop("mix_size", "mix_source_size", "mix_target", "mix_copies")
    size = word_count(F.col(f"`{text}`"))
    sizes = materialize(df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size")), "mix-sizes")
    plan, few, passes = mixing_plan(sizes, seed, weights, budget, max_copies)
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(kept, F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{source}`").alias("source"), size.alias("size"))
    return _copies(rows, plan, few, seed, passes).select("_row.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"))


def _copies(rows: DataFrame, plan: DataFrame, few: bool, seed: str, passes: int) -> DataFrame:
    rows = _ranked(_join_plan(rows, plan, few), "_id", seed)
    return rows.withColumn("copies", F.col("whole") + F.when(F.coalesce(F.col("size") > 0, F.lit(False)) & _taken(passes), 1).otherwise(0))


def op4_pareto_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = materialize(docs.select("doc_id", "source", word_count("text").alias("size")), "mix-sizes")
    plan, few, passes = mixing_plan(sizes)
    rows = _copies(sizes.withColumn("_id", F.col("doc_id")), plan, few, SEED, passes)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: Passes written out in SQL; more than any source of the small tables needs.
ORACLE_PASSES = 24


def _oracle() -> str:
    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    sql = f"""
WITH docs AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
s1 AS (SELECT *, CAST(CASE place % {len(WEIGHTS)} {weights} END AS DOUBLE) AS weight, CAST(source_size * {MAX_COPIES} AS DOUBLE) AS cap FROM s0),
s2 AS (
  SELECT *, (CAST({BUDGET} AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM s1 WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT level AS open_level FROM s2 WHERE level * weight < cap ORDER BY cap / weight, place LIMIT 1),
s3 AS (SELECT source, source_size, CASE WHEN open_level * weight < cap THEN open_level * weight ELSE cap END AS target FROM s2 LEFT JOIN lv ON true),
c0 AS (SELECT source, length(bin(size)) AS weight, CAST(sum(size) AS BIGINT) AS words FROM docs GROUP BY ALL),
c1 AS (
  SELECT c0.*, s3.source_size, s3.target,
         (s3.target - {MAX_COPIES} * CAST(coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
           / nullif(CAST(sum(words * weight) OVER (PARTITION BY c0.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS own_level
  FROM c0 JOIN s3 ON c0.source IS NOT DISTINCT FROM s3.source),
c2 AS (SELECT *, arg_max(own_level, weight) FILTER (WHERE own_level * weight < {MAX_COPIES}) OVER (PARTITION BY source) AS level FROM c1),
c3 AS (SELECT *, CASE WHEN source_size > 0 THEN coalesce(CASE WHEN level * weight < {MAX_COPIES} THEN level * weight END, CAST({MAX_COPIES} AS DOUBLE)) ELSE 0 END AS copies FROM c2),
p0 AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS share, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS room FROM c3),
d0 AS (
  SELECT d.doc_id, d.source, d.size, d.draw, p.source_size, p.target, p.whole, p.share, p.room, false AS got,
         CASE WHEN share > 0 THEN (u / (1 - u)) / (share / (1 - share)) END AS rank
  FROM (SELECT *, (CAST(CAST('0x' || substr(draw, 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM docs) d
  JOIN p0 p ON d.source IS NOT DISTINCT FROM p.source AND length(bin(d.size)) = p.weight)"""
    for k in range(ORACLE_PASSES):
        sql += f""",
e{k} AS (SELECT *, share > 0 AND size > 0 AND size <= room AND room > target * {TOLERANCE} AND NOT got AS can FROM d{k}),
f{k} AS (SELECT *, can AND sum(CASE WHEN can THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank, draw) <= room AS now FROM e{k}),
d{k + 1} AS (SELECT doc_id, source, size, draw, source_size, target, whole, share, room - sum(CASE WHEN now THEN size ELSE 0 END) OVER (PARTITION BY source) AS room, got OR now AS got, rank FROM f{k})"""
    return sql + f"""
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN got THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM d{ORACLE_PASSES}"""


ORACLE_SQL = {"op4_pareto_mixing": _oracle()}
