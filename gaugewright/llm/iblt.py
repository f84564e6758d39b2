"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled between versions.

A text's paragraphs are its lines, a long line cut every ``PARAGRAPH_WORDS`` words; a digest is a paragraph's XXH64. A
sketch is a small table of cells: each digest is added to one cell of each of three parts, and a cell holds the number,
the XOR of the digests and the XOR of their check hashes. Subtracting two sketches cancels what both texts hold. A cell
with one digest left gives it away, and taking it out of its other cells frees more: peeling recovers the digests that
differ. Where that fails, a larger sketch is tried: the digests are dealt to more tables by another hash, and what still
fails is dealt again. Everything is built from DataFrame functions, and a row never holds more than two texts' digests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, table

PARAGRAPH_WORDS = 16
#: Cells in each of a table's three parts.
PART = 8
#: Digests that a retry deals to one table on average, and tables that one retry deals to at most.
LOAD, FAN = 12, 16
#: Peeling rounds of one table; it has failed if cells are left then.
PEELS = 10
#: Retries inside a row; what is left then (rare, long texts) is retried as rows of its own, until nothing is left.
RETRIES = 3
#: Ranges of ids per shuffle partition and in all, within which neighbours are found.
RANGES_PER_PARTITION, MAX_RANGES = 4, 65_536


def paragraph_digests(text: Column, words: int = PARAGRAPH_WORDS) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; null, empty and blank texts have none."""
    pieces = F.regexp_extract_all(text, F.lit(rf"\S++(?:[ \t]++\S++){{0,{words - 1}}}+"), F.lit(0))
    return F.coalesce(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))), _none())


def _none() -> Column:
    return F.array().cast("array<bigint>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _hashed(digests: Column, level: int) -> Column:
    return F.transform(digests, lambda d: F.struct(d.alias("k"), F.xxhash64(d, F.lit(level)).alias("h")))


def sketch(hashed: Column) -> Column:
    """Cells (m, v, n, k, h) of digests with their check hash: a hash belongs to the cells whose value it has under their mask."""
    places = F.array(*[F.struct(F.lit(PART - 1 << 8 * j).cast("long").alias("m"), F.lit(r << 8 * j).cast("long").alias("v")) for j in range(3) for r in range(PART)])

    def cell(at: Column, own: Column) -> Column:
        zero = F.struct(at["m"].alias("m"), at["v"].alias("v"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))
        return F.aggregate(F.filter(own, lambda x: x["h"].bitwiseAND(at["m"]) == at["v"]), zero, lambda c, x: _merged(c, F.lit(1), x))

    return _let(hashed, lambda own: F.transform(places, lambda at: cell(at, own)))


def _merged(cell: Column, n: Column, x: Column) -> Column:
    return F.struct(cell["m"].alias("m"), cell["v"].alias("v"), (cell["n"] + n).alias("n"), cell["k"].bitwiseXOR(x["k"]).alias("k"), cell["h"].bitwiseXOR(x["h"]).alias("h"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _merged(x, -y["n"], y))


def peel(cells: Column, level: int) -> Column:
    """Of a difference of sketches: (ok, plus, minus), whether all cells came empty, and the digests that each side had alone."""

    def pure(x: Column) -> Column:
        return (F.abs(x["n"]) == 1) & (F.xxhash64(x["k"], F.lit(level)) == x["h"])

    def step(s: Column) -> Column:
        def without(x: Column) -> Column:
            return F.aggregate(F.filter(s["found"], lambda p: p["h"].bitwiseAND(x["m"]) == x["v"]), x, lambda c, p: _merged(c, -p["n"], p))

        left = F.transform(s["cells"], without)
        plus, minus = (F.transform(F.filter(s["found"], alone), lambda p: p["k"]) for alone in (lambda p: p["n"] > 0, lambda p: p["n"] < 0))
        return F.struct(left.alias("cells"), F.concat(s["plus"], plus).alias("plus"), F.concat(s["minus"], minus).alias("minus"), F.lit(True).alias("on"))

    def found(s: Column) -> Column:
        # one digest may be alone in several cells: it is taken once
        alone = F.transform(F.filter(s["cells"], pure), lambda x: F.struct(x["n"].alias("n"), x["k"].alias("k"), x["h"].alias("h")))
        return F.struct(s["cells"].alias("cells"), s["plus"].alias("plus"), s["minus"].alias("minus"), F.array_distinct(alone).alias("found"))

    def one_round(s: Column, _: Column) -> Column:
        tried = _let(found(s), lambda x: F.when(F.size(x["found"]) == 0, stopped(s)).otherwise(step(x)))
        return F.when(s["on"], tried).otherwise(s)

    def stopped(s: Column) -> Column:
        return F.struct(s["cells"].alias("cells"), s["plus"].alias("plus"), s["minus"].alias("minus"), F.lit(False).alias("on"))

    start = F.struct(cells.alias("cells"), _none().alias("plus"), _none().alias("minus"), F.lit(True).alias("on"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, one_round, lambda s: F.struct((~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0))).alias("ok"), s["plus"].alias("plus"), s["minus"].alias("minus")))


def _attempt(a: Column, b: Column, level: int) -> Column:
    """One table for the digests of both sides: ok, plus, minus, and the sides if it failed."""
    none = _none()
    done = peel(subtract(sketch(_hashed(a, level)), sketch(_hashed(b, level))), level)
    return _let(done, lambda d: F.struct(d["ok"].alias("ok"), F.when(d["ok"], d["plus"]).otherwise(none).alias("plus"), F.when(d["ok"], d["minus"]).otherwise(none).alias("minus"), F.when(d["ok"], none).otherwise(a).alias("a"), F.when(d["ok"], none).otherwise(b).alias("b")))


def _larger(a: Column, b: Column, level: int) -> Column:
    """Both sides dealt to several tables by another hash, each tried: an array of attempts."""
    fan = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil((F.size(a) + F.size(b)) / F.lit(LOAD)).cast("int")))

    def places(side: Column, fan: Column) -> Column:
        return F.transform(side, lambda d: F.struct(d.alias("d"), F.pmod(F.xxhash64(d, F.lit(-level)), fan).alias("g")))

    def dealt(side: Column, group: Column) -> Column:
        return F.transform(F.filter(side, lambda x: x["g"] == group), lambda x: x["d"])

    def groups(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), x["fan"] - 1), lambda g: _let(F.struct(dealt(x["a"], g).alias("a"), dealt(x["b"], g).alias("b")), lambda y: _attempt(y["a"], y["b"], level)))

    return _let(fan, lambda n: _let(F.struct(n.alias("fan"), places(a, n).alias("a"), places(b, n).alias("b")), groups))


def _retried(df: DataFrame, name: str, levels: range) -> DataFrame:
    """Replace the attempts in array column ``name`` that failed by larger ones, level by level; successes are put together."""
    for level in levels:
        again = F.flatten(F.transform(F.filter(name, lambda x: ~x["ok"]), lambda x: _larger(x["a"], x["b"], level)))
        df = df.withColumn("_again", again).withColumn(name, F.concat(_settled(name), "_again")).drop("_again")
    return df.withColumn(name, F.concat(_settled(name), F.filter(name, lambda x: ~x["ok"])))


def _recovered(attempts: Column, side: str) -> Column:
    """The digests that attempts recovered on one side (none where they failed)."""
    return F.flatten(F.transform(attempts, lambda x: x[side]))


def _settled(name: str) -> Column:
    """The successful attempts as one."""
    done = F.filter(name, lambda x: x["ok"])
    return F.array(F.struct(F.lit(True).alias("ok"), *[_recovered(done, side).alias(side) for side in ("plus", "minus")], _none().alias("a"), _none().alias("b")))


def _packed(cells: Column) -> Column:
    """A sketch as bytes: 2 for the number, 8 for the digests and 4 for the check of each cell."""
    text = F.transform(cells, lambda x: F.concat(F.lpad(F.hex(x["n"].bitwiseAND(0xFFFF)), 4, "0"), F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"].bitwiseAND(0xFFFFFFFF)), 8, "0")))
    return F.unhex(F.array_join(text, ""))


def with_next(df: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the row after each row by descending ``order``, the first row after the last.

    Ties follow the code points of the first column; nulls come last. Ranges of ids (from percentiles) are sorted each by
    itself, and the head of each range is also sent to the range before it. Only bounds and heads reach the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(RANGES_PER_PARTITION * parts, MAX_RANGES))
    bounds = df.agg(F.percentile_approx(order, [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges).alias("b")).first()["b"] or []
    bounds = F.array(*map(F.lit, sorted({*bounds}))) if bounds else F.array().cast("array<bigint>")

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = (s["lo"] < s["hi"]) & (F.get(bounds, mid) <= F.col(order))
        return F.struct(F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    place = F.aggregate(F.sequence(F.lit(0), F.lit(ranges.bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.size(bounds).alias("hi")), halve, lambda s: s["lo"])
    placed = df.withColumn("_range", F.when(F.col(order).isNull(), -1).otherwise(place))
    heads = sorted(placed.groupBy("_range").agg(F.max(order).alias("head")).collect(), key=lambda r: -r["_range"])
    # the head of each range follows the last row of the range before it, that of the first range the last row of all
    to = {r["_range"]: (heads[i - 1]["_range"], r["head"]) for i, r in enumerate(heads)}
    size = max(to, default=0) + 2
    before = F.array(*[F.lit(to.get(i - 1, (None, None))[0]).cast("int") for i in range(size)])
    head = F.array(*[F.lit(to.get(i - 1, (None, None))[1]).cast("long") for i in range(size)])
    is_head = F.get(head, F.col("_range") + 1).eqNullSafe(F.col(order))
    own, sent = F.struct(F.col("_range").alias("r"), F.lit(0).alias("copy")), F.struct(F.get(before, F.col("_range") + 1).alias("r"), F.lit(1).alias("copy"))
    rows = placed.withColumn("_to", F.explode(F.when(is_head, F.array(own, sent)).otherwise(F.array(own))))
    rows = rows.withColumns({"_range": F.col("_to.r"), "_copy": F.col("_to.copy")}).drop("_to").repartition(parts, "_range")
    w = W.partitionBy("_range").orderBy("_copy", F.col(order).desc_nulls_last(), columns[0])
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where("_copy = 0").drop("_copy", "_range")


def fingerprints(df: DataFrame, pairs: dict[str, tuple[str, str]], recover: bool = False) -> DataFrame:
    """Replace digest columns by sketches, and add how many digests each side of a pair has alone, and those digests if asked.

    ``pairs`` maps a name to two digest columns. Added: ``<column>_sketch`` (binary), ``<column>_n``, and for each pair
    ``<name>_plus`` and ``<name>_minus``; with ``recover`` also the recovered digests themselves, sorted, in
    ``<name>_plus_digests`` and ``<name>_minus_digests``. The digest columns go; columns of the new names are replaced, all other names are
    free. Written to the shared folder; rows are neither lost nor made, and a null list of digests is empty.
    """
    sides = list(dict.fromkeys(c for p in pairs.values() for c in p))
    new = {*(f"{c}_{x}" for c in sides for x in ("sketch", "n")), *(f"{n}_{x}{end}" for n in pairs for x in ("plus", "minus") for end in ("", "_digests"))}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in sides and c not in new]
    digests = [F.coalesce(F.col(c), F.array().cast("array<bigint>")).alias(c) for c in sides]
    df, rest = df.select(F.struct(*kept, F.lit(None).alias("_end")).alias("_doc"), *digests), ["_doc"]
    for c in sides:
        df = df.withColumn(f"{c}_cells", sketch(_hashed(F.col(c), 0)))
    none = _none()
    for name, (a, b) in pairs.items():
        df = df.withColumn("_first", peel(subtract(F.col(f"{a}_cells"), F.col(f"{b}_cells")), 0))
        ok = F.col("_first.ok")
        side = [F.when(ok, none).otherwise(F.col(c)).alias(x) for c, x in ((a, "a"), (b, "b"))]
        df = df.withColumn(name, F.array(F.struct(ok.alias("ok"), F.when(ok, F.col("_first.plus")).otherwise(none).alias("plus"), F.when(ok, F.col("_first.minus")).otherwise(none).alias("minus"), *side))).drop("_first")
        df = _retried(df, name, range(1, RETRIES + 1))
    packed = [x for c in sides for x in (_packed(F.col(f"{c}_cells")).alias(f"{c}_sketch"), F.size(c).alias(f"{c}_n"))]
    base = materialize(df.select(*rest, *packed, *pairs, F.monotonically_increasing_id().alias("_row")), "sketches")
    unsettled = reduce(lambda x, y: x | y, [F.size(name) > 1 for name in pairs])
    recovered = [_recovered(F.col(name), side).alias(f"{name}_{side}") for name in pairs for side in ("plus", "minus")]
    names = [c for c in base.columns if c not in (*pairs, "_row")]
    todo = base.where(unsettled).select("_row", F.explode(F.array(*[F.struct(F.lit(name).alias("pair"), F.filter(name, lambda x: ~x["ok"]).alias("left")) for name in pairs])).alias("p"))
    todo = todo.select("_row", "p.pair", F.explode("p.left").alias("x"))
    found, level = [], RETRIES
    while not todo.isEmpty():
        level += 1
        tried = todo.select("_row", "pair", F.explode(_larger(F.col("x.a"), F.col("x.b"), level)).alias("x"))
        tried = materialize(tried, f"sketches-{level}")
        found.append(tried.where("x.ok").select("_row", "pair", "x.plus", "x.minus"))
        todo = tried.where("not x.ok")
    out = base.select(*names, *recovered, "_row", unsettled.alias("_open"))
    alone = [f"{n}_{s}" for n in pairs for s in ("plus", "minus")]
    order = ["_doc.*", *[c for c in names if c != "_doc"], *[F.size(c).cast("long").alias(c) for c in alone], *([F.array_sort(c).alias(f"{c}_digests") for c in alone] if recover else [])]
    if not found:
        return out.select(*order).drop("_end")
    # a row's digests are at most those of its two texts
    more = reduce(DataFrame.unionByName, found).groupBy("_row").agg(*[F.flatten(F.collect_list(F.when(F.col("pair") == name, F.col(side)))).alias(f"_{name}_{side}") for name in pairs for side in ("plus", "minus")])
    late = out.where("_open").join(more, "_row", "left").withColumns({f"{name}_{side}": F.concat(f"{name}_{side}", F.coalesce(F.col(f"_{name}_{side}"), _none())) for name in pairs for side in ("plus", "minus")})
    return out.where("not _open").select(*order).unionByName(late.select(*order)).drop("_end")


def _one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit(""))


def likeness(n: Column, m: Column, plus: Column, minus: Column) -> Column:
    """Share of the two texts' digests that both have, 1 if neither has any."""
    return F.when(n + minus == 0, F.lit(1.0)).otherwise((n - plus) / (n + minus))


def op3_iblt_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, its edited text and the next one, by (doc_id, text); one row per input row.

    ``removed_digests`` and ``added_digests`` are the paragraph digests that peeling recovered: those of the text that its
    edited text lacks, and the other way round. The edited text has its last third of code points replaced by the next text's first as many. Null texts are empty;
    texts without a word have no digests, and two such texts are alike (1.0). Equal texts have equal fingerprints.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"])
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), *[paragraph_digests(F.col(c)).alias(a) for c, a in (("text", "own"), ("edited", "edit"), ("next_text", "nxt"))])
    got = fingerprints(rows, {"e": ("own", "edit"), "x": ("own", "nxt")}, recover=True)
    near = {name: likeness(F.col("own_n"), F.col(f"{other}_n"), F.col(f"{name}_plus"), F.col(f"{name}_minus")) for name, other in (("e", "edit"), ("x", "nxt"))}
    return got.select("doc_id", "n_chars", "edited_sha256", _one_line(F.base64("own_sketch")).alias("fingerprint"), _one_line(F.base64("edit_sketch")).alias("edited_fingerprint"), near["e"].alias("near_edited"), near["x"].alias("near_next"), F.col("e_plus_digests").alias("removed_digests"), F.col("e_minus_digests").alias("added_digests"))
