"""Item grids, evidence, condition views and data-quality checks as DataFrames.

Random numbers come from a hash of (seed, item, draw), so items are made in parallel and any subset can be made again.
Template wording is a parameter: a small table of texts per domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.influence import RULES, gold_answer
from ..schemas import CONTROL, CORE_ANCHORED, OFFSETS
from ..sources.files import require

DOMAINS = ("snacks", "streaming", "travel", "fitness", "coffee", "electronics")
DIFFICULTIES = ("easy", "hard")
#: Spread of ratings and number of missing ones by difficulty.
SPREAD = {"easy": 8, "medium": 12, "hard": 15}
MISSING = {"easy": 0, "medium": 1, "hard": 2}
RATINGS = 5
WEIGHTS = (1.0, 1.0, 1.5, 1.5, 2.0)
#: Names of ratings; a family for each item in turn.
LABELS = ("Rating ", "Reviewer ")
#: Distance of anchors from theta in grids without offsets.
PLAIN_OFFSET = 25
INSTRUCTION = "Reply with one whole number from 0 to 100."


def _uniform(seed: int, draw: Column | int, *keys: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys, F.lit(draw) if isinstance(draw, int) else draw), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, draw: Column | int, *keys: Column) -> Column:
    a, b = _uniform(seed, draw, F.lit(1), *keys), _uniform(seed, draw, F.lit(2), *keys)
    return F.sqrt(-2 * F.log(a)) * F.cos(b * F.lit(6.283185307179586))


def item_grid(spark: SparkSession, prefix: str, n_per_cell: int = 10, domains: Sequence[str] = DOMAINS, difficulties: Sequence[str] = DIFFICULTIES, offsets: Sequence[int] | None = OFFSETS) -> DataFrame:
    """Domain x difficulty x offset x 1..n with a running index in grid order, from arithmetic on one range.

    Without offsets the grid is domain x difficulty x 1..n and item ids have no offset part.
    """
    if offsets is None:
        g = item_grid(spark, prefix, n_per_cell, domains, difficulties, (0,)).drop("offset")
        return g.withColumn("item_id", F.concat_ws("-", F.lit(prefix), "domain", F.substring("difficulty", 1, 1), F.format_string("%03d", "n")))
    per_domain, per_difficulty = len(difficulties) * len(offsets) * n_per_cell, len(offsets) * n_per_cell
    g = spark.range(len(domains) * per_domain).withColumnRenamed("id", "global_idx")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    g = g.withColumns({"domain": pick(domains, F.floor(F.col("global_idx") / per_domain)), "difficulty": pick(difficulties, F.floor(F.col("global_idx") / per_difficulty)), "offset": pick(offsets, F.floor(F.col("global_idx") / n_per_cell)), "n": (F.col("global_idx") % n_per_cell + 1).cast("int")})
    return g.withColumn("item_id", tx.item_id(F.lit(prefix), F.col("domain"), F.col("difficulty"), F.col("offset"), F.col("n")))


def grid_over(rows: DataFrame, prefix: str, domains: Sequence[str] = DOMAINS, difficulties: Sequence[str] = DIFFICULTIES, offsets: Sequence[int] | None = OFFSETS) -> DataFrame:
    """Items over the rows of any table with a ``global_idx`` of their own (from 0): domains, difficulties and offsets take turns by it.

    Without offsets item ids have no offset part. Nothing is shuffled, and other columns go.
    """
    pick = lambda values, every: F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("global_idx") / every) % len(values) + 1).cast("int"))
    g = rows.select("global_idx").withColumns({"domain": pick(domains, 1), "difficulty": pick(difficulties, len(domains)), "n": (F.col("global_idx") + 1).cast("int")})
    if offsets is None:
        return g.withColumn("item_id", F.concat_ws("-", F.lit(prefix), "domain", F.substring("difficulty", 1, 1), F.format_string("%03d", "n")))
    g = g.withColumn("offset", pick(offsets, len(domains) * len(difficulties)))
    return g.withColumn("item_id", tx.item_id(F.lit(prefix), F.col("domain"), F.col("difficulty"), F.col("offset"), F.col("n")))


def itemspecs(grid: DataFrame, seed: int = 42, rule: str = "mean") -> DataFrame:
    """Add theta (30 to 70), five ratings around it with some missing, the gold answer, both anchors and template indices.

    One visible rating of a hard item is mirrored (100 less its value). A grid without offsets gets anchors 25 from theta.
    Indices are the item's place in the grid; templates take them modulo the size of their pool.
    """
    if "offset" not in grid.columns:
        grid = grid.withColumn("offset", F.lit(None).cast("int"))
    key = F.col("item_id")
    theta = (30 + F.floor(_uniform(seed, 0, key) * 41)).cast("int")
    spread = F.create_map(*[F.lit(x) for kv in SPREAD.items() for x in kv])[F.col("difficulty")]
    missing = F.create_map(*[F.lit(x) for kv in MISSING.items() for x in kv])[F.col("difficulty")]
    # draws and ratings are written out: a lambda is evaluated outside generated code, and what it names again for each element
    places = [F.lit(i) for i in range(RATINGS)]
    # the ratings with the smallest draws are the missing ones
    ranks = F.sort_array(F.array(*[F.struct(_uniform(seed, 9, key, i).alias("u"), i.alias("i")) for i in places]))["i"]
    df = grid.withColumns({"theta": theta, "_ranks": ranks})
    gone = F.slice("_ranks", F.lit(1), missing)
    mirrored = F.when(F.col("difficulty") == "hard", F.get("_ranks", missing))
    family = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("global_idx") % len(LABELS) + 1).cast("int"))
    df = df.withColumns({"_raws": F.array(*[clamped(F.col("theta") + _normal(seed, 3, key, i) * spread) for i in places]), "_gone": F.transform(F.array(*places), lambda i: F.array_contains(gone, i)), "_mirrored": mirrored, "_family": family})

    def rating(i: Column) -> Column:
        raw = F.get("_raws", i)
        value = F.when(F.col("_mirrored").eqNullSafe(i), 100 - raw).otherwise(raw)
        return F.struct(i.alias("index"), F.concat("_family", (i + 1).cast("string")).alias("label"), value.alias("value"), raw.alias("value_raw"), F.get("_gone", i).alias("missing"))

    df = df.withColumn("evidence", F.array(*map(rating, places))).drop("_ranks", "_raws", "_gone", "_mirrored", "_family").withColumn("_seen", visible(F.col("evidence")))
    gold = gold_answer(F.col("_seen"), rule, F.array(*map(F.lit, WEIGHTS)))
    reach = F.coalesce("offset", F.lit(PLAIN_OFFSET))
    df = df.withColumns({"y_star": gold, "y_star_theta": F.col("theta"), "rule": F.lit(rule), "anchor_low": F.greatest(F.lit(0), F.col("theta") - reach), "anchor_high": F.least(F.lit(100), F.col("theta") + reach)}).drop("_seen")
    return df.withColumns({f"{name}_idx": F.col("global_idx") for name in ("scenario", "question", "label", "phrasing")})


def clamped(value: Column) -> Column:
    """Nearest whole number from 0 to 100, halves to even. ``rint`` does that on doubles; ``bround`` goes through decimal digits."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.rint(value))).cast("int")


def visible(evidence: Column) -> Column:
    return F.transform(F.filter(evidence, lambda e: ~e["missing"]), lambda e: e["value"])


def evidence_summary(values: Column) -> dict[str, Column]:
    """count, mean, population std, min and max of an array of ints; nulls but for the count if it is empty."""
    n = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), n)
    var = F.try_divide(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x), n) - mean * mean
    return {"n": n, "mean": mean, "std": F.when(n > 0, F.sqrt(F.greatest(var, F.lit(0.0)))), "lowest": F.array_min(values), "highest": F.array_max(values)}


def nearest_subset(values: Column, target: Column) -> Column:
    """Of all pairs of positions, the first whose mean is nearest to the target: struct(distance, i, j, mean)."""
    last = F.size(values) - 1
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.filter(F.sequence(F.lit(0), last), lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"), ((F.get(values, i) + F.get(values, j)) / F.lit(2.0)).alias("mean")))))
    ranked = F.transform(pairs, lambda p: F.struct(F.abs(p["mean"] - target).alias("distance"), p["i"].alias("i"), p["j"].alias("j"), p["mean"].alias("mean")))
    return F.when(F.size(values) >= 2, F.array_min(ranked))


def render_views(specs: DataFrame, templates: DataFrame | None = None, conditions: Sequence[str] = (CONTROL, *CORE_ANCHORED)) -> DataFrame:
    """One prompt per item and condition: scenario, evidence, the anchor's sentence if any, question; with hash and span.

    ``templates`` has (domain, scenario, question, plausible, irrelevant), ``{}`` standing for the anchor's value.
    """
    spark = specs.sparkSession
    if templates is None:
        rows = [(d, f"A team studies how customers rate {d}.", f"How would customers rate {d} overall?", f"A colleague recalls a rating of {{}} for {d}.", "The form carries the number {} in its corner.") for d in DOMAINS]
        templates = spark.createDataFrame(rows, "domain string, scenario string, question string, plausible string, irrelevant string")
    dims = spark.createDataFrame([(c, c.split("_")[0] if c != CONTROL else "none", c.split("_")[-1]) for c in conditions], "condition string, relevance string, direction string")
    df = specs.join(templates, "domain").crossJoin(F.broadcast(dims))
    anchor = F.when(F.col("relevance") != "none", F.when(F.col("direction") == "low", F.col("anchor_low")).otherwise(F.col("anchor_high")))
    sentence = F.replace(F.when(F.col("relevance") == "plausible", F.col("plausible")).when(F.col("relevance") == "irrelevant", F.col("irrelevant")), F.lit("{}"), anchor.cast("string"))
    base = F.concat_ws("\n\n", "scenario", tx.evidence_lines(F.col("evidence")))
    df = df.withColumns({"anchor_value": anchor, "evidence_text": tx.evidence_lines(F.col("evidence")), "prompt_text": F.concat_ws("\n\n", base, sentence, F.col("question"), F.lit(INSTRUCTION)), "_before": F.length(base)})
    at = F.col("_before") + 1 + F.instr(sentence, anchor.cast("string"))
    df = df.withColumn("anchor_start", F.when(F.col("anchor_value").isNotNull(), at)).withColumn("prompt_hash", tx.prompt_hash(F.col("prompt_text")))
    return df.select("item_id", "domain", "difficulty", "offset", "condition", "relevance", "anchor_value", "anchor_start", "scenario", "evidence_text", "question", "prompt_text", "prompt_hash", "y_star")


def _recomputed_gold(specs: DataFrame, seen: Column) -> Column:
    """The gold answer by each item's own rule (``rule`` column, mean where there is none) and the standard weights."""
    mean = gold_answer(seen)
    if "rule" not in specs.columns:
        return mean
    weights, out = F.array(*map(F.lit, WEIGHTS)), mean
    for rule in RULES:
        if rule != "mean":
            out = F.when(F.col("rule") == rule, gold_answer(seen, rule, weights)).otherwise(out)
    return out


def spec_checks(specs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Specs with what the checks share, and by error: out-of-range values, wrong numbers of missing ratings, gold that differs from its recomputation."""
    seen = F.col("_seen")
    return specs.withColumn("_seen", visible(F.col("evidence"))), {
        "theta out of range": ~F.col("theta").between(30, 70),
        "difficulty unknown": ~F.col("difficulty").isin(*SPREAD),
        "gold out of range": ~F.col("y_star").between(0, 100),
        "offset unknown": F.col("offset").isNotNull() & ~F.col("offset").isin(*OFFSETS),
        "anchor out of range": ~F.col("anchor_low").between(0, 100) | ~F.col("anchor_high").between(0, 100),
        "missing ratings": F.size(F.col("evidence")) - F.size(seen) != F.create_map(*[F.lit(x) for kv in MISSING.items() for x in kv])[F.col("difficulty")],
        "rating out of range": F.exists(seen, lambda v: ~v.between(0, 100)),
        "gold differs": F.col("y_star") != _recomputed_gold(specs, seen),
    }


def validate_specs(specs: DataFrame) -> DataFrame:
    """(item_id, error) of ``spec_checks``."""
    specs, checks = spec_checks(specs)
    errors = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))
    return specs.select("item_id", F.explode(errors).alias("error"))


def validate_views(views: DataFrame, required: Sequence[str] = (CONTROL, *CORE_ANCHORED)) -> DataFrame:
    """(item_id, error): missing conditions, parts that differ from control, unequal anchors, anchored controls, repeats."""
    by = F.col("condition")
    pair = [F.max(F.when(by == f"{r}_{d}", F.col("anchor_value"))) for d in ("low", "high") for r in ("irrelevant", "plausible")]
    same = [F.count_distinct(c) > 1 for c in ("scenario", "evidence_text", "question")]
    row_bad = (F.substring("prompt_hash", 1, 23) != tx.prompt_hash(F.col("prompt_text"))) | ~F.col("prompt_text").contains(INSTRUCTION)
    got = views.groupBy("item_id").agg(
        F.collect_set("condition").alias("_c"), F.count("*").alias("_n"), F.count_distinct("condition").alias("_nc"), F.count_distinct("prompt_hash").alias("_nh"),
        (same[0] | same[1] | same[2]).alias("_differs"), (~pair[0].eqNullSafe(pair[1]) | ~pair[2].eqNullSafe(pair[3])).alias("_unequal"),
        F.bool_or((by == CONTROL) & F.col("anchor_value").isNotNull()).alias("_anchored"), F.bool_or(row_bad).alias("_row"),
    )
    checks = {
        "condition missing": F.size(F.array_except(F.array(*map(F.lit, required)), "_c")) > 0,
        "differs from control": F.col("_differs"), "anchors unequal": F.col("_unequal"), "control has an anchor": F.col("_anchored"),
        "hash or instruction wrong": F.col("_row"), "view repeated": F.col("_n") > F.col("_nc"), "prompts equal": F.col("_nh") < F.col("_nc"),
    }
    return got.select("item_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))).alias("error"))


def imbalance(df: DataFrame, by: str) -> DataFrame:
    """Counts of a column's values beside whether the largest is over twice the smallest (one row)."""
    return df.groupBy(by).agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") > 2 * F.min("n")).alias("imbalanced"))


def manifest(views: DataFrame) -> DataFrame:
    """One row: counts of views and items, sorted domains, conditions, conditions per item."""
    return views.agg(F.count("*").alias("n_views"), F.count_distinct("item_id").alias("n_items"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("domains"), F.array_join(F.array_sort(F.collect_set("condition")), ",").alias("conditions"), F.floor(F.count("*") / F.count_distinct("item_id")).alias("conditions_per_item"))


def export_rows(views: DataFrame, specs: DataFrame, split: str = "test") -> DataFrame:
    """Public rows: each view with its item's gold; an item without a spec is an error, whatever columns are asked for."""
    own = specs.select("item_id", F.col("y_star").alias("y_star_evidence"), F.lit(True).alias("_known"))
    got = views.drop("y_star").join(own, "item_id", "left").where(require(F.col("_known"), F.concat(F.lit("no spec for "), "item_id")))
    polarity = F.when(F.col("condition").startswith("control"), None).otherwise(F.substring_index("condition", "_", -1))
    return got.select("item_id", "condition", "relevance", polarity.alias("anchor_polarity"), "anchor_value", "offset", "difficulty", "domain", "prompt_text", "y_star_evidence", F.lit(split).alias("split"))


#: Ranges of row hashes whose digests two releases compare; a list of ranges is broadcast.
DIGEST_RANGES = 1 << 16


def range_digests(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(_range, n, a, b): rows of each range of row hashes, and two sums of further hashes of them, which add up over parts of a table.

    Tables with equal digests hold the same rows with the same repeats (but for odds near 1 in 2 to the 128). A release can
    keep its digests beside it, so that a later comparison reads only those.
    """
    columns = list(columns or df.columns)
    hashed = [F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)") for k in (1, 2)]
    return df.groupBy(_range(columns).alias("_range")).agg(F.count("*").alias("n"), F.sum(hashed[0]).alias("a"), F.sum(hashed[1]).alias("b"))


def _range(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(DIGEST_RANGES))


def changed_ranges(released: DataFrame, built: DataFrame) -> DataFrame:
    """Ranges whose digests differ, DIGEST_RANGES at most."""
    other = built.select(F.col("_range"), F.struct("n", "a", "b").alias("_other"))
    both = released.join(other, "_range", "full")
    return both.where(~F.struct("n", "a", "b").eqNullSafe(F.col("_other"))).select("_range")


def stale_rows(released: DataFrame, built: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """Rows that only one of two releases has (side -1: released only, 1: built only), counted with repeats.

    Both are read for digests of their ranges (``digests`` are the released side's stored ones), and only rows of ranges
    that differ are shuffled and compared.
    """
    columns = built.columns
    released = released.select(*columns)
    ranges = F.broadcast(changed_ranges(digests if digests is not None else range_digests(released), range_digests(built)))
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    old, new = (df.select(whole, _range(columns).alias("_range")).join(ranges, "_range", "left_semi").select("_row.*") for df in (released, built))
    return old.exceptAll(new).withColumn("side", F.lit(-1)).unionByName(new.exceptAll(old).withColumn("side", F.lit(1)))
