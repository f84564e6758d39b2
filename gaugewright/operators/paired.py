"""Pairing each anchored answer with its item's control: last-wins rows, wide item tables, completeness, open tasks.

Records have columns item, condition, pos (any ordered type), answer, anchor, gold, parsed_ok and the cell columns named
by ``cell``. A later row of the same (cell, item, condition) replaces an earlier one, among parsed rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.influence import item_uai, toward_anchor
from ..schemas import CONTROL, CORE_ANCHORED, EPSILON, TWO_STAGE
from ..session import written
from ..sources.files import require


def last_wins(records: DataFrame, cell: Sequence[str], keep: Sequence[str] = ("answer", "anchor", "gold")) -> DataFrame:
    """One row per (cell, item, condition): the parsed one of the highest ``pos``. Partial aggregates run before the shuffle."""
    keys = [*cell, "item", "condition"]
    rows = records.where("parsed_ok").groupBy(*keys)
    if _fixed_width(records, "pos", *keep):
        return rows.agg(*[F.max_by(c, "pos").alias(c) for c in keep])
    return rows.agg(F.max_by(F.struct(*keep), F.col("pos")).alias("r")).select(*keys, "r.*")


def _fixed_width(df: DataFrame, *columns: str) -> bool:
    """Whether all columns are of types that a hash aggregate updates in place; others make Spark sort the rows first."""
    return all(t in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp") for c, t in df.dtypes if c in columns)


def item_table(records: DataFrame, cell: Sequence[str], conditions: Sequence[str] = (CONTROL, *CORE_ANCHORED), extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per (cell, item), wide: for each condition a struct (answer, anchor, gold, stage1) of its last parsed row.

    A condition that an item lacks has null fields. Give ``pos`` a number or a time: then nothing is sorted. One shuffle does dedup and control attachment. Also counts: n_records (all rows), n_answered (parsed with an answer)
    and has_parsed. ``extra`` adds aggregates per item.
    """
    fields = ["answer", "anchor", "gold", *(["stage1"] if "stage1" in records.columns else [])]
    counts = [
        F.count("*").alias("n_records"),
        F.count_if(F.col("parsed_ok") & F.col("answer").isNotNull()).alias("n_answered"),
        F.max(F.coalesce(F.col("parsed_ok"), F.lit(False))).alias("has_parsed"),
    ]
    at = {c: F.when(F.col("parsed_ok") & (F.col("condition") == c), F.col("pos")) for c in conditions}
    if _fixed_width(records, "pos", *fields):  # a value at a time: a hash aggregate
        wide = [F.struct(*[F.max_by(x, at[c]).alias(x) for x in fields]).alias(c) for c in conditions]
    else:
        wide = [F.max_by(F.struct(*fields), at[c]).alias(c) for c in conditions]
    more = [v.alias(k) for k, v in (extra or {}).items()]
    return records.groupBy(*cell, "item").agg(*counts, *wide, *more)


def effects(items: DataFrame, baseline: str = CONTROL, anchored: Sequence[str] = CORE_ANCHORED, epsilon: float = EPSILON) -> DataFrame:
    """Add ``uai_<c>`` and ``tar_<c>`` for each anchored condition of an item table, against ``baseline``."""
    y = F.col(f"{baseline}.answer")
    return items.withColumns({f"uai_{c}": item_uai(F.col(f"{c}.answer"), y, F.col(f"{c}.anchor"), epsilon) for c in anchored} | {f"tar_{c}": toward_anchor(F.col(f"{c}.answer"), y, F.col(f"{c}.anchor")) for c in anchored})


def long_effects(items: DataFrame, cell: Sequence[str], baseline: str = CONTROL, anchored: Sequence[str] = CORE_ANCHORED, epsilon: float = EPSILON) -> DataFrame:
    """One row per answered anchored condition with an answered control: condition, answer, anchor, control, gold, uai, tar."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"{c}.answer").alias("answer"), F.col(f"{c}.anchor").alias("anchor")) for c in anchored])).alias("r")
    rows = items.select(*cell, "item", F.col(f"{baseline}.answer").alias("control"), F.col(f"{baseline}.gold").alias("gold"), each).select(*cell, "item", "control", "gold", "r.*")
    rows = rows.where("control is not null and answer is not null and anchor is not null")
    return rows.withColumn("uai", item_uai(F.col("answer"), F.col("control"), F.col("anchor"), epsilon)).withColumn("tar", toward_anchor(F.col("answer"), F.col("control"), F.col("anchor")))


def baseline_choice(records: DataFrame, cell: Sequence[str], prefer: str = CONTROL, strict: bool = False) -> DataFrame:
    """Per cell the baseline condition: ``prefer`` if it occurs, else the other control if that does, else ``prefer``.

    ``strict``: a cell that has neither is an error.
    """
    other = TWO_STAGE if prefer == CONTROL else CONTROL
    seen = records.groupBy(*cell).agg(F.bool_or(F.col("condition") == prefer).alias("p"), F.bool_or(F.col("condition") == other).alias("o"))
    if strict:
        seen = seen.where(require(F.col("p") | F.col("o"), F.concat(F.lit("no baseline in "), F.to_json(F.struct(*cell)))))
    return seen.select(*cell, F.when(F.col("p"), prefer).when(F.col("o"), other).otherwise(prefer).alias("baseline"))


def complete_items(views: DataFrame, required: Sequence[str], cell: Sequence[str] = ()) -> DataFrame:
    """Items that have every required condition, with the number of conditions found."""
    kept = views.where(F.col("condition").isin(*required)).groupBy(*cell, "item").agg(F.collect_set("condition").alias("c"))
    return kept.where(F.size("c") == len(set(required))).select(*cell, "item", F.size("c").alias("n_conditions"))


def prepare_items(views: DataFrame, specs: DataFrame, required: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row per item that has every required condition: ``attributes`` of its alphabetically first one, and the spec in ``spec``.

    Items that lack a condition are left out (``complete_items`` counts the rest). A complete item without a spec is an error.
    """
    kept = views.where(F.col("condition").isin(*required)).groupBy("item_id").agg(F.count_distinct("condition").alias("_n"), F.min_by(F.struct(*attributes), "condition").alias("_a"))
    own = specs.select("item_id", F.struct(*[c for c in specs.columns if c != "item_id"]).alias("spec"), F.lit(True).alias("_known"))
    got = kept.where(F.col("_n") == len(set(required))).join(own, "item_id", "left")
    return got.where(require(F.col("_known"), F.concat(F.lit("no spec for "), "item_id"))).select("item_id", "_a.*", "spec")


def with_baseline(records: DataFrame, cell: Sequence[str], prefer: str = CONTROL, strict: bool = False, stored: bool = False) -> DataFrame:
    """Records whose ``condition`` says ``control`` where it is their cell's baseline (``baseline`` keeps its name).

    The other control keeps its place as ``control_twostage`` if it was chosen against, so metrics over ``control`` are
    metrics over each cell's own baseline. ``strict``: a cell without either control is an error. ``stored`` writes the
    records first: what they come from (a join, a parse) then runs once and not for the choice and the rows each.
    """
    records = written(records, "own-baseline") if stored else records
    chosen = baseline_choice(records, cell, prefer, strict)
    rows = records.join(chosen, list(cell))
    name = F.when(F.col("condition") == F.col("baseline"), CONTROL).when((F.col("condition") == CONTROL) & (F.col("baseline") != CONTROL), TWO_STAGE).otherwise(F.col("condition"))
    return rows.withColumn("condition", name)


def tasks(items: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every item under every condition; Spark broadcasts the conditions if they are few."""
    return items.crossJoin(conditions)


def open_tasks(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without a finished record."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def seeded_items(items: DataFrame, n: int, seed: int = 42, key: str = "item") -> DataFrame:
    """``n`` items in a seeded random order (``ord`` from 0): the same ones for every run, partitioning and engine restart."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    head = items.select(key).distinct().withColumn("_u", draw).orderBy("_u").limit(n)
    return head.select(key, (F.row_number().over(W.orderBy("_u")) - 1).alias("ord"))


def split_ablations(views: DataFrame, core: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Views of core conditions, and of all others."""
    is_core = F.col("condition").isin(*core)
    return views.where(is_core), views.where(~is_core)


def by_visible_count(records: DataFrame) -> DataFrame:
    """Rows ``uncertain_p<k>_<condition>`` as (k, condition); others go."""
    found = F.regexp_extract("condition", r"^uncertain_p(\d+)_(.+)$", 1)
    return records.where(found != "").withColumn("k", found.cast("int")).withColumn("condition", F.regexp_extract("condition", r"^uncertain_p(\d+)_(.+)$", 2))


def realism_of(condition: Column, variants: Sequence[str]) -> Column:
    """``baseline`` for a bare ``_low`` or ``_high``, else the first of ``variants`` that ends the name, else null."""
    out = F.when(condition.rlike("^(plausible|irrelevant)_(low|high)$"), "baseline")
    for v in variants:
        out = out.when(condition.endswith(f"_{v}"), v)
    return out


def keep_first(rows: DataFrame, keys: Sequence[str], place: Sequence[str]) -> DataFrame:
    """Of rows with equal keys (null is a key) the first by ``place``, which tells rows of a key apart; partial aggregates run before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*place)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def splice(core: DataFrame, new: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Core records of the kept conditions, then new ones: ``part`` 0 and 1 go before ``pos``."""
    core = core if keep is None else core.where(F.col("condition").isin(*keep))
    return core.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)), allowMissingColumns=True)
