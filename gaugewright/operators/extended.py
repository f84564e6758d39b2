"""Extended metrics per cell: vectors of pull by relevance group, their intervals, paired tests and adjusted probabilities.

Everything is one long frame of vectors (cell, vector, item, direction, value), so intervals and tests of all vectors of all
cells come from one pass each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.influence import direction_of, item_uai, relevance_of
from ..schemas import CONTROL, EPSILON, RELEVANCES, TWO_STAGE
from ..session import written
from .statistics import BOOT, SEED, bh_adjust, bootstrap_ci, wilcoxon

ORDER = ["item", "direction", "condition"]


def last_answers(records: DataFrame, cell: Sequence[str], tasks: int | None = None) -> DataFrame:
    """(cell, item, condition, answer, anchor, gold, pos) of each last parsed row, all of an item's in one partition.

    A task holds its rows' groups and sorts them; ``tasks`` (``adapters.line_tasks``) has to grow with the records for that to stay bounded.
    """
    key = [*cell, "item"]
    rows = records.where("parsed_ok").select(*key, "condition", "answer", "anchor", "gold", "pos").repartition(*([tasks] if tasks else []), *key)
    return rows.groupBy(*key, "condition").agg(*[F.max_by(c, "pos").alias(c) for c in ("answer", "anchor", "gold")], F.max("pos").alias("pos"))


def uai_vectors(records: DataFrame, cell: Sequence[str], baseline: str = CONTROL, epsilon: float = EPSILON, merge: bool = False, tasks: int | None = None) -> DataFrame:
    """(cell, grp, item, direction, condition, uai): pull of every anchored condition against its item's baseline answer.

    The group is the condition's relevance. ``merge`` keeps one value per (group, item, direction), that of the condition
    with the latest record, as sets of variants (mild, strong, ordered) share a direction. One shuffle by cell and item.
    """
    return _pulls(last_answers(records.withColumn("gold", F.lit(None).cast("int")), cell, tasks), cell, baseline, epsilon, merge)


def _pulls(last: DataFrame, cell: Sequence[str], baseline: str, epsilon: float, merge: bool) -> DataFrame:
    key = [*cell, "item"]
    control = F.max(F.when(F.col("condition") == baseline, F.col("answer"))).over(W.partitionBy(*key))
    grp = relevance_of(F.col("condition"))
    got = last.withColumn("control", control).where(grp.isNotNull()).withColumns({"grp": grp, "direction": direction_of(F.col("condition"))})
    got = got.withColumn("uai", item_uai(F.col("answer"), F.col("control"), F.col("anchor"), epsilon)).where("uai is not null")
    if merge:
        latest = F.row_number().over(W.partitionBy(*key, "grp", "direction").orderBy(F.desc("pos"), F.desc("condition")))
        got = got.withColumn("_r", latest).where("_r = 1")
    return got.select(*cell, "grp", "item", "direction", "condition", "uai")


def vectors(records: DataFrame, cell: Sequence[str], baseline: str = CONTROL, epsilon: float = EPSILON, tasks: int | None = None) -> DataFrame:
    """(cell, vector, item, direction, condition, value): ``uai_<group>``, ``disc_delta`` (plausible less irrelevant pull of
    an item and direction) and ``mae`` (the baseline's errors)."""
    return _vectors(last_answers(records, cell, tasks), cell, baseline, epsilon)


def _vectors(last: DataFrame, cell: Sequence[str], baseline: str, epsilon: float) -> DataFrame:
    uai = _pulls(last, cell, baseline, epsilon, merge=True)
    pulls = uai.select(*cell, F.concat(F.lit("uai_"), F.col("grp")).alias("vector"), *ORDER, F.col("uai").alias("value"))
    side = {g: F.max(F.when(F.col("grp") == g, F.col("uai"))) for g in ("plausible", "irrelevant")}
    pairs = uai.groupBy(*cell, "item", "direction").agg((side["plausible"] - side["irrelevant"]).alias("value")).where("value is not null")
    pairs = pairs.select(*cell, F.lit("disc_delta").alias("vector"), "item", "direction", F.lit("").alias("condition"), "value")
    errors = last.where(F.col("condition") == baseline).withColumn("value", F.abs(F.col("answer") - F.col("gold")).cast("double"))
    errors = errors.select(*cell, F.lit("mae").alias("vector"), "item", F.lit("").alias("direction"), F.lit(baseline).alias("condition"), "value")
    return pulls.unionByName(pairs).unionByName(errors.where("value is not null"))


def paired_tests(vecs: DataFrame, cell: Sequence[str], digits: int = 6) -> DataFrame:
    """(cell, vector, n, p, p_bh): signed-rank tests of each pull against 0 and of plausible against irrelevant (``disc_delta``).

    Probabilities are rounded before they are adjusted, and adjusted among the cell's non-null ones.
    """
    p = wilcoxon(vecs.where("vector != 'mae'"), [*cell, "vector"], "value").withColumn("p", F.round("p", digits))
    return bh_adjust(p.select(*cell, "vector", "n", "p"), cell, "p", ["vector"])


def intervals(vecs: DataFrame, cell: Sequence[str], n_boot: int = BOOT, seed: int = SEED, method: str = "exact") -> DataFrame:
    """(cell, vector, n, ci): number of values and struct(mean, lo, hi) of each vector, in full precision."""
    got = bootstrap_ci(vecs, [*cell, "vector"], "value", ["item", "direction"], n_boot, seed, method=method)
    return got.select(*cell, "vector", "n", F.struct("mean", "lo", "hi").alias("ci"))


def extended_metrics(records: DataFrame, cell: Sequence[str], baseline: str = CONTROL, epsilon: float = EPSILON, n_boot: int = BOOT, seed: int = SEED, method: str = "exact", tasks: int | None = None) -> DataFrame:
    """Per cell and vector: n, ci, p and p_bh; vectors against the two-stage control end in ``_ts`` where it isn't the baseline.

    A vector without values has no row; a cell without a two-stage control has no ``_ts`` rows. Records are read once: the
    last answers and the vectors are written tables, which tests and intervals share.
    """
    last = written(last_answers(records, cell, tasks), "last-answers")
    vecs = _vectors(last, cell, baseline, epsilon)
    if baseline != TWO_STAGE:
        ts = _pulls(last, cell, TWO_STAGE, epsilon, merge=True)
        vecs = vecs.unionByName(ts.select(*cell, F.concat(F.lit("uai_"), F.col("grp"), F.lit("_ts")).alias("vector"), *ORDER, F.col("uai").alias("value")))
    vecs = written(vecs, "vectors")
    tested = paired_tests(vecs.where(~F.col("vector").endswith("_ts")), cell).drop("n")
    return intervals(vecs, cell, n_boot, seed, method).join(tested, [*cell, "vector"], "left")


def wide(extended: DataFrame, cell: Sequence[str]) -> DataFrame:
    """One row per cell with ``<vector>_ci``, ``<vector>_n`` and ``<vector>_p_bh`` columns; vectors that a cell lacks are null."""
    names = [*(f"uai_{g}" for g in RELEVANCES), "disc_delta", "mae"]
    pick = lambda v, c: F.max(F.when(F.col("vector") == v, F.col(c)))
    return extended.groupBy(*cell).agg(*[pick(v, c).alias(f"{v}_{c}") for v in names for c in ("ci", "n", "p_bh")])
