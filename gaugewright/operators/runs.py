"""Whole runs as functions: a suite or a probe in, its records and metrics per cell out. Nothing runs before an action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CONTROL, CORE_ANCHORED, TWO_STAGE
from ..sources.committed import write_run
from .analysis import curve
from .inference import Backend, run_single_stage, run_two_stage, sends_plain_tools
from .metrics import unified_metrics
from .paired import by_visible_count, realism_of, splice, with_baseline
from .suites import SUFFIXES, TOOLS, VARIANTS, suite_views, tool_messages, with_suffix

CELL = ["model_id", "suite"]


#: Rows of one part of a spliced run, most: places of a part stay below this.
PART_ROWS = 1 << 50


def evaluation_rows(records: DataFrame) -> DataFrame:
    """Records under the names that paired metrics read: item, answer, anchor, gold, and ``pos``, a long.

    ``pos`` goes by ``part`` (a spliced run's core is before its new records) and then by ``place`` (the line's place in its
    file, see ``read_jsonl``), where records have these columns; rows that have neither are taken to be one per view.
    """
    part = F.coalesce(F.col("part"), F.lit(0)).cast("long") if "part" in records.columns else F.lit(0).cast("long")
    place = F.coalesce(F.col("place"), F.lit(0)).cast("long") if "place" in records.columns else F.lit(0).cast("long")
    columns = {"item": F.col("item_id"), "answer": F.col("answer_int"), "anchor": F.col("anchor_value"), "gold": F.col("y_star"), "pos": part * PART_ROWS + place}
    rows = records.withColumns(columns)
    return rows.withColumn("stage1", F.col("stage1_answer")) if "stage1_answer" in records.columns else rows


def run_suite(specs: DataFrame, suite: str, backend: Backend, model_id: str, done: DataFrame | None = None, plain_tools: bool = False) -> DataFrame:
    """Records of a suite's views. History is asked in two turns. Tool views are asked as messages with calls and results,
    or as plain prompts if ``plain_tools`` says so, the model's family has no role for tools or the backend sends none.
    """
    views = suite_views(specs, suite)
    if suite == "history":
        part = lambda n: F.col("components")[n]
        two = views.withColumns({"stage1_prompt": F.coalesce(part("stage1_user_message"), F.col("prompt_text")), "stage2_prompt": part("stage2_user_message")})
        if done is not None:
            two = two.join(done.select("item_id", "condition").distinct(), ["item_id", "condition"], "left_anti")
        return run_two_stage(two, backend, model_id)
    if suite == "tool" and not sends_plain_tools(model_id, backend, plain_tools):
        return run_single_stage(tool_messages(views), backend, model_id, done, messages="messages", tools=TOOLS)
    return run_single_stage(views, backend, model_id, done)


def suite_metrics(records: DataFrame, suite: str, two_stage: bool = False) -> DataFrame:
    """Metrics per model and suite; ``two_stage`` sets history against its two-stage control where there is one."""
    rows = evaluation_rows(records)
    if suite == "history" and two_stage:
        rows = with_baseline(rows, CELL, TWO_STAGE)
    return unified_metrics(rows, CELL)


def run_strategies(specs: DataFrame, suite: str, backend: Backend, model_id: str, names: Sequence[str] = tuple(SUFFIXES)) -> DataFrame:
    """Records of a suite under each prompt suffix, with its name in ``mitigation``."""
    strategies = specs.sparkSession.createDataFrame([(n,) for n in names], "mitigation string")
    views = suite_views(specs, suite).crossJoin(strategies)
    return run_single_stage(with_suffix(views, F.col("mitigation")), backend, model_id)


def run_sampling(specs: DataFrame, suite: str, backend: Backend, model_id: str, temperatures: Sequence[float], seeds: Sequence[int], top_p: float = 0.9) -> DataFrame:
    """Records of a suite per temperature and seed; temperature 0 is greedy and has seed 0 alone.

    The backend gets temperature, seed_idx and top_p of each request as its settings. ``tag`` names the setting as result
    folders do: greedy, or t<temperature>_s<seed>.
    """
    settings = [(0.0, 0, 1.0, "greedy")] * (0.0 in temperatures) + [(t, s, top_p, f"t{t}_s{s}") for t in temperatures if t for s in seeds]
    drawn = specs.sparkSession.createDataFrame(settings, "temperature double, seed_idx int, top_p double, tag string")
    return run_single_stage(suite_views(specs, suite).crossJoin(F.broadcast(drawn)), backend, model_id, settings=("temperature", "seed_idx", "top_p"))


def run_variant(specs: DataFrame, kind: str, backend: Backend, model_id: str, core: DataFrame | None = None) -> DataFrame:
    """Records of a variant's views (realism, intensity, partial evidence), after the core run's controls and anchored records if given."""
    new = run_single_stage(suite_views(specs, kind), backend, model_id)
    return new if core is None else splice(core, new, (CONTROL, TWO_STAGE, *CORE_ANCHORED))


def variant_curve(records: DataFrame, kind: str) -> DataFrame:
    """Mean pull per level of a variant: realism tags, or mild, plain and strong intensity."""
    c = F.col("condition")
    if kind.endswith("_realism"):
        level = realism_of(c, sorted({n.split("_", 2)[2] for n in VARIANTS[kind][1]}, key=len))
    else:
        level = F.when(c.startswith("plausible_mild"), "mild").when(c.startswith("plausible_strong"), "strong").when(c.isin("plausible_low", "plausible_high"), "plain")
    return curve(evaluation_rows(records), CELL, level)


def partial_evidence_metrics(records: DataFrame) -> DataFrame:
    """Metrics per model, suite and number of visible ratings."""
    return unified_metrics(evaluation_rows(by_visible_count(records)), [*CELL, "k"])


def finish(records: DataFrame, metrics: DataFrame, path: str, config: dict | None = None) -> None:
    """Write a run: records as JSON lines by cell, then, committed together, a summary per cell, one table of all and the run's configuration."""
    records.write.mode("overwrite").partitionBy(*CELL).json(f"{path}/records")
    write_run(metrics, f"{path}/summaries", CELL, config)
