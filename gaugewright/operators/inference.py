"""Model runs as batch jobs: prompts or chats in, parsed records out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import parse_response


class ChatBackend(Protocol):
    """A model that reads more than prompts. Every method answers its list in order; ``settings`` has a dict per request (empty where a run has no settings)."""

    #: Whether messages of tools can be sent; else their results have to stand in the prompt.
    supports_tools: bool

    def __call__(self, prompts: list[str], settings: list[dict] | None = None) -> list[str]: ...

    def chat(self, messages: list[list[dict]], settings: list[dict], tools: list[dict] | None = None) -> list[str]: ...


#: A model: a plain function from prompts to answers (asked with settings as second argument where a run has some) or a ChatBackend.
Backend = Callable[..., list[str]]


def fake_backend(prompts: list[str], settings: list[dict] | None = None) -> list[str]:
    """Deterministic answers for tests: the prompt's length modulo 101."""
    return [f"My final answer is {len(p) % 101}." for p in prompts]


def generate(df: DataFrame, backend: Backend, prompt: str = "prompt_text", out: str = "raw_text", settings: Sequence[str] = (), messages: str | None = None, tools: list[dict] | None = None) -> DataFrame:
    """Add the backend's answer to each row, batch by batch; a batch with another number of answers is an error.

    Rows are asked their prompt, or their ``messages`` (an array of structs; null fields are left out) through the
    backend's ``chat``. The columns ``settings`` go with each request as a dict.
    """
    source = df.drop(out)
    schema = source.select("*", F.lit("").alias(out)).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name: batch.column(names.index(name)).to_pylist()
            each = [dict(zip(settings, v)) for v in zip(*map(column, settings))] if settings else [{}] * batch.num_rows
            if messages:
                chats = [[{k: v for k, v in m.items() if v is not None} for m in chat or []] for chat in column(messages)]
                answers = backend.chat(chats, each, tools)
            else:
                prompts = [p or "" for p in column(prompt)]
                answers = backend(prompts, each) if settings else backend(prompts)
            if len(answers) != batch.num_rows:
                raise ValueError(f"{len(answers)} answers to {batch.num_rows} prompts")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=names)

    return source.mapInArrow(run, schema)


#: Longer failed texts are shown to a fallback by their first and last characters only.
FALLBACK_MOST, FALLBACK_HEAD, FALLBACK_TAIL = 1500, 200, 1200


def parsed_records(df: DataFrame, raw: str = "raw_text", prompt: str = "prompt_text", fallback: Backend | None = None) -> DataFrame:
    """Add answer_int, parsed_ok and parse_strategy by the cascade. ``fallback`` is asked for the number in texts that fail
    it (of at least 2 characters); its first whole number counts if it is from 0 to 100, as ``llm_fallback``."""
    p = parse_response(F.col(raw), F.col(prompt))
    got = df.withColumn("_p", p).select("*", F.col("_p.answer").alias("answer_int"), F.col("_p.ok").alias("parsed_ok"), F.col("_p.strategy").alias("parse_strategy")).drop("_p")
    if fallback is None:
        return got
    text = F.trim(F.col(raw))
    short = F.when(F.length(text) > FALLBACK_MOST, F.concat(F.substring(text, 1, FALLBACK_HEAD), F.lit("\n...\n"), F.right(text, F.lit(FALLBACK_TAIL)))).otherwise(text)
    failed = F.coalesce((F.col("parse_strategy") == "failed") & (F.length(text) >= 2), F.lit(False))
    asked = generate(got.where(failed).withColumn("_q", F.concat(F.lit("Which number from 0 to 100 does this text settle on? Reply with it, or NONE.\n\n"), short)), fallback, "_q", "_r")
    number = F.regexp_extract("_r", r"\b(\d+)\b", 1).try_cast("int")
    found = F.when(F.upper(F.trim("_r")) != "NONE", F.when(number.between(0, 100), number))
    asked = asked.withColumns({"answer_int": found, "parsed_ok": found.isNotNull(), "parse_strategy": F.when(found.isNotNull(), "llm_fallback").otherwise("failed")})
    return got.where(~failed).unionByName(asked.select(*got.columns))


def run_single_stage(views: DataFrame, backend: Backend, model_id: str, done: DataFrame | None = None, settings: Sequence[str] = (), messages: str | None = None, tools: list[dict] | None = None) -> DataFrame:
    """Records of all views that ``done`` has no record of (by item and condition); settings, messages and tools as ``generate``."""
    todo = views if done is None else views.join(done.select("item_id", "condition").distinct(), ["item_id", "condition"], "left_anti")
    return parsed_records(generate(todo, backend, settings=settings, messages=messages, tools=tools)).withColumn("model_id", F.lit(model_id))


def run_two_stage(views: DataFrame, backend: Backend, model_id: str, first: str = "stage1_prompt", second: str = "stage2_prompt") -> DataFrame:
    """Ask the first prompt, then the second with the first answer as context; the first answer is the anchor of anchored rows.

    Views without a second prompt are single turns (controls). Views without a first prompt fail as MISSING_STAGE_COMPONENTS.
    """
    stage1 = generate(views, backend, first, "stage1_raw_text")
    got = stage1.withColumn("_s", parse_response(F.col("stage1_raw_text"), F.col(first))).withColumn("stage1_answer", F.col("_s.answer")).drop("_s")
    context = F.concat(F.col(first), F.lit("\n\n"), F.col("stage1_raw_text"), F.lit("\n\n"), F.col(second))
    got = generate(got.withColumn("prompt_text", F.coalesce(context, F.col(first))), backend)
    got = got.withColumn("raw_text", F.when(F.col(first).isNull(), F.lit("MISSING_STAGE_COMPONENTS")).when(F.col(second).isNull(), F.col("stage1_raw_text")).otherwise(F.col("raw_text")))
    anchored = F.col("condition").rlike("^(plausible|irrelevant)_")
    got = got.withColumn("anchor_value", F.when(anchored, F.col("stage1_answer"))).withColumn("stage1_answer", F.when(F.col(second).isNotNull(), F.col("stage1_answer")))
    return parsed_records(got).withColumn("model_id", F.lit(model_id))


def routed(models: DataFrame, hosted: Sequence[str], known_hosted: Sequence[str] = ()) -> DataFrame:
    """Add ``is_hosted``: by the declared backend, by name where none is declared."""
    declared = F.lower(F.coalesce("backend", F.lit("")))
    by_name = F.coalesce(F.col("model_id").isin(*known_hosted), F.lit(False)) if known_hosted else F.lit(False)
    return models.withColumn("is_hosted", F.when(declared != "", declared.isin(*hosted)).otherwise(by_name))


#: Families whose chat templates have no role for tools.
PLAIN_FAMILIES = ("gemma", "olmo")


def sends_plain_tools(model_id: str, backend: Backend, asked: bool = False) -> bool:
    """Whether a run puts tool results into the prompt: as asked, by family, or because the backend has no tool messages."""
    return asked or any(f in model_id.lower() for f in PLAIN_FAMILIES) or not getattr(backend, "supports_tools", hasattr(backend, "chat"))


def plain_tool_prompts(models: DataFrame, asked: bool = False, families: Sequence[str] = PLAIN_FAMILIES) -> DataFrame:
    """Add ``plaintext``: whether tool results go into the prompt, as asked, by family, or where the backend has no tool messages."""
    family = F.lit(False)
    for f in families:
        family = family | F.lower("model_id").contains(f)
    return models.withColumn("plaintext", F.lit(asked) | family | ~F.coalesce("supports_tools", F.lit(True)))


def unfinished_cells(cells: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells without a summary: what a rerun has to do."""
    return cells.join(summaries.select(*keys).distinct(), list(keys), "left_anti")
