"""Rendering and text helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "(not reported)"


def prompt_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, 16))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-")


def item_id(prefix: Column, domain: Column, difficulty: Column, offset: Column, n: Column) -> Column:
    return F.concat_ws("-", prefix, domain, F.substring(difficulty, 1, 1), F.concat(F.lit("off"), F.format_string("%02d", offset)), F.format_string("%03d", n))


def evidence_lines(evidence: Column, show_missing: bool = True) -> Column:
    """``- label: value`` lines of array<struct<label,value,missing>>."""
    kept = evidence if show_missing else F.filter(evidence, lambda e: ~e["missing"])
    lines = F.transform(kept, lambda e: F.concat(F.lit("- "), e["label"], F.lit(": "), F.when(e["missing"], F.lit(MISSING)).otherwise(e["value"].cast("string"))))
    return F.array_join(lines, "\n")


def document_block(docs: Column) -> Column:
    """Numbered ``[Document i]`` blocks of an array of texts."""
    return F.array_join(F.transform(docs, lambda d, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("] "), d)), "\n")


def insert_at_rank(docs: Column, doc: Column, rank: Column) -> Column:
    """``docs`` with ``doc`` at 1-based ``rank``, which is clamped to the list's ends."""
    at = F.greatest(F.lit(1), F.least(rank, F.size(docs) + 1)).cast("int")
    return F.concat(F.slice(docs, F.lit(1), at - 1), F.array(doc), F.slice(docs, at, F.greatest(F.size(docs) - at + 1, F.lit(0))))


def anchor_span(prompt: Column, value: Column) -> Column:
    """[start, stop) of the value's digits in a prompt in code points; null where they don't occur."""
    at = F.instr(prompt, value.cast("string"))
    return F.when(at > 0, F.array(at - 1, at - 1 + F.length(value.cast("string"))))


def flatten_turns(turns: Column) -> Column:
    """Role-marked turns as one text."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n\n")


def reference_json(source: Column, value: Column, note: Column) -> Column:
    """A tool's reference object with a blank after each comma and colon; null values are left out."""
    quoted = [F.concat(F.lit(f'"{k}": '), F.to_json(F.struct(v.alias("v")))) for k, v in (("source", source), ("note", note))]
    strings = [F.regexp_replace(q, r': \{"v":(.*)\}$', ": $1") for q in quoted]
    parts = F.array(strings[0], F.when(value.isNotNull(), F.concat(F.lit('"value": '), value.cast("string"))), strings[1])
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", "), F.lit("}"))


def scored_document_block(docs: Column, scored: Column) -> Column:
    """Numbered blocks of texts; where ``scored``, each has a score that falls by 0.13 from 1.00 on."""
    def block(d: Column, i: Column) -> Column:
        score = F.format_string(" | relevance=%.2f", F.round(1.0 - F.lit(0.13) * i, 2))
        return F.concat(F.lit("[Document "), (i + 1).cast("string"), F.when(scored, score).otherwise(""), F.lit("]\n"), d)

    return F.array_join(F.transform(docs, block), "\n\n")
