"""The answer cascade as Column expressions: a number from 0 to 100 out of free text, and the tier that found it.

Tiers in order: structured, xml_tag, final_answer; a declared but invalid answer or a text that breaks off ends the
cascade; then regex, last_number; else failed. Values out of range are never clamped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that define the tiers.
NUMBER = r"-?\d+(?:\.\d+)?"
WHOLE = r"(?<![\d.])-?\d+(?!\d)(?!\.\d)"
STATED = r"(?i)(?:is|=|:\s*)\s*(\d{1,3})\s*(?:[.\s\n]|$)"
XML = r"(?i)<answer>\s*(-?\d+(?:\.\d+)?)\s*</answer>"
STRICT = (
    r"(?i)(?:final\s+answer|my\s+(?:final\s+)?(?:answer|estimate))\s*(?:is|:)\s*(\d{1,3})",
    r"(?i)(?:the\s+answer\s+is|answer\s*:)\s*(\d{1,3})",
    r"(?i)Answer:\s*\[?(\d{1,3}(?:\.\d+)?)\]?",
    r"(?i)(?:overall|estimated|composite)\s+\S+\s+(?:index|score|rating)\s+(?:is\s*:?|=|:)\s*(?:approximately\s+|about\s+|around\s+)?(\d{1,3})",
    r"(?i)(?:overall\s+)?(?:willingness-to-pay|WTP)\s+index\s+(?:is\s*:?|=|:)\s*(?:approximately\s+|about\s+|around\s+)?(\d{1,3})",
    r"(?m)\*\*(\d{1,3})\*\*\s*$",
)
TAIL = (
    r"(?i)(?<!maximum\s)(?<!minimum\s)(?<!average\s)\bindex\s+is\s*:?\s*(?:approximately\s+|about\s+|around\s+)?(\d{1,3})\b",
    r"(?i)(?:therefore|thus|hence|so|,)\s+(?:the\s+)?(?:overall\s+)?(?:willingness-to-pay\s+)?(?:index|estimate|rating|score)\s+(?:is\s*:?|=|:)\s*(\d{1,3})\b",
)
TAIL_CHARS = 520
TOOL_CALL = r"(?i)^\s*\{[\"\s]*name[\"\s]*:"
OPEN_ENDINGS = [
    "of", "the", "a", "an", "to", "and", "or", "with", "that", "which", "when", "if", "as", "by", "for", "in", "on", "at", "from", "into", "would",
    "could", "should", "will", "can", "may", "might", "be", "is", "are", "was", "were", "have", "has", "had", "do", "does", "did", "following",
    "using", "considering", "assuming", "average", "sum", "total", "where", "while", "however", "although", "because",
]
ENDINGS = (".", "!", "?", ")", "]", "</answer>", '"')
LEAST_CHARS = 100

_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _SPACE, "")


def in_range(value: Column) -> Column:
    return F.when(value.between(0, 100), value.cast("int"))


def _rounded(text: Column) -> Column:
    return F.bround(text.try_cast("double"), 0)


def _last_or_null(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.get(found, F.size(found) - 1)


def parse_structured(raw: Column) -> Column:
    """``answer`` of a text that is one JSON object: whole numbers in range; strings and fractions are refused, true is 1."""
    doc = F.try_parse_json(raw)
    kind = F.schema_of_variant(F.try_variant_get(doc, "$.answer", "variant"))
    number = F.try_variant_get(doc, "$.answer", "double")
    whole = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)), number)
    flag = F.when(kind == "BOOLEAN", F.try_variant_get(doc, "$.answer", "boolean").cast("double"))
    return F.when(F.schema_of_variant(doc).startswith("OBJECT"), in_range(F.coalesce(whole, flag)))


def parse_xml(raw: Column) -> Column:
    return in_range(_rounded(_last_or_null(raw, XML)))


def is_tool_call(raw: Column) -> Column:
    return strip(raw).rlike(TOOL_CALL)


def parse_final_answer(raw: Column) -> Column:
    """Declared answers: strict phrases anywhere, then looser ones near the end; per phrase its last match counts."""
    text = strip(raw)
    end = F.right(text, F.lit(TAIL_CHARS))
    found = [in_range(_rounded(_last_or_null(text, p))) for p in STRICT]
    return F.coalesce(*found, *[in_range(_rounded(_last_or_null(end, p))) for p in TAIL])


def declares_answer(raw: Column) -> Column:
    text = strip(raw)
    end = F.right(text, F.lit(TAIL_CHARS))
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in STRICT] + [end.rlike(p) for p in TAIL])


def breaks_off(raw: Column) -> Column:
    """Whether a long text stops in the middle of a sentence, on a word that asks for more."""
    text = F.regexp_replace(raw, r"(?U)\s+$", "")
    line = strip(F.substring_index(text, "\n", -1))
    word = F.regexp_replace(F.lower(F.regexp_extract(line, r"(?U)(\S+)$", 1)), r"[,;:'\"]+$", "")
    ended = reduce(lambda a, b: a | b, [text.endswith(e) for e in ENDINGS])
    return (F.length(text) >= LEAST_CHARS) & ~ended & ~text.rlike(r"\b\d{1,3}\s*$") & (line != "") & ~line.rlike(r"\d") & word.isin(OPEN_ENDINGS)


def _wholes(text: Column) -> Column:
    """Stand-alone whole numbers in range, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(WHOLE), F.lit(0)), lambda x: x.try_cast("int"))
    return F.filter(found, lambda x: x.between(0, 100))


def parse_integer(raw: Column, prompt: Column | None = None) -> Column:
    """The one number that a text can mean: alone, alone on the last line, last stated, or alone after the prompt's own go."""
    text = strip(raw)
    bare = F.when(text.rlike(r"^-?\d+$"), text.try_cast("long"))
    unique = F.array_distinct(_wholes(text))
    on_last = F.array_distinct(_wholes(F.substring_index(text, "\n", -1)))
    stated = F.filter(F.transform(F.regexp_extract_all(text, F.lit(STATED), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.between(0, 100))
    fresh = F.array_except(unique, _wholes(F.coalesce(prompt, F.lit("")))) if prompt is not None else None
    out = F.when(text.rlike(r"^-?\d+$"), in_range(bare)).when(F.size(unique) == 0, None).when(F.size(unique) == 1, F.get(unique, F.lit(0)))
    out = out.when(F.size(on_last) == 1, F.get(on_last, F.lit(0))).when(F.size(stated) > 0, F.get(stated, F.size(stated) - 1))
    if fresh is not None:
        out = out.when((F.coalesce(prompt, F.lit("")) != "") & (F.size(fresh) == 1), F.get(fresh, F.lit(0)))
    return F.when(~text.rlike(TOOL_CALL), out)


def parse_last_number(raw: Column) -> Column:
    """Last number in range on the last line that is not blank; else the very last number, if it is in range."""
    text = strip(raw)
    line = F.substring_index(text, "\n", -1)
    near = F.filter(F.transform(F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0)), lambda x: F.bround(x.try_cast("double"), 0)), lambda x: x.between(0, 100))
    return F.when(~text.rlike(TOOL_CALL), F.coalesce(in_range(F.get(near, F.size(near) - 1)), in_range(_rounded(_last_or_null(text, NUMBER, 0)))))


def parse_response(raw: Column, prompt: Column | None = None, structured: Column | None = None) -> Column:
    """struct<answer int, ok boolean, strategy string> of the cascade; null and empty texts fail."""
    raw = F.coalesce(raw, F.lit(""))
    tiers = [("structured", parse_structured(structured))] if structured is not None else []
    tiers += [("xml_tag", parse_xml(raw)), ("final_answer", parse_final_answer(raw))]
    late = [("regex", parse_integer(raw, prompt)), ("last_number", parse_last_number(raw))]

    def hit(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("answer"), F.lit(True).alias("ok"), F.lit(name).alias("strategy")))

    failed = F.struct(F.lit(None).cast("int").alias("answer"), F.lit(False).alias("ok"), F.lit("failed").alias("strategy"))
    stop = F.when(declares_answer(raw) | breaks_off(raw), failed)
    return F.coalesce(*[hit(n, v) for n, v in tiers], stop, *[hit(n, v) for n, v in late], failed)
