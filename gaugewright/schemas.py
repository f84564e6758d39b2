"""Schemas of evaluation tables (as DDL) and the condition dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CONTROL, TWO_STAGE = "control", "control_twostage"
CORE_ANCHORED = ("irrelevant_low", "irrelevant_high", "plausible_low", "plausible_high")
CORE = (CONTROL, *CORE_ANCHORED)
EXTENDED = ("placebo_low", "placebo_high", "authority_low", "authority_high")
INTENSITY = ("plausible_mild_low", "plausible_mild_high", "plausible_strong_low", "plausible_strong_high")
#: Groups by substring, in order of precedence.
RELEVANCES = ("placebo", "authority", "neutral", "irrelevant", "plausible")
OFFSETS = (15, 25, 40)
EPSILON = 3.0

USAGE = "struct<prompt_tokens:long,completion_tokens:long,cost:double,completion_tokens_details:struct<reasoning_tokens:long>,prompt_tokens_details:struct<cached_tokens:long>>"

RECORDS = (
    "model_id string, item_id string, suite string, domain string, difficulty string, condition string, anchor_relevance string, "
    "anchor_value int, y_star_evidence int, y_star_theta int, answer_int int, parsed_ok boolean, parse_strategy string, raw_text string, "
    f"stage1_answer int, stage1_raw_text string, api_usage {USAGE}, temperature double, seed_idx int, mitigation string"
)

_EVIDENCE = "array<struct<type:string,value:int,value_raw:int,label:string,index:int,missing:boolean>>"
ITEMSPECS = (
    "item_id string, suite string, domain string, template_family string, theta int, y_star int, y_star_theta int, y_star_evidence int, "
    "difficulty string, anchors struct<low:int,high:int,gap:int,offset:int,anchor_type:string,relevance:string>, "
    f"evidence_structured {_EVIDENCE}, scenario_template_idx int, question_template_idx int, anchor_phrasing_idx int, "
    "evidence_label_family_idx int, scoring_function string, scoring_weights array<double>, render_version string, generator_version string, seed long"
)

PROMPT_VIEWS = (
    "item_id string, suite string, condition string, relevance string, anchor_value int, anchor_span array<int>, prompt_text string, prompt_hash string, "
    "prompt_components struct<scenario:string,evidence:string,question:string,answer_format:string,anchor_sentence:string,stage1_user_message:string,"
    "stage2_user_message:string,demos:array<string>,framing_intro:string,retrieved_docs:string,anchor_doc_id:string,reference_result:string>"
)


def conditions(spark: SparkSession) -> DataFrame:
    """The condition dimension: (name, relevance, direction, variant, is_control, is_core, ord)."""
    rows = []
    for name in (*CORE, TWO_STAGE, *EXTENDED, *INTENSITY, "neutral_low", "neutral_high"):
        parts = name.split("_")
        is_control = name in (CONTROL, TWO_STAGE)
        rows.append((name, "none" if is_control else parts[0], None if is_control else parts[-1], parts[1] if len(parts) == 3 and not is_control else None, is_control, name in CORE, len(rows)))
    return spark.createDataFrame(rows, "name string, relevance string, direction string, variant string, is_control boolean, is_core boolean, ord int")
