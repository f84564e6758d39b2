"""The corpus pipeline: stages over `documents`, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewright.llm.bpe_automaton import encode_texts
from gaugewright.llm.common import materialize, table
from gaugewright.llm.language import UNKNOWN, fit_language_model, learnable, predict_language
from gaugewright.llm.mixing import mix
from gaugewright.llm.simhash import near_dedup

#: A document is rejected if its language is unknown or its posterior is below this.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; null texts and texts without a letter go."""
    model = fit_language_model(learnable(docs))
    marked = predict_language(docs, model)
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 rows."""
    mixed = mix(docs)
    return mixed.withColumn("mix_copies", F.explode(F.array_repeat(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian 32-bit), their digest, and that of the text they decode to."""
    encoded = encode_texts(docs.select("doc_id", "source", "text"), decoded_column="decoded")
    return encoded.select("doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

#: No stage but the mixing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
