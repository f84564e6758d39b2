"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points per chunk that the array operators hold in memory at once (one longer text is a chunk by itself).
CHUNK_CHARS = 1_500_000
#: Words of 64 bits of the table of keys that spares other rows a shuffle; it is broadcast, whatever the input's size.
FILTER_WORDS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Local sessions (tests) get a temporary one where it is unset; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='gaugewright-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; ``GAUGEWRIGHT_TOKENIZERS`` overrides the installed package."""
    folder = os.environ.get("GAUGEWRIGHT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(values: list, sizes: list[int], limit: int = CHUNK_CHARS):
    """Ranges (start, stop) of consecutive values of at most ``limit`` units, one value at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(values):
        yield start, len(values)


def flagged(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Add ``maybe``: false only for rows whose long ``key`` is not among ``keys``. By a bitmap of FILTER_WORDS rows at most, without a shuffle of ``df``."""
    h = F.xxhash64(key)
    word, bit = F.pmod(h, F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int"))
    bits = keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return df.join(F.broadcast(bits), word == F.col("word"), "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "bits")


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not among ``keys``; only those that the bitmap can't clear are shuffled."""
    rows = flagged(df, keys, key)
    return rows.where("not maybe").drop("maybe").unionByName(rows.where("maybe").drop("maybe").join(keys, key, "left_anti"))
