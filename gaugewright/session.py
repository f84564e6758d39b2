"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it (a cluster ships it with the job)."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])
    return spark


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share. Local sessions get a temporary one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gaugewright-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and there for good when executors are lost."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(df: DataFrame, rows: int) -> int:
    """Number of tasks of about ``rows`` rows of ``df`` each, at least two a core."""
    return max(-(-df.count() // rows), 2 * df.sparkSession.sparkContext.defaultParallelism)


def spread(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt to tasks of about ``rows`` rows, at least two a core: for a small table (one file, one task) whose rows make much work."""
    return df.repartition(tasks_for(df, rows))
