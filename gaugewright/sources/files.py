"""JSON lines, result trees, optional summaries, registries and small sinks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import ITEMSPECS, PROMPT_VIEWS, RECORDS


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str, strict: bool = True, places: bool = False) -> DataFrame:
    """JSON lines with the given schema, the file of each row in ``source_path``; blank lines are skipped.

    ``places`` adds ``place``, a long that grows along a file: the start of the line's split and its number there. (A split
    has fewer lines than bytes, and lines are counted over one task's splits, which together are no longer than one.)

    ``strict``: a malformed line is an error that names its file, whatever columns are asked for (the check is a filter
    over all columns, so column pruning can't drop it). Otherwise it is a row with ``_corrupt_record`` set.
    """
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path)
    read = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "_corrupt_record"]))
    df = df.withColumn("source_path", F.col("_metadata.file_path"))
    if places:
        df = df.withColumn("place", F.input_file_block_start() + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    if not strict:
        return df
    wrong = F.concat(F.lit("malformed line in "), F.col("source_path"), F.lit(": "), F.col("_corrupt_record"), F.lit(" read as "), read)
    return df.where(require(F.col("_corrupt_record").isNull(), wrong)).drop("_corrupt_record")


def require(condition: Column, message: Column) -> Column:
    """A filter that keeps every row and fails with the message at the first one that breaks the condition."""
    return F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def read_itemspecs(spark: SparkSession, path: str | list[str], schema: str = ITEMSPECS) -> DataFrame:
    """Item specs, the last line of each item; files go in the order of their names."""
    return _last_lines(read_jsonl(spark, path, schema), ["item_id"])


def read_prompt_views(spark: SparkSession, path: str | list[str], schema: str = PROMPT_VIEWS) -> DataFrame:
    """Prompt views, the last line of each item and condition."""
    return _last_lines(read_jsonl(spark, path, schema), ["item_id", "condition"])


def _last_lines(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key in file order: readers number rows in order inside a split, and splits of a file by their start."""
    place = F.struct(F.col("source_path"), F.col("_start"), F.col("_row"))
    rows = df.withColumn("_start", F.input_file_block_start()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("r")).select(*keys, "r.*")


def suite_file(names: Sequence[str], kind: str, full: bool = False) -> str:
    """Of a dataset folder's file names that of ``kind`` to read: core files first, the full one when asked, either if the other is missing."""
    wanted = [f"{kind}_core.jsonl", f"{kind}.jsonl"]
    for name in reversed(wanted) if full else wanted:
        if name in names:
            return name
    raise FileNotFoundError(f"no {kind} file among {sorted(names)}")


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = False) -> None:
    df.write.option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Finished records as a table hashed and sorted by ``keys``: joins on exactly these keys and groupings by them and more read it without a shuffle. Replaces the table."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def read_results(spark: SparkSession, base: str, suites: Sequence[str] | None = None, schema: str = RECORDS) -> DataFrame:
    """Records of a tree ``<base>/<suite>/<slug>[/<variant>]/results.jsonl`` with suite, slug and variant from the path.

    Folders that begin with an underscore are skipped. ``place`` is a row's place in its file.
    """
    df = read_jsonl(spark, f"{base.rstrip('/')}/*/*", schema, places=True).withColumnRenamed("suite", "record_suite")
    tail = F.regexp_extract("source_path", r"/([^/]+/[^/]+(?:/[^/]+)?)/[^/]+$", 1)
    rel = F.split(F.regexp_replace(F.replace("source_path", F.lit("file://"), F.lit("")), "^.*?" + _quoted(base.rstrip("/").replace("file://", "")) + "/", ""), "/")
    df = df.withColumns({"suite": F.get(rel, F.lit(0)), "slug": F.get(rel, F.lit(1)), "variant": F.when(F.size(rel) > 3, F.get(rel, F.lit(2)))}).where(~F.col("suite").startswith("_") & ~F.col("slug").startswith("_") & (tail != ""))
    return df if suites is None else df.where(F.col("suite").isin(*suites))


def list_results(spark: SparkSession, base: str, suites: Sequence[str], registry: DataFrame | None = None) -> DataFrame:
    """Result files of a tree as a list, without reading them: (ord, suite, slug, short, path).

    Files are ``<base>/<suite>/<slug>[/<variant>]/results.jsonl`` of the given suites, in their order, then by path; files
    at other depths don't count. ``short`` is the registry's name (slug, short), the slug where it has none.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "results.jsonl").load(base).select("path")
    root = _quoted(base.rstrip("/").removeprefix("file://").removeprefix("file:"))
    rel = F.split(F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), f"^.*?{root}/", ""), "/")
    order = F.create_map(*[F.lit(x) for i, name in enumerate(suites) for x in (name, i)])
    rows = found.select("path", rel.alias("_rel")).where(F.size("_rel").between(3, 4)).select("path", "_rel", F.get("_rel", F.lit(0)).alias("suite"), F.get("_rel", F.lit(1)).alias("slug"))
    rows = rows.withColumn("_suite", order[F.col("suite")]).where(F.col("_suite").isNotNull())
    rows = rows.withColumn("ord", F.row_number().over(W.orderBy("_suite", "_rel")) - 1)  # one row per result file
    names = registry if registry is not None else spark.createDataFrame([], "slug string, short string")
    return display_names(rows, names).select("ord", "suite", "slug", "short", "path")


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_summaries(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Summaries that are JSON objects or arrays, one file each."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_optional_summaries(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Summaries with their file; a file that isn't JSON gives a row with ``broken`` true and null values, not an error."""
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt_record").option("recursiveFileLookup", "true").json(path)
    return df.withColumn("source_path", F.col("_metadata.file_path")).withColumn("broken", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def panel(cells: DataFrame, summaries: DataFrame, keys: Sequence[str], at: Sequence[str] = ()) -> DataFrame:
    """Every cell of a fixed panel with its summary, nulls where it has none; ``at`` names path parts, last first, that hold the keys."""
    if at:
        parts = F.split("source_path", "/")
        summaries = summaries.withColumns({k: F.element_at(parts, -2 - i) for i, k in enumerate(at)})
    return cells.join(summaries, list(keys), "left")


def curves(summaries: DataFrame, keys: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Wide curve summaries (a mean and ``<level>_n`` for each level) as one row per key and level."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("level"), F.col(c).cast("double").alias("uai"), F.col(f"{c}_n").cast("long").alias("n")) for c in levels]))
    return summaries.select(*keys, each.alias("_r")).select(*keys, "_r.*")


def variants(summaries: DataFrame, keys: Sequence[str], variant: str, names: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per key with the metrics of each variant side by side (``<variant>_<metric>``); absent ones are null."""
    picks = [F.max(F.when(F.col(variant) == v, F.col(m))).alias(f"{v}_{m}") for v in names for m in metrics]
    return summaries.groupBy(*keys).agg(*picks)


def ordered_panel(spark: SparkSession, names: Sequence[str], key: str = "key") -> DataFrame:
    """A registry's panel as a dimension with its authoritative order in ``ord``."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"{key} string, ord int")


def merged_prices(live: DataFrame, stored: DataFrame, model: str = "model") -> DataFrame:
    """Stored prices, replaced by live ones where those are above 0; models of either side stay."""
    a = live.select(F.col(model), *[F.col(c).alias(f"_{c}") for c in ("price_in", "price_out")])
    pick = lambda c: F.when(F.col(f"_{c}") > 0, F.col(f"_{c}")).otherwise(F.col(c))
    return stored.join(a, model, "full").select(model, *[pick(c).alias(c) for c in ("price_in", "price_out")]).where("price_in is not null or price_out is not null")


def write_summaries(cells: DataFrame, path: str, keys: Sequence[str]) -> None:
    """A JSON summary per cell in ``<path>/cells/<key>=<value>/...`` and one table of all cells in ``<path>/all``, written by tasks."""
    cells.repartition(*keys).write.partitionBy(*keys).json(f"{path}/cells")
    cells.coalesce(1).sortWithinPartitions(*keys).write.json(f"{path}/all")


def prefer(rows: DataFrame, keys: Sequence[str], rank: str) -> DataFrame:
    """Of rows with equal keys that of the lowest rank (a full file before a core one, live prices before stored ones)."""
    rest = [c for c in rows.columns if c not in (*keys, rank)]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("r")).select(*keys, "r.*")


def display_names(df: DataFrame, registry: DataFrame, slug: str = "slug", name: str = "short") -> DataFrame:
    """Add the registry's short name, the slug itself where it has none."""
    dim = registry.select(F.col("slug").alias(slug), F.col(name))
    return df.join(dim, slug, "left").withColumn(name, F.coalesce(name, slug))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def write_report(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small report table as one CSV file with a header, in the given order."""
    df.orderBy(*order).coalesce(1).write.option("header", "true").csv(path)


def number(value: float | None, digits: int = 2, dash: str = "-", signed: bool = False, percent: bool = False) -> str:
    """Fixed-point text as Python rounds it, of a share as whole percent; a dash for null and what isn't finite."""
    if value is None or not math.isfinite(value):
        return dash
    if percent:
        return f"{round(value * 100):d}%"
    return f"{value:+.{digits}f}" if signed else f"{value:.{digits}f}"


def markdown(df: DataFrame, order: Sequence[str], digits: int = 4, most: int = 10_000) -> str:
    """A small report table (per-cell rows) as Markdown; nulls are dashes. More than ``most`` rows are an error: write those."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write the table instead")
    show = lambda v: "-" if v is None or v != v else f"{round(v, digits)}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def read_or_empty(spark: SparkSession, path: str, schema: str, suites: Sequence[str] | None = None) -> DataFrame:
    """JSON lines of a path that may not be there (then no rows), of the given suites."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    df = read_jsonl(spark, path, schema) if there else spark.createDataFrame([], f"{schema}, source_path string")
    return df if suites is None else df.where(F.col("suite").isin(*suites))
