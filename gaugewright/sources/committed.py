"""A reader of JSON lines that names the line of a malformed one, and a sink of runs that appear as a whole or not at all.

Both are Spark data sources: byte ranges are read and rows are written by tasks; only the sink's commit runs on the driver.
Paths are local or URIs of a store that pyarrow knows.
"""

from __future__ import annotations

import datetime
import json
import os
import subprocess
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.json as pajson
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import __version__

#: Bytes of a range, and of the lines that a task checks at once.
SPLIT_BYTES, CHECK_BYTES = 64 << 20, 4 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:")))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


class LinesReader(DataSourceReader):
    def __init__(self, paths: list[str], split: int):
        self.paths, self.split = paths, split

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            fs, at = _store(path)
            info = fs.get_file_info(at)
            if info.type == pafs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [info] if info.is_file else [f for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
            prefix = path[: len(path) - len(at)] if "://" in path and path.endswith(at) else ""
            for f in sorted(files, key=lambda f: f.path):
                out += [ByteRange(prefix + f.path, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
        return out

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range (none where there is nothing to read)."""
        if part is None:
            return
        fs, at = _store(part.path)
        with fs.open_input_file(at) as file:
            place = part.start
            if place:  # a line that began before belongs to the range before
                file.seek(place - 1)
                place += len(_line(file)) - 1
            while place < part.end:
                file.seek(place)
                data = file.read(min(CHECK_BYTES, part.end - place))
                if not data.endswith(b"\n"):
                    data += _line(file)
                yield self._checked(part.path, file, place, data)
                place += len(data)

    def _checked(self, path: str, file: pa.NativeFile, place: int, data: bytes) -> pa.RecordBatch:
        lines, places = [], []
        for line in data.splitlines(keepends=True) if b"\r" not in data else data.replace(b"\r", b" ").splitlines(keepends=True):
            if line.strip():
                lines.append(line.strip())
                places.append(place)
            place += len(line)
        if not _objects(lines):
            for line, start in zip(lines, places):
                try:
                    wrong = "" if isinstance(json.loads(line), dict) else "not an object"
                except ValueError as e:
                    wrong = getattr(e, "msg", str(e))
                if wrong:
                    raise ValueError(f"{path}:{_number(file, start)}: malformed JSON ({wrong})")
        return pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()), pa.array([path] * len(lines), pa.string()), pa.array(places, pa.int64())], names=["value", "source_path", "place"])


def _line(file: pa.NativeFile) -> bytes:
    """The rest of the line at the file's position, with its end."""
    out = b""
    while data := file.read(1 << 16):
        end = data.find(b"\n")
        if end >= 0:
            return out + data[: end + 1]
        out += data
    return out


def _objects(lines: list[bytes]) -> bool:
    """Whether a fast parser takes all lines for objects of one shape; if not, they are looked at one by one."""
    if any(not line.startswith(b"{") for line in lines):
        return False
    try:
        return not lines or pajson.read_json(pa.BufferReader(b"\n".join(lines)), parse_options=pajson.ParseOptions(newlines_in_values=False)).num_rows == len(lines)
    except pa.ArrowInvalid:
        return False


def _number(file: pa.NativeFile, place: int) -> int:
    """Number of the line at a byte, from 1: only a malformed line makes a task count the line ends before it."""
    file.seek(0)
    n = 1
    while place > 0:
        data = file.read(min(CHECK_BYTES, place))
        n += data.count(b"\n")
        place -= len(data)
    return n


class StrictLines(DataSource):
    """Lines of JSON with their file and byte place; a line that isn't an object is an error that names ``file:line``, whatever columns are asked for."""

    @classmethod
    def name(cls) -> str:
        return "strict_lines"

    def schema(self) -> str:
        return "value string, source_path string, place long"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(json.loads(self.options["files"]), int(self.options.get("split", SPLIT_BYTES)))


def read_numbered(spark: SparkSession, path: str | list[str], schema: str, split: int = SPLIT_BYTES) -> DataFrame:
    """JSON lines of files or folders with the given schema, ``source_path`` and ``place`` (the line's first byte).

    A malformed line fails with its file and number, and so does a count. Blank lines are skipped.
    """
    spark.dataSource.register(StrictLines)
    lines = spark.read.format("strict_lines").option("files", json.dumps([path] if isinstance(path, str) else path)).option("split", split).load()
    return lines.select(F.from_json("value", schema).alias("_r"), "source_path", "place").select("_r.*", "source_path", "place")


@dataclass
class Written(WriterCommitMessage):
    parts: list[str] = field(default_factory=list)


class RunWriter(DataSourceWriter):
    """Tasks write into a folder beside the target; the commit adds the table's order and the configuration and swaps the folders."""

    def __init__(self, options: dict, names: list[str], overwrite: bool):
        self.path, self.keys, self.config = options["path"], json.loads(options["keys"]), options.get("config", "{}")
        self.names, self.overwrite = names, overwrite
        fs, at = _store(self.path)
        if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)
        self.staging = f"{at}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, task = _store(self.path)[0], TaskContext.get()
        part = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.json"
        lines = []
        for row in rows:
            text = json.dumps(dict(zip(self.names, row)), ensure_ascii=False, default=str).encode()
            folder = "/".join([self.staging, "cells", *(f"{k}={_folder(row[self.names.index(k)])}" for k in self.keys)])
            fs.create_dir(folder, recursive=True)
            with fs.open_output_stream(f"{folder}/summary.json") as out:
                out.write(text)
            lines.append(text)
        if not lines:
            return Written()
        fs.create_dir(f"{self.staging}/all", recursive=True)
        with fs.open_output_stream(f"{self.staging}/all/{part}") as out:
            out.write(b"\n".join(lines) + b"\n")
        return Written([part])

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        fs, at = _store(self.path)
        fs.create_dir(f"{self.staging}/all", recursive=True)
        kept = {p for m in messages if m for p in m.parts}
        for f in fs.get_file_info(pafs.FileSelector(f"{self.staging}/all")):
            if f.base_name not in kept:  # of an attempt that was not taken
                fs.delete_file(f.path)
        config = {"timestamp": datetime.datetime.now(datetime.UTC).isoformat(), "revision": revision(), "version": __version__} | json.loads(self.config)
        with fs.open_output_stream(f"{self.staging}/run_config.json") as out:
            out.write(json.dumps(config, indent=2).encode())
        old = f"{at}.old-{uuid.uuid4().hex}"
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.move(at, old)
        fs.move(self.staging, at)
        if fs.get_file_info(old).type != pafs.FileType.NotFound:
            fs.delete_dir(old)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        fs, _ = _store(self.path)
        if fs.get_file_info(self.staging).type != pafs.FileType.NotFound:
            fs.delete_dir(self.staging)


def _folder(value) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else quote(str(value), safe="")


def revision() -> str | None:
    """Short revision of the working folder's repository, if it is in one."""
    try:
        return subprocess.run(["git", "rev-parse", "--short", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


class RunSummaries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_summaries"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RunWriter(dict(self.options), schema.names, overwrite)


def write_run(cells: DataFrame, path: str, keys: Sequence[str], config: dict | None = None) -> None:
    """One row per cell as ``cells/<key>=<value>/summary.json``, all of them in ``all``, and ``run_config.json`` (time,
    revision, version and ``config``): together when the job commits, in place of an earlier run; a failed job leaves nothing.
    """
    cells.sparkSession.dataSource.register(RunSummaries)
    cells.write.format("run_summaries").mode("overwrite").option("keys", json.dumps(list(keys))).option("config", json.dumps(config or {})).save(path)
