"""Growing logs of lines as a data source whose offsets are byte positions.

A position is always the start of a line. What is read ends with the last complete line, so a line that is still
being written comes with a later read, and a restart in the middle of a file neither loses nor repeats one. Tasks read ranges
of bytes; a range owns the lines that start in it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "byte_tail"
SCHEMA = "path string, at bigint, following bigint, line string"
#: Bytes of a task, of one read, and of lines in one Arrow batch.
TASK_BYTES = 16 << 20
BLOCK_BYTES = 1 << 20


class Log(NamedTuple):
    """A file, or the files of a folder, in a file system that drivers and executors both reach."""

    system: fs.FileSystem
    path: str

    @classmethod
    def at(cls, path: str) -> Log:
        if "://" in path or path.startswith("file:"):
            return cls(*fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:")))
        return cls(fs.LocalFileSystem(), path)

    def sizes(self) -> dict[str, int]:
        """Size of each file by its path; a missing path has none, and names that start with a dot or underscore are not read."""
        info = self.system.get_file_info(self.path)
        if info.type == fs.FileType.NotFound:
            return {}
        if info.type == fs.FileType.File:
            return {info.path: info.size}
        found = self.system.get_file_info(fs.FileSelector(self.path, recursive=True))
        return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.base_name[0] not in "._"}

    def complete(self, path: str, since: int, size: int) -> int:
        """Position behind the last complete line, found from the end backwards; ``since`` if none is complete behind it."""
        with self.system.open_input_file(path) as file:
            end = size
            while end > since:
                start = max(since, end - BLOCK_BYTES)
                file.seek(start)
                at = file.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return since

    def check(self, path: str, since: int, size: int) -> None:
        """A position must lie within the file and behind a line's end."""
        if since > size:
            raise ValueError(f"position {since} is beyond the end of {path} ({size} bytes); start again from 0")
        if since > 0:
            with self.system.open_input_file(path) as file:
                file.seek(since - 1)
                if file.read(1) != b"\n":
                    raise ValueError(f"position {since} of {path} is not at the start of a line; use one that a read has returned")

    def latest(self, since: dict[str, int]) -> dict[str, int]:
        sizes = self.sizes()
        for path in since:
            self.check(path, since[path], sizes.get(path, 0))
        return {path: self.complete(path, since.get(path, 0), size) for path, size in sizes.items()}

    def lines(self, path: str, start: int, end: int, first: int) -> Iterator[tuple[int, int, str]]:
        """(position, position behind it, text) of the lines that start in a range; ``first`` is where the read as a whole began."""
        with self.system.open_input_file(path) as file:
            at = start
            if start > first:
                # The line that runs into the range belongs to the one before; with its last byte before the range a line starts here.
                at = start - 1
            file.seek(at)
            rest, skip = b"", start > first
            while at < end or rest or skip:
                block = file.read(BLOCK_BYTES)
                if not block:
                    return
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    following = at + len(line) + 1
                    if skip:
                        skip = False
                    elif at < end:
                        yield at, following, line.decode("utf-8", "replace")
                    at = following
                    if at >= end:
                        return


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int):
        super().__init__((path, start, end, first))


def ranges(start: dict[str, int], end: dict[str, int], step: int = TASK_BYTES) -> list[Range]:
    out = []
    for path, to in end.items():
        first = start.get(path, 0)
        out += [Range(path, a, min(a + step, to), first) for a in range(first, to, step)]
    return out


def _batches(log: Log, partition: Range) -> Iterator[pa.RecordBatch]:
    path, start, end, first = partition.value
    names = ["path", "at", "following", "line"]
    rows, size = [], 0
    for row in log.lines(path, start, end, first):
        rows.append(row)
        size += len(row[2]) + 40
        if size > BLOCK_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c) for c in zip(*rows))], names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), *(pa.array(c) for c in zip(*rows))], names)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, since: dict[str, int]):
        self.path, self.since = path, since

    def initialOffset(self) -> dict:
        return dict(self.since)

    def latestOffset(self) -> dict:
        # A file that is gone keeps no position; one that grew without a whole line keeps its own.
        return Log.at(self.path).latest(self.since)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        log, sizes = Log.at(self.path), Log.at(self.path).sizes()
        for path in end:
            log.check(path, start.get(path, 0), sizes.get(path, 0))
        return ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(Log.at(self.path), partition)


class _Batch(DataSourceReader):
    def __init__(self, path: str, since: dict[str, int]):
        self.path, self.since = path, since

    def partitions(self) -> list[Range]:
        return ranges(self.since, Log.at(self.path).latest(self.since)) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(Log.at(self.path), partition) if partition.value[0] else iter(())


class ByteTail(DataSource):
    """Options: ``path``, and ``since``, a JSON map from file to position (0 for files it does not name)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _since(self) -> dict[str, int]:
        return json.loads(self.options.get("since", "{}"))

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"], self._since())

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], self._since())


def parsed(lines: DataFrame, schema: str, valid: Column | None = None) -> DataFrame:
    """``lines`` with the columns of their JSON objects; blank lines, lines that do not parse and those that break ``valid`` are dropped."""
    wanted = F.from_json("line", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.withColumn("_row", wanted).where("trim(line) <> '' and _row is not null and _row._corrupt is null").select("path", "at", "following", "_row.*").drop("_corrupt")
    return rows if valid is None else rows.where(F.coalesce(valid, F.lit(False)))


def tail_stream(spark: SparkSession, path: str, schema: str, valid: Column | None = None, since: dict[str, int] | None = None) -> DataFrame:
    """A growing file, or folder of files, of JSON lines as a stream with the place of each line; the checkpoint holds byte positions."""
    spark.dataSource.register(ByteTail)
    return parsed(spark.readStream.format(NAME).option("path", path).option("since", json.dumps(since or {})).load(), schema, valid)


def read_since(spark: SparkSession, path: str, schema: str, since: dict[str, int] | None = None, valid: Column | None = None, limit: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Entries behind the positions ``since`` (file to byte), and the positions to go on from.

    Bad lines and entries that break ``valid`` are consumed. With a ``limit`` the first so many entries come, in the order of
    file and place, and the positions are those behind the last of them; the driver then learns one row.
    """
    spark.dataSource.register(ByteTail)
    log, since = Log.at(path), since or {}
    end = log.latest(since)
    rows = parsed(spark.read.format(NAME).option("path", path).option("since", json.dumps(since)).load(), schema, valid)
    if limit is None:
        # The log may grow before the read: only what was complete now counts.
        ends = F.create_map(*[F.lit(x) for pair in end.items() for x in pair]) if end else F.lit(None).cast("map<string,bigint>")
        return rows.where(F.col("at") < ends[F.col("path")]), end
    first = rows.orderBy("path", "at").limit(limit)
    last = first.agg(F.count("at").alias("n"), F.max(F.struct("path", "following")).alias("last")).first()
    if last["n"] < limit:
        return first, end
    path_of_last = last["last"]["path"]
    return first, {p: since.get(p, 0) if p > path_of_last else last["last"]["following"] if p == path_of_last else e for p, e in end.items()}
