"""Files with exact names and bytes, read and written in parallel, and lines of text files in their order.

A file need not fit a task. Rows (file, at, bytes) are written by position, so many tasks fill one file, a repeated task
writes the same bytes to the same place, and files appear under their names when all tasks are done. Files are read in
ranges of bytes. Both need a folder that the driver and all executors mount (a `file:` path, such as a network file
system); Spark's own writers, which need none, are in `sinks`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pagetide.config import Chunk
from pagetide.session import stage

WAITING = ".waiting-"  # begins the name of a folder with files that are not whole yet
SPLIT = 128 << 20  # bytes that a task reads, about
OPENING = 256 << 10  # bytes that could be read while a file is opened, about
HELD, ROWS = 1 << 20, 1000  # bytes and chunks of a batch, about


def mounted(path: str) -> str:
    """The path as the file system knows it."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"files with exact names need a mounted folder, not {found.scheme}:")
    return unquote(found.path)


# ---- writing


@dataclass
class Written(WriterCommitMessage):
    """Bytes written to each file by a task, and the largest place reached."""

    files: dict[str, tuple[int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.waiting = root, os.path.join(root, WAITING + uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: dict[str, tuple[int, int]] = {}
        name, out = None, -1
        try:
            for batch in iterator:
                for file, at, data in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("bytes"), strict=True):
                    if file != name:
                        if out >= 0:
                            os.close(out)
                        path = os.path.join(self.waiting, _safe(file))
                        os.makedirs(os.path.dirname(path), exist_ok=True)
                        name, out = file, os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
                    left, place = memoryview(data.as_buffer()), at
                    size = len(left)
                    while left:
                        n = os.pwrite(out, left, place)
                        left, place = left[n:], place + n
                    total, reach = files.get(file, (0, 0))
                    files[file] = total + size, max(reach, at + size)
        finally:
            if out >= 0:
                os.close(out)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files: dict[str, tuple[int, int]] = {}
        for message in messages:
            for file, (n, reach) in message.files.items() if message else ():
                total, most = files.get(file, (0, 0))
                files[file] = total + n, max(most, reach)
        torn = [f for f, (n, reach) in files.items() if n != reach]
        if torn:
            raise ValueError(f"bytes of {len(torn)} files overlap or are missing, among them {min(torn)!r}")
        for file in files:
            target = os.path.join(self.root, file)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(os.path.join(self.waiting, file), target)

    def abort(self, messages: list[Written | None]) -> None:
        """What waits is left to the folder's own clean-up; no reader looks there."""


def _safe(file: str) -> str:
    """A relative name that stays in the folder and can be read again."""
    parts = file.split("/")
    if any(p in ("", "..") or p.startswith(".") for p in parts):
        raise ValueError(f"{file!r} is no name of a file below the folder")
    return file


class NamedFiles(DataSource):
    """Writes rows (file, at, bytes): the bytes of a file and their places in it."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite):
        return _Writer(mounted(self.options["path"]))


def write_named(rows: DataFrame, path: str) -> None:
    """Write rows (file, at, bytes) below a folder. The pieces of a file must fill it without gap or overlap."""
    rows.sparkSession.dataSource.register(NamedFiles)
    os.makedirs(mounted(path), exist_ok=True)
    ready = rows.select("file", F.col("at").cast("bigint").alias("at"), F.col("bytes").cast("binary").alias("bytes"))
    ready.write.format("named_files").mode("append").save(path)


# ---- reading


@dataclass
class Range:
    """Bytes of a file; a begin that is a multiple of the chunk size."""

    file: str
    start: int
    stop: int


@dataclass
class Ranges(InputPartition):
    """What a task reads: a range of a large file, or many small files."""

    ranges: list[Range]


class _ChunkReader(DataSourceReader):
    def __init__(self, root: str, size: int, split: int, tasks: int):
        self.root, self.size, self.tasks = root, size, tasks
        self.step = max(1, split // size) * size

    def partitions(self) -> list[Ranges]:
        out = []
        for folder, folders, files in os.walk(self.root):
            folders[:] = sorted(f for f in folders if not f.startswith((".", "_")))
            for file in sorted(f for f in files if not f.startswith((".", "_"))):
                path = os.path.join(folder, file)
                size = os.path.getsize(path)
                out += [Range(os.path.relpath(path, self.root), a, min(a + self.step, size)) for a in range(0, size, self.step)]
        return self._dealt(out)

    def _dealt(self, ranges: list[Range]) -> list[Ranges]:
        """The ranges in tasks of about `step` bytes, or of less if there are few bytes for the tasks at a time."""
        work = [r.stop - r.start + OPENING for r in ranges]
        most, held = min(self.step + OPENING, sum(work) // self.tasks), 0
        out = [Ranges([])]
        for r, n in zip(ranges, work, strict=True):
            if out[-1].ranges and held + n > most:
                out.append(Ranges([]))
                held = 0
            out[-1].ranges.append(r)
            held += n
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name, part, piece in self._pieces(partition.ranges):
            rows.append((name, part, piece))
            held += len(piece)
            if held >= HELD or len(rows) == ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _pieces(self, ranges: list[Range]) -> Iterator[tuple[str, int, bytes]]:
        for r in ranges:
            with open(os.path.join(self.root, r.file), "rb") as data:
                data.seek(r.start)
                for at in range(r.start, r.stop, self.size):
                    yield r.file, at // self.size + 1, data.read(min(self.size, r.stop - at))

    @staticmethod
    def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds, strict=True)], ["file", "part", "bytes"])


class FileChunks(DataSource):
    """Reads files as chunks (file, part, bytes) of a fixed number of bytes."""

    @classmethod
    def name(cls) -> str:
        return "file_chunks"

    def schema(self) -> str:
        return "file string, part bigint, bytes binary"

    def reader(self, schema):
        return _ChunkReader(mounted(self.options["path"]), *(int(self.options[x]) for x in ("size", "split", "tasks")))


def read_chunks(spark: SparkSession, path: str, chunk: Chunk = Chunk(), split: int = SPLIT) -> DataFrame:
    """The files below a folder in chunks: file, part (from 1), name, bytes. Empty files have none.

    A task reads a range of a file, whole chunks of about `split` bytes, or many small files, so files of any size are
    read in parallel and by no more tasks than their bytes need.
    """
    spark.dataSource.register(FileChunks)
    tasks = 2 * spark.sparkContext.defaultParallelism
    rows = spark.read.format("file_chunks").options(size=chunk.bytes, split=split, tasks=tasks).load(path)
    name = F.format_string(f"{chunk.prefix.replace('%', '%%')}%03d.md", F.col("part"))
    return rows.select("file", F.col("part").cast("int").alias("part"), name.alias("name"), "bytes")


def file_name(path: Column) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines of text files with their order: file, line (from 1), seq (over all files, from 1), value.

    Files are taken in natural order: shorter paths first, then by name. A file may lie in many splits; the lines of
    each are counted, and sums over the splits before give every line its number. The lines are staged once, as
    other runs of a scan may cut its files elsewhere.
    """
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # the path is given as a uri
    raw = spark.read.text(path).select(
        "value", plain.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    lines = stage(raw, "lines")
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    files = splits.groupBy("file").agg(F.sum("n").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each file in the first window, and for each split of a file in the second
    files = files.select("file", earlier(Window.orderBy(F.length("file"), "file")).alias("lines_before"))
    splits = splits.select("file", "block", "first", earlier(Window.partitionBy("file").orderBy("block")).alias("before"))
    line = (F.col("at") - F.col("first") + F.col("before") + 1).alias("line")
    return lines.join(splits.join(files, "file"), ["file", "block"]).select("file", line, "lines_before", "value").select(
        "file", "line", (F.col("lines_before") + F.col("line")).alias("seq"), "value"
    )
