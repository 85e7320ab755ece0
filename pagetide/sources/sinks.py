"""Files written by the jobs.

`write_records`, `write_shards`, `write_chunks` and `write_combined` use Spark's writers and any store. The `_files`
variants give every file its exact name and bytes, below a mounted folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.config import Pack
from pagetide.operators.skew import KeyedOrder, hot_keys
from pagetide.sources.files import write_named

MOST_TASKS = 10_000
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_records(records: DataFrame, path: str) -> None:
    """Page records as JSON Lines. NULL values stay visible; Markdown keys exist only if the columns do."""
    out = records.withColumn("crawled_at", F.date_format("crawled_at", ISO))
    out.write.option("ignoreNullFields", "false").json(path)


def write_shards(lines: DataFrame, assigned: DataFrame, path: str, pack: Pack = Pack(), line: str = "value") -> None:
    """Text lines (seq, value) below shard=N folders, in seq order, one file per shard.

    Every shard is at most one task's write, as its size is bounded by `pack.max_bytes` or a single line. There are as
    many tasks as shards, up to MOST_TASKS.
    """
    placed = lines.select("seq", line).join(assigned.select("seq", "shard"), "seq")
    n = min(MOST_TASKS, assigned.agg(F.max("shard")).first()[0] or 1)
    name = F.concat(F.lit(pack.prefix + "_"), F.col("shard").cast("string")).alias("shard")
    (
        placed.repartition(n, "shard")
        .sortWithinPartitions("shard", "seq")
        .select(name, F.col(line).alias("value"))
        .write.partitionBy("shard")
        .text(path)
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows (key, part, name, bytes) as a table."""
    chunks.write.parquet(path)


def write_combined(pieces: DataFrame, path: str, group: str, order: str = "seq", target_rows: int = 50_000) -> None:
    """Combined documents as text below one folder per group; the files of a folder, in name order, are the document.

    Rows are range-partitioned by group and order, so that a large group is spread over many files. Each piece ends
    with a line feed, which the text writer adds.
    """
    rows = pieces.count()
    if not rows:
        return
    parts = max(1, math.ceil(rows / target_rows))
    (
        pieces.withColumn("value", F.regexp_replace("piece", r"\n\z", ""))
        .repartitionByRange(parts, group, order)
        .sortWithinPartitions(group, order)
        .select(group, "value")
        .write.partitionBy(group)
        .text(path)
    )


def write_shard_files(
    lines: DataFrame, assigned: DataFrame, path: str, pack: Pack = Pack(), line: str = "value", suffix: str = ".jsonl"
) -> None:
    """Text lines (seq, value) as files {prefix}_{shard}.jsonl, in seq order. Shard 1 is not written if it is empty."""
    placed = lines.select("seq", line).join(assigned.select("seq", "nbytes", "shard"), "seq")
    before = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # of one shard's size
    name = F.concat(F.lit(pack.prefix + "_"), F.col("shard").cast("string"), F.lit(suffix))
    data = F.concat(line, F.lit("\n")).cast("binary")
    write_named(placed.select(name.alias("file"), F.coalesce(F.sum("nbytes").over(before), F.lit(0)).alias("at"), data.alias("bytes")), path)


def write_combined_files(pieces: DataFrame, path: str, group: str, order: str = "seq", suffix: str = ".md") -> None:
    """Combined documents (group, order, piece), each as one file that is named after its group.

    The place of a piece is the sum of the sizes before it, also of a group that many tasks share; no task holds a file.
    """
    sized = pieces.select(group, order, F.col("piece").cast("binary").alias("bytes")).withColumn("size", F.octet_length("bytes").cast("bigint"))
    placed = KeyedOrder(sized, group, order, hot_keys(sized, group)).running_sum(F.col("size"), "upto").rows()
    write_named(placed.select(_named(group, suffix).alias("file"), (F.col("upto") - F.col("size")).alias("at"), "bytes"), path)


def write_chunk_files(chunks: DataFrame, path: str, key: str | None = None) -> None:
    """Chunks (key, part, name, bytes) as files of their names, below a folder for each key if one is named."""
    file = F.col("name") if key is None else F.concat(F.col(key).cast("string"), F.lit("/"), F.col("name"))
    write_named(chunks.select(file.alias("file"), F.lit(0).alias("at"), "bytes"), path)


def _named(group: str, suffix: str) -> Column:
    return F.concat(F.col(group).cast("string"), F.lit(suffix))
