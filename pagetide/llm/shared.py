"""Small helpers of the text operators: the shared folder, and words of Arrow text columns as numpy arrays."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.session import shared_dir

SLICE = 2 << 20  # bytes of text that numpy looks at together
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = r"[\x20\x09-\x0D]+"
_ODD = np.uint64(0x9E3779B97F4A7C15)
BYTE_HASHES = np.random.default_rng(7).integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


BROADCAST_ROWS = 300_000  # counted rows up to this many (about 30 MB) are broadcast; more are shuffled


def bounded(df: DataFrame) -> DataFrame:
    """The staged frame, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def row_key(docs: DataFrame) -> Column:
    """What names a row where it is judged by its text: ids may be null or repeat."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose row key is in the one column of `gone`."""
    return docs.join(bounded(gone), row_key(docs) == gone[gone.columns[0]], "left_anti")


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir that Python workers can map into memory.

    The shared folder must therefore be a mounted path (file:), such as a network file system.
    """
    found = urlparse(shared_dir(spark))
    if found.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted spark.checkpoint.dir, not {found.scheme}:")
    folder = f"{unquote(found.path)}/model/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def write_array(path: str, values: np.ndarray) -> None:
    """Write a .npy file so that a repeated or speculative task leaves one whole file."""
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(own, "wb") as out:
        np.save(out, values)
    os.replace(own, path)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as strings; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(column.cast(pa.large_string()), "")


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some rows, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, end row, bytes, and the offsets of the texts in these bytes."""
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each word. Words never cross texts."""
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        starts[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash for each word."""
    size = ends - starts
    out = size.astype(np.uint64) * _ODD
    order = np.flatnonzero(size <= 64)
    at, k = starts[order], 0
    while len(order):
        out[order] = (out[order] ^ BYTE_HASHES[data[at + k]]) * _ODD
        out[order] ^= out[order] >> np.uint64(29)
        k += 1
        more = size[order] > k
        if not more.all():
            order, at = order[more], at[more]
    for i in np.flatnonzero(size > 64):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return mix(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
