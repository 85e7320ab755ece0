"""Fixed-size byte chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.config import Chunk


def byte_chunks(documents: DataFrame, chunk: Chunk = Chunk(), key: str = "doc_id", body: str = "body") -> DataFrame:
    """Cut a text or binary column into pieces of `chunk.bytes` bytes: key, part (from 1), name, bytes.

    A cut may fall inside a character, as only bytes count. An empty document has no piece.
    """
    raw = F.col(body)
    if dict(documents.dtypes)[body] == "string":
        raw = F.encode(raw, "UTF-8")
    size = F.lit(chunk.bytes)
    numbers = F.sequence(F.lit(1), F.ceil(F.octet_length("_b") / size).cast("int"))
    # the filter counts bytes without encoding, so that each document is encoded once
    parts = documents.filter(F.octet_length(body) > 0).select(key, raw.alias("_b"))
    return parts.select(key, "_b", F.explode(numbers).alias("part")).select(
        key,
        "part",
        F.format_string(f"{chunk.prefix.replace('%', '%%')}%03d.md", F.col("part")).alias("name"),
        F.substring(F.col("_b"), (F.col("part") - 1) * size + 1, size).alias("bytes"),
    )
