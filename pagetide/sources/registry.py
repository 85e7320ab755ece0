"""The url registry: one row per url, kept as parquet files that are never overwritten.

`RegistryStore` writes a whole snapshot with each commit, which suits a job over the whole corpus. `RegistryTable` is
log-structured and suits small batches: urls are dealt into buckets by hash, a bucket is one base and some deltas, and a
commit writes deltas of the buckets that have news.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Collection, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("markdown_hash", T.StringType()),
        T.StructField("first_crawled_at", T.TimestampNTZType()),
        T.StructField("last_crawled_at", T.TimestampNTZType()),
        T.StructField("change_count", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
    ]
)
POINTER = "version BIGINT, path STRING"
STORED = T.StructType([*REGISTRY.fields, T.StructField("version", T.LongType())])
MANIFEST = T.StructType(
    [
        T.StructField("bucket", T.IntegerType()),
        T.StructField("version", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("is_base", T.BooleanType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("buckets", T.IntegerType()),
    ]
)


class _Versions:
    """Versions below one folder. A version counts once its one-row pointer file is committed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def latest(self, before: int | None = None) -> tuple[int, str] | None:
        """(version, path) of the newest version, or of the newest one older than `before`."""
        try:
            pointers = self.spark.read.schema(POINTER).parquet(f"{self.root}/pointers")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        if before is not None:
            pointers = pointers.filter(pointers.version < before)
        row = pointers.selectExpr("max(struct(version, path)) AS m").first()["m"]
        return (row["version"], row["path"]) if row else None

    def _next(self) -> int:
        found = self.latest()
        return found[0] + 1 if found else 0

    def _point(self, version: int, path: str) -> None:
        pointer = self.spark.createDataFrame([(version, path)], POINTER).coalesce(1)
        pointer.write.mode("append").parquet(f"{self.root}/pointers")


class RegistryStore(_Versions):
    """Whole snapshots."""

    def read(self, before: int | None = None) -> DataFrame:
        """The registry as a table; empty before the first commit."""
        found = self.latest(before)
        if found is None:
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).parquet(f"{self.root}/{found[1]}")

    def commit(self, registry: DataFrame, version: int | None = None) -> int:
        """Write a new snapshot beside the ones being read, then point to it."""
        version = self._next() if version is None else version
        name = f"snapshot-{version:012d}-{uuid.uuid4().hex}"
        registry.select(*REGISTRY.fieldNames()).write.parquet(f"{self.root}/{name}")
        self._point(version, name)
        return version


class RegistryTable(_Versions):
    """Buckets by url hash, each a base and at most `most_deltas` deltas; every version has a manifest of live files.

    A row that a url has in a newer delta replaces the older ones. A reader that names the buckets of its urls opens the
    files of these buckets only. A bucket with too many deltas is merged into a new base by the commit that brings the
    last one, and no other bucket is touched. `buckets` is fixed by the first commit; it should leave some hundred MB in
    each. The manifest, of at most buckets * (most_deltas + 1) rows, is what the driver holds. One writer at a time; a
    commit that is repeated with its version number takes the place of the earlier try.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256, most_deltas: int = 8):
        if buckets < 1 or most_deltas < 0:
            raise ValueError("buckets must be positive and most_deltas not negative")
        super().__init__(spark, root)
        self.buckets, self.most_deltas = buckets, most_deltas

    def entries(self, before: int | None = None) -> list[Row]:
        """The live files of the newest version (older than `before`)."""
        found = self.latest(before)
        if found is None:
            return []
        out = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{found[1]}").collect()
        if out:
            self.buckets = out[0]["buckets"]
        return out

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.buckets)).cast("int")

    def touched(self, urls: DataFrame, before: int | None = None) -> list[int]:
        """Numbers of the buckets that hold these urls (column url)."""
        self.entries(before)  # tells the number of buckets
        return sorted(r[0] for r in urls.select(self.bucket(F.col("url"))).distinct().collect())

    def read(self, buckets: Collection[int] | None = None, before: int | None = None) -> DataFrame:
        """The registry, or these buckets of it, as a table; empty before the first commit."""
        wanted = None if buckets is None else set(buckets)
        live = [e for e in self.entries(before) if wanted is None or e["bucket"] in wanted]
        return self._newest(live).drop("version")

    def _newest(self, live: list[Row]) -> DataFrame:
        """The newest row of each url in these files."""
        if not live:
            return self.spark.createDataFrame([], STORED)
        rows = self.spark.read.schema(STORED).parquet(*(f"{self.root}/{e['path']}" for e in live))
        if all(e["is_base"] for e in live):
            return rows
        # the join that follows is on url too, so it needs no shuffle of its own
        names = [n for n in STORED.fieldNames() if n != "url"]
        return rows.groupBy("url").agg(F.max_by(F.struct(*names), "version").alias("row")).select("url", "row.*")

    def _write(self, rows: DataFrame, name: str, known: Iterable[int], version: int) -> list[Row]:
        """Write rows, a file for each bucket, and return the manifest entries of what was written."""
        path, known = f"data/{name}", set(known)
        placed = rows.withColumn("bucket", self.bucket(F.col("url"))).repartition("bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("bucket", T.IntegerType())])
        written = self.spark.read.schema(schema).parquet(f"{self.root}/{path}").groupBy("bucket").count().collect()
        entry = Row(*MANIFEST.fieldNames())
        return [entry(b, version, f"{path}/bucket={b}", b not in known, n, self.buckets) for b, n in written]

    def commit(self, changes: DataFrame, version: int | None = None) -> int:
        """Write rows of new or changed urls, each url once, as the next version (or as this one)."""
        version = self._next() if version is None else version
        live = self.entries(before=version)
        name = f"{version:012d}-{uuid.uuid4().hex}"
        rows = changes.select(*REGISTRY.fieldNames(), F.lit(version).cast("bigint").alias("version"))
        live += self._write(rows, name, (e["bucket"] for e in live), version)
        deltas = Counter(e["bucket"] for e in live if not e["is_base"])
        crowded = {b for b, n in deltas.items() if n > self.most_deltas}
        if crowded:
            whole = self._newest([e for e in live if e["bucket"] in crowded])
            live = [e for e in live if e["bucket"] not in crowded] + self._write(whole, f"{name}-base", (), version)
        self.spark.createDataFrame(live, MANIFEST).coalesce(1).write.parquet(f"{self.root}/manifests/{name}")
        self._point(version, name)
        return version
