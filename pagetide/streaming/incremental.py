"""Incremental refresh: a stream of observations, processed batch by batch with the refresh job.

The registry is a log-structured table. Micro-batch b reads, of the newest version older than b + 1, the buckets that
hold its urls, and commits deltas of these buckets as version b + 1. So a batch costs what its own urls cost, whatever
the size of the registry, and one that is replayed after a failure reads the same input and writes the same version.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.config import Extract, Markdown, Refresh, Scope
from pagetide.functions.urls import url_key
from pagetide.plans.refresh import refresh_job
from pagetide.sources.registry import RegistryTable


def start(
    raw_stream: DataFrame,
    root: str,
    scope: Scope,
    refresh: Refresh = Refresh(),
    extract: Extract = Extract(),
    markdown: Markdown = Markdown(),
    trigger: dict | None = None,
    buckets: int = 256,
):
    """Start the streaming query. Records go to root/records/batch=N, the registry to root/registry.

    `buckets` counts if the registry is new.
    """
    spark = raw_stream.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        table = RegistryTable(spark, f"{root}/registry", buckets)
        urls = batch.filter("url IS NOT NULL AND body IS NOT NULL").select(url_key(F.col("url")).alias("url"))
        known = table.read(table.touched(urls, batch_id + 1), batch_id + 1)
        result = refresh_job(batch, known, scope, refresh, extract, markdown, frontier=False, changes_only=True)
        result.records.write.mode("overwrite").parquet(f"{root}/records/batch={batch_id}")
        result.rejects.write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
        table.commit(result.registry, batch_id + 1)

    writer = raw_stream.writeStream.foreachBatch(process).option("checkpointLocation", f"{root}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def run_deliveries(deliveries: Iterable[DataFrame], registry: DataFrame | None, folder: str, **settings) -> DataFrame:
    """Process deliveries of observations one after the other, a micro-batch each, in a fresh root below `folder`.

    Returns the registry after the last one.
    """
    root, spark = f"{folder.rstrip('/')}/{uuid.uuid4().hex}", None
    for number, delivery in enumerate(deliveries):
        spark = delivery.sparkSession
        if not number and registry is not None:
            RegistryTable(spark, f"{root}/registry", settings.get("buckets", 256)).commit(registry, 0)
        delivery.write.mode("append").parquet(f"{root}/in")
        start(spark.readStream.schema(delivery.schema).parquet(f"{root}/in"), root, **settings).awaitTermination()
    if spark is None:
        raise ValueError("no delivery")
    return RegistryTable(spark, f"{root}/registry").read()
