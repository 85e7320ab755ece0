"""Incremental decisions with the registry held as keyed streaming state, one value per url.

The alternative to `incremental`: no registry table is read per batch. Only narrow rows enter the state; page text
stays outside and is joined on seq. The observations that a micro-batch has of a url are walked in the order of seq,
whatever Arrow batches they come in; a task holds these narrow rows of one url.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagetide.config import Refresh
from pagetide.sources.registry import REGISTRY

STATE = (
    "content_hash STRING, markdown_hash STRING, first_crawled_at BIGINT, last_crawled_at BIGINT, "
    "change_count INT, status INT"
)
OUTPUT = (
    "url STRING, seq BIGINT, is_fresh BOOLEAN, is_cached BOOLEAN, previous_hash STRING, previous_at BIGINT, "
    "previous_status INT, content_status STRING, change_count INT"
)
HELD = tuple(c.split()[0] for c in STATE.split(","))
DECISION = Row(*(c.split()[0] for c in OUTPUT.split(",")))


class UrlProcessor(StatefulProcessor):
    """Walks the observations of a url as they arrive and keeps its registry row. Times are microseconds."""

    def __init__(self, refresh: Refresh):
        self.refresh, self.wait = refresh, timedelta(days=refresh.days) // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", STATE)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.row.update(tuple(initialState[n] for n in HELD))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.row.get()
        state = tuple(found) if found is not None else None
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq)):
            decision, state = self.step(state, r)
            yield DECISION(key[0], r.seq, *decision, state[4])
        if state is not None:
            self.row.update(state)

    def step(self, state, r):
        """(decision columns, new state) of one observation."""
        now, markdown = r.observed_at, r.markdown_hash
        old, last, status = (state[0], state[3], state[5]) if state else (None, None, None)
        if state is None or self.refresh.mode == "force":
            due = True
        else:
            waited = last is None or now - last >= self.wait
            due = self.refresh.mode == "auto" and waited
        fresh = due or not old
        label = "new" if not old else "updated" if old != r.content_hash else "unchanged"
        decision = (fresh, not fresh and self.refresh.output_cached, old, last, status, label)
        if fresh:
            count = 0
            if state is not None:
                changed = old != r.content_hash or (bool(markdown) and state[1] != markdown)
                count = state[4] + int(changed)
            state = (r.content_hash, markdown, state[2] if state else now, now, count, int(r.status))
        return decision, state

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_deliveries(deliveries: Iterable[DataFrame], registry: DataFrame | None, refresh: Refresh, folder: str) -> DataFrame:
    """Decisions on deliveries of narrow observations, a micro-batch each, in a fresh root below `folder`."""
    root, out = f"{folder.rstrip('/')}/{uuid.uuid4().hex}", None
    for delivery in deliveries:
        spark = delivery.sparkSession
        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, ROCKSDB)
        try:
            delivery.write.mode("append").parquet(f"{root}/in")
            out = decide_stream(spark.readStream.schema(delivery.schema).parquet(f"{root}/in"), registry, refresh)
            writer = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
            writer.trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set(PROVIDER, before)
    if out is None:
        raise ValueError("no delivery")
    found = spark.read.schema(out.schema).parquet(f"{root}/out")
    return found.withColumn("previous_at", F.col("previous_at").cast("timestamp_ntz"))


def decide_stream(observations: DataFrame, registry: DataFrame | None, refresh: Refresh) -> DataFrame:
    """Decisions per observation of a stream of url, seq, observed_at, content_hash, markdown_hash, status.

    `registry` is the state to begin with. Needs the RocksDB state store. Times are UTC.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = observations.withColumn("observed_at", micros("observed_at"))
    initial = None
    if registry is not None:
        times = ("first_crawled_at", "last_crawled_at")
        state = registry.select(*(micros(c).alias(c) if c in times else c for c in REGISTRY.fieldNames()))
        initial = state.groupBy("url")
    decided = rows.groupBy("url").transformWithState(
        statefulProcessor=UrlProcessor(refresh),
        outputStructType=OUTPUT,
        outputMode="Append",
        timeMode="None",
        initialState=initial,
    )
    return decided.withColumn("previous_at", F.timestamp_micros("previous_at"))
