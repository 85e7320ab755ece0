from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row, functions as F

from pagetide.config import Markdown, Refresh, Scope
from pagetide.operators.registry import decide
from pagetide.plans.refresh import refresh_job
from pagetide.sources.observations import OBSERVATION
from pagetide.sources.registry import REGISTRY, RegistryTable
from pagetide.streaming import incremental

T0 = datetime(2024, 1, 1)
SCOPE = Scope.of(domains=("h",))
PAGE = "<head><title> {0} </title></head><body><main>{1} <a href='/l{0}'>x</a></main></body>"


def observation(seq, path, text, day):
    return (seq, f"http://h/{path}?v={seq}", PAGE.format(path, text), "text/html", 200, T0 + timedelta(days=day))


BATCHES = [
    [observation(1, "a", "one", 0), observation(2, "b", "one", 0), observation(3, "a", "two", 0), (4, "http://h/x", None, None, 500, T0)],
    [observation(5, "a", "three", 1), observation(6, "c", "one", 1)],
    [observation(7, "a", "three", 8), observation(8, "b", "one", 8), observation(9, "b", "late", 9)],
]
OLD = [("http://h/c", "stored", "md-stored", T0 - timedelta(days=9), T0 - timedelta(days=1), 2, 404)]


@pytest.mark.parametrize("markdown", [False, True])
def test_refresh_job_walks_repeated_visits(spark, hot_mode, markdown):
    raw = spark.createDataFrame([r for b in BATCHES for r in b], OBSERVATION)
    old = spark.createDataFrame(OLD, REGISTRY)
    result = refresh_job(raw, old, SCOPE, Refresh("auto", 7), markdown=Markdown(enabled=markdown), as_of="2024-01-10 00:00:00")
    rows = {(r["url"][-1], r["content"].split(">")[1].split()[0]): r for r in result.records.collect()}
    label = {k: (r["content_status"], r["crawled_at"]) for k, r in rows.items()}
    day = lambda n: T0 + timedelta(days=n)
    assert result.records.count() == 8
    assert label[("a", "one")] == ("new", day(0))
    assert label[("a", "two")] == ("updated", day(0))
    assert label[("c", "one")] == ("updated", day(-1))
    assert label[("b", "late")] == ("updated", day(8))
    assert rows[("c", "one")]["content_hash"] == "stored" and rows[("c", "one")]["status"] == 404
    assert ("markdown_hash" in result.records.columns) == markdown
    if markdown:
        assert rows[("c", "one")]["markdown_hash"] == "md-stored"
        # shown from the registry: the hash the url had when it was taken over, beside fresh Markdown
        assert rows[("a", "two")]["markdown_hash"] == rows[("a", "one")]["markdown_hash"]
        assert rows[("a", "two")]["markdown_content"].startswith("two")
    after = {r["url"][-1]: r for r in result.registry.collect()}
    assert sorted(after) == ["a", "b", "c"]
    assert (after["a"]["change_count"], after["a"]["last_crawled_at"]) == (1, day(8))
    assert (after["b"]["change_count"], after["b"]["first_crawled_at"]) == (0, day(0))
    assert after["c"]["content_hash"] == "stored"
    assert {r["url"] for r in result.frontier.collect()} == {"http://h/la", "http://h/lb", "http://h/lc"}
    assert [(r["seq"], r["reason"]) for r in result.rejects.collect()] == [(4, "no body")]


def write_batches(spark, folder):
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, OBSERVATION).coalesce(1).write.parquet(f"{folder}/day={i}")


def test_stream_equals_batches(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    old = spark.createDataFrame(OLD, REGISTRY)
    store = RegistryTable(spark, f"{root}/registry", buckets=16, most_deltas=1)
    store.commit(old, 0)
    expected = old
    refresh = Refresh("auto", 7)
    for i, rows in enumerate(BATCHES):
        frame = spark.createDataFrame(rows, OBSERVATION)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OBSERVATION).parquet(source)
        incremental.start(stream, root, SCOPE, refresh).awaitTermination()
        expected = refresh_job(frame, expected, SCOPE, refresh, frontier=False).registry
    order = lambda df: sorted(map(tuple, df.select(*REGISTRY.fieldNames()).collect()))
    assert order(store.read()) == order(expected)
    assert store.latest()[0] == 3
    assert spark.read.parquet(f"{root}/records").count() == 8
    assert spark.read.parquet(f"{root}/rejects").count() == 1


@pytest.mark.parametrize("refresh", [Refresh("auto", 5), Refresh("none", output_cached=False)], ids=str)
def test_keyed_state_equals_batch(spark, tmp_path, refresh):
    from pagetide.streaming.keyed import decide_stream

    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    schema = "url string, seq bigint, observed_at timestamp_ntz, content_hash string, markdown_hash string, status int"
    rows = [(f"http://h/{'abc'[i % 3]}", i, T0 + timedelta(days=i), "xyz"[i // 4 % 3], None, 200) for i in range(24)]
    source = str(tmp_path / "in")
    # many small batches out of order, as one micro-batch
    spark.conf.set("spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch", "2")
    for part in (rows[:9], rows[9:]):
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(source)
    old = spark.createDataFrame(OLD, REGISTRY)
    stream = decide_stream(spark.readStream.schema(schema).parquet(source), old, refresh)
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    spark.conf.unset("spark.sql.execution.arrow.transformWithStateInPandas.maxRecordsPerBatch")
    names = ("seq", "is_fresh", "is_cached", "previous_hash", "previous_at", "previous_status", "content_status")
    got = spark.read.parquet(str(tmp_path / "out")).withColumn("previous_at", F.col("previous_at").cast("timestamp_ntz"))
    batch = decide(spark.createDataFrame(rows, schema).drop("markdown_hash"), old, refresh)
    order = lambda df: sorted(map(tuple, df.select(*names).collect()), key=repr)
    assert order(got) == order(batch)


class _State:
    """Stands for the state of one url and notes what is asked of it."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


def test_keyed_state_is_asked_once_for_a_url_and_batch():
    from pagetide.streaming.keyed import UrlProcessor

    day = 86_400_000_000
    processor = UrlProcessor(Refresh("auto", 5))
    processor.row = _State()
    seen = lambda seq, days, text: Row(url="u", seq=seq, observed_at=days * day, content_hash=text, markdown_hash=None, status=200)
    rows = [seen(3, 5, "b"), seen(1, 0, "a"), seen(2, 4, "b")]
    out = list(processor.handleInputRows(("u",), iter(rows), None))
    assert [(r.seq, r.is_fresh, r.previous_at, r.content_status, r.change_count) for r in out] == [
        (1, True, None, "new", 0), (2, False, 0, "updated", 0), (3, True, 0, "updated", 1),
    ]
    assert processor.row.calls == ["get", "update"]
    assert processor.row.value == ("b", None, 0, 5 * day, 1, 200)
