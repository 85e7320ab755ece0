"""The log-structured registry: what a batch reads and writes, deltas, compaction and repeated commits."""

import random
import re
from datetime import datetime, timedelta

import pytest

from pagetide.config import Refresh, Scope
from pagetide.sources.observations import OBSERVATION
from pagetide.sources.registry import REGISTRY, RegistryTable
from pagetide.streaming import incremental

T0 = datetime(2024, 1, 1)


def rows(urls, version):
    return [(u, f"h{version}", None, T0, T0 + timedelta(days=version), version, 200) for u in urls]


def frame(spark, found):
    return spark.createDataFrame(found, REGISTRY)


def folders(df):
    return {int(re.search(r"/bucket=(\d+)/", f)[1]) for f in df.inputFiles()}


def content(df):
    return sorted(tuple(r) for r in df.select(*REGISTRY.fieldNames()).collect())


def test_batches_touch_their_buckets_only(spark, tmp_path):
    table = RegistryTable(spark, str(tmp_path), buckets=16, most_deltas=2)
    assert content(table.read()) == [] and table.touched(spark.createDataFrame([], "url string")) == []
    urls = [f"http://h/{i}" for i in range(300)]
    expected = {r[0]: r for r in rows(urls, 0)}
    assert table.commit(frame(spark, list(expected.values()))) == 0
    everywhere = folders(table.read())
    assert everywhere == set(range(16)) and all(e["is_base"] for e in table.entries())
    rng = random.Random(1)
    for version in range(1, 6):
        some = [*rng.sample(urls, 2), f"http://new/{version}"]
        news = rows(some, version)
        touched = table.touched(spark.createDataFrame([(u,) for u in some], "url string"))
        before = {(e["bucket"], e["path"]) for e in table.entries()}
        known = table.read(touched)
        assert folders(known) <= set(touched) and len(touched) <= 3
        assert {r["url"] for r in known.collect()} >= set(some[:2])
        assert table.commit(frame(spark, news)) == version
        after = {(e["bucket"], e["path"]) for e in table.entries()}
        assert {b for b, _ in before ^ after} == set(touched)
        expected |= {r[0]: r for r in news}
        assert content(table.read()) == sorted(expected.values())
    # an old version is still there
    assert max(r[5] for r in content(table.read(before=3))) == 2
    # another session finds the number of buckets
    again = RegistryTable(spark, str(tmp_path), buckets=99)
    assert content(again.read(range(16))) == sorted(expected.values()) and again.buckets == 16


def test_crowded_buckets_are_merged(spark, tmp_path):
    table = RegistryTable(spark, str(tmp_path), buckets=1, most_deltas=2)
    for version in range(7):
        table.commit(frame(spark, rows(["a", f"u{version}"], version)))
        deltas = [e for e in table.entries() if not e["is_base"]]
        assert len(deltas) == version % 3 and len(table.entries()) == 1 + len(deltas)
    assert [r[5] for r in content(table.read())] == [6, *range(7)]


def test_repeated_commits_replace_each_other(spark, tmp_path):
    table = RegistryTable(spark, str(tmp_path), buckets=4)
    table.commit(frame(spark, rows(["a", "b"], 0)), 0)
    table.commit(frame(spark, rows(["a"], 1)), 1)
    table.commit(frame(spark, rows(["a"], 1)), 1)
    assert table.latest()[0] == 1 and len(table.entries(before=1)) == len({e["bucket"] for e in table.entries(before=1)})
    assert sorted((r[0], r[5]) for r in content(table.read())) == [("a", 1), ("b", 0)]
    table.commit(frame(spark, []))
    assert sorted((r[0], r[5]) for r in content(table.read())) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize("setting", [{"buckets": 0}, {"most_deltas": -1}])
def test_settings(spark, setting):
    with pytest.raises(ValueError):
        RegistryTable(spark, "/nowhere", **setting)


def test_stream_with_repeated_urls(spark, tmp_path):
    """Three micro-batches over the same urls; the counts are those of a walk, and a batch opens its own buckets only."""
    page = "<body><main>{}</main></body>"
    deliver = lambda day, texts: spark.createDataFrame(
        [(100 * day + i, f"http://h/{k}?d={day}", page.format(t), "text/html", 200, T0 + timedelta(days=day)) for i, (k, t) in enumerate(texts)],
        OBSERVATION,
    )
    old = frame(spark, [(f"http://h/z{i}", "x", None, T0, T0, 0, 200) for i in range(200)])
    days = [deliver(0, [("a", 1), ("b", 1), ("a", 2)]), deliver(8, [("a", 2), ("z7", 1)]), deliver(16, [("a", 3), ("b", 1), ("c", 1)])]
    got = incremental.run_deliveries(days, old, str(tmp_path), scope=Scope.of(domains=("h",)), refresh=Refresh("auto", 7), buckets=64)
    state = {r["url"]: (r["change_count"], r["first_crawled_at"], r["last_crawled_at"]) for r in got.collect()}
    day = lambda n: T0 + timedelta(days=n)
    # the second text of day 0 is not due, so the second delivery changes the page for the first time
    assert state["http://h/a"] == (2, day(0), day(16))
    assert state["http://h/b"] == (0, day(0), day(16)) and state["http://h/z7"] == (1, T0, day(8)) and len(state) == 203
    root = next(tmp_path.iterdir())
    table = RegistryTable(spark, f"{root}/registry")
    for version, urls in ((1, 2), (2, 2), (3, 3)):
        new = [e for e in table.entries(before=version + 1) if e["version"] == version]
        assert 1 <= len(new) <= urls
    with pytest.raises(ValueError):
        incremental.run_deliveries([], None, str(tmp_path), scope=Scope.of())
