import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagetide.config import Refresh
from pagetide.operators import registry as R
from pagetide.operators.skew import KeyedOrder, hot_keys, spread_join
from pagetide.sources.registry import REGISTRY, RegistryStore

T0 = datetime(2024, 1, 1)
VISIT = "url string, seq bigint, observed_at timestamp_ntz, content_hash string, markdown_hash string, status int"


def random_registry(rng, urls):
    return [
        (u, rng.choice(["a", "b", "", None]), rng.choice([None, "m1"]), T0 - timedelta(days=30),
         rng.choice([None, T0 - timedelta(days=rng.randint(0, 12))]), rng.randint(0, 3), rng.choice([200, 404]))
        for u in urls if rng.random() < 0.6
    ]


def random_visits(rng, urls, n, span_days, monotone):
    rows = []
    for seq in range(n):
        share = seq / n if monotone else rng.random()
        at = T0 + timedelta(days=int(share * span_days), hours=rng.randint(0, 1) if not monotone else 0)
        url = urls[0] if rng.random() < 0.4 else rng.choice(urls)
        rows.append((url, seq * 3 + 1, at, rng.choice("abc"), rng.choice([None, "", "m1", "m2"]), rng.choice([200, 500])))
    return rows


def walk(registry, visits, refresh):
    """The decisions made one observation at a time."""
    state = {r[0]: {"hash": r[1], "at": r[4], "status": r[6], "seq": None, "md": r[2]} for r in registry}
    out = {}
    for url, seq, at, content, _, status in sorted(visits, key=lambda v: v[1]):
        s = state.get(url)
        if s is None or refresh.mode == "force":
            due = True
        elif refresh.mode == "none":
            due = False
        else:
            due = s["at"] is None or (at - s["at"]) // timedelta(days=1) >= refresh.days
        old = s["hash"] if s else None
        fresh = due or not old
        out[seq] = (
            fresh, not fresh and refresh.output_cached, old, s["at"] if s else None, s["status"] if s else None,
            s["seq"] if s else None, "new" if not old else "updated" if old != content else "unchanged",
        )
        if fresh:
            state[url] = {"hash": content, "at": at, "status": status, "seq": seq, "md": None}
    return out


@pytest.mark.parametrize("seed", (1, 2))
@pytest.mark.parametrize(
    "refresh",
    [Refresh("force"), Refresh("none", output_cached=False), Refresh("auto", 0), Refresh("auto", 3), Refresh("auto", 40)],
    ids=str,
)
def test_decide_equals_walk(spark, hot_mode, refresh, seed):
    rng = random.Random(seed)
    urls = [f"u{i}" for i in range(12)]
    registry, visits = random_registry(rng, urls), random_visits(rng, urls, 150, 20, monotone=seed != 2)
    narrow = spark.createDataFrame(visits, VISIT).drop("markdown_hash").repartition(4)
    rows = R.decide(narrow, spark.createDataFrame(registry, REGISTRY), refresh).collect()
    names = ("is_fresh", "is_cached", "previous_hash", "previous_at", "previous_status", "previous_seq", "content_status")
    assert {r["seq"]: tuple(r[n] for n in names) for r in rows} == walk(registry, visits, refresh)


def upsert_loop(registry, visits):
    table = {r[0]: list(r) for r in registry}
    counts = {}
    for url, seq, at, content, markdown, status in sorted(visits, key=lambda v: v[1]):
        row = table.get(url)
        if row is None:
            table[url] = [url, content, markdown, at, at, 0, status]
        else:
            if row[1] != content or (markdown and row[2] != markdown):
                row[5] += 1
            row[1], row[2], row[4], row[6] = content, markdown, at, status
        counts[seq] = table[url][5]
    return sorted(map(tuple, table.values())), counts


@pytest.mark.parametrize("seed", (1, 2))
def test_history_and_upsert_equal_loop(spark, hot_mode, seed):
    rng = random.Random(100 + seed)
    urls = [f"u{i}" for i in range(10)]
    registry, visits = random_registry(rng, urls), random_visits(rng, urls, 120, 9, monotone=True)
    table, counts = upsert_loop(registry, visits)
    old, seen = spark.createDataFrame(registry, REGISTRY), spark.createDataFrame(visits, VISIT)
    assert {r["seq"]: r["change_count"] for r in R.history(seen, old).collect()} == counts
    got = R.upsert_visits(old, seen).select(*REGISTRY.fieldNames()).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == table


def test_golden_change_counts(spark):
    steps = [("new", None), ("changed", None), ("changed", "md"), ("changed", "md")]
    current = spark.createDataFrame([], REGISTRY)
    seen = []
    for i, (content, markdown) in enumerate(steps):
        batch = spark.createDataFrame([("u", i, T0 + timedelta(days=i), content, markdown, 200)], VISIT)
        current = R.upsert(current, batch.drop("seq"))
        seen.append(current.first()["change_count"])
    row = current.first()
    assert seen == [0, 1, 2, 2]
    assert (row["first_crawled_at"], row["last_crawled_at"]) == (T0, T0 + timedelta(days=3))
    off = R.upsert(current, spark.createDataFrame([("u", 9, T0, "changed", None, 200)], VISIT).drop("seq")).first()
    assert (off["markdown_hash"], off["change_count"]) == (None, 2)


def test_keyed_order_splits_keys(spark, hot_mode):
    rows = [("hot" if i % 3 else f"k{i}", i, i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint").repartition(5)
    hot = hot_keys(df, "k")
    assert (hot.keys == ("hot",)) == (hot_mode == "split")
    assert hot_keys(df.filter("false"), "k").keys == hot_keys(df.withColumn("k", F.lit(None).cast("string")), "k").keys == ()
    got = (
        KeyedOrder(df, "k", "o", hot)
        .before(F.col("v"), "b", when=F.col("v") > 3)
        .max_before(F.col("v"), "m")
        .running_sum(F.col("v"), "s")
        .rows()
    )
    assert got.count() == 300
    past, expected = {}, {}
    for k, o, v in rows:
        seen = past.setdefault(k, [])
        big = [x for x in seen if x > 3]
        expected[o] = (big[-1] if big else None, max(seen) if seen else None, sum(seen) + v)
        seen.append(v)
    assert {r["o"]: (r["b"], r["m"], r["s"]) for r in got.collect()} == expected


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, hot_mode, how):
    left = spark.createDataFrame([("h" if i % 2 else f"k{i % 30}", i) for i in range(200)] + [(None, 999)], "k string, i int")
    right = spark.createDataFrame([("h", 1), ("k2", 2), ("zz", 3)], "k string, r int")
    spread = spread_join(left, right, "k", how, hot_keys(left, "k"), "i")
    assert sorted(map(str, spread.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    assert spread.columns == left.join(right, "k", how).columns
    with pytest.raises(ValueError):
        spread_join(left, right, "k", "full", hot_keys(left, "k"), "i")


def test_statistics(spark, hot_mode):
    rows = [(f"https://{'abc'[i % 3]}.example.{'com' if i % 4 else 'org'}/{i}", f"h{i % 40}" if i > 60 else "same", None, T0, T0 + timedelta(days=i // 2), i % 2, 200) for i in range(100)]
    table = spark.createDataFrame(rows + [("https://x/1", "", None, T0, T0, 0, 200)], REGISTRY)
    assert tuple(R.crawl_stats(table).first()) == (101, 50)
    sites = {r["site"]: (r["total_urls"], r["changed_urls"]) for r in R.crawl_stats_by_site(table).collect()}
    assert sites == {"example.com": (75, 50), "example.org": (25, 0), "x": (1, 0)}
    top = [r["url"] for r in R.recent_pages(table, 3).collect()]
    assert top == sorted(r[0] for r in rows[98:]) + [sorted(r[0] for r in rows[96:98])[0]]
    groups = {r["content_hash"]: r["n_urls"] for r in R.duplicate_content(table).collect()}
    assert groups == {"same": 61}
    members = R.duplicate_members(table).collect()
    assert len(members) == 61 and {r["first_url"] for r in members} == {min(r[0] for r in rows[:61])}


def test_snapshots(spark, tmp_path):
    store = RegistryStore(spark, str(tmp_path / "registry"))
    assert store.latest() is None and store.read().count() == 0
    one = spark.createDataFrame([("u1", "h", None, T0, T0, 0, 200)], REGISTRY)
    assert store.commit(one) == 0
    two = store.read().unionByName(spark.createDataFrame([("u2", "h", None, T0, T0, 0, 200)], REGISTRY))
    assert store.commit(two) == 1
    assert store.read().count() == 2 and store.read(before=1).count() == 1
    assert store.commit(one, 1) == 1  # a replayed batch writes its version again
    assert store.latest()[0] == 1
    assert store.read().schema == REGISTRY
