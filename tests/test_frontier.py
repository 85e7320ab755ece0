import random
from datetime import datetime, timedelta

from pagetide.config import Refresh, Scope
from pagetide.operators import frontier
from pagetide.operators.parse import LINK
from pagetide.sources.registry import REGISTRY

T0 = datetime(2024, 1, 31)
SCOPE = Scope.of(domains=("e.com",))


def pages(spark, rows):
    return spark.createDataFrame(rows, f"seq bigint, page_url string, url string, links array<{LINK.simpleString()}>")


def test_frontier(spark, hot_mode):
    many = [(f"http://e.com/hot?x={i}", "", None) for i in range(40)]
    rows = [
        (1, "http://e.com/?a#b", "http://e.com/", [
            ("http://e.com/new#top", "", None), ("http://e.com/new", "", None), ("http://sub.e.com/s", "", "noopener"),
            ("http://note.com/", "", None), ("http://e.com/no", "", "nofollow"), ("http://e.com/f.pdf?x", "", None),
            ("http://e.com/resting?q", "", None), ("http://e.com/due", "", None), ("http://e.com/?a", "", None),
        ]),
        (2, "http://e.com/new", "http://e.com/new", many),
    ]
    registry = [(f"http://e.com/{p}", "h", None, T0, T0 - timedelta(days=d), 0, 200) for p, d in (("resting", 1), ("due", 7))]
    known = spark.createDataFrame(registry, REGISTRY)
    source = pages(spark, rows)
    links = frontier.page_links(source)
    plan = lambda scope, refresh: {
        r["link_url"] for r in frontier.plan_frontier(links, known, scope, refresh, str(T0), seen=source).collect()
    }
    hot = {m[0] for m in many}
    assert plan(SCOPE, Refresh("auto", 7)) == {"http://sub.e.com/s", "http://e.com/due"} | hot
    assert plan(SCOPE, Refresh("force")) == {"http://sub.e.com/s", "http://e.com/due", "http://e.com/resting?q"} | hot
    own = Scope.of(domains=("e.com",), include_subdomains=False, respect_robots=False)
    assert plan(own, Refresh("none")) == {"http://e.com/no"} | hot
    counts = {r["seq"]: r["n_links"] for r in frontier.link_counts(source, SCOPE).collect()}
    assert counts == {1: 7, 2: 40}
    assert frontier.page_links(source, SCOPE).count() == 47


def test_scope_table(spark, hot_mode):
    hosts = ["e.com"] * 30 + ["a.e.com", "b.a.e.com", "f.org", "x.f.org", "ae.com", ""]
    links = spark.createDataFrame([(f"http://{h}/{i}" if h else "mailto:x",) for i, h in enumerate(hosts)], "url string")
    sites = spark.createDataFrame([("e.com", True), ("f.org", False), ("a.e.com", True)], "domain string, include_subdomains boolean")
    got = {r["url"] for r in frontier.in_scope_table(links, sites).collect()}
    assert got == {f"http://{h}/{i}" for i, h in enumerate(hosts) if h in ("e.com", "a.e.com", "b.a.e.com", "f.org")}


def test_reachable_equals_breadth_first_search(spark, hot_mode):
    rng = random.Random(5)
    edges = {(f"n{rng.randint(0, 60)}", f"n{rng.randint(0, 60)}") for _ in range(80)} | {("n0", f"n{i}") for i in range(100, 130)}
    frame = spark.createDataFrame(sorted(edges), "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n7",)], "url string")
    hops, front, hop = {"n0": 0, "n7": 0}, {"n0", "n7"}, 0
    while front:
        hop += 1
        front = {d for s, d in edges if s in front} - set(hops)
        hops.update(dict.fromkeys(front, hop))
    got = {r["url"]: r["hop"] for r in frontier.reachable(frame, seeds).collect()}
    assert got == hops
    assert {r["url"] for r in frontier.reachable(frame, seeds, max_hops=1).collect()} == {u for u, h in hops.items() if h <= 1}
    assert frontier.reachable(frame, spark.createDataFrame([], seeds.schema)).collect() == []
    assert frontier.reachable(frame, seeds.filter("false")).collect() == []
    assert {r["url"] for r in frontier.reachable(frame.filter("false"), seeds).collect()} == {"n0", "n7"}
