"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.session import stage


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached. `links` has two long columns a and b.

    Large-star and small-star steps by turns until the links no longer change; about log(n) rounds. Minima are taken
    with a map-side combine and joined back, so a node with very many links is no single group. Nodes without a
    link to another node are not returned; null ends are ignored; no links give no rows.
    """
    edges = stage(_downward(links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")), "links")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), True)
        edges = stage(_star(_downward(large), False), "links")


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of a under the smallest of them and a: larger neighbours, or a and the smaller ones."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    if large:
        low = F.least("a", "m")
        moved = joined.filter("b > a").select(F.col("b").alias("a"), low.alias("b"))
    else:
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return _downward(moved.filter("a <> b"))
