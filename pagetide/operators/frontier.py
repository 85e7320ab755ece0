"""Links of parsed pages, the next urls to visit, and reachability."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagetide.config import Refresh, Scope
from pagetide.functions.gates import may_follow, recrawl_due, visitable_type
from pagetide.functions.urls import authority, domain_suffixes, same_domain, url_key
from pagetide.operators.skew import SALTS, hot_keys, spread_join
from pagetide.session import keep_partitioned, shared_dir

REQUEST = r"(?s)#.*"


def _extracted(url: Column, scope: Scope) -> Column:
    return same_domain(url, scope.domains, include_subdomains=True) & visitable_type(url, scope)


def page_links(pages: DataFrame, scope: Scope | None = None) -> DataFrame:
    """One row per page and distinct link: src_url, url (as written, resolved), text, rel.

    With a scope, only links into its domains (subdomains included) that do not point to binary files remain.
    """
    links = pages.select(F.col("page_url").alias("src_url"), F.inline("links"))
    return links if scope is None else links.filter(_extracted(F.col("url"), scope))


def link_counts(pages: DataFrame, scope: Scope | None = None) -> DataFrame:
    """Number of distinct links per page."""
    links = F.col("links") if scope is None else F.filter("links", lambda link: _extracted(link["url"], scope))
    return pages.select("seq", F.col("page_url").alias("src_url"), F.size(links).alias("n_links"))


def followable(links: DataFrame, scope: Scope) -> DataFrame:
    """Links the scope lets us follow, as distinct requests: link_url (without fragment) and its registry key."""
    wanted = (
        may_follow(F.col("rel"), scope)
        & visitable_type(F.col("url"), scope)
        & same_domain(url_key(F.col("url")), scope.domains, scope.include_subdomains)
    )
    return (
        links.filter(wanted)
        .select(F.regexp_replace("url", REQUEST, "").alias("link_url"), url_key(F.col("url")).alias("url"))
        .distinct()
    )


def in_scope_table(links: DataFrame, sites: DataFrame, column: str = "url") -> DataFrame:
    """Links whose host equals, or lies below, a domain of a scope table (domain, include_subdomains).

    The suffix test becomes an equality: each distinct host is expanded to the domains it belongs to.
    """
    host = authority(F.col(column))
    hosts = links.select(host.alias("_host")).distinct()
    belongs = hosts.select("_host", F.explode(domain_suffixes(F.col("_host"))).alias("domain"))
    allowed = (
        belongs.join(sites.select("domain", "include_subdomains").distinct(), "domain")
        .filter(F.col("include_subdomains") | (F.col("_host") == F.col("domain")))
        .select("_host")
        .distinct()
    )
    tagged = links.withColumn("_host", host)
    hot = hot_keys(tagged, "_host")
    return spread_join(tagged, allowed, "_host", "left_semi", hot, column).drop("_host")


def plan_frontier(
    links: DataFrame, registry: DataFrame, scope: Scope, refresh: Refresh, as_of: str, seen: DataFrame | None = None
) -> DataFrame:
    """Requests to make next: in scope, unknown or due at `as_of`, and not made in this run.

    `registry` is the registry after the pages of this run were written. `seen` has the urls requested in this run
    in column page_url. Path prefixes are tested when a page is processed, not here.
    """
    wanted = followable(links, scope)
    now = F.lit(as_of).cast("timestamp_ntz")
    fresh_enough = registry.filter(~recrawl_due(F.lit(True), F.col("last_crawled_at"), now, refresh)).select("url")
    hot = hot_keys(links, url_key(F.col("url")))
    todo = spread_join(wanted, fresh_enough, "url", "left_anti", hot, "link_url")
    if seen is not None:
        made = seen.select(F.regexp_replace("page_url", REQUEST, "").alias("link_url")).distinct()
        todo = todo.join(made, "link_url", "left_anti")
    return todo.select("link_url", "url")


def reachable(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, partitions: int | None = None) -> DataFrame:
    """Urls reachable from the seeds over edges (src, dst), with their smallest number of hops.

    Edges are shuffled by source once and stay in place; each hop moves only the new urls and is written to the
    shared folder, so the lineage of a hop is one read. Ends when a hop finds nothing new. To follow only urls that
    are due, leave the edges to other urls out.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/stage/reach-{uuid.uuid4().hex}"

    def keep(urls: DataFrame, hop: int) -> tuple[DataFrame, int]:
        """The urls of a hop as a table, and how many they are, counted while they are written."""
        rows = Observation()
        urls.select("url").observe(rows, F.count("*").alias("n")).write.parquet(f"{folder}/hop={hop}")
        return spark.read.schema("url STRING").parquet(f"{folder}/hop={hop}"), rows.get["n"]

    hot = hot_keys(edges, "src")
    source, salt = F.col("src"), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["src", "_piece"] if hot.keys else ["src"]
    placed = edges.select("src", "dst", F.when(hot.has(source), salt).otherwise(F.lit(0)).alias("_piece"))
    placed = keep_partitioned(placed.select("dst", *keys).repartition(n, *keys))
    (front, size), hop = keep(seeds.select("url").distinct(), 0), 0
    while size and (max_hops is None or hop < max_hops):
        hop += 1
        url = F.col("url")
        pieces = F.when(hot.has(url), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        starts = front.select(url.alias("src"), F.explode(pieces).alias("_piece"))
        found = placed.join(starts, keys).select(F.col("dst").alias("url")).distinct()
        front, size = keep(found.join(spark.read.schema("url STRING, hop INT").parquet(folder), "url", "left_anti"), hop)
    return spark.read.schema("url STRING, hop INT").parquet(folder)
