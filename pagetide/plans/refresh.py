"""The refresh job: observations and a registry in; records, a new registry, the frontier and rejects out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.config import Extract, Markdown, Refresh, Scope
from pagetide.operators.frontier import page_links, plan_frontier
from pagetide.operators.markdown import add_markdown
from pagetide.operators.parse import page_records
from pagetide.operators.registry import decide, upsert_visits
from pagetide.operators.skew import hot_keys, spread_join
from pagetide.session import stage
from pagetide.sources.observations import as_observations, split_rejects, with_text_bodies

RECORD = (
    "url", "title", "meta_description", "content", "content_hash", "crawled_at", "status", "length", "robots_meta",
    "content_status",
)
MARKDOWN_COLUMNS = ("markdown_content", "markdown_hash", "markdown_length")


@dataclass(frozen=True)
class RefreshResult:
    """Lazy results of one run. `visits` are the observations that were taken over into the registry."""

    records: DataFrame
    registry: DataFrame
    frontier: DataFrame | None
    rejects: DataFrame
    visits: DataFrame
    pages: DataFrame


def _shown(fresh: str | Column, cached: str | Column) -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(F.col("is_fresh"), as_col(fresh)).otherwise(as_col(cached))


def emit(pages: DataFrame, decisions: DataFrame, markdown: Markdown) -> DataFrame:
    """Rows that will be emitted, with text, decision columns and, if switched on, Markdown.

    The gate comes first, so suppressed pages are never converted. Page text moves once, in the join on url and seq.
    """
    chosen = decisions.filter("is_fresh OR is_cached").drop("observed_at", "content_hash", "status")
    rows = pages.drop("links").join(chosen, ["url", "seq"])
    return add_markdown(rows, options=markdown) if markdown.enabled else rows


def as_records(emitted: DataFrame, markdown: Markdown) -> DataFrame:
    """Page records: fresh values for pages taken over, registry values for pages shown from the registry."""
    out = emitted
    if markdown.enabled:
        # a cached row shows the Markdown hash its url had then: from this batch, or from the registry
        cached_here = F.col("previous_seq").isNotNull() & ~F.col("is_fresh")
        made = emitted.filter("is_fresh").select("seq", F.col("markdown_hash").alias("_made"))
        late = emitted.filter(cached_here)
        held = late.select("seq", F.col("previous_seq").alias("_seq"))
        by_seq = made.withColumnRenamed("seq", "_seq")
        found = spread_join(held, by_seq, "_seq", "inner", hot_keys(held, "_seq"), "seq").select("seq", "_made")
        late = late.join(found, "seq", "left")
        out = emitted.filter(~cached_here).withColumn("_made", F.lit(None).cast("string")).unionByName(late)
        stored = F.coalesce(F.nullif("_made", F.lit("")), F.nullif("stored_markdown_hash", F.lit("")), "markdown_hash")
        out = out.withColumn("markdown_hash", _shown("markdown_hash", stored))
    names = RECORD + (MARKDOWN_COLUMNS if markdown.enabled else ())
    return out.select(
        "*",
        _shown("observed_at", "previous_at").alias("crawled_at"),
        _shown("content_hash", "previous_hash").alias("_hash"),
        _shown("status", "previous_status").alias("_status"),
    ).drop("content_hash", "status").withColumnsRenamed({"_hash": "content_hash", "_status": "status"}).select(*names)


def refresh_job(
    raw: DataFrame,
    registry: DataFrame,
    scope: Scope,
    refresh: Refresh = Refresh(),
    extract: Extract = Extract(),
    markdown: Markdown = Markdown(),
    as_of: str | None = None,
    frontier: bool = True,
    changes_only: bool = False,
) -> RefreshResult:
    """One batch of observations against the registry.

    The parsed pages are written once to the shared folder; decisions are made on their narrow columns only. Pages
    without url or body go to `rejects`. Bodies are text, or bytes of any charset. `as_of` is the time at which the frontier is planned. With `changes_only` the
    new registry has just the rows of urls that were taken over, and `registry` need hold the urls of the batch only.
    """
    if changes_only and frontier:
        raise ValueError("the frontier needs the whole registry")
    usable, rejects = split_rejects(raw)
    pages = stage(page_records(as_observations(with_text_bodies(usable)), scope, extract, frontier), "pages")
    narrow = pages.select("url", "seq", "observed_at", "content_hash", "status")
    hot = hot_keys(narrow, "url")
    decisions = stage(decide(narrow, registry, refresh, hot), "decisions")
    emitted = emit(pages, decisions, markdown)
    if markdown.enabled:
        emitted = stage(emitted, "emitted")
        hashes = emitted.filter("is_fresh").select("url", "seq", "observed_at", "content_hash", "markdown_hash", "status")
    else:
        no_hash = F.lit(None).cast("string").alias("markdown_hash")
        hashes = decisions.filter("is_fresh").select("url", "seq", "observed_at", "content_hash", no_hash, "status")
    after = upsert_visits(registry, hashes, hot, changes_only)
    planned = None
    if frontier:
        if as_of is None:
            raise ValueError("planning the frontier needs as_of")
        after = stage(after, "registry")
        planned = plan_frontier(page_links(pages), after, scope, refresh, as_of, seen=raw.select(F.col("url").alias("page_url")))
    return RefreshResult(as_records(emitted, markdown), after, planned, rejects, hashes, pages)
