"""Registry jobs: lookups, decisions for repeated observations, history, upsert, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.config import Refresh
from pagetide.functions.gates import emit_cached, emit_fresh, recrawl_due
from pagetide.functions.text import change_label, truthy
from pagetide.functions.urls import authority, site_key
from pagetide.operators.skew import Hot, KeyedOrder, hot_keys, spread_join
from pagetide.operators.takeover import take_over

DAY = 86_400_000_000  # microseconds
REG = "reg_"


def registry_side(registry: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Registry columns under a prefix, with `reg_known` set on every row."""
    return registry.select(
        "url", F.lit(True).alias(REG + "known"), *(F.col(c).alias(REG + c) for c in columns)
    )


def with_registry(observations: DataFrame, registry: DataFrame, columns: tuple[str, ...], hot: Hot) -> DataFrame:
    """Left join of observations with the registry; `reg_known` tells whether the url was there."""
    joined = spread_join(observations, registry_side(registry, columns), "url", "left", hot, "seq")
    return joined.withColumn(REG + "known", F.coalesce(REG + "known", F.lit(False)))


def content_changed(hash_: Column, markdown: Column, old_hash: Column, old_markdown: Column) -> Column:
    """The content hash differs, or there is a Markdown hash and it differs."""
    return ~hash_.eqNullSafe(old_hash) | (truthy(markdown) & ~markdown.eqNullSafe(old_markdown))


# --- which observations are taken over -----------------------------------------------------------------------


def decide(observations: DataFrame, registry: DataFrame, refresh: Refresh, hot: Hot | None = None) -> DataFrame:
    """Decide per observation, in `seq` order per url, what happens to it.

    Each observation sees the state its predecessors left: once a url is taken over, later observations of the same
    url are measured against that time. Input: url, seq, observed_at, content_hash, status (narrow rows, no text).
    Adds is_fresh, is_cached, previous_hash, previous_at, previous_status, previous_seq (of an observation in this
    batch), content_status and the stored Markdown hash.
    """
    hot = hot if hot is not None else hot_keys(observations, "url")
    columns = ("content_hash", "markdown_hash", "last_crawled_at", "status")
    known = with_registry(observations, registry, columns, hot)
    # rows without a usable previous hash are taken over at once and then set the clock of their url
    since = F.when(truthy(F.col("reg_content_hash")), F.col("reg_last_crawled_at"))
    ready = F.col("reg_known") & truthy(F.col("reg_content_hash"))
    order = KeyedOrder(known, "url", "seq", hot)
    now = F.col("observed_at")

    if refresh.mode == "force":
        order = order._with(order.df.withColumn("is_fresh", F.lit(True)))
    elif refresh.mode == "none":
        order = order.before(F.col("seq"), "_first")
        order = order._with(order.df.withColumn("is_fresh", ~ready & F.col("_first").isNull()).drop("_first"))
    elif refresh.days == 0:
        order = order.max_before(now, "_seen")
        latest = F.greatest(since, F.col("_seen"))
        order = order._with(order.df.withColumn("is_fresh", F.coalesce(now >= latest, F.lit(True))).drop("_seen"))
    else:
        wait = F.make_dt_interval(F.lit(refresh.days))
        order = order._with(order.df.withColumn("_open", F.coalesce(now >= since + wait, F.lit(True))))
        order = order.before(F.lit(True), "_taken", when=F.col("_open"))
        first = F.col("_open") & F.col("_taken").isNull()
        settled = order._with(order.df.withColumn("is_fresh", first).drop("_open", "_taken"))
        span = observations.agg((F.max("observed_at") - F.min("observed_at") >= wait).alias("long")).first()["long"]
        if span:  # a url may be taken over again
            settled = take_over(KeyedOrder(known, "url", "seq", hot), "observed_at", since, refresh.days * DAY, "is_fresh")
        order = settled

    held = F.struct(
        F.col("content_hash").alias("hash"),
        F.col("observed_at").alias("at"),
        F.col("status").alias("status"),
        F.col("seq").alias("seq"),
    )
    rows = order.before(held, "_state", when=F.col("is_fresh")).rows()
    in_batch = F.col("_state").isNotNull()
    pick = lambda field, stored: F.when(in_batch, F.col("_state." + field)).otherwise(F.col(stored))
    return rows.select(
        *observations.columns,
        "is_fresh",
        (~F.col("is_fresh") & F.lit(refresh.output_cached)).alias("is_cached"),
        pick("hash", "reg_content_hash").alias("previous_hash"),
        pick("at", "reg_last_crawled_at").alias("previous_at"),
        pick("status", "reg_status").alias("previous_status"),
        F.col("_state.seq").alias("previous_seq"),
        change_label(F.col("content_hash"), pick("hash", "reg_content_hash")).alias("content_status"),
        F.when(~in_batch, F.col("reg_markdown_hash")).alias("stored_markdown_hash"),
    )


# --- history and upsert --------------------------------------------------------------------------------------


def history(visits: DataFrame, registry: DataFrame, hot: Hot | None = None) -> DataFrame:
    """Each visit compared with the one before it, and the change count it leads to.

    Input: url, seq, content_hash, markdown_hash and whatever else should pass through. The registry row stands
    before the first visit; the first visit of an unknown url is not a change.
    """
    hot = hot if hot is not None else hot_keys(visits, "url")
    known = with_registry(visits, registry, ("content_hash", "markdown_hash", "change_count"), hot)
    seen = F.struct(F.col("content_hash").alias("hash"), F.col("markdown_hash").alias("markdown"))
    order = KeyedOrder(known, "url", "seq", hot).before(seen, "_before")
    in_batch = F.col("_before").isNotNull()
    old = lambda field, stored: F.when(in_batch, F.col("_before." + field)).otherwise(F.col(stored))
    changed = (in_batch | F.col("reg_known")) & content_changed(
        F.col("content_hash"),
        F.col("markdown_hash"),
        old("hash", "reg_content_hash"),
        old("markdown", "reg_markdown_hash"),
    )
    order = order._with(order.df.withColumn("changed", changed))
    order = order.running_sum(F.col("changed").cast("int"), "_changes")
    total = (F.coalesce("reg_change_count", F.lit(0)) + F.col("_changes")).cast("int")
    return order.rows().select(*visits.columns, "changed", total.alias("change_count"))


def upsert_visits(
    registry: DataFrame, visits: DataFrame, hot: Hot | None = None, changes_only: bool = False
) -> DataFrame:
    """Registry after any number of visits per url: url, seq, observed_at, content_hash, markdown_hash, status.

    With `changes_only`, just the rows of the visited urls.
    """
    last = F.max_by(
        F.struct("content_hash", "markdown_hash", "observed_at", "status", "change_count"), F.col("seq")
    )
    folded = (
        history(visits, registry, hot)
        .groupBy("url")
        .agg(last.alias("l"), F.min_by("observed_at", "seq").alias("first_at"))
        .select("url", "first_at", "l.*")
    )
    how = "right" if changes_only else "full_outer"
    return _merge(registry, folded, F.col("n.change_count"), F.col("n.first_at"), how)


def upsert(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """Registry after one visit per url: url, observed_at, content_hash, markdown_hash, status."""
    changed = content_changed(
        F.col("n.content_hash"), F.col("n.markdown_hash"), F.col("o.content_hash"), F.col("o.markdown_hash")
    )
    count = F.coalesce("o.change_count", F.lit(0)) + F.when(F.col("o.url").isNotNull() & changed, 1).otherwise(0)
    return _merge(registry, batch, count, F.col("n.observed_at"))


def _merge(registry: DataFrame, news: DataFrame, count: Column, first_at: Column, how: str = "full_outer") -> DataFrame:
    """Join on url. Both sides hold a url once; rows without news survive a full join as they are."""
    o, n = registry.alias("o"), news.alias("n")
    touched = F.col("n.url").isNotNull()
    take = lambda new, old: F.when(touched, F.col("n." + new)).otherwise(F.col("o." + old))
    return o.join(n, F.col("o.url") == F.col("n.url"), how).select(
        F.coalesce("o.url", "n.url").alias("url"),
        take("content_hash", "content_hash").alias("content_hash"),
        take("markdown_hash", "markdown_hash").alias("markdown_hash"),
        F.when(F.col("o.url").isNull(), first_at).otherwise(F.col("o.first_crawled_at")).alias("first_crawled_at"),
        take("observed_at", "last_crawled_at").alias("last_crawled_at"),
        F.when(touched, count).otherwise(F.col("o.change_count")).cast("int").alias("change_count"),
        take("status", "status").cast("int").alias("status"),
    )


# --- single observation per url ------------------------------------------------------------------------------


def label_observations(observations: DataFrame, registry: DataFrame, refresh: Refresh, hot: Hot | None = None) -> DataFrame:
    """Due flag, change label and emission flags against the stored registry, each observation on its own."""
    hot = hot if hot is not None else hot_keys(observations, "url")
    columns = ("content_hash", "markdown_hash", "last_crawled_at", "status")
    joined = with_registry(observations, registry, columns, hot)
    due = recrawl_due(F.col("reg_known"), F.col("reg_last_crawled_at"), F.col("observed_at"), refresh)
    return (
        joined.withColumn("is_due", due)
        .withColumn("content_status", change_label(F.col("content_hash"), F.col("reg_content_hash")))
        .withColumn("is_fresh", emit_fresh(F.col("is_due"), F.col("reg_content_hash")))
        .withColumn("is_cached", emit_cached(F.col("is_due"), F.col("reg_content_hash"), refresh))
    )


# --- statistics ----------------------------------------------------------------------------------------------


def crawl_stats(registry: DataFrame) -> DataFrame:
    """Number of urls, and of urls that changed at least once."""
    return registry.agg(
        F.count("*").alias("total_urls"), F.count_if(F.col("change_count") > 0).alias("changed_urls")
    )


def crawl_stats_by_site(registry: DataFrame) -> DataFrame:
    """The same two counts per site."""
    return registry.groupBy(site_key(authority(F.col("url"))).alias("site")).agg(
        F.count("*").alias("total_urls"), F.count_if(F.col("change_count") > 0).alias("changed_urls")
    )


def recent_pages(registry: DataFrame, n: int = 10) -> DataFrame:
    """The n most recently visited urls."""
    return (
        registry.select("url", "last_crawled_at", "change_count")
        .orderBy(F.desc("last_crawled_at"), "url")
        .limit(n)
    )


def duplicate_content(registry: DataFrame) -> DataFrame:
    """Content hashes found at more than one url, with their number of urls and the first url.

    The registry holds a url once, so a plain count will do, and map-side combining keeps a hash that fills a third
    of the table from reaching one task.
    """
    return (
        registry.filter(truthy(F.col("content_hash")))
        .groupBy("content_hash")
        .agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"))
        .filter("n_urls > 1")
    )


def duplicate_members(registry: DataFrame) -> DataFrame:
    """Every url that shares its content with another, beside the first url of its group."""
    rows = registry.filter(truthy(F.col("content_hash"))).select("content_hash", "url")
    groups = duplicate_content(registry)
    return spread_join(rows, groups, "content_hash", "inner", hot_keys(rows, "content_hash"), "url")
