"""The registered queries: one per job, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.config import Chunk, Extract, Markdown, Pack, Refresh, Scope
from pagetide.functions import gates, urls
from pagetide.functions.markdown_rules import mark_code_languages, tidy_markdown
from pagetide.functions.text import clean_html, fingerprint
from pagetide.operators import chunks, combine, frontier, packing, registry
from pagetide.operators.markdown import add_markdown
from pagetide.operators.parse import page_records, parse_pages
from pagetide.operators.skew import hot_keys
from pagetide.plans import corpus
from pagetide.plans.refresh import refresh_job
from pagetide.session import shared_dir, stage
from pagetide.sources import files, jsonl, observations, sinks
from pagetide.streaming import incremental, keyed

EVERYTHING = Scope.of(domains=("example.com", "example.net", "example.org"))
OFF = Scope.of(respect_robots=False)
ONE_DOMAIN = Scope.of(domains=("example.com",))
PREFIXES = Scope.of(
    seeds=("http://therha.example.com/en/676?x=1",),
    prefixes="https://blog., http://www.cheap-pills.example.com/en/4,,https://thther.example.org/en/685/a/b/",
)
WEEK = Refresh("auto", 7)
PACK = Pack(max_bytes=16_384)
CHUNK = Chunk(bytes=1_000)
FILE_PACK = Pack(max_bytes=262_144, prefix="lines")
FILE_CHUNK = Chunk(bytes=65_536)


def _pages(spark, sf):
    return corpus.table(spark, sf, "pages")


def _documents(spark, sf):
    return corpus.table(spark, sf, "documents")


def _variant_observations(spark, sf):
    raw = corpus.as_raw(corpus.variant_pages(_pages(spark, sf)))
    return observations.as_observations(raw)


def url_keys(spark, sf):
    u = F.col("url")
    return _pages(spark, sf).select(
        "page_id",
        urls.url_key(u).alias("key"),
        urls.without_query(u).alias("without_query"),
        urls.authority(u).alias("host"),
        urls.site_key(urls.authority(u)).alias("site"),
        urls.same_domain(u, ("example.com",), True).alias("with_subdomains"),
        urls.same_domain(u, ("thther.example.org", "www.therti.example.org"), False).alias("exact"),
        urls.extension(u).alias("extension"),
    )


def clean_fingerprint(spark, sf):
    cleaned = _pages(spark, sf).select("page_id", clean_html(F.col("html")).alias("c"))
    return cleaned.select("page_id", fingerprint(F.col("c")).alias("content_hash"), F.length("c").alias("length"))


def main_content(spark, sf):
    records = page_records(_variant_observations(spark, sf), OFF, want_links=False)
    return records.select(F.col("seq").alias("page_id"), "content", "content_hash", "length")


def body_content(spark, sf):
    records = page_records(_variant_observations(spark, sf), OFF, Extract("body"), want_links=False)
    return records.select(F.col("seq").alias("page_id"), "content_hash", "length")


def page_metadata(spark, sf):
    records = page_records(_variant_observations(spark, sf), OFF, want_links=False)
    return records.select(F.col("seq").alias("page_id"), "title", "meta_description", "robots_meta")


def robots_scope(spark, sf):
    parsed = parse_pages(_variant_observations(spark, sf), want_links=False)
    return parsed.select(
        F.col("seq").alias("page_id"),
        gates.robots_allowed(F.col("robots_meta"), F.col("is_json"), EVERYTHING).alias("robots_ok"),
        gates.in_path_scope(F.col("url"), PREFIXES).alias("path_ok"),
    )


def recrawl_due(spark, sf):
    pages = _pages(spark, sf)
    seen = pages.select(F.col("page_id").alias("seq"), urls.url_key(F.col("url")).alias("url"))
    known = registry.with_registry(
        seen, corpus.derived_registry(pages), ("last_crawled_at",), hot_keys(seen, "url")
    )
    now = F.lit(corpus.AS_OF).cast("timestamp_ntz")
    due = lambda mode: gates.recrawl_due(F.col("reg_known"), F.col("reg_last_crawled_at"), now, Refresh(mode, 7))
    return known.select(F.col("seq").alias("page_id"), *(due(m).alias(m) for m in ("auto", "force", "none")))


def change_labels(spark, sf):
    pages = _pages(spark, sf)
    seen = pages.select(
        F.col("page_id").alias("seq"),
        urls.url_key(F.col("url")).alias("url"),
        corpus.article_hash(pages).alias("content_hash"),
        F.lit(corpus.AS_OF).cast("timestamp_ntz").alias("observed_at"),
    )
    labelled = registry.label_observations(seen, corpus.derived_registry(pages), WEEK)
    return labelled.select(F.col("seq").alias("page_id"), "is_due", "content_status", "is_fresh", "is_cached")


def _refresh(spark, sf, **settings):
    pages = _pages(spark, sf)
    raw = corpus.as_raw(corpus.variant_pages(pages))
    settings = {"scope": EVERYTHING, "refresh": WEEK, "frontier": False, **settings}
    return refresh_job(raw, corpus.derived_registry(pages), **settings)


def refresh_records(spark, sf):
    return _refresh(spark, sf).records


def refresh_records_uncached(spark, sf):
    return _refresh(spark, sf, refresh=Refresh("none", 7, output_cached=False)).records


def _refresh_with_markdown(spark, sf):
    pages = _pages(spark, sf)
    raw = observations.pages_as_observations(pages, corpus.AS_OF)
    options = Markdown(enabled=True)
    return refresh_job(raw, corpus.derived_registry(pages), OFF, WEEK, markdown=options, frontier=False)


def refresh_records_markdown(spark, sf):
    return _refresh_with_markdown(spark, sf).records.select(
        "url", "content_status", "content_hash", "crawled_at", "markdown_content", "markdown_hash", "markdown_length"
    )


def refresh_bytes(spark, sf):
    """Records of pages that arrive as bytes in several charsets."""
    pages = _pages(spark, sf)
    job = refresh_job(corpus.as_bytes(pages), corpus.derived_registry(pages), OFF, WEEK, frontier=False)
    return job.records.select("url", "title", "content", "content_hash", "content_status", "length")


def registry_after_markdown(spark, sf):
    return _refresh_with_markdown(spark, sf).registry


def registry_after_refresh(spark, sf):
    return _refresh(spark, sf).registry


def registry_upsert(spark, sf):
    pages = _pages(spark, sf)
    n = F.col("page_id")
    rows = pages.select(
        "page_id",
        urls.url_key(F.col("url")).alias("url"),
        F.lit(corpus.AS_OF).cast("timestamp_ntz").alias("observed_at"),
        corpus.article_hash(pages).alias("content_hash"),
        F.when(n % 4 == 0, F.concat(F.lit("md-"), n.cast("string"))).when(n % 4 == 1, "md-new").alias("markdown_hash"),
        F.lit(200).alias("status"),
    )
    # an upsert takes one visit per url
    batch = rows.groupBy("url").agg(F.max_by(F.struct(*rows.columns[2:]), "page_id").alias("v")).select("url", "v.*")
    return registry.upsert(corpus.derived_registry(pages), batch)


def registry_history(spark, sf):
    pages = _pages(spark, sf)
    seen = corpus.visits(pages)
    rows = registry.history(seen, corpus.derived_registry(pages))
    return rows.select("url", "seq", "changed", "change_count")


def registry_after_visits(spark, sf):
    pages = _pages(spark, sf)
    return registry.upsert_visits(corpus.derived_registry(pages), corpus.visits(pages))


def registry_fold(spark, sf):
    pages = _pages(spark, sf)
    narrow = corpus.visits(pages).drop("markdown_hash")
    rows = registry.decide(narrow, corpus.derived_registry(pages), Refresh("auto", 5))
    return rows.select(
        "url", "seq", "is_fresh", "is_cached", "previous_hash", "previous_at", "previous_status", "content_status"
    )


def crawl_stats(spark, sf):
    return registry.crawl_stats(corpus.derived_registry(_pages(spark, sf)))


def crawl_stats_by_site(spark, sf):
    return registry.crawl_stats_by_site(corpus.derived_registry(_pages(spark, sf)))


def recent_pages(spark, sf):
    return registry.recent_pages(corpus.derived_registry(_pages(spark, sf)))


def duplicate_content(spark, sf):
    return registry.duplicate_content(corpus.document_registry(_documents(spark, sf)))


def duplicate_members(spark, sf):
    return registry.duplicate_members(corpus.document_registry(_documents(spark, sf)))


def page_links(spark, sf):
    return frontier.page_links(parse_pages(_variant_observations(spark, sf))).withColumn(
        "rel", F.coalesce("rel", F.lit(""))
    )


def link_counts(spark, sf):
    return frontier.link_counts(parse_pages(_variant_observations(spark, sf)), ONE_DOMAIN)


def scope_links(spark, sf):
    """Links on the sites of a scope table; here hosts of pages or the domains above them, some with subdomains."""
    pages = _pages(spark, sf)
    host = urls.authority(F.col("url"))
    sites = (
        pages.select(F.when(F.length(host) % 2 == 0, host).otherwise(urls.site_key(host)).alias("domain"))
        .distinct()
        .withColumn("include_subdomains", F.length("domain") % 3 == 0)
    )
    links = frontier.page_links(stage(parse_pages(_variant_observations(spark, sf)), "parsed"))
    return frontier.in_scope_table(links, sites).select("src_url", "url")


def next_urls(spark, sf):
    result = _refresh(spark, sf, scope=ONE_DOMAIN, frontier=True, as_of=corpus.AS_OF)
    return result.frontier


def reachable(spark, sf):
    pages = _pages(spark, sf)
    now = F.lit(corpus.AS_OF).cast("timestamp_ntz")
    old = corpus.derived_registry(pages)
    resting = old.filter(~gates.recrawl_due(F.lit(True), F.col("last_crawled_at"), now, WEEK)).select(
        F.col("url").alias("dst")
    )
    edges = corpus.page_edges(pages).join(resting, "dst", "left_anti").select("src", "dst")
    seeds = pages.filter("page_id % 50 = 0").select(urls.url_key(F.col("url")).alias("url"))
    return frontier.reachable(edges, seeds)


def byte_chunks(spark, sf):
    return chunks.byte_chunks(_documents(spark, sf), CHUNK, "doc_id", "text")


def _line_sizes(spark, sf):
    return _documents(spark, sf).select(F.col("doc_id").alias("seq"), packing.line_bytes(F.col("text")).alias("nbytes"))


def shard_pack(spark, sf):
    return packing.assign_shards(_line_sizes(spark, sf), PACK)


def shard_manifest(spark, sf):
    return packing.shard_manifest(packing.assign_shards(_line_sizes(spark, sf), PACK))


def entries_combined(spark, sf):
    return combine.combine_entries(corpus.document_entries(_documents(spark, sf)), corpus.AS_OF, "site")


def entry_counts(spark, sf):
    return combine.entry_counts(corpus.document_entries(_documents(spark, sf)), "site")


def jsonl_scan(spark, sf):
    return jsonl.read_entries(corpus.document_lines(_documents(spark, sf)))[0]


def jsonl_skipped(spark, sf):
    return jsonl.read_entries(corpus.document_lines(_documents(spark, sf)))[1].select("seq", "reason")


def markdown_post(spark, sf):
    marked = F.concat(
        F.lit("```  sql\nx\n```\n\n\n\n[a b](<https://e.org/?q=1>) snake_case_name __bold__ _em_\n"), F.col("text")
    )
    return _documents(spark, sf).select("doc_id", tidy_markdown(marked, Markdown()).alias("markdown"))


def code_languages(spark, sf):
    code = F.concat(
        F.when(F.col("doc_id") % 2 == 0, '<pre><code class="language-').otherwise("<pre><code class='lang-"),
        F.col("lang"),
        F.when(F.col("doc_id") % 2 == 0, '">').otherwise("'>"),
        F.regexp_replace("text", r"[<>]", " "),
        F.lit("</code></pre>"),
    )
    return _documents(spark, sf).select("doc_id", fingerprint(mark_code_languages(code, Markdown())).alias("html_hash"))


def markdown_corpus(spark, sf):
    raw = observations.pages_as_observations(_pages(spark, sf), corpus.AS_OF)
    records = page_records(observations.as_observations(raw), OFF, want_links=False)
    return add_markdown(records).select(
        F.col("seq").alias("page_id"), "markdown_content", "markdown_hash", "markdown_length"
    )


def page_decode(spark, sf):
    """Pages as bytes in four charsets, named by the header, a meta tag, an http-equiv tag or nothing."""
    n = F.col("page_id") % 4
    raw = _pages(spark, sf).select(
        "page_id",
        "url",
        F.when(n == 0, "text/html; charset=UTF-16LE; x=1").otherwise("text/html").alias("content_type"),
        F.when(n == 0, F.encode("html", "UTF-16LE"))
        .when(n == 1, F.encode("html", "UTF-8"))
        .when(
            n == 2,
            F.encode(
                F.replace(
                    "html",
                    F.lit('<meta charset="utf-8">'),
                    F.lit('<meta http-equiv="Content-Type" content="text/html; charset=windows-1252">'),
                ),
                "ISO-8859-1",
            ),
        )
        .otherwise(F.encode(F.replace("html", F.lit('<meta charset="utf-8">'), F.lit("")), "UTF-8"))
        .alias("bytes"),
    )
    name = observations.charset(F.col("content_type"), F.col("url"), F.col("bytes"))
    named = raw.select("page_id", name.alias("charset"), "bytes")
    return named.select(
        "page_id", "charset", fingerprint(observations.decode_body(F.col("bytes"), F.col("charset"))).alias("text_hash")
    )


def incremental_refresh(spark, sf):
    """The registry after the pages arrived three times, some days apart, as micro-batches of a stream."""
    pages = _pages(spark, sf)
    deliveries = (
        corpus.as_raw(corpus.variant_pages(corpus.delivered_pages(pages, k)), days) for k, days in enumerate(corpus.LATER)
    )
    return incremental.run_deliveries(
        deliveries, corpus.derived_registry(pages), f"{shared_dir(spark)}/stream", scope=EVERYTHING, refresh=WEEK, buckets=32
    )


def keyed_refresh(spark, sf):
    """Decisions on the same three deliveries with the registry as keyed state of a stream."""
    pages = _pages(spark, sf)

    def narrow(number, days):
        raw = corpus.as_raw(corpus.variant_pages(corpus.delivered_pages(pages, number)), days)
        records = page_records(observations.as_observations(raw), EVERYTHING, want_links=False)
        no_hash = F.lit(None).cast("string").alias("markdown_hash")
        return records.select("url", "seq", "observed_at", "content_hash", no_hash, "status")

    deliveries = (narrow(k, days) for k, days in enumerate(corpus.LATER))
    decided = keyed.run_deliveries(deliveries, corpus.derived_registry(pages), WEEK, f"{shared_dir(spark)}/keyed")
    return decided.select(
        "url", "seq", "is_fresh", "is_cached", "previous_hash", "previous_at", "previous_status", "content_status"
    )


def _folder(spark, name):
    return f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def records_jsonl(spark, sf):
    """The page records, written as JSON Lines and read again."""
    records, path = _refresh(spark, sf).records, _folder(spark, "records")
    sinks.write_records(records, path)
    return spark.read.schema(records.schema).options(timestampNTZFormat=sinks.ISO, **jsonl.STRICT).json(path)


def rejected_requests(spark, sf):
    return observations.split_rejects(corpus.failing_requests(_pages(spark, sf)))[1]


def _line_files(spark, sf):
    """The documents as JSON Lines in files of bounded size."""
    lines, path = stage(corpus.document_lines(_documents(spark, sf)), "json"), _folder(spark, "lines")
    assigned = packing.assign_shards(lines.select("seq", packing.line_bytes(F.col("value")).alias("nbytes")), FILE_PACK)
    sinks.write_shard_files(lines, assigned, path, FILE_PACK)
    return files.read_lines(spark, path)


def shard_files(spark, sf):
    """Shards as files with exact names: every line of every file."""
    lines = _line_files(spark, sf)
    return lines.select(files.file_name(F.col("file")).alias("name"), "line", "seq", fingerprint(F.col("value")).alias("line_hash"))


def jsonl_combined(spark, sf):
    """Files of JSON Lines, read in the order of their lines and combined into one Markdown document."""
    entries, _ = jsonl.read_entries(_line_files(spark, sf).drop("file", "line"))
    pieces = combine.combine_entries(entries.withColumn("document", F.lit("all")), corpus.AS_OF, "document")
    return pieces.select("seq", "piece")


def _combined_files(spark, sf):
    path = _folder(spark, "combined")
    sinks.write_combined_files(entries_combined(spark, sf), path, "site")
    return path


def combined_files(spark, sf):
    """A Markdown file for each site: its lines."""
    lines = files.read_lines(spark, _combined_files(spark, sf))
    return lines.select(files.file_name(F.col("file")).alias("name"), "line", fingerprint(F.col("value")).alias("line_hash"))


def chunk_files(spark, sf):
    """The Markdown files of the sites, cut into files of a fixed size."""
    path = _folder(spark, "chunks")
    sinks.write_chunk_files(files.read_chunks(spark, _combined_files(spark, sf), FILE_CHUNK), path, "file")
    written = files.read_chunks(spark, path, FILE_CHUNK)  # each of them is one chunk
    return written.select(F.col("file").alias("name"), F.octet_length("bytes").alias("n_bytes"), F.sha2("bytes", 256).alias("bytes_hash"))


def markdown_elements(spark, sf):
    """Headings, emphasis, links, lists, quotes, images, tables, code and rules."""
    return add_markdown(corpus.element_pages(_pages(spark, sf))).select(
        F.col("seq").alias("page_id"), "markdown_content", "markdown_hash", "markdown_length"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        url_keys, clean_fingerprint, main_content, body_content, page_metadata, robots_scope, recrawl_due,
        change_labels, refresh_records, refresh_records_uncached, refresh_records_markdown, registry_after_markdown,
        registry_after_refresh, registry_upsert, registry_history, registry_after_visits, registry_fold, crawl_stats, crawl_stats_by_site,
        recent_pages, duplicate_content, duplicate_members, page_links, link_counts, scope_links, next_urls,
        reachable, byte_chunks, shard_pack, shard_manifest, entries_combined, entry_counts, jsonl_scan,
        jsonl_skipped, markdown_post, code_languages, markdown_corpus, page_decode, refresh_bytes, incremental_refresh,
        records_jsonl, rejected_requests, shard_files, jsonl_combined, combined_files, chunk_files, markdown_elements, keyed_refresh,
    )
}
