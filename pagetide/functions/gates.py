"""Predicates that decide which pages and links take part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.config import Refresh, Scope
from pagetide.functions.text import truthy
from pagetide.functions.urls import extension, without_query


def is_json(content_type: Column, url: Column) -> Column:
    """A JSON response, by header or by the end of the url as it was requested."""
    header = F.lower(F.coalesce(content_type, F.lit(""))).contains("application/json")
    return header | F.coalesce(url.endswith(".json"), F.lit(False))


def robots_allowed(robots_meta: Column, json_page: Column, scope: Scope) -> Column:
    """False only for a non-JSON page whose first robots meta tag says noindex."""
    if not scope.respect_robots:
        return F.lit(True)
    return json_page | ~F.lower(F.coalesce(robots_meta, F.lit(""))).contains("noindex")


def in_path_scope(url: Column, scope: Scope) -> Column:
    """The page is a seed, lies below a prefix, or is an ancestor of a prefix."""
    if not scope.prefixes:
        return F.lit(True)
    page = without_query(url)
    seeds = [s.split("?", 1)[0] for s in scope.seeds]
    tests = [page.isin(*seeds)] if seeds else []
    as_folder = F.concat(F.regexp_replace(page, r"/+$", ""), F.lit("/"))
    for prefix in (p.split("?", 1)[0] for p in scope.prefixes):
        tests.append(page.startswith(prefix))
        tests.append(F.startswith(F.lit(prefix.rstrip("/")), as_folder))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def may_follow(rel: Column, scope: Scope) -> Column:
    """A link not marked nofollow."""
    if not scope.respect_robots:
        return F.lit(True)
    return ~F.coalesce(rel, F.lit("")).contains("nofollow")


def visitable_type(url: Column, scope: Scope) -> Column:
    """A link that does not point to a binary file type."""
    if not scope.deny_extensions:
        return F.lit(True)
    return ~F.coalesce(extension(url).isin(*scope.deny_extensions), F.lit(False))


def recrawl_due(known: Column, last_crawled_at: Column, as_of: Column, refresh: Refresh) -> Column:
    """Whether a url is due at `as_of`. Elapsed 24-hour periods count, not calendar days."""
    if refresh.mode == "force":
        return F.lit(True)
    if refresh.mode == "none":
        return ~known
    old = last_crawled_at <= as_of - F.make_dt_interval(F.lit(refresh.days))
    return ~known | last_crawled_at.isNull() | F.coalesce(old, F.lit(False))


def emit_fresh(due: Column, previous_hash: Column) -> Column:
    """The page is taken over: written to the registry and emitted with fresh values."""
    return due | ~truthy(previous_hash)


def emit_cached(due: Column, previous_hash: Column, refresh: Refresh) -> Column:
    """The page is emitted with the values the registry holds."""
    return ~due & truthy(previous_hash) & F.lit(refresh.output_cached)
