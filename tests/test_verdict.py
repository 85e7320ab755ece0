"""Cases that were once wrong: long and repeated JSON values, requests of the same run, list items, long pages."""

import time

import pytest

from pagetide.config import Markdown, Refresh, Scope
from pagetide.functions.markup import scan
from pagetide.operators.markdown import to_markdown
from pagetide.plans.refresh import refresh_job
from pagetide.sources import jsonl


def test_long_and_repeated_json_values(spark):
    long = "x" * 25_000_000
    lines = [
        (1, '{"markdown_content": "' + long + '"}'),
        (2, '{"markdown_content": "a", "markdown_content": "b"}'),
        (3, '  {"markdown_content": "c"} '),
        (4, '{"title": "no text"}'),
    ]
    good, skipped = jsonl.read_entries(spark.createDataFrame(lines, "seq int, value string"))
    assert {r["seq"]: len(r["markdown_content"]) for r in good.collect()} == {1: len(long), 2: 1, 3: 1}
    assert good.filter("seq = 2").first()["markdown_content"] == "b"
    assert [r["reason"] for r in skipped.collect()] == ["no markdown_content"]


def test_a_run_does_not_ask_twice(spark):
    page = '<html><body><article><a href="/x">x</a> <a href="/dead">d</a> <a href="/new">n</a></article></body></html>'
    hidden = '<html><head><meta name="robots" content="noindex"></head><body><p>h</p></body></html>'
    rows = [
        (1, "https://e.com/", page, "text/html", 200), (2, "https://e.com/x", hidden, "text/html", 200),
        (3, "https://e.com/dead", None, None, None),
    ]
    raw = spark.createDataFrame(rows, "seq long, url string, body string, content_type string, status int").selectExpr(
        "*", "timestamp_ntz '2024-01-31 00:00:00' AS observed_at"
    )
    registry = spark.createDataFrame(
        [], "url string, content_hash string, markdown_hash string, first_crawled_at timestamp_ntz, last_crawled_at timestamp_ntz, change_count int, status int"
    )
    result = refresh_job(raw, registry, Scope.of(domains=("e.com",)), Refresh("auto", 7), as_of="2024-01-31 00:00:00")
    assert [r["url"] for r in result.frontier.collect()] == ["https://e.com/new"]


@pytest.mark.parametrize("tag, text", [("p", "a"), ("div", "a"), ("h3", "### a")])
def test_first_block_of_an_item_stays_behind_its_bullet(tag, text):
    assert to_markdown(f"<ul><li><{tag}>a</{tag}></li></ul>", "", Markdown(enabled=True)).rstrip() == f"  * {text}"


def test_unclosed_tags_take_no_time():
    began = time.perf_counter()
    assert list(scan("<a " * 400_000)) == []
    assert time.perf_counter() - began < 2
