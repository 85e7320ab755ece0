from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagetide.config import Extract, Markdown, Refresh, Scope
from pagetide.functions import gates, urls
from pagetide.functions.text import change_label, clean_html, fingerprint, strip


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_url_parts(spark):
    given = ["https://a.b.example.com:8080/x/y.PDF?q=1#f", "http://example.com#top", "HTTP://u:p@H/", "not a url", "https://h?x"]
    assert column(spark, given, urls.url_key) == [
        "https://a.b.example.com:8080/x/y.PDF", "http://example.com", "HTTP://u:p@H/", "not a url", "https://h"
    ]
    assert column(spark, given, urls.authority) == ["a.b.example.com:8080", "example.com", "u:p@H", "", "h"]
    assert column(spark, given, urls.extension) == ["pdf", "", "", "", ""]
    assert column(spark, ["a#b?c"], urls.without_query) == ["a#b"]


def test_site_key(spark):
    assert column(spark, ["sub.example.com", "example.com", "a.b.c.example.com", "localhost"], urls.site_key) == [
        "example.com", "example.com", "example.com", "localhost"
    ]


def test_same_domain(spark):
    given = ["https://example.com/path", "https://different.com/", "https://sub.example.com/p", "https://notexample.com/", None]
    test = lambda flag: column(spark, given, lambda c: urls.same_domain(c, ("example.com",), flag))
    assert test(True) == [True, False, True, False, False]
    assert test(False) == [True, False, False, False, False]


def test_domain_suffixes(spark):
    assert column(spark, ["a.b.c"], urls.domain_suffixes) == [["a.b.c", "b.c", "c"]]


@pytest.mark.parametrize(
    "prefixes, expected",
    [
        ("", [True] * 7),
        ("https://example.com/blog/", [True, True, False, True, False, True, False]),
        ("https://example.com/blog", [True, True, False, True, True, True, False]),
        ("https://example.com/about, ,https://example.com/blog/", [True, True, True, True, False, True, False]),
    ],
)
def test_path_scope(spark, prefixes, expected):
    given = [
        "https://example.com/blog/", "https://example.com/blog/post1?x=1", "https://example.com/about",
        "https://example.com/", "https://example.com/blogger", "https://seed.org/start?a=1", "https://example.org/blog/",
    ]
    scope = Scope.of(seeds=("https://seed.org/start?b=2",), prefixes=prefixes)
    assert column(spark, given, lambda c: gates.in_path_scope(c, scope)) == expected


def test_ancestor_test_equals_component_test(spark):
    """The one-line ancestor rule against a component-by-component comparison."""
    pieces = ["", "a", "ab", "b"]
    candidates = ["https://h" + "".join("/" + p for p in (x, y, z)) for x in pieces for y in pieces for z in pieces]
    prefix = "https://h/a/b/ab/"
    scope = Scope.of(seeds=("https://other/",), prefixes=(prefix,))

    def by_components(url):
        mine, theirs = url.rstrip("/").split("/"), prefix.rstrip("/").split("/")
        return url.startswith(prefix) or (len(mine) < len(theirs) and theirs[: len(mine)] == mine)

    got = column(spark, candidates, lambda c: gates.in_path_scope(c, scope))
    assert got == [by_components(u) for u in candidates]


def test_robots(spark):
    given = ["noindex, follow", "NoIndex", "follow", "none", "", None]
    strict, lax = Scope.of(), Scope.of(respect_robots=False)
    html, json = F.lit(False), F.lit(True)
    assert column(spark, given, lambda c: gates.robots_allowed(c, html, strict)) == [False, False, True, True, True, True]
    assert column(spark, given, lambda c: gates.robots_allowed(c, json, strict)) == [True] * 6
    assert column(spark, given, lambda c: gates.robots_allowed(c, html, lax)) == [True] * 6


def test_json_flag(spark):
    df = spark.createDataFrame(
        [("text/html", "http://h/a.json"), ("text/html", "http://h/a.json?x"), ("Application/JSON; x", "http://h/"), (None, "http://h/")],
        "t string, u string",
    )
    assert [r[0] for r in df.select(gates.is_json(F.col("t"), F.col("u"))).collect()] == [True, False, True, False]


def test_nofollow_and_binary_links(spark):
    scope = Scope.of()
    assert column(spark, ["nofollow noopener", "noopener", None], lambda c: gates.may_follow(c, scope)) == [False, True, True]
    assert column(spark, ["http://h/a.PDF?x", "http://h/a.html", "http://h/pdf"], lambda c: gates.visitable_type(c, scope)) == [
        False, True, True
    ]


def test_recrawl_due(spark):
    now = datetime(2024, 1, 31)
    last = [None, datetime(2024, 1, 31), datetime(2024, 1, 24), datetime(2024, 1, 24, 0, 0, 1), datetime(2024, 1, 1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(last)], "i int, v timestamp_ntz").orderBy("i")
    at = F.lit(str(now)).cast("timestamp_ntz")

    def due(mode, known=True):
        test = gates.recrawl_due(F.lit(known), F.col("v"), at, Refresh(mode, 7))
        return [r[0] for r in df.select(test).collect()]

    assert due("auto") == [True, False, True, False, True]
    assert due("force") == [True] * 5
    assert due("none") == [False] * 5
    assert due("none", known=False) == [True] * 5


@pytest.mark.parametrize("due", [True, False])
@pytest.mark.parametrize("previous", ["h", "", None])
@pytest.mark.parametrize("cached", [True, False])
def test_emission_table(spark, due, previous, cached):
    refresh = Refresh(output_cached=cached)
    row = spark.range(1).select(
        gates.emit_fresh(F.lit(due), F.lit(previous).cast("string")).alias("fresh"),
        gates.emit_cached(F.lit(due), F.lit(previous).cast("string"), refresh).alias("cached"),
    ).first()
    assert row["fresh"] == (due or not previous)
    assert row["cached"] == (not due and bool(previous) and cached)


def test_labels(spark):
    df = spark.createDataFrame([("h1", None), ("h1", ""), ("h1", "h2"), ("h1", "h1")], "c string, p string")
    assert [r[0] for r in df.select(change_label(F.col("c"), F.col("p"))).collect()] == ["new", "new", "updated", "unchanged"]


def test_fingerprint(spark):
    golden = "726df8bcc21cb319dde031e10a3ab40ee5ce4979cef01451a9be341fec8e8153"
    assert column(spark, ["This is test content"], fingerprint) == [golden]


def test_clean_html(spark):
    page = (
        "　<div> <script type='x'>var a = '</p>';\n</script><p>Text\n\t with  \x1f spaces</p>"
        "<STYLE>p{}</STYLE><!-- multi\nline --> </div>\n"
    )
    assert column(spark, [page, ""], clean_html) == ["<div> <p>Text with spaces</p> </div>", ""]


def test_strip(spark):
    assert column(spark, ["  a b \x1c", "", None], strip) == ["a b", "", None]


def test_settings():
    for wrong in (lambda: Refresh("sometimes"), lambda: Extract("x"), lambda: Markdown(heading_style="y"), lambda: Refresh(days=-1)):
        with pytest.raises(ValueError):
            wrong()
    assert Scope.of(seeds="https://a.example.com/x?y").domains == ("a.example.com",)
