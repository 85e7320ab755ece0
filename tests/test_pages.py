import codecs
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagetide.config import Extract, Markdown, Scope
from pagetide.functions.markdown_rules import mark_code_languages, tidy_markdown
from pagetide.operators.markdown import add_markdown, markdown_of
from pagetide.operators.parse import page_records, read_page
from pagetide.sources.observations import OBSERVATION, as_observations, charset, decode_body, split_rejects, with_text_bodies

NOW = datetime(2024, 1, 31)
ALL = "<html><body>{}</body></html>"
MAIN = "<main><p>Main</p></main>"
ARTICLE = "<article>Art</article>"
CONTENT = "<div class='big content'>C<div>in</div></div>"
MAIN_DIV = "<div id=main>M</div>"


def content(html, mode="auto"):
    return read_page(html, "http://h/", mode)[3]


@pytest.mark.parametrize(
    "body, expected",
    [
        (CONTENT + ARTICLE + MAIN, MAIN),
        (MAIN_DIV + CONTENT + ARTICLE, ARTICLE),
        (MAIN_DIV + CONTENT, CONTENT),
        ("<p class=contents></p>" + MAIN_DIV, MAIN_DIV),
        ("<section><br class='main'/>x</section>", "<br class='main'/>"),
        ("<div id='content'>a<div>b</div>c</div><div class=content>z</div>", "<div id='content'>a<div>b</div>c</div>"),
        ("<p>x</p>", "<body><p>x</p></body>"),
        ("<script>'<main>no</main>'</script><!-- <main>no</main> --><p>x</p>", None),
        ("<main>open <p>x", "<main>open <p>x"),
    ],
)
def test_cascade(body, expected):
    html = ALL.format(body)
    assert content(html) == (expected or f"<body>{body}</body>")
    assert content(html, "body") == f"<body>{body}</body>"


def test_body_without_end_and_no_body():
    assert content("<html><body><p>x</p>") == "<body><p>x</p>"
    assert content("<p>plain</p>") == "<p>plain</p>"


def test_metadata():
    html = (
        "<head><title></title><TITLE> A &amp; <b> </TITLE><meta name=description content=' d '>"
        "<meta name='robots'><meta content=\"NoIndex\" name='robots'><meta name='robots' content='follow'></head>"
    )
    title, description, robots, _, _ = read_page(html, "http://h/", "auto")
    assert (title, description, robots) == (" A & <b> ", " d ", "NoIndex")


def test_links():
    html = (
        "<base href='/dir/'><a href='x?q=1&amp;r=2#f' rel='nofollow me'>One <b>two</b> &amp; x</a>"
        "<a name='no'>n</a><area HREF='//o.org/y'><a href='mailto:a@b'>m</a><a href='javascript:f()'>j</a>"
        "<a href='x?q=1&r=2#f'>again</a><a href=' /p '>p</a><a href='http://[bad'>b</a><a href=\"/d/../e\">e</a>"
    )
    links = read_page(html, "https://h.com/a/b", "auto")[4]
    assert [(link["url"], link["text"], link["rel"]) for link in links] == [
        ("https://h.com/dir/x?q=1&r=2#f", "One two & x", "nofollow me"),
        ("https://o.org/y", "", None),
        ("https://h.com/p", "p", None),
        ("https://h.com/e", "e", None),
    ]


def observe(spark, rows):
    raw = spark.createDataFrame([(*r, 200, NOW) for r in rows], OBSERVATION)
    return as_observations(raw)


def test_page_records(spark):
    rows = [
        (1, "http://h/a?x#y", ALL.format("<main> A\n b </main>"), "text/html"),
        (2, "http://h/data.json", '{"a":  1, "robots": "noindex"}', "text/html"),
        (3, "http://h/no", "<meta name=robots content='noindex'><p>x</p>", None),
        (4, "http://other/", "<p>x</p>", None),
        (5, "http://h/e", "", None),
    ]
    scope = Scope.of(seeds=("http://h/",), prefixes=("http://h/",))
    got = {r["seq"]: r for r in page_records(observe(spark, rows), scope).collect()}
    assert sorted(got) == [1, 2, 5]
    assert (got[1]["url"], got[1]["content"], got[1]["length"]) == ("http://h/a", "<main> A b </main>", 18)
    assert (got[2]["content"], got[2]["title"], got[2]["links"]) == (rows[1][2], "", [])
    assert (got[5]["content"], got[5]["length"]) == ("", 0)
    ungated = page_records(observe(spark, rows), Scope.of(respect_robots=False), Extract("body"))
    assert ungated.count() == 5


def test_rejects(spark):
    raw = spark.createDataFrame([(1, "http://h/", None, None, 500, NOW), (2, None, "x", None, 200, NOW), (3, "u", "", None, 200, NOW)], OBSERVATION)
    usable, rejects = split_rejects(raw)
    assert [r["seq"] for r in usable.collect()] == [3]
    assert {(r["seq"], r["reason"]) for r in rejects.collect()} == {(1, "no body"), (2, "no url")}


def test_charset_and_decoding(spark):
    text = "<p>日本 é</p>"
    meta = '<META charset="Shift_JIS">'
    equiv = "<meta http-equiv='Content-Type' content='text/html; charset=euc-jp'>"
    rows = [
        (1, "text/html; Charset=ISO-8859-1; x", "u", "é".encode("latin-1"), None, "iso-8859-1", "é"),
        (2, "text/html", "u", (meta + "日本").encode("shift_jis"), None, "shift_jis", meta + "日本"),
        (3, None, "u", (equiv + "日本").encode("euc-jp"), None, "euc-jp", equiv + "日本"),
        (4, "text/html", "u", text.encode(), None, "utf-8", text),
        (5, "application/json", "u", meta.encode(), None, "utf-8", meta),
        (6, "text/html; charset=utf-8", "u", b"a\xffb", "", "utf-8", "a�b"),
        (7, "text/html; charset=utf-8", "u", "é".encode("cp1252"), "cp1252", "cp1252", "é"),
        (8, "text/html; charset=nonsense", "u", "é".encode(), None, "nonsense", "é"),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "i int, t string, u string, b binary, d string").orderBy("i")
    named = df.withColumn("c", charset(F.col("t"), F.col("u"), F.col("b"), F.col("d")))
    got = named.select("i", "c", decode_body(F.col("b"), F.col("c")).alias("x")).collect()
    assert [(r["c"], r["x"]) for r in got] == [r[5:] for r in rows]


# --- Markdown ---------------------------------------------------------------------------------------------------


def convert(spark, html, base="https://example.com/a/b", **options):
    df = spark.createDataFrame([(html, base)], "h string, b string")
    return df.select(markdown_of(F.col("h"), F.col("b"), Markdown(**options))).first()[0]


HARBOUR = "https://harbour.test/log/day"


def test_markdown_of_a_log_entry(spark):
    html = (
        '<h3>Tide table</h3><p>High water <b>04:12</b>, then <i>falling</i>; see <a href="../chart?d=2#low">its curve</a></p>'
        "<blockquote>Mind the <code>ebb</code></blockquote><ol><li>Moor<li>Wait<ul><li>an hour<li>or two</ul></ol><h6>R&amp;D</h6>"
        '<pre><code class="language-sql">SELECT 1\n  FROM tides</code></pre><hr/><p>one<br/>two<style>p{}</style></p>'
        '<!-- <p>off</p> --><img alt="The bay" src="/img/bay.png">'
    )
    blocks = [
        "### Tide table", "High water **04:12**, then *falling*; see [its curve](https://harbour.test/chart?d=2#low)", "> Mind the `ebb`",
        "  1. Moor\n  2. Wait\n    * an hour\n    * or two", "###### R&D", "```sql\nSELECT 1\n  FROM tides\n```", "* * *", "one  \ntwo",
        "![The bay](https://harbour.test/img/bay.png)",
    ]
    assert convert(spark, html, HARBOUR) == "\n\n".join(blocks)


def test_markdown_of_berths(spark):
    html = (
        "<table><caption>Berths</caption><tr><th>Pier</th><th>Boats<th>Free</th></tr>"
        "<tr><td>North</td><td>12</td><td><i>none</i></td></tr><tr><td>Old | new</td></tr></table>"
    )
    rows = ["| Pier       | Boats | Free   |", "|------------|-------|--------|", "| North      | 12    | *none* |", "| Old \\| new |       |        |"]
    assert convert(spark, html) == "\n".join(["Berths", "", *rows])
    assert convert(spark, html, preserve_tables=False) == "Berths\n\nPier Boats Free\nNorth 12 *none*\nOld | new"


@pytest.mark.parametrize(
    "html, options, expected",
    [
        ("<h2>Log</h2><p>x</p><h1>A</h1><h4>z</h4>", {"heading_style": "setext"}, "Log\n---\n\nx\n\nA\n===\n\n#### z"),
        ('<ul><li>to <a href="/pier">the pier</a>, <a href="mailto:x@y">mail</a></li></ul>', {"ignore_links": True}, "* to the pier, mail"),
        ('<p><img src="a.png" alt="buoy"></p><p>Red buoy</p>', {"preserve_images": False}, "Red buoy"),
        ("<pre><code class='lang-js'>x</code></pre>", {"code_highlighting": False}, "```\nx\n```"),
        ("<p>a_b_c</p><p>__z__</p>", {}, "a*b*c\n\n_*z*_"),
        ("<p>__z__ a_b_c</p>", {"rewrite_emphasis": False}, "__z__ a_b_c"),
    ],
)
def test_markdown_settings(spark, html, options, expected):
    assert convert(spark, html, HARBOUR, **options) == expected


def test_markdown_columns_of_empty_content(spark):
    df = spark.createDataFrame([("", "u"), (None, "u")], "content string, url string")
    for row in add_markdown(df).collect():
        assert (row["markdown_content"], row["markdown_length"]) == ("", 0)
        assert row["markdown_hash"].startswith("e3b0c442")


def test_rules(spark):
    df = spark.createDataFrame([("# H\n\n\n\n\nText  x\n\n\n\n```  sql\na\n```\n[t](<http://h/?a b>)\n",)], "m string")
    tidy = lambda **o: df.select(tidy_markdown(F.col("m"), Markdown(**o))).first()[0]
    assert tidy() == "# H\n\nText  x\n\n```sql\na\n```\n[t](http://h/?a b)"
    assert "(<http" in tidy(ignore_links=True)
    assert "```  sql" in tidy(code_highlighting=False)
    html = spark.createDataFrame([('<pre><code class="language-js">a</code></pre><pre><code class="x lang-y">b</code></pre>',)], "h string")
    assert html.select(mark_code_languages(F.col("h"), Markdown())).first()[0] == (
        '<pre lang="js"><code>a</code></pre><pre><code class="x lang-y">b</code></pre>'
    )


@pytest.mark.parametrize("junk", ["<", "<a", "<p", "</", "<!--", "<a href='", "&#xFFFFFFFF;", "<td>x", "</table></li></b></a>", "<li>x<table><tr><td><pre>"])
def test_broken_markup_never_fails(junk):
    from pagetide.operators.markdown import to_markdown

    for html in (junk, f"<body>{junk}</body>", f"x{junk}y"):
        read_page(html, "http://h/", "auto")
        to_markdown(html, "http://h/", Markdown())


def test_bodies_as_bytes(spark):
    """Mark, header, tag, statistics, in this order; empty, null and broken bytes; text tables stay as they are."""
    kana = "<p>これはテストのページです。カタカナもある</p>"
    rows = [
        (1, "text/html; charset=utf-8", "\ufeff<p>é</p>".encode("utf-16le"), "<p>é</p>"),
        (2, "text/html; charset=utf-16be", "<p>é</p>".encode("utf-16be"), "<p>é</p>"),
        (3, "text/html", ("<meta charset='koi8-r'>" + "да").encode("koi8-r"), "<meta charset='koi8-r'>да"),
        (4, None, kana.encode("euc_jp"), kana),
        (5, None, kana.encode("cp932"), kana),
        (6, None, kana.encode("iso-2022-jp"), kana),
        (7, None, kana.encode(), kana),
        (8, None, "<p>ça “va”</p>".encode("cp1252"), "<p>ça “va”</p>"),
        (9, None, "<p>é and more</p>".encode("utf-16be"), "<p>é and more</p>"),
        (10, "text/html; charset=utf-8", b"a\xffb", "a\ufffdb"),
        (11, "text/html; charset=nonsense", "é".encode(), "é"),
        (12, None, b"", ""),
        (13, None, None, None),
        (14, None, codecs.BOM_UTF8 + "é".encode(), "é"),
        (15, "application/json", '{"a": "é"}'.encode("cp1252"), '{"a": "é"}'),
    ]
    schema = "seq long, url string, content_type string, body binary"
    given = spark.createDataFrame([(i, f"http://e.com/{i}", kind, raw) for i, kind, raw, _ in rows], schema)
    got = {r["seq"]: r["body"] for r in with_text_bodies(given).collect()}
    assert got == {i: text for i, _, _, text in rows}
    text = given.withColumn("body", given["content_type"])
    assert with_text_bodies(text) is text
    assert with_text_bodies(given.limit(0)).collect() == []
