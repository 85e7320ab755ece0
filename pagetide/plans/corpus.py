"""Inputs of the registered queries, derived by Spark from the given tables.

The page corpus knows neither robots nor description tags, one content element and no repeated visits, so variants are
made by plain text replacement. The expressions are SQL that other engines read in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions.text import clean_html, fingerprint
from pagetide.functions.urls import url_key

AS_OF = "2024-01-31 00:00:00"
HOT_URL = "https://hot.example.com/"

VARIANT_HTML = """
CASE page_id % 6 WHEN 0 THEN replace(h3, '<a href="/', '<a rel="nofollow" href="/') ELSE h3 END
"""
STEPS = (
    (
        "h1",
        """CASE page_id % 10
             WHEN 3 THEN replace(html, '<head>', '<head><meta name="robots" content="noindex">')
             WHEN 4 THEN replace(html, '<head>', '<head><meta name="robots" content="NoIndex,follow">')
             WHEN 5 THEN replace(html, '<head>', '<head><meta name="robots" content="none">')
             ELSE html END""",
    ),
    (
        "h2",
        """CASE page_id % 4 WHEN 0 THEN replace(h1, '<head>',
             concat('<head><meta name="description" content=" About ', CAST(page_id AS VARCHAR(20)), ' ">'))
             ELSE h1 END""",
    ),
    (
        "h3",
        """CASE page_id % 7
             WHEN 1 THEN replace(replace(h2, '<article>', '<main>'), '</article>', '</main>')
             WHEN 2 THEN replace(replace(h2, '<article>', '<div class="x content">'), '</article>', '</div>')
             WHEN 3 THEN replace(replace(h2, '<article>', '<div id="main">'), '</article>', '</div>')
             WHEN 4 THEN replace(replace(h2, '<article>', '<section>'), '</article>', '</section>')
             ELSE h2 END""",
    ),
)
CONTENT_TYPE = "CASE WHEN page_id % 20 = 19 THEN 'application/json' ELSE 'text/html' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def variant_pages(pages: DataFrame) -> DataFrame:
    """Pages with robots and description tags, other content elements, nofollow links and JSON responses."""
    out = pages
    for name, expression in STEPS:
        out = out.withColumn(name, F.expr(expression))
    return out.select(
        "page_id", "url", F.expr(VARIANT_HTML).alias("html"), F.expr(CONTENT_TYPE).alias("content_type")
    )


DELIVERY = 420_000_000_000_000  # added to page_id for each further delivery; a multiple of all divisors used here
LATER = (0, 3, 9)  # days after AS_OF of the deliveries


def delivered_pages(pages: DataFrame, number: int) -> DataFrame:
    """The pages as they are seen again later: with another query, and new text in some of them."""
    if not number:
        return pages.select("page_id", "url", "html")
    new = F.replace("html", F.lit("</article>"), F.lit(f"<p>v{number}</p></article>"))
    return pages.select(
        (F.col("page_id") + number * DELIVERY).alias("page_id"),
        F.concat("url", F.lit(f"?v={number}")).alias("url"),
        F.when(F.col("page_id") % (number + 1) == 0, new).otherwise(F.col("html")).alias("html"),
    )


def as_raw(pages: DataFrame, later: int = 0) -> DataFrame:
    """The observation columns of a table pages(page_id, url, html, content_type), made some days after AS_OF."""
    return pages.select(
        F.col("page_id").cast("bigint").alias("seq"),
        "url",
        F.col("html").alias("body"),
        "content_type",
        F.lit(200).alias("status"),
        (F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval(F.lit(later))).alias("observed_at"),
    )


def as_bytes(pages: DataFrame) -> DataFrame:
    """as_raw with bodies as bytes in several charsets, named by the header, a mark, a tag, or nothing at all."""
    tag = F.lit('<meta charset="utf-8">')
    equiv = F.lit('<meta http-equiv="Content-Type" content="text/html; charset=windows-1252">')
    bare = F.replace("html", tag, F.lit(""))
    n = F.col("page_id") % 7
    body = (
        F.when(n == 0, F.encode("html", "UTF-16LE"))
        .when(n == 1, F.concat(F.unhex(F.lit("FEFF")), F.encode("html", "UTF-16BE")))
        .when(n == 2, F.encode(F.replace("html", tag, equiv), "ISO-8859-1"))
        .when(n == 3, F.encode(bare, "UTF-8"))
        .when(n == 4, F.encode(bare, "UTF-16LE"))
        .when(n == 5, F.encode(bare, "ISO-8859-1"))
        .otherwise(F.encode(bare, "UTF-16BE"))
    )
    kind = F.when(n == 0, "text/html; charset=UTF-16LE").otherwise("text/html")
    return as_raw(pages.select("page_id", "url", body.alias("html"), kind.alias("content_type")))


def article_hash(pages: DataFrame):
    """Fingerprint of the cleaned article element of an unchanged corpus page."""
    return fingerprint(clean_html(F.regexp_extract("html", r"(?s)<article>.*?</article>", 0)))


def derived_registry(pages: DataFrame) -> DataFrame:
    """What an earlier run left behind, with stale, equal or missing hashes and mixed ages.

    Every fifth page is not known by its url; its row is that of a page which is gone.
    """
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    n = F.col("page_id")
    days = lambda d: F.make_dt_interval(d)
    key = url_key(F.col("url"))
    rows = pages.select(
        n.alias("page_id"),
        F.when(n % 5 == 0, F.concat(key, F.lit("/gone"))).otherwise(key).alias("url"),
        F.when(n % 5 == 1, "")
        .when(n % 5 == 2, F.sha2(F.concat(F.lit("stale-"), n.cast("string")).cast("binary"), 256))
        .otherwise(article_hash(pages))
        .alias("content_hash"),
        F.when(n % 2 == 0, F.concat(F.lit("md-"), n.cast("string"))).alias("markdown_hash"),
        (as_of - days(F.lit(30))).alias("first_crawled_at"),
        (as_of - days((n % 14).cast("int"))).alias("last_crawled_at"),
        (n % 3).cast("int").alias("change_count"),
        F.when(n % 11 == 0, 404).otherwise(200).alias("status"),
    )
    # two pages may share a url; the registry holds it once
    state = F.max_by(F.struct(*rows.columns[2:]), "page_id")
    return rows.groupBy("url").agg(state.alias("s")).select("url", "s.*")


def visits(pages: DataFrame) -> DataFrame:
    """Four visits per page, three days apart; the pages of every third id share one hot url."""
    n, k = F.col("page_id"), F.col("k")
    text = lambda *parts: F.sha2(F.concat_ws("-", *(p.cast("string") for p in parts)).cast("binary"), 256)
    version = F.when(k == 0, 0).when((n % 4 == 0) & (k == 3), 2).otherwise(1)
    repeated = pages.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    start = F.lit(AS_OF).cast("timestamp_ntz")
    return repeated.select(
        F.when(n % 3 == 0, HOT_URL).otherwise(url_key(F.col("url"))).alias("url"),
        (k * 1_000_000 + n).cast("bigint").alias("seq"),
        (start + F.make_dt_interval((k * 3).cast("int"), F.lit(0), (n % 600).cast("int"))).alias("observed_at"),
        text(F.lit("body"), F.when(n % 3 == 0, n % 2).otherwise(n), version).alias("content_hash"),
        F.when(k >= 2, text(F.lit("md"), F.when(n % 3 == 0, n % 2).otherwise(n), version)).alias("markdown_hash"),
        F.lit(200).alias("status"),
    )


def document_registry(documents: DataFrame) -> DataFrame:
    """Documents seen as pages of their source, so that exact copies share a hash."""
    return documents.select(
        F.concat(F.lit("https://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        fingerprint(F.col("text")).alias("content_hash"),
    )


def document_entries(documents: DataFrame) -> DataFrame:
    """Documents as entries of combined Markdown; every seventh has no title, every eleventh no url."""
    n = F.col("doc_id")
    return documents.select(
        n.cast("bigint").alias("seq"),
        F.col("source").alias("site"),
        F.when(n % 7 != 0, F.concat(F.lit("Document "), n.cast("string"))).alias("title"),
        F.when(n % 11 != 0, F.concat(F.lit("https://"), "source", F.lit("/"), n.cast("string"))).alias("url"),
        F.col("text").alias("markdown_content"),
    )


def document_lines(documents: DataFrame) -> DataFrame:
    """Documents as JSON Lines, two of ten in good order and the others odd or damaged in one way each."""
    n = F.col("doc_id")
    url = F.concat(F.lit("https://"), "source", F.lit("/"), n.cast("string"))
    full = F.to_json(F.struct(url.alias("url"), F.lit("T").alias("title"), F.col("text").alias("markdown_content")))
    bare = F.to_json(F.struct(F.col("text").alias("markdown_content")))
    string = F.to_json(F.struct(F.col("text").alias("x")))  # {"x":"..."}
    line = (
        F.when(n % 10 == 0, full)
        .when(n % 10 == 1, bare)
        .when(n % 10 == 2, F.concat(full, F.lit(" xyz")))
        .when(n % 10 == 3, F.concat(F.lit("{'markdown_content': '"), F.translate("text", "'\"\\\n\t\r", ""), F.lit("'}")))
        .when(n % 10 == 4, F.to_json(F.struct(url.alias("url"), F.col("text").alias("content"))))
        .when(n % 10 == 5, F.concat(F.lit('{"url": "u", "markdown_content": null, '), F.substr(string, F.lit(2))))
        .when(n % 10 == 6, F.concat(F.lit("["), full, F.lit("]")))
        .when(n % 10 == 7, F.regexp_replace(string, r'^\{"x":|\}$', ""))
        .when(n % 10 == 8, F.regexp_replace("text", r"(?s).", " "))
        .otherwise(F.regexp_replace(bare, r"\}$", ""))
    )
    return documents.select(n.cast("bigint").alias("seq"), line.alias("value"))


def page_edges(pages: DataFrame) -> DataFrame:
    """A synthetic link graph over the pages: page i links to pages (7i+1) mod n and (11i+3) mod n."""
    count = pages.count()
    n = F.col("page_id")
    ids = pages.select(n.alias("dst_id"), url_key(F.col("url")).alias("dst"))
    targets = F.array((n * 7 + 1) % count, (n * 11 + 3) % count)
    out = pages.select(url_key(F.col("url")).alias("src"), F.explode(targets).alias("dst_id"))
    return out.join(ids, "dst_id").select("src", "dst")


def failing_requests(pages: DataFrame) -> DataFrame:
    """Observations of which some have no body, no url, or neither."""
    raw = as_raw(variant_pages(pages))
    return raw.withColumns({"body": F.when(F.col("seq") % 9 != 0, F.col("body")), "url": F.when(F.col("seq") % 13 != 0, F.col("url"))})


# an element of each kind, some around the letters of an article, written as {w}
ELEMENTS = (
    '<article><h2>Some of it</h2><p>One <em>{w}</em> and <strong>two</strong> <a href="/to?x=1">three</a>.</p>'
    "<ul><li>a</li><li>two<ul><li>{w}</li></ul></li></ul><ol><li>first</li><li>b</li></ol><blockquote>said</blockquote>"
    '<img src="i.png" alt="seen"><table><tr><th>A</th><th>B</th></tr><tr><td>{w}</td><td>c</td></tr></table>'
    '<pre><code class="language-py">{w}\n  x = 1</code></pre><hr><p>here<br>end <code>k = 2</code></p></article>'
)


def element_pages(pages: DataFrame) -> DataFrame:
    """seq, url and content: ELEMENTS around the letters of each article."""
    article = F.regexp_extract("html", r"(?s)<article>.*?</article>", 0)
    words = F.trim(F.regexp_replace(F.regexp_replace(article, "<[^>]*>|&[a-z]+;?", " "), r"[^\p{L}]+", " "))
    return pages.select(
        F.col("page_id").alias("seq"), F.lit("http://h/a").alias("url"), F.replace(F.lit(ELEMENTS), F.lit("{w}"), words).alias("content")
    )
