"""Page parsing: one Arrow pass per body yields metadata, the main-content slice and the links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import islice
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.config import Extract, Scope
from pagetide.functions import gates
from pagetide.functions.batches import slices
from pagetide.functions.markup import MARKUP, attributes, is_empty_element, scan
from pagetide.functions.text import clean_html, fingerprint, strip

LINK = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("rel", T.StringType())]
)
PARSED = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("meta_description", T.StringType()),
        T.StructField("robots_meta", T.StringType()),
        T.StructField("content_raw", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
    ]
)
ARROW_PARSED = pa.schema(
    [
        ("title", pa.string()),
        ("meta_description", pa.string()),
        ("robots_meta", pa.string()),
        ("content_raw", pa.string()),
        ("links", pa.list_(pa.struct([("url", pa.string()), ("text", pa.string()), ("rel", pa.string())]))),
    ]
)
BODY_END = re.compile(r"</body\s*>", re.I)
SITE = re.compile(r"https?://[^/?#]+", re.I)
PLAIN_PATH = re.compile(r"/(?!/)(?:(?!/\.)[^?#;\s])*")
CLASS_TARGETS = ("content", "main")


def _slice(html: str, tags: list, at: int) -> str:
    """Source text of the element that starts at tag number `at`, up to its depth-matched end tag."""
    start, end, _, name, attrs = tags[at]
    if is_empty_element(name, attrs):
        return html[start:end]
    depth = 1
    for _, stop, closing, other, other_attrs in islice(tags, at + 1, None):
        if other != name:
            continue
        if closing:
            depth -= 1
            if depth == 0:
                return html[start:stop]
        elif not is_empty_element(other, other_attrs):
            depth += 1
    body_end = BODY_END.search(html, end)
    return html[start : body_end.start() if body_end and name != "body" else len(html)]


def _text_of(fragment: str) -> str:
    return " ".join(unescape(MARKUP.sub("", fragment)).split())


def read_page(html: str, url: str, mode: str, want_links: bool = True) -> tuple:
    """(title, description, robots, content slice, links) of one HTML page."""
    tags = list(scan(html))
    title, base = "", None
    named: dict[str, str] = {}
    first: dict[str, int] = {}
    anchors = []
    for i, (start, end, closing, name, attrs) in enumerate(tags):
        if closing:
            continue
        if name == "title":
            if not title:
                stop = tags[i + 1][0] if i + 1 < len(tags) else len(html)
                title = unescape(html[end:stop])
        elif name == "meta":
            a = attributes(attrs)
            if "content" in a:
                named.setdefault(a.get("name", ""), a["content"])
        elif name == "base":
            if base is None:
                base = attributes(attrs).get("href")
        elif name in ("main", "article", "body"):
            first.setdefault(name, i)
        elif name in ("a", "area") and "href" in attrs.lower():
            anchors.append(i)
        if "content" in attrs or "main" in attrs:
            a = attributes(attrs)
            tokens = a.get("class", "").split() + [a.get("id", "")]
            for target in CLASS_TARGETS:
                if target in tokens:
                    first.setdefault("." + target, i)

    order = ("body",) if mode == "body" else ("main", "article", ".content", ".main", "body")
    chosen = next((first[k] for k in order if k in first), None)
    content = html if chosen is None else _slice(html, tags, chosen)

    links: dict[str, dict] = {}
    if want_links and anchors:
        root = url
        try:
            root = urljoin(url, base.strip()) if base else url
        except ValueError:
            pass
        site = SITE.match(root)
        behind, follows = len(html), {}  # where the next anchor begins
        for i in range(len(tags) - 1, -1, -1):
            follows[i] = behind
            if tags[i][3] == "a":
                behind = tags[i][0]
        for i in anchors:
            a = attributes(tags[i][4])
            href = a.get("href", "").strip()
            try:
                # plain root-relative links need no full url resolution
                target = site[0] + href if site and PLAIN_PATH.fullmatch(href) else urljoin(root, href)
            except ValueError:
                continue
            if target.lower().startswith(("http://", "https://")) and target not in links:
                text = ""
                if tags[i][3] == "a":
                    text = _text_of(html[tags[i][1] : follows[i]])
                links[target] = {"url": target, "text": text, "rel": a.get("rel")}
    return title, named.get("description", ""), named.get("robots", ""), content, list(links.values())


def parse_pages(observations: DataFrame, extract: Extract = Extract(), want_links: bool = True) -> DataFrame:
    """Replace `body` by the parsed fields. Each body is sent to Python and scanned once, a slice of a batch at a time.

    Expects the columns of `sources.observations`; rows without a body must be gone (see `rejects`).
    """
    kept = [c for c in observations.columns if c != "body"]
    schema = T.StructType([observations.schema[c] for c in kept] + PARSED.fields)
    mode = extract.mode
    page_url, flag = "page_url", "is_json"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.schema.names
            for batch in (whole.slice(*part) for part in slices(whole.column(names.index("body")))):
                columns = [batch.column(names.index(n)) for n in (page_url, flag, "body")]
                rows = [
                    ("", "", "", body, []) if json_page else read_page(body, url, mode, want_links)
                    for url, json_page, body in zip(*(c.to_pylist() for c in columns))
                ]
                parsed = [
                    pa.array([r[k] for r in rows], type=field.type) for k, field in enumerate(ARROW_PARSED)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(n)) for n in kept] + parsed, names=kept + ARROW_PARSED.names
                )

    return observations.mapInArrow(run, schema)


def page_records(observations: DataFrame, scope: Scope, extract: Extract = Extract(), want_links: bool = True) -> DataFrame:
    """Pages inside the scope with title, description, robots value, content, its hash and length, and links.

    The path test needs only the url and runs before the parse; robots needs the parsed meta tag.
    """
    inside = observations.filter(gates.in_path_scope(F.col("url"), scope))
    parsed = parse_pages(inside, extract, want_links)
    allowed = parsed.filter(gates.robots_allowed(F.col("robots_meta"), F.col("is_json"), scope))
    cleaned = allowed.withColumn(
        "content", F.when(F.col("is_json"), F.col("content_raw")).otherwise(clean_html(F.col("content_raw")))
    ).drop("content_raw")
    return (
        cleaned.withColumn("content_hash", fingerprint(F.col("content")))
        .withColumn("length", F.length("content"))
        .withColumn("title", strip(F.col("title")))
        .withColumn("meta_description", strip(F.col("meta_description")))
    )
