"""HTML column to Markdown column, over rows that will be emitted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.config import Markdown
from pagetide.functions.batches import slices
from pagetide.functions.markdown_rules import mark_code_languages, tidy_markdown
from pagetide.functions.markup import MARKUP, attributes, scan
from pagetide.functions.text import fingerprint

SPACES = re.compile(r"\s+")
HEADINGS = {f"h{n}": n for n in range(1, 7)}
MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "u": "*", "del": "~~", "s": "~~", "strike": "~~"}
PARAGRAPHS = frozenset(
    "p div section article main header footer nav aside form figure figcaption address fieldset details summary "
    "dl dt dd center html body".split()
)
HIDDEN = frozenset(("script", "style", "head", "title", "template"))


class _Page:
    """Markdown of one page, written left to right. Breaks and blanks are held back until text follows."""

    def __init__(self, base: str, options: Markdown):
        self.base, self.options = base, options
        self.out: list[str] = []
        self.breaks, self.gap = 0, False
        self.fresh = False  # a line or an item has begun and has no text yet
        self.item = -1  # length of the output where an item has begun
        self.opening: list[str] = []  # emphasis marks whose text has not begun
        self.quote, self.quoted, self.lists = 0, 0, []
        self.links: list[tuple[str, int]] = []
        self.heading = None
        self.pre = 0
        self.tables: list[dict] = []

    def block(self, lines: int = 2):
        self.breaks, self.gap = max(self.breaks, lines), False

    def put(self, text: str):
        """Write text that starts with a printing character, after the breaks or the blank that wait."""
        margin = "> " * self.quote
        if self.breaks:
            if self.out:
                blank = "\n" + ("> " * min(self.quote, self.quoted)).rstrip()
                self.out.append(blank * (self.breaks - 1) + "\n" + margin)
            elif margin:
                self.out.append(margin)
        elif self.gap and self.out:
            self.out.append(" ")
        self.breaks, self.gap, self.fresh, self.quoted = 0, False, False, self.quote
        if self.opening:
            self.out.extend(self.opening)
            self.opening.clear()
        self.out.append(text)

    def text(self, raw: str):
        raw = unescape(raw)
        if self.pre:
            self.out.append(raw)
            return
        flat = SPACES.sub(" ", raw)
        if flat.startswith(" ") and not self.breaks and not self.fresh:
            self.gap = True
        if words := flat.strip(" "):
            self.put(words)
            self.gap = flat.endswith(" ")

    def resolve(self, target: str) -> str:
        try:
            return urljoin(self.base, target) if self.base else target
        except ValueError:
            return target

    def open(self, name: str, a: dict):
        if self.pre and name not in ("pre", "code"):
            return
        bare = self.item == len(self.out)  # right behind a bullet: the first block of an item stays on its line
        if name in HEADINGS:
            if not bare:
                self.block()
            if self.options.heading_style == "setext" and HEADINGS[name] < 3:
                self.put("")
            else:
                self.put("#" * HEADINGS[name] + " ")
            self.heading, self.fresh = len(self.out), True
        elif name in PARAGRAPHS:
            if not bare:
                self.block()
        elif name in MARKS:
            self.opening.append(MARKS[name])
        elif name == "br":
            self.out.append("  \n" + "> " * self.quote)
            self.gap, self.fresh = False, True
        elif name == "hr":
            self.block()
            self.put("* * *")
            self.block()
        elif name == "blockquote":
            self.block()
            self.quote += 1
        elif name in ("ul", "ol"):
            self.block(1 if self.lists else 2)
            start = a.get("start", "")
            self.lists.append([name, int(start) - 1 if start.isdigit() else 0])
        elif name == "li":
            self.block(1)
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.put("  " * max(len(self.lists), 1) + ("* " if kind[0] == "ul" else f"{kind[1]}. "))
            self.fresh, self.item = True, len(self.out)
        elif name == "a":
            if "href" in a and not self.options.ignore_links:
                self.put("[")
                self.links.append((self.resolve(a["href"]), len(self.out)))
        elif name == "img":
            if self.options.preserve_images and a.get("src"):
                self.put(f"![{a.get('alt', '')}]({self.resolve(a['src'])})")
        elif name == "pre":
            self.block()
            self.put(f"```{a.get('lang', '')}\n")
            self.pre += 1
        elif name == "code" and not self.pre:
            self.opening.append("`")
        elif name == "table":
            self.block()
            self.tables.append({"rows": [], "out": None})
        elif name == "tr" and self.tables:
            self.end_cell()
            self.tables[-1]["rows"].append([])
        elif name in ("td", "th") and self.tables:
            self.end_cell()
            table = self.tables[-1]
            if not table["rows"]:
                table["rows"].append([])
            table["out"], self.out = self.out, []
            self.breaks, self.gap = 0, False

    def close(self, name: str):
        if self.pre and name != "pre":
            return
        if name in HEADINGS:
            if self.heading is not None and self.options.heading_style == "setext" and HEADINGS[name] < 3:
                width = len("".join(self.out[self.heading :]).strip())
                self.out.append("\n" + ("=" if name == "h1" else "-") * max(width, 3))
            self.heading = None
            self.block()
        elif name in PARAGRAPHS:
            self.block()
        elif name in MARKS or name == "code":
            mark = MARKS.get(name, "`")
            if mark in self.opening:
                self.opening.remove(mark)
            elif self.out:
                self.out.append(mark)
        elif name == "blockquote":
            self.quote = max(self.quote - 1, 0)
            self.block()
        elif name in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.block(1 if self.lists else 2)
        elif name == "li":
            self.block(1)
        elif name == "a" and self.links:
            target, _ = self.links.pop()
            self.out.append(f"](<{target}>)")
        elif name == "pre" and self.pre:
            self.pre -= 1
            if not (self.out and self.out[-1].endswith("\n")):
                self.out.append("\n")
            self.out.append("```")
            self.block()
        elif name in ("td", "th") and self.tables:
            self.end_cell()
        elif name == "table" and self.tables:
            self.end_cell()
            self.end_table(self.tables.pop()["rows"])

    def end_cell(self):
        table = self.tables[-1]
        if table["out"] is not None:
            table["rows"][-1].append(SPACES.sub(" ", "".join(self.out)).strip())
            self.out, table["out"] = table["out"], None
            self.breaks, self.gap = 2, False
            self.opening.clear()

    def end_table(self, rows: list[list[str]]):
        rows = [r for r in rows if r]
        if not rows:
            return
        if not self.options.preserve_tables:
            for row in rows:
                self.block(1)
                self.put(" ".join(row))
            self.block()
            return
        count = max(map(len, rows))
        rows = [[cell.replace("|", "\\|") for cell in r] + [""] * (count - len(r)) for r in rows]
        widths = [max(3, *(len(r[k]) for r in rows)) for k in range(count)]
        lines = ["| " + " | ".join(c.ljust(w) for c, w in zip(r, widths)) + " |" for r in rows]
        lines.insert(1, "|" + "|".join("-" * (w + 2) for w in widths) + "|")
        self.put("\n".join(lines))
        self.block()


def to_markdown(html: str, base: str, options: Markdown) -> str:
    """Markdown of one HTML fragment, before the tidy rules."""
    page, pos, hidden = _Page(base, options), 0, None
    for start, end, closing, name, attrs in scan(html):
        if hidden is None and start > pos:
            page.text(MARKUP.sub("", html[pos:start]))
        pos = end
        if hidden is not None:
            if closing and name == hidden:
                hidden = None
        elif name in HIDDEN:
            hidden = None if closing else name
        elif closing:
            page.close(name)
        else:
            page.open(name, attributes(attrs) if attrs else {})
            if attrs.endswith("/") and name in ("a", "p", "div"):
                page.close(name)
    if hidden is None:
        page.text(MARKUP.sub("", html[pos:]))
    if page.pre:
        page.pre = 1
        page.close("pre")
    while page.tables:
        page.close("table")
    return "".join(page.out)


def markdown_of(html: Column, base_url: Column, options: Markdown = Markdown()) -> Column:
    """Markdown of an HTML column; relative links are resolved against `base_url`. NULL or empty gives ''."""

    @F.arrow_udf(T.StringType())
    def convert(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, bases in batches:
            for part in slices(pages):
                pairs = zip(pages.slice(*part).to_pylist(), bases.slice(*part).to_pylist())
                yield pa.array([to_markdown(h, b or "", options) if h else "" for h, b in pairs], type=pa.string())

    return tidy_markdown(convert(mark_code_languages(html, options), base_url), options)


def add_markdown(df: DataFrame, html: str = "content", url: str = "url", options: Markdown = Markdown()) -> DataFrame:
    """Add markdown_content, markdown_hash and markdown_length beside an HTML column."""
    return (
        df.withColumn("markdown_content", markdown_of(F.col(html), F.col(url), options))
        .withColumn("markdown_hash", fingerprint(F.col("markdown_content")))
        .withColumn("markdown_length", F.length("markdown_content"))
    )
