"""Tag scanner shared by the two Python stages (page parsing and Markdown conversion)."""

from __future__ import annotations

import re
from html import unescape

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Elements whose text is not markup, and elements without an end tag.
RAW_TEXT = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in ("script", "style", "title", "textarea")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def scan(html: str):
    """Yield (start, end, closing, name, attribute text) of every tag; comments and raw text are skipped."""
    pos, last = 0, html.rfind(">") + 1  # no tag ends behind the last bracket
    while found := MARKUP.search(html, pos, last):
        pos = found.end()
        name = found[2]
        if name is None:
            continue
        name = name.lower()
        closing = found[1] == "/"
        yield found.start(), pos, closing, name, found[3]
        if not closing and name in RAW_TEXT:
            end = RAW_TEXT[name].search(html, pos)
            pos = end.start() if end else len(html)


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name; the first of equal names counts."""
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def is_empty_element(name: str, attrs: str) -> bool:
    return name in VOID or attrs.endswith("/")
