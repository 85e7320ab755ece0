"""URL filters: all glob rules run over a url at once, as one bit-parallel automaton.

A canonical url is its host in lower case followed by its path. A rule is a glob over it: `*` stands for any
characters but "/", `**` for any characters, `?` for one character but "/". A site rule (host, path) becomes two such
globs: the path below the host, and below any subdomain (`*` never leaves the host, as the first "/" ends it).

The states of all globs lie side by side in the bits of a mask of several 64-bit words, one state before the first
symbol of a glob and one after each. For every character there is a mask of the states that it leads to and one of the
states whose wildcard it keeps (Shift-And). A step moves all globs by one character: shift the active states, keep
those that the character leads to, and add those that stay in a wildcard. A url matches the globs whose last state is
active at its end. Urls of one batch take their steps together as rows of a numpy matrix, one column for each word; few
long ones are stepped one by one on whole masks.

Defined results: a null url, or one without "://", has an empty host and an empty path. Of the site rules that fit,
the longest decides (host and path together; of equal ones the first as text). If none fits, the glob with
the most plain characters does (of equal ones the first as text), and a url without any match is allowed. Rows are
judged one by one, so repeated rows, null ids, ties and empty tables need no rule. Letters above A-Z keep their case. Urls of
any length are read to their end. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm import shared

U = np.uint64
LONG = 2048  # urls with more characters than this are stepped one by one
ANY, INSIDE, ONE = "**", "*", "?"  # wildcards


@dataclass(frozen=True)
class Site:
    """A verdict for the pages below a path of a host and of its subdomains."""

    verdict: str
    host: str
    path: str = "/"  # begins with "/", or is empty

    def __post_init__(self):
        if "/" in self.host or self.path[:1] not in ("", "/"):
            raise ValueError(f"{self.name!r} is no host followed by a path")

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[list[tuple[str, bool]]]:
        """Symbols (text, whether it is a wildcard) of the globs: for the host, and for its subdomains."""
        plain = [(c, False) for c in self.name]
        # without a path the host must end there
        tails = [[(ANY, True)]] if self.path else [[], [("/", False), (ANY, True)]]
        return [[*head, *plain, *tail] for head in ([], [(INSIDE, True), (".", False)]) for tail in tails]


@dataclass(frozen=True)
class Glob:
    """A verdict for the canonical urls that a glob matches."""

    verdict: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern

    def globs(self) -> list[list[tuple[str, bool]]]:
        symbols, i = [], 0
        while i < len(self.pattern):
            size = 2 if self.pattern.startswith(ANY, i) else 1
            text = self.pattern[i : i + size]
            symbols.append((text, text in (ANY, INSIDE, ONE)))
            i += size
        return [symbols]


SITES = (
    Site("allow", "org"), Site("block", "example.org", "/es/"), Site("block", "example.org", "/en/1"),
    Site("allow", "com", "/fr/"), Site("block", "com", "/de/"),
)
# hosts and paths that rarely hold prose
GLOBS = tuple(Glob("block", p) for p in (
    "*pills*/**", "adult-*/**", "*.adult-*/**", "*casino*/**", "*-deals.*/**", "spam.*/**", "*.spam.*/**",
    "**/login**", "**/signup**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**/cgi-bin/**", "**/calendar/????/**",
    "**.pdf", "**.zip", "**.exe", "**.jp?g", "**/print/**", "**/feed/", "**/tag/*/page/**",
)) + (Glob("allow", "**/print/about**"),)


class Automaton:
    """All globs of the rules in one mask."""

    def __init__(self, rules: tuple[Site | Glob, ...]):
        self.rules = rules
        start, ends, bit = [], [], 0
        moves: dict[str, list[int]] = {}  # plain characters: states that they lead to
        one, stay_any, stay_inside = [], [], []
        for number, rule in enumerate(rules):
            for symbols in rule.globs():
                start.append(bit)
                for text, wild in symbols:
                    if wild and text != ONE:
                        (stay_any if text == ANY else stay_inside).append(bit)
                        continue
                    bit += 1
                    (one if wild else moves.setdefault(text, [])).append(bit)
                ends.append((bit, number))
                bit += 1
        self.words = max(1, -(-bit // 64))
        mask = lambda bits: sum(1 << b for b in set(bits))
        self.start, self.ends = mask(start), ends
        self.chars = sorted(set(moves) | {"/"})
        self.codes = np.array([ord(c) for c in self.chars], np.uint32)
        # masks by class of character: the known ones, then all others
        lead = [mask(moves.get(c, []) + (one if c != "/" else [])) for c in self.chars] + [mask(one)]
        stay = [mask(stay_any + (stay_inside if c != "/" else [])) for c in self.chars] + [mask(stay_any + stay_inside)]
        self.lead, self.stay = lead, stay
        self.lead_words, self.stay_words = self._matrix(lead), self._matrix(stay)
        self.start_words = self._matrix([self.start])[0]

    def _matrix(self, masks: list[int]) -> np.ndarray:
        return np.array([[m >> (64 * w) & (2**64 - 1) for w in range(self.words)] for m in masks], U)

    def _classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))

    def _one(self, text: str) -> int:
        """States at the end of one url."""
        lead, stay, active = self.lead, self.stay, self.start
        for c in self._classes(text).tolist():
            active = (active << 1) & lead[c] | active & stay[c]
            if not active:
                break
        return active

    def _many(self, texts: list[str]) -> np.ndarray:
        """States at the end of each url, a row of words for each."""
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-size, kind="stable")  # the urls that have a character at a place come first
        classes = self._classes("".join(texts))
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        active = np.tile(self.start_words, (len(texts), 1))
        for place in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -place, "left"))
            c = classes[begin[:n] + place]
            now = active[:n]
            moved = now << U(1)
            moved[:, 1:] |= now[:, :-1] >> U(63)
            active[:n] = moved & self.lead_words[c] | now & self.stay_words[c]
        out = np.empty_like(active)
        out[order] = active
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """For each url and rule, whether the rule matches."""
        out = np.zeros((len(texts), len(self.rules)), bool)
        short = [i for i, t in enumerate(texts) if len(t) <= LONG]
        states = self._many([texts[i] for i in short])
        for bit, number in self.ends:
            out[short, number] |= (states[:, bit // 64] >> U(bit % 64) & U(1)).astype(bool)
        for i in set(range(len(texts))) - set(short):
            state = self._one(texts[i])
            for bit, number in self.ends:
                out[i, number] |= bool(state >> bit & 1)
        return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", sites=SITES, globs=GLOBS) -> DataFrame:
    """key, host, path, rule (the site rule that decides, or null), pattern (the glob that does, or null) and verdict."""
    host, path = parts(F.col(url))
    # best rules first: site rules by length, then globs by their plain characters
    plain = lambda g: sum(not wild for _, wild in g.globs()[0])
    rules = (*sorted(sites, key=lambda s: (-len(s.name), s.name)), *sorted(globs, key=lambda g: (-plain(g), g.name)))
    automaton = Automaton(rules)
    site_names = pa.array([r.name if isinstance(r, Site) else None for r in rules] + [None], pa.string())
    glob_names = pa.array([r.name if isinstance(r, Glob) else None for r in rules] + [None], pa.string())
    verdicts = pa.array([r.verdict for r in rules] + ["allow"], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches, 4096):
            texts = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            hit = np.append(automaton.matches(texts), np.ones((len(texts), 1), bool), axis=1)
            first = pa.array(hit.argmax(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, site_names.take(first), glob_names.take(first), verdicts.take(first)],
                ["key", "host", "path", "rule", "pattern", "verdict"],
            )

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    out = rows.mapInArrow(run, f"key {kind}, host string, path string, rule string, pattern string, verdict string")
    return out.withColumnRenamed("key", key)


def _regex(glob: Glob) -> str:
    """The glob in the regular expressions of the comparison."""
    kinds = {ANY: "(?:.|\n)*", INSIDE: "[^/]*", ONE: "[^/]"}
    return "".join(kinds[t] if wild else "[" + t + "]" for t, wild in glob.globs()[0])


def _oracle() -> str:
    site = [f"""('{s.host}', '{s.path}', '{s.verdict}')""" for s in SITES]
    order = sorted(GLOBS, key=lambda g: (-sum(not wild for _, wild in g.globs()[0]), g.name))
    cases = " ".join(f"WHEN regexp_full_match(host || path, '{_regex(g)}') THEN '{g.pattern}'" for g in order)
    allowed = ", ".join(f"'{g.pattern}'" for g in GLOBS if g.verdict == "allow")
    return rf"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {', '.join(site)}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS k FROM pages),
h AS (SELECT page_id, k, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM u),
p AS (SELECT page_id, k, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
r AS (SELECT k, rule_host || rule_path AS rule, rule_verdict FROM p JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) = 1),
g AS (SELECT p.*, r.rule, r.rule_verdict, CASE WHEN r.rule IS NULL THEN CASE {cases} END END AS pattern FROM p LEFT JOIN r USING (k))
SELECT page_id, host, path, rule, pattern,
  coalesce(rule_verdict, CASE WHEN pattern IS NULL OR pattern IN ({allowed}) THEN 'allow' ELSE 'block' END) AS verdict FROM g
"""


ORACLE = _oracle()
