"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Cost and rejection of each rule are estimated on a sample: the rule alone is timed over it, and the share of
documents it rejects is counted. Rules are then ordered by rejection per cost, and each document is judged by the first
rule that rejects it, so later rules are not evaluated. The order has no influence on the verdict.

Defined results: a null text has no words and fails the base. Empty tables give an empty result. Rows are judged one by
one, so repeated rows get equal results. Other columns are not looked at.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.shared import SPACES
from pagetide.session import stage

SAMPLE_ROWS = 1_000  # about as many documents are looked at for costs and rejections
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

# A document is rejected where the condition holds. `words` are the words, `t` is the text.
RULES = {
    "symbols": "10 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "shouting": "2 * length(regexp_replace(t, '[^A-Z]+', '')) > length(regexp_replace(t, '[^A-Za-z]+', ''))",
    "letters": "2 * length(regexp_replace(t, '[^\\\\p{L}]+', '')) < word_chars",
    "long_words": "exists(words, w -> length(w) > 1000)",
}


def base(docs: DataFrame) -> DataFrame:
    """doc_id, t, words and the counts of the text."""
    t = F.coalesce("text", F.lit(""))
    blank = F.lit(BLANK)
    split = docs.select(
        "doc_id", t.alias("t"),
        F.filter(F.split(F.btrim(t, blank), SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split(t, "\n"), lambda line: F.btrim(line, blank) != "").alias("lines"),
    )
    return split.select(
        "doc_id", "t", "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANK, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _bound(F.col("words"), _repeat_words).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _bound(value: Column, body) -> Column:
    """body(value) with the value evaluated once, however often the body names it and wherever filters move it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of three words that occur twice or more, the first included."""
    word = lambda i, k: F.element_at(words, i + k)
    windows = F.when(
        F.size(words) >= 3,
        F.sort_array(F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.struct(F.xxhash64(word(i, 0), word(i, 1), word(i, 2)).alias("h"), i.alias("p")),
        )),
    ).otherwise(F.array().cast("array<struct<h: bigint, p: int>>"))
    return _bound(windows, _covered)


def _covered(windows: Column) -> Column:
    """Sorted by hash, equal windows are neighbours. Each repeated one covers up to 3 words before the next begins."""
    h = lambda i: F.get(windows, i)["h"]
    n = F.size(windows)
    repeated = F.filter(windows, lambda x, i: ((i > 0) & (h(i - 1) == x["h"])) | ((i < n - 1) & (h(i + 1) == x["h"])))
    return F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["p"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")),
        lambda s: s["n"],
    )


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def plan(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, rejected share, seconds) in the order of the cascade, from a sample of about `sample_rows` documents."""
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    sample = stage(base(docs.sample(fraction=share, seed=11)).filter(~base_failed()), "sample")
    n = max(sample.count(), 1)

    def timed(condition: str) -> tuple[float, int]:
        began = time.perf_counter()
        hits = sample.agg(F.count_if(F.expr(condition)).alias("n")).first()["n"]
        return time.perf_counter() - began, hits

    timed("n_words < 0")
    nothing = min(timed("n_words < 0")[0] for _ in range(2))
    found = []
    for name, condition in rules.items():
        tries = [timed(condition) for _ in range(2)]
        cost = max(min(seconds for seconds, _ in tries) - nothing, 1e-4)
        found.append((name, tries[0][1] / n, cost))
    return sorted(found, key=lambda rule: (-rule[1] / rule[2], rule[2], rule[0]))


def judge(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    order = [name for name, _, _ in plan(docs, rules)]
    verdict = F.when(base_failed(), False)
    for name in order:
        verdict = verdict.when(F.expr(rules[name]), False)
    return base(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict.otherwise(True).alias("kept"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
  list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS p, words FROM d WHERE len(words) >= 3),
h AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, words[p], words[p + 1], words[p + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
b AS (SELECT doc_id, t, words, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 10 * n_dup_lines > 3 * n_lines
    OR 2 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > length(regexp_replace(t, '[^A-Za-z]+', '', 'g'))
    OR 2 * length(regexp_replace(t, '[^\p{L}]+', '', 'g')) < word_chars
    OR len(list_filter(words, lambda w: length(w) > 1000)) > 0) AS kept
FROM f
"""
