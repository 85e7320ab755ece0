"""Benchmark decontamination with spaced seeds, as DataFrame expressions only.

A seed is a hash of some tokens of a short window; a fixed mask says which. Tokens that the mask leaves out may
differ, so a copied passage with replaced words still meets its original. Benchmark items are hashed at every
position, documents at every second one. The two masks below are chosen (by search over all cases) so that
every window of 16 tokens with at most 2 replaced ones holds a seed without a replaced token, at either parity of its
start. Seeds that meet give an alignment of a document with an item; the tokens along it are then compared.

An overlap is an alignment with a window of 16 item tokens of which at most 2 differ. Items with fewer than 16 tokens
must occur whole; with `short_replaced` one token of them may differ if they have 8 or more (2 in 16, rounded down),
otherwise none. The two masks catch every such item of 14 or 15 tokens; one of 8 to 13 has its first or its last
tokens unchanged, so these are seeds too, at every start. Tokens are the runs of letters and digits of the lower-cased text.

Defined results: null and empty texts, and items without a token, overlap with nothing. Documents with the same
doc_id count as one in the report: it is contaminated if a row of it is. Rows with a null doc_id are compared too and
count as one document there. `clean` takes out rows, whatever their id. Items with equal tokens count as one, named by the smallest item_id. Empty tables give no overlaps. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm import shared
from pagetide.session import stage

WINDOW = 16
REPLACED = 2
STRIDE = 2
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 8, 10, 11, 12))
SPAN = 13  # tokens that the longest mask reaches over
ENDS = -1  # kind of the seeds of both ends of short items


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _tolerated(n: int) -> int:
    """Tokens that may differ in an item of n tokens, fewer than a window has."""
    return n * REPLACED // WINDOW


def _seeds(df: DataFrame, key: str, stride: int, short: list[int], more: Column | None = None) -> DataFrame:
    """key, seed, start: a row for each mask and start of array column h (hashes of the tokens).

    `short`: lengths of items that are too short for the masks; these are hashed whole, at every start. `more`: an
    array of further seeds.
    """
    arrays = [_seed_array(kind, mask, stride) for kind, mask in enumerate(MASKS)]
    arrays += [_seed_array(len(MASKS) + n, tuple(range(n)), 1) for n in short]
    arrays += [] if more is None else [more]
    return df.select(key, F.explode(F.flatten(F.array(*arrays))).alias("s")).select(key, "s.seed", "s.at")


def _seed_array(kind: int, mask: tuple[int, ...], step: int) -> Column:
    """The seeds of one mask at every `step`-th start of h."""
    last = F.size("h") - (mask[-1] + 1)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    seed = lambda i: F.xxhash64(F.lit(kind), *(F.element_at("h", i + (o + 1)) for o in mask))
    return F.transform(starts, lambda i: F.struct(seed(i).alias("seed"), i.alias("at")))


def overlaps(docs: DataFrame, benchmark: DataFrame, short_replaced: bool = False) -> DataFrame:
    """doc_id, item_id, start (token of the document where the item would begin, may be negative), n_equal, n_item."""
    items = stage(
        benchmark.select("item_id", tokens(F.col("text")).alias("item"))
        .filter(F.size("item") > 0).groupBy("item").agg(F.min("item_id").alias("item_id"))
        .withColumn("class", F.xxhash64("item")),
        "items",
    )
    # at most SPAN + STRIDE - 2 different lengths
    size = F.size("item")
    short = sorted(r[0] for r in items.filter(size < SPAN + STRIDE - 1).select(size).distinct().collect())
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    loose = [n for n in short if short_replaced and _tolerated(n)]
    short = [n for n in short if n not in loose]
    end = min(loose, default=0) // 2
    ends = _seed_array(ENDS, tuple(range(end)), 1) if loose else None
    at_end = lambda s: F.size("h").isin(loose) & ((s["at"] == 0) | (s["at"] == F.size("h") - end))
    item_ends = F.filter(ends, at_end) if loose else None
    known = stage(_seeds(items.select("class", hashed(F.col("item")).alias("h")), "class", 1, short, item_ends), "seeds")
    mine = docs.select("doc_id", hashed(tokens(F.col("text"))).alias("h"))
    met = (
        _seeds(mine, "doc_id", STRIDE, short, ends)
        .join(shared.bounded(known.withColumnRenamed("at", "item_at")), "seed")
        .select("doc_id", "class", (F.col("at") - F.col("item_at")).alias("start"))
        .distinct()
    )
    met = stage(met, "met")
    # the tokens of documents with an alignment, next to those of the items
    per_doc = met.join(shared.bounded(items), "class").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", "start", "item")).alias("met")
    )
    per_doc = stage(per_doc, "aligned")
    few = met.limit(shared.BROADCAST_ROWS + 1).count() <= shared.BROADCAST_ROWS
    with_words = docs.select(F.col("doc_id").alias("id"), "text").join(
        F.broadcast(per_doc) if few else per_doc, F.col("id").eqNullSafe(F.col("doc_id"))
    )
    each = with_words.select("doc_id", tokens(F.col("text")).alias("words"), "met").select(
        "doc_id",
        F.explode(F.transform(F.col("met"), lambda m: _compared(F.col("words"), m))).alias("o"),
    )
    window = F.least(F.col("o.n_item"), F.lit(WINDOW))
    tolerated = F.floor(F.col("o.n_item") * REPLACED / WINDOW) if short_replaced else F.lit(0)
    fits = F.col("o.best") >= F.when(F.col("o.n_item") < WINDOW, window - tolerated).otherwise(window - REPLACED)
    return each.filter(fits).select("doc_id", "o.item_id", "o.start", "o.n_equal", "o.n_item").distinct()


def _compared(words: Column, m: Column) -> Column:
    """Equal tokens along an alignment: in all, and in the best window."""
    n = F.size(m["item"])
    window = F.least(n, F.lit(WINDOW))
    at = lambda i: m["start"] + i + 1
    equal = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when((at(i) >= 1) & (at(i) <= F.size(words)), (F.get(words, at(i) - 1) == F.element_at(m["item"], i + 1)).cast("int")).otherwise(0),
    )
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)
    sums = F.transform(F.sequence(F.lit(1), n - window + 1), lambda s: total(F.slice(equal, s, window)))
    return F.struct(
        m["item_id"].alias("item_id"), m["start"].alias("start"), n.alias("n_item"),
        total(equal).alias("n_equal"), F.array_max(sums).alias("best"),
    )


def report(docs: DataFrame, benchmark: DataFrame, short_replaced: bool = False) -> DataFrame:
    """A row for each document: doc_id, contaminated, n_items, item_id (smallest), n_equal (most equal tokens)."""
    found = stage(overlaps(docs, benchmark, short_replaced), "overlaps").groupBy(F.col("doc_id").alias("hit")).agg(
        F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"),
        F.max("n_equal").cast("long").alias("n_equal"),
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("hit")), "left").select(
        "doc_id",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id",
        F.coalesce("n_equal", F.lit(0)).cast("long").alias("n_equal"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, short_replaced: bool = False) -> DataFrame:
    """The rows without an overlap, with all their columns. Rows that share an id are judged one by one."""
    keyed = docs.select(shared.row_key(docs).alias("doc_id"), "text")
    found = stage(overlaps(keyed, benchmark, short_replaced).select(F.col("doc_id").alias("_hit")).distinct(), "contaminated")
    return shared.without(docs, found)
