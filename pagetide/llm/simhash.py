"""SimHash near-duplicates with a binary trie joined with itself.

Fingerprints are leaves of a binary trie. A pair of trie nodes is expanded into the pairs of their children; the
bits in which the paths differ are added up, and a pair is dropped as soon as they exceed the budget. The upper part
of the trie is expanded by Spark, four bits a round, for node pairs with too many leaves for one task. Pairs below
that bound go to tasks, which walk down the rest of the two subtrees together.

Each task returns only a minimum spanning forest of its links (by differing bits), so a group of n close
fingerprints costs n rows instead of n * n. A spanning forest has the same components as all its links, at
every smaller distance too.

Defined results: a null or empty text has no words; its fingerprint is zero and it is linked like any other. Rows
with the same text have the same fingerprint and class. An empty table gives an empty result. Rows with a null
doc_id are returned with a component of null unless linked with a row that has an id. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.llm import shared
from pagetide.llm.components import components
from pagetide.session import release, stage

LEAVES = 120_000  # leaves of a node pair that one task takes
STEP = 4  # bits a round
SLICE = 1 << 16  # bytes of text whose shingles a task holds together; their arrays are many times as large
STATES = 1 << 14  # node pairs that a task expands together
U = np.uint64


# ---- fingerprints

def _shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of the texts, and the number of shingles of each text."""
    data = shared.LOWER[data]
    space = shared.SPACE[data]
    first = np.zeros(len(data), bool)  # white space directly after a word
    first[1:] = space[1:] & ~space[:-1]
    starts, ends, row = shared.find_words(data, offsets)
    n = np.bincount(row, minlength=len(offsets) - 1)
    # the words, each followed by one space
    size = ends - starts
    to = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(int(to[-1]), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[~space]
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(n)))[:-1]
    row = np.repeat(np.arange(len(n)), count)
    word = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)))[:-1], count) + begin[row]
    last = word + np.minimum(n[row], shingle) - 1
    text = memoryview(joined.tobytes())
    digest = xxhash.xxh64_intdigest
    hashes = [digest(text[s:e], 42) for s, e in zip(to[word].tolist(), (to[last + 1] - 1).tolist(), strict=True)]
    return np.array(hashes, U), count


def _majority(hashes: np.ndarray, count: np.ndarray, words: int) -> np.ndarray:
    """A row of `words` 64-bit integers for each text: a bit is 1 if it is set in over half of the hashes."""
    out = np.zeros((len(count), words), U)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    begin = np.concatenate(([0], np.cumsum(count)))[some]
    for k in range(words):
        h = hashes if k == 0 else shared.mix(hashes + U(k * 0x9E3779B97F4A7C15 % 2**64))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        set_ = (2 * ones > count[some][:, None]).astype(np.uint8)
        out[some, k] = np.packbits(set_, axis=1, bitorder="little").view(U)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, fp (the 64-bit SimHash) and sketch (binary, `words` * 8 bytes, little endian, fp first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in shared.text_slices(shared.text_column(batch), SLICE):
                parts.append(_majority(*_shingle_hashes(data, offsets, shingle), words))
            all_ = np.concatenate(parts) if parts else np.zeros((0, words), U)
            sketch = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(8 * words), len(all_), [None, pa.py_buffer(np.ascontiguousarray(all_).tobytes())]
            )
            fp = pa.array(all_[:, 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp, sketch.cast(pa.binary())], ["doc_id", "fp", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long, sketch binary")


# ---- the join inside one pair of nodes

def _split(leaves: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the leaves with this bit begin, for each interval of leaves that agree above the bit."""
    pivot = ((leaves[lo] >> U(bit)) | U(1)) << U(bit)
    return np.clip(np.searchsorted(leaves, pivot), lo, hi)


def _walk(a: np.ndarray, b: np.ndarray, same: bool, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indexes of sorted leaves that differ in at most `budget` bits, from node pairs walked together."""
    above = 0 if top >= 64 else (int(a[0]) ^ int(b[0])) >> top  # bits of the two paths down to here
    start = tuple(np.array([x], np.int64) for x in (0, len(a), 0, len(b), above.bit_count()))
    stack = [(top, start)]
    while stack:
        bit, (alo, ahi, blo, bhi, diff) = stack.pop()
        if len(alo) > STATES:
            half = len(alo) // 2
            state = (alo, ahi, blo, bhi, diff)
            stack += [(bit, tuple(x[half:] for x in state)), (bit, tuple(x[:half] for x in state))]
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if bit == 0:
            single[:] = True
        if single.any():
            i, j = alo[single], blo[single]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            yield i[near], j[near]
            alo, ahi, blo, bhi, diff = (x[~single] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        bit -= 1
        am, bm = _split(a, alo, ahi, bit), _split(b, blo, bhi, bit)
        parts = []
        for x0, x1, y0, y1, d in (
            (alo, am, blo, bm, diff), (am, ahi, bm, bhi, diff), (alo, am, bm, bhi, diff + 1), (am, ahi, blo, bm, diff + 1),
        ):
            keep = (x1 > x0) & (y1 > y0) & (d <= budget)
            if same:
                keep &= x0 <= y0
            parts.append(tuple(x[keep] for x in (x0, x1, y0, y1, d)))
        stack.append((bit, tuple(np.concatenate(x) for x in zip(*parts, strict=True))))


def _forest(i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Indexes of the links of a minimum spanning forest."""
    parent: dict[int, int] = {}
    kept = []
    order = np.argsort(weight, kind="stable")
    for k, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p] if p in parent else p
            x = p
        while (p := parent.setdefault(y, y)) != y:
            parent[y] = parent[p] if p in parent else p
            y = p
        if x != y:
            parent[y] = x
            kept.append(k)
    return np.array(kept, np.int64)


def _joined(bits: int, budget: int, most: int):
    """The function of one node pair: its members in, links of the spanning forest out."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        leaf = group.column("leaf").to_numpy().view(U)
        node = group.column("node").to_numpy()
        raw = group.column("sketch").combine_chunks()
        sketch = np.frombuffer(b"".join(raw.to_pylist()), U).reshape(len(raw), -1)
        depth, same = key[3].as_py(), key[1].as_py() == key[2].as_py()
        left = np.flatnonzero(side == 0)
        left = left[np.argsort(leaf[left], kind="stable")]
        right = left if same else np.flatnonzero(side == 1)
        right = right if same else right[np.argsort(leaf[right], kind="stable")]
        # leaves may repeat (equal table keys of different sketches): walk over distinct ones, then meet their members
        a, a_at = np.unique(leaf[left], return_index=True)
        b, b_at = (a, a_at) if same else np.unique(leaf[right], return_index=True)
        a_end, b_end = np.append(a_at[1:], len(left)), np.append(b_at[1:], len(right))
        out_i, out_j, out_w = [np.zeros(0, np.int64)] * 3
        waiting, waiting_n = [], 0

        def settle():
            nonlocal out_i, out_j, out_w, waiting, waiting_n
            i, j, w = (np.concatenate(x) for x in zip((out_i, out_j, out_w), *waiting, strict=True))
            keep = _forest(i, j, w)
            out_i, out_j, out_w = i[keep], j[keep], w[keep]
            waiting, waiting_n = [], 0

        def meet(i, j):
            """Links between members of the leaves."""
            nonlocal waiting_n
            w = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1).astype(np.int64)
            near = (w <= most) & (i != j)
            waiting.append((i[near], j[near], w[near]))
            waiting_n += int(near.sum())
            if waiting_n > 2_000_000:
                settle()

        if len(a) and len(b):
            for i, j in _walk(a, b, same, bits - depth, budget):
                one = (a_end[i] - a_at[i] == 1) & (b_end[j] - b_at[j] == 1)
                meet(left[a_at[i[one]]], right[b_at[j[one]]])
                for p, q in zip(i[~one].tolist(), j[~one].tolist(), strict=True):
                    for x in left[a_at[p] : a_end[p]]:
                        meet(np.full(b_end[q] - b_at[q], x), right[b_at[q] : b_end[q]])
            if same:  # members of one leaf
                for p in np.flatnonzero(a_end - a_at > 1):
                    own = left[a_at[p] : a_end[p]]
                    for k in range(1, len(own)):
                        meet(np.full(len(own) - k, own[k - 1]), own[k:])
        settle()
        return pa.table({"a": node[out_i], "b": node[out_j], "bits": out_w.astype(np.int32)})

    return run


# ---- the join

def trie_join(leaves: DataFrame, bits: int, budget: int, most: int | None = None, most_leaves: int = LEAVES) -> DataFrame:
    """a, b, bits: a spanning forest of the links between nodes whose leaves differ in at most `budget` bits.

    `leaves` has tab (int, one trie each), leaf (long with `bits` low bits), node (long) and sketch (binary).
    A link also needs whole sketches that differ in at most `most` bits (default: the budget).
    """
    leaves = stage(leaves.select("tab", "leaf", "node", "sketch"), "leaves")
    up = lambda depth: F.shiftrightunsigned("leaf", bits - depth) if depth else F.lit(0).cast("long")
    pairs = leaves.groupBy("tab").agg(F.count("*").alias("na")).select(
        "tab", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("diff"), "na", F.col("na").alias("nb")
    )
    depth, tasks = 0, None
    while True:
        pairs = stage(pairs, "pairs")
        full = (F.col("na") + F.col("nb") > most_leaves) if depth < bits else F.lit(False)
        # this depth's node pairs that fit, with their leaves
        ends = pairs.filter(~full).select("tab", "a", "b")
        here = leaves.select("tab", up(depth).alias("at"), "leaf", "node", "sketch")
        sides = ends.select("tab", "a", "b", F.col("a").alias("at"), F.lit(0).alias("side")).unionByName(
            ends.filter("a <> b").select("tab", "a", "b", F.col("b").alias("at"), F.lit(1).alias("side"))
        )
        found = sides.join(here, ["tab", "at"]).select("tab", "a", "b", F.lit(depth).alias("depth"), "side", "leaf", "node", "sketch")
        tasks = found if tasks is None else tasks.unionByName(found)
        more = pairs.filter(full)
        if depth >= bits or more.isEmpty():
            break
        step = min(STEP, bits - depth)
        kids = leaves.groupBy("tab", up(depth + step).alias("kid")).agg(F.count("*").alias("n")).withColumn(
            "at", F.shiftrightunsigned("kid", step)
        )
        pairs = (
            more.select("tab", "a", "b", "diff")
            .join(kids.select("tab", F.col("at").alias("a"), F.col("kid").alias("x"), F.col("n").alias("na")), ["tab", "a"])
            .join(kids.select("tab", F.col("at").alias("b"), F.col("kid").alias("y"), F.col("n").alias("nb")), ["tab", "b"])
            .withColumn("diff", F.col("diff") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << step) - 1))))
            .filter((F.col("diff") <= budget) & (F.col("x") <= F.col("y")))
            .select("tab", F.col("x").alias("a"), F.col("y").alias("b"), "diff", "na", "nb")
        )
        depth += step
    run = _joined(bits, budget, budget if most is None else most)
    return tasks.groupBy("tab", "a", "b", "depth").applyInArrow(run, "a long, b long, bits int")


def _with_components(prints: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of prints (doc_id, node) with component_id, the smallest document that links lead to."""
    classes = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    names = components(links)
    named = classes.join(names, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(smallest, "component").select("node", "component_id"), "node")


def near_classes(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: 64-bit fingerprints linked at `budget` or fewer bits."""
    prints = stage(fingerprints(docs, shingle).withColumn("node", F.col("fp")), "prints")
    leaves = prints.groupBy("fp").agg(F.first("sketch").alias("sketch")).select(
        F.lit(0).alias("tab"), F.col("fp").alias("leaf"), F.col("fp").alias("node"), "sketch"
    )
    return _with_components(prints, trie_join(leaves, 64, budget)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# ---- texts that share 0.8 of their shingles

SAMPLE = 2_000_000  # shingles, of whole texts, in which frequent ones are looked for, about
TURNS = (1, 8)  # how many of every bucket each set meets in a turn, before all pairs that are left
FREQUENT = 50_000  # frequent shingles that are put last, at most
CHECKED = 400_000  # shingles of texts that are compared in one group of a task, about
BAND = 1.05  # sizes of sets that differ by less may be in one band
CROWDED = 32  # sets of a bucket from which on parities come to it, so that no row is written for pairs that these tell apart
WIDE = 1.25  # the band there, as rows with parities are not repeated often
SHORT = 64  # words of such a parity, at most
OVERLAP = "9 * both >= 4 * (na + nb)"  # sets of na and nb with `both` in common: both / (na + nb - both) >= 0.8
# the same, of members in one set only: at least as many as the parities of two sets differ in bits
DIFFER = "5 * least(na, nb) >= 4 * greatest(na, nb) AND 9 * differ <= na + nb"


def _members(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes of the distinct shingles of some texts at a time, and how many each text has."""
    for _, _, data, offsets in shared.text_slices(column, SLICE):
        h, count = _shingle_hashes(data, offsets, shingle)
        row = np.repeat(np.arange(len(count)), count)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        yield h[new], np.bincount(row[new], minlength=len(count))


def _parities(h: np.ndarray, n: np.ndarray, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Of each set (n members of h): 64 times a power of two bits, at least 2 n, and the number of 64-bit words of each set.

    `most` is a power of two that the number of words does not exceed.
    Bit i is 1 if an odd number of members have i as their low bits. Halves of a parity, by XOR, are the one of half its size.
    """
    words = np.minimum(np.left_shift(1, np.ceil(np.log2(np.maximum(n, 32) / 32)).astype(np.int64)), most)
    begin = np.concatenate(([0], np.cumsum(words)))
    place = np.repeat(64 * begin[:-1], n) + (h & np.repeat(64 * words - 1, n).astype(U)).astype(np.int64)
    odd = (np.bincount(place, minlength=64 * int(begin[-1])) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(U), words


def _differ(x: str, y: str) -> Column:
    """How many bits of two columns of parities differ; the longer one is halved if it is twice as long."""
    half = lambda c: f"zip_with(slice({c}, 1, size({c}) div 2), slice({c}, size({c}) div 2 + 1, size({c}) div 2), (p, q) -> p ^ q)"
    of = lambda c, d: f"CASE WHEN size({c}) > size({d}) THEN {half(c)} ELSE {c} END"
    return F.expr(f"aggregate(zip_with({of(x, y)}, {of(y, x)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)")


def _frequent(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of frequent shingles, the rarest of them first. Which ones these are changes the work, not the result."""
    words = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6  # about
    part = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, -(-words // SAMPLE)))) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, _ in _members(shared.text_column(batch), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    counts = part.mapInArrow(run, "h long").groupBy("h").count().filter("count >= 4")
    found = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").collect()
    return np.array([r[0] for r in reversed(found)], np.int64).view(U)


def shingle_sets(docs: DataFrame, shingle: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, k (the row key), node (a hash of the set of distinct shingles), fp (its SimHash), n, prefix, parity and short (a parity too).

    The prefix has the first n - 0.8 n + 1 members, in an order of all shingles with the frequent ones last. Two sets that are
    0.8 similar have one of these in common, whatever the order is.
    """
    place = np.argsort(frequent)
    known = frequent[place]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, lengths, sizes, nodes, prints, full, short = [], [], [], [], [], [], []
            for h, n in _members(shared.text_column(batch), shingle):
                ends = np.cumsum(n).tolist()
                raw = memoryview(h.tobytes())
                nodes.append(np.array([xxhash.xxh64_intdigest(raw[8 * s : 8 * e], 42) for s, e in zip([0, *ends], ends)], U))
                prints.append(_majority(h, n, 1)[:, 0])
                sizes.append(n)
                full.append(_parities(h, n))
                short.append(_parities(h, n, SHORT))
                row = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, place[at] + 1, 0)
                order = np.lexsort((h, rank, row))
                nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                prefixes.append(h[order[nth < length[row]]])
                lengths.append(length)
            flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            starts = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(flat(sizes, np.int64)))).astype(np.int32))
            prefix = pa.ListArray.from_arrays(starts(lengths), pa.array(flat(prefixes, U).view(np.int64)))
            parities = [
                pa.ListArray.from_arrays(starts([w for _, w in x]), pa.array(flat([p for p, _ in x], U).view(np.int64))) for x in (full, short)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(flat(nodes, U).view(np.int64)), pa.array(flat(prints, U).view(np.int64)),
                 pa.array(flat(sizes, np.int64).astype(np.int32)), prefix, *parities],
                ["doc_id", "k", "node", "fp", "n", "prefix", "parity", "short"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", shared.row_key(docs).alias("k"), "text").mapInArrow(
        run, f"doc_id {kind}, k long, node long, fp long, n int, prefix array<long>, parity array<long>, short array<long>"
    )


def _texts(docs: DataFrame, ends: DataFrame, classes: DataFrame) -> DataFrame:
    """Staged: node and the text of one of its rows. Only these texts are shuffled if there are few."""
    wanted = stage(ends.join(classes, "node").select("node", F.col("of").alias("k")), "ends")
    keys = shared.bounded(wanted.select(F.col("k").alias("_k")))
    keyed = docs.select(shared.row_key(docs).alias("k"), "text")
    one = keyed.join(keys, keyed["k"] == F.col("_k"), "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    return stage(one.join(wanted, "k").select("node", "text"), "texts")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """Staged: a, b: the pairs of nodes whose sets are 0.8 similar, counted member by member.

    Pairs whose parities differ in too many bits for that are dropped first, so that no text is fetched for them. A text
    meets those of all its partners in one place, or in several if they are many.
    """
    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    met = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "met")
    few = classes.join(shared.bounded(met), "node", "left_semi")
    of = lambda x: few.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"parity_{x}"))
    close = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("differ", _differ("parity_a", "parity_b")).filter(DIFFER)
    every, pairs = pairs, stage(close.select("a", "b"), "candidates")
    release(every, met)
    texts = _texts(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), classes)
    sized = pairs.join(classes.select(F.col("node").alias("b"), "n"), "b")
    load = stage(sized.groupBy("a").agg(F.sum("n").alias("n")).withColumn("parts", F.floor(F.col("n") / CHECKED) + 1), "load")
    groups = (load.agg(F.sum("n")).first()[0] or 0) // CHECKED + 1
    part = F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")
    partners = pairs.join(load, "a").select("a", part, F.col("b").alias("node"))
    own = load.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    tasks = stage(partners.unionByName(own), "tasks")
    met = tasks.join(texts, "node").select(F.pmod(F.xxhash64("a", "part"), F.lit(groups)).alias("g"), "a", "node", "text")

    def sets(table: pa.Table) -> list[np.ndarray]:
        out = []
        for chunk in table.column("text").chunks:
            column = pc.fill_null(chunk.cast(pa.large_string()), "")
            for h, n in _members(column, shingle):
                out += np.split(h, np.cumsum(n)[:-1])
        return out

    def check(group: pa.Table) -> pa.Table:
        a, node = (group.column(c).to_numpy() for c in ("a", "node"))
        members = sets(group)
        of = {k: members[i] for i, k in enumerate(a.tolist()) if node[i] == k}
        found = []
        for i in np.flatnonzero(a != node):
            x, y = of[int(a[i])], members[i]
            if 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)):
                found.append(i)
        return pa.table({"a": pa.array(a[found]), "b": pa.array(node[found])})

    out = stage(met.groupBy("g").applyInArrow(check, "a long, b long").distinct(), "verified")
    release(pairs, texts, load, tasks)
    return out


def _alike(buckets: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """Staged: a, b: links between sets that are 0.8 similar, enough for the components of all such links.

    First come the pairs that SimHash names (fingerprints with at most two differing bits) and those of each set with
    the smallest set of a bucket (sets with one prefix member in common). They hold large groups together with few
    links. Then, in two turns, each set meets some of its bucket that are not in its component yet, others in every
    bucket, and at last all pairs of a bucket are taken whose sets are in different components still. At the first member that two
    similar sets share, neither has fewer members left than they must have in common; so at each place of a prefix there
    is a largest size of a partner (`most`), and only sets whose sizes suit each other's places are paired. The
    buckets are released.
    """
    # `shared` prefix members in common; beyond the shorter prefix at most 0.8 n - 1 members follow
    likely = "9 * (shared + (4 * greatest(na, nb) + 4) div 5 - 1) >= 4 * (na + nb)"
    leading = buckets.filter("node <> a AND 5 * least(na, n) >= 4 * greatest(na, n)").groupBy("a", F.col("node").alias("b"), "na", F.col("n").alias("nb"))
    leading = leading.agg(F.count("*").alias("shared")).filter(likely).select("a", "b")
    prints = stage(classes.filter("n > 0").groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    equal = classes.join(prints.withColumnRenamed("node", "a"), "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    near = trie_join(
        prints.select(F.lit(0).alias("tab"), F.col("fp").alias("leaf"), "node", F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("sketch")), 64, 2
    )
    links = _verified(leading.union(equal).union(near.select("a", "b")), docs, classes, shingle)

    def open_buckets(c: DataFrame) -> DataFrame:
        """Staged: the sets of those buckets of c with several components, with `largest` and `many` of a bucket; c is released."""
        now = c.select("h", "node", "n", "most").join(components(links), "node", "left")
        now = now.withColumn("component", F.coalesce("component", "node")).repartition("h")
        # the aggregate takes every column, so that it and the join below share one shuffle
        parted = now.groupBy("h").agg(
            F.min(F.struct("component", "node", "n", "most")).alias("lo"), F.max("component").alias("hi"),
            F.max("n").alias("largest"), F.count("*").alias("many"),
        )
        out = stage(now.join(parted.filter("lo.component <> hi").select("h", "largest", "many"), "h"), "open")
        release(c)
        return out

    suits = "ca <> cb AND na <= nb AND nb <= ma AND na <= mb AND (na < nb OR a < b)"
    named = lambda x: [F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("most").alias(f"m{x}"), F.col("component").alias(f"c{x}")]
    c = buckets
    for turn, meetings in enumerate(TURNS):  # each set and some of its bucket, others in every bucket and turn
        c = open_buckets(c)
        dealt = c.select("h", "node", "n", "most", "component").repartition("h")
        drawn = [F.min_by(F.struct("node", "n", "most", "component"), F.xxhash64("node", "h", F.lit(turn + 10 * i))) for i in range(meetings)]
        met = dealt.groupBy("h").agg(F.array_distinct(F.array(*drawn)).alias("met"))
        one = dealt.join(met, "h").withColumn("met", F.explode("met")).filter("component <> met.component")
        other = [F.col("met.node").alias("b"), F.col("met.n").alias("nb"), F.col("met.most").alias("mb"), F.col("met.component").alias("cb")]
        one = one.select(*named("a"), *other).filter("nb <= ma AND na <= mb")
        links = links.union(_verified(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), docs, classes, shingle))
    c = open_buckets(c)

    def paired(c: DataFrame, width: float, *own: str) -> DataFrame:
        """The pairs of each bucket that may be similar by their sizes, with these columns of both sets."""
        band = lambda size: F.floor(F.log(size) / F.log(F.lit(width))).cast("int")
        of = lambda x: named(x) + [F.col(column).alias(f"{column}_{x}") for column in own]
        smaller = c.select("h", "largest", *of("a")).filter("na <= ma")
        smaller = smaller.withColumn("band", F.explode(F.sequence(band(F.col("na")), band(F.least("ma", "largest"))))).drop("largest")
        return smaller.join(c.select("h", *of("b")).withColumn("band", band(F.col("nb"))), ["h", "band"]).filter(suits)

    crowd = c.filter(F.col("many") >= CROWDED).join(classes.select("node", "short"), "node")
    told = paired(crowd, WIDE, "short").withColumn("differ", _differ("short_a", "short_b")).filter(DIFFER)
    pairs = paired(c.filter(F.col("many") < CROWDED), BAND).select("a", "b").unionByName(told.select("a", "b"))
    links = links.union(_verified(pairs, docs, classes, shingle))
    release(c)
    return links


def similar_classes(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, component_id, k (the row key): texts linked if they share 0.8 or more of their distinct shingles.

    Every link is counted on the shingles themselves, and no pair at 0.8 or more is missed, at any size of the input;
    only shingles are taken as equal if their 64-bit hashes are. Shingles are made again for the texts that are compared, so
    no more than a fifth of them is ever written.
    """
    sets = stage(shingle_sets(docs, shingle, _frequent(docs, shingle)), "sets")
    rows = stage(sets.select("doc_id", "k", "node"), "rows")
    first = [F.first(c).alias(c) for c in ("fp", "n", "parity", "short")]
    classes = stage(sets.groupBy("node").agg(*first, F.min("k").alias("of")), "classes")
    entries = sets.select("node", "n", F.posexplode("prefix").alias("p", "h"))
    entries = entries.select("h", "node", "n", F.expr("CAST((9 * (n - p) - 4 * n) div 4 AS INT)").alias("most")).repartition("h")
    # the aggregate takes every column, so that it and the join below share one shuffle
    lead = entries.groupBy("h").agg(F.min(F.struct("node", "n", "most")).alias("lead"), F.max("node").alias("top")).filter("lead.node <> top")
    buckets = entries.join(lead, "h").select("h", "node", "n", "most", F.col("lead.node").alias("a"), F.col("lead.n").alias("na"))
    buckets = stage(buckets.dropDuplicates(["h", "node"]), "buckets")
    release(sets)
    alike = _alike(buckets, docs, classes, shingle)
    return _with_components(rows, alike).select("doc_id", "component_id", "k")


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs, with all columns, whose doc_id is the smallest of its group; equal rows (id and text) once.

    Rows with a null doc_id stay unless their text is in a group with an id. Rows that share an id, or have none, are
    judged one by one.
    """
    found = stage(similar_classes(docs, shingle), "groups")
    gone = stage(found.filter("doc_id <> component_id OR doc_id IS NULL AND component_id IS NOT NULL").select(F.col("k").alias("_gone")).distinct(), "gone")
    again = stage(found.groupBy(F.col("k").alias("_again")).count().filter("count > 1").select("_again"), "again")
    kept = shared.without(docs, gone)
    if again.isEmpty():
        return kept
    is_again = shared.row_key(kept) == again["_again"]
    return kept.join(again, is_again, "left_anti").unionByName(
        kept.join(again, is_again, "left_semi").dropDuplicates(["doc_id", "text"])
    )
