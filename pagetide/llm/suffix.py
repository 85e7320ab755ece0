"""Removal of long repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that lies in a string of LENGTH bytes which starts anywhere else as well is removed.

Spark deals out the work by content. The window of LENGTH bytes at each place has a smallest hash of its GRAM-byte
strings; a piece is a run of places with the same smallest hash, with all bytes of their windows. Equal windows have
equal smallest hashes, so they lie in pieces of the same hash. A hash of one piece, with one such string in it, holds
no repeat and ends there. So far only places and digests move. If all pieces of a hash are copies of one, they are
repeated from end to end. Of the other hashes each distinct piece is cut out of one of its documents and goes, with its
number of copies, to tasks that take the pieces of many hashes at a time.

A task sorts the suffixes of its pieces, and derives their common prefixes from the Burrows-Wheeler transform:
intervals of suffixes are extended backward, breadth first, so common prefixes appear by increasing value, and the
expansion stops at LENGTH. Neighbours that are not parted by then share LENGTH bytes.

Pieces of a hash with more text than MOST fit no task; their windows are counted by a 128-bit hash over all tasks.

Defined results: a null or empty text has 0 bytes and no spans; so has every text shorter than LENGTH. Matches never
cross texts. Equal rows are copies of each other, so all their bytes go if there are LENGTH of them. An empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm import shared
from pagetide.session import release, stage

LENGTH = 200
GRAM = 48
BLOCK = 1 << 20  # bytes of pieces for a task, about
MOST = 2 << 20  # bytes of pieces of one hash that a task takes
U = np.uint64


# ---- pieces

def _smallest(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every place of the bytes: the hash of its gram, and the smallest such hash in the window that begins there."""
    h, size = shared.BYTE_HASHES[data], 1
    while size < gram:  # hashes of strings of doubled, at last overlapping, length
        step = min(size, gram - size)
        h = h[: len(h) - step] * U(0xD6E8FEB86659FD93) + h[step:]
        h ^= h >> U(32)
        h *= U(0x9E3779B97F4A7C15)
        size += step
    h ^= h >> U(29)
    low, width, reach = h, 1, length - gram + 1
    while width < reach:
        step = min(width, reach - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return h, low


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first and last place (in its text), hash of each piece of these texts, and whether it has that gram twice."""
    if len(data) < length:
        return (*(np.zeros(0, np.int64),) * 3, np.zeros(0, U), np.zeros(0, bool))
    h, low = _smallest(data, length, gram)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    inside = np.arange(len(low)) + length <= offsets[row + 1]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new & inside)
    # a piece ends before the next one begins or where windows would leave the text
    stops = np.flatnonzero(np.append(new, True) | ~np.append(inside, False))
    last = stops[np.searchsorted(stops, first, "right")] - 1
    own = row[first]
    # windows of one piece can only be equal if its smallest gram is there twice
    size = last - first + 1 + length - gram
    to = np.cumsum(size)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(first - (to - size), size)
    twice = np.add.reduceat(h[at] == np.repeat(low[first], size), to - size, dtype=np.int64) > 1 if len(to) else np.zeros(0, bool)
    return own, first - offsets[own], last - offsets[own], low[first], twice


# ---- one task

def _suffixes(text: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Places in the order of their suffixes, compared up to `length` or to the end of the piece.

    `text` has 0 at the end of each piece, `left` the bytes up to there. Suffixes that reach their end keep their order.
    """
    n = len(text)
    key = np.zeros(n + 8, U)
    key[:n] = text
    for size in (1, 2, 4):  # the next 8 bytes, with 0 behind the end of a piece
        whole = (key[: n + 8 - size] & U(255)) > 0
        key[: n + 8 - size] = (key[: n + 8 - size] << U(8 * size)) | np.where(whole, key[size:], 0)
    key = key[:n]
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    short = np.flatnonzero(left[order] < 8)
    group = np.cumsum(new)[short]
    order[short] = order[short][np.argsort((group << 32) | order[short])]
    new[short] = True
    del key, sorted_key
    rank = np.zeros(n, np.int64)
    reach = 8
    while True:
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        rank[order] = np.repeat(begin, size)
        if reach >= length:
            return order
        open_ = np.flatnonzero(np.repeat(size > 1, size))
        if not len(open_):
            return order
        at = order[open_]
        if n < 1 << 21:  # three ranks fit into one key
            both = (rank[at] << 42) | (rank[at + reach] << 21) | rank[np.minimum(at + 2 * reach, n - 1)]
            reach *= 3
        else:
            both = (rank[at] << 32) | rank[at + reach]
            reach *= 2
        sort = np.argsort(both)
        both = both[sort]
        order[open_] = at[sort]
        new[open_[1:]] |= both[1:] != both[:-1]


def _parted(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True where a suffix shares less than `length` bytes with the one before it, by backward extension."""
    n = len(text)
    bwt = text[order - 1]  # of the first place: the end mark of the last piece
    back = np.empty(n, np.int64)  # place of the suffix that is longer by one byte
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    parted = np.zeros(n + 1, bool)
    parted[[0, n]] = True
    # strings of one byte; every end mark differs from all others
    marks = int((text == 0).sum())
    count = np.bincount(text, minlength=256)[1:]
    end = marks + np.cumsum(count)
    lo = np.concatenate((np.arange(marks), (end - count)[count > 0]))
    hi = np.concatenate((np.arange(marks), end[count > 0] - 1))
    parted[hi + 1] = True
    for _ in range(1, length):
        if not len(lo):
            break
        size = hi - lo + 1
        one, two, many = size == 1, size == 2, size > 2
        a = lo[one]
        a = a[bwt[a] > 0]
        new_lo, new_hi = [back[a]], [back[a]]
        a = lo[two]
        c, d = bwt[a], bwt[a + 1]
        same = (c == d) & (c > 0)
        new_lo.append(back[a[same]])
        new_hi.append(back[a[same]] + 1)
        for x, sign in ((a, c), (a + 1, d)):
            x = x[(c != d) & (sign > 0)]
            new_lo.append(back[x])
            new_hi.append(back[x])
        if many.any():
            begin, width = lo[many], size[many]
            to = np.cumsum(width)
            at = np.arange(to[-1]) + np.repeat(begin - (to - width), width)
            # sorted by interval, byte and place; the first place of each byte and how many follow it
            key = np.sort((((np.repeat(np.arange(len(begin)), width) << 8) | bwt[at]) << 32) | at)
            first = np.flatnonzero(np.concatenate(([True], (key[1:] >> 32) != (key[:-1] >> 32))))
            n_same = np.diff(np.append(first, len(key)))
            real = ((key[first] >> 32) & 255) > 0
            low = back[key[first[real]] & 0xFFFFFFFF]
            new_lo.append(low)
            new_hi.append(low + n_same[real] - 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~parted[hi + 1]
        lo, hi = lo[fresh], hi[fresh]
        parted[hi + 1] = True
    return parted


def _repeats(pieces: list[bytes], copies: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece and place of every window that occurs more than once, copies counted."""
    size = np.array([len(p) + 1 for p in pieces])
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)  # 255 never occurs in UTF-8; it becomes 0
    end = np.cumsum(size)
    piece = np.repeat(np.arange(len(pieces)), size)
    left = np.repeat(end - 1, size) - np.arange(len(text))
    order = _suffixes(text, left, length)
    begin = np.flatnonzero(_parted(text, order, length)[:-1])
    many = np.add.reduceat(copies[piece[order]], begin) > 1
    found = order[np.repeat(many, np.diff(np.append(begin, len(order))))]
    found = np.sort(found[left[found] >= length])
    return piece[found], found - (end - size)[piece[found]]


def _spans(places: np.ndarray, length: int) -> list[list[int]]:
    """Maximal runs of bytes covered by windows at these sorted places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > length) + 1
    return [[int(p[0]), int(p[-1]) + length] for p in np.split(places, cut)]


def _span_rows(group: pa.Table, piece: np.ndarray, place: np.ndarray, length: int) -> pa.Table:
    rows, cut = np.unique(piece, return_index=True)
    spans = [_spans(p, length) for p in (np.split(place, cut[1:]) if len(rows) else [])]
    h, t = (group.column(c).to_numpy()[rows] for c in ("h", "t"))
    flat = pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.table({"h": h, "t": t, "spans": flat})


SPANS = "h long, t long, spans array<struct<a: int, b: int>>"  # a piece is named by its smallest hash and its digest


# ---- tables

def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["k"] == b["k"])


def _texts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` (doc_id, k, ...), each with the text of its document; only these texts are shuffled if the keys are few."""
    rest = [c for c in wanted.columns if c not in ("doc_id", "k")]
    wanted = wanted.withColumnsRenamed({"doc_id": "_doc", "k": "_k"})
    keys = shared.bounded(wanted.select(F.col("_doc").alias("_one"), F.col("_k").alias("_other")))
    few = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("_one")) & (F.col("k") == F.col("_other")), "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("k") == F.col("_k"))
    return few.join(wanted, same).select("doc_id", "k", *rest, "text")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """Staged: doc_id, k (a hash of doc_id and text) and their repeated spans of bytes (a, b), which may overlap."""
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text").filter(F.octet_length("text") >= length)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for lo, hi, data, offsets in shared.text_slices(shared.text_column(batch)):
                row, first, last, h, twice = _pieces(data, offsets, length, gram)
                at = pa.array(row + lo)
                raw, begin = memoryview(data.tobytes()), offsets[row]
                t = [digest(raw[a:b]) for a, b in zip((begin + first).tolist(), (begin + last + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                     pa.array(h.view(np.int64)), pa.array(np.array(t, U).view(np.int64)), pa.array(twice)],
                    ["doc_id", "k", "first", "last", "h", "t", "inner"],
                )

    key_type = docs.schema["doc_id"].dataType.simpleString()
    found = stage(keyed.mapInArrow(find, f"doc_id {key_type}, k long, first int, last int, h long, t long, inner boolean"), "pieces")
    twice = found.groupBy("h").agg(F.count("*").alias("n"), F.bool_or("inner").alias("inner")).filter("n > 1 OR inner").select("h")
    places = stage(found.drop("inner").join(twice, "h"), "places")
    release(found)
    owner = F.min(F.struct("doc_id", "k", "first", "last")).alias("owner")
    pieces = places.groupBy("h", "t").agg(F.count("*").alias("n"), owner).withColumn("size", F.expr("owner.last - owner.first") + length)
    pieces = stage(pieces, "distinct")
    by_hash = pieces.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("size").alias("bytes"))
    sized = stage(pieces.join(by_hash, "h"), "sized")
    release(pieces)
    alike = F.expr("kinds = 1 AND n > 1")
    whole = sized.filter(alike).select("h", "t", F.array(F.struct(F.lit(0).alias("a"), F.col("size").cast("int").alias("b"))).alias("spans"))
    open_ = sized.filter(~alike)
    total = open_.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, total // BLOCK)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["first", "last", "h", "t", "n"]
            for i in range(batch.num_rows):
                data = batch.column(3)[i].as_buffer().to_pybytes()
                first, last, *rest = batch.column(2)[i].values.flatten()
                parts = [data[a : b + length] for a, b in zip(first.to_pylist(), last.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(parts, pa.binary())], [*names[2:], "piece"])

    def cut_out(some: DataFrame) -> DataFrame:
        """h, t, n and the bytes of pieces, each from its one owner."""
        own = some.select("owner.doc_id", "owner.k", F.struct("owner.first", "owner.last", "h", "t", "n").alias("p"))
        own = stage(own.groupBy("doc_id", "k").agg(F.collect_list("p").alias("pieces")), "owners")
        text = _texts(keyed, own)
        # rows that repeat a document give its pieces again
        return text.mapInArrow(cut, "h long, t long, n long, piece binary").dropDuplicates(["h", "t"])

    def expand(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        piece, place = _repeats(group.column("piece").to_pylist(), group.column("n").to_numpy(), length)
        return _span_rows(group, piece, place, length)

    small = cut_out(open_.filter(F.col("bytes") <= most)).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    spans = whole.unionByName(small.groupBy("bucket").applyInArrow(expand, SPANS))
    large = open_.filter(F.col("bytes") > most)
    if not large.isEmpty():
        spans = spans.unionByName(_counted(stage(cut_out(large), "large"), length))
    spans = stage(spans.filter(F.size("spans") > 0), "spans")
    release(sized)
    each = places.join(spans, ["h", "t"]).select("doc_id", "k", "first", F.explode("spans").alias("s"))
    out = stage(
        each.groupBy("doc_id", "k").agg(
            F.sort_array(F.collect_set(F.struct((F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b")))).alias("spans")
        ),
        "repeated",
    )
    release(places, spans)
    return out


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of pieces whose hash has too much text for one task: windows counted by hash, over all tasks."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, t, n, piece = (c.to_pylist() for c in batch.columns)
            for x, y, p, m in zip(h, t, piece, n, strict=True):
                places = range(len(p) - length + 1)
                w = np.frombuffer(b"".join([xxhash.xxh128_digest(p[i : i + length]) for i in places]), np.int64).reshape(-1, 2)
                k = len(w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array([x] * k, pa.int64()), pa.array([y] * k, pa.int64()),
                     pa.array(np.arange(k, dtype=np.int32)), pa.array([m] * k, pa.int64())],
                    ["w1", "w2", "h", "t", "place", "n"],
                )

    each = stage(pieces.mapInArrow(windows, "w1 long, w2 long, h long, t long, place int, n long"), "windows")
    twice = each.groupBy("w1", "w2").agg(F.sum("n").alias("all")).filter("all > 1").select("w1", "w2")
    # the places of a piece are as many as its bytes at most; a span for each run of places that reach each other
    places = each.join(twice, ["w1", "w2"]).groupBy("h", "t").agg(F.sort_array(F.collect_set("place")).alias("places"))
    at = lambda i: F.get("places", i)
    a = F.filter("places", lambda p, i: (i == 0) | (p - at(i - 1) > length))
    b = F.filter("places", lambda p, i: (i == F.size("places") - 1) | (at(i + 1) - p > length))
    return places.select("h", "t", F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), (y + length).alias("b"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    per_doc = repeated_spans(docs, length, gram, most)
    key_type = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("k"), "text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, runs, digest = [], [], []
            for i in range(batch.num_rows):
                data, n, k, last = batch.column(3)[i].as_buffer(), 0, 0, 0
                hasher = hashlib.sha256()
                for a, b in zip(*(x.to_numpy().tolist() for x in batch.column(2)[i].values.flatten()), strict=True):
                    if a > last or not k and not a:  # a new run; spans that touch are one
                        k += 1
                    if a > last:
                        hasher.update(data[last:a])
                    n += max(0, b - max(a, last))
                    last = max(last, b)
                hasher.update(data[last:])
                removed.append(n)
                runs.append(k)
                digest.append(hasher.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "k", "n_removed", "n_spans", "sha"],
            )

    changed = _texts(keyed, per_doc).mapInArrow(
        drop, f"doc_id {key_type}, k long, n_removed long, n_spans long, sha string"
    ).dropDuplicates(["doc_id", "k"])
    text = F.coalesce("text", F.lit(""))
    plain = docs.select(
        "doc_id", F.xxhash64("doc_id", "text").alias("k"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole")
    )
    return plain.join(changed, _same(plain, changed), "left").select(
        plain["doc_id"], "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )
