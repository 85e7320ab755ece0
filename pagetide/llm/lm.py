"""Scores of an interpolated modified Kneser-Ney bigram model of words, counted in Spark.

Words are hashed to 64 bits; the place of a hash in the sorted array of all training words is the id of the word. A
bigram is the pair of its ids, without loss. Tasks count the bigrams they meet and send them as packed runs of
sorted numbers, dealt by the first word; first words with a large share of all tokens are dealt by both words. A
task then merges the runs of one piece, writes the piece as sorted arrays to the shared folder, and sends on what the
words need: how often and how variously each is continued (for its weight of the lower order) and after how
many different words it occurs (its continuation count). Scoring tasks map the arrays into memory.

The order is two: nearly all longer runs of words occur once, so a trigram table is about as large as the text itself.

Defined results: a null text is empty; an empty text is one end token. An unknown word gets what the lowest order keeps
for one word that was never seen. Without training rows every token has probability 1 (V = 0, base likewise).
Repeated rows count as often as they occur. Other columns are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm import arrays, shared

U = np.uint64
END = U(0xE4D0F7E870F7EA57)  # the hash of the end token
HELD = 6_000_000  # tokens whose counts a task holds before it sends them on
SALTS = 64  # pieces for a first word with a large share of the tokens
PER_PIECE = 2_500_000  # tokens, about, in a piece of the bigrams
SPAN = 1_000_000  # ids in a piece of the tables by word


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, end, hashes of the tokens of these rows (each text ends with END), and the row of each token."""
    for lo, hi, data, offsets in shared.text_slices(shared.text_column(batch)):
        data = shared.LOWER[data]
        starts, ends, row = shared.find_words(data, offsets)
        n = np.bincount(row, minlength=hi - lo)
        h = np.full(len(row) + hi - lo, END, U)
        h[np.arange(len(row)) + row] = shared.hash_words(data, starts, ends)
        yield lo, hi, h, np.repeat(np.arange(hi - lo), n + 1)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counted(batches, keys_of, send):
    """Count keys over all batches of a task; `send` makes the batches of rows from sorted keys and counts."""
    held, n = [], 0
    for batch in batches:
        for keys in keys_of(batch):
            if n + len(keys) > HELD and held:
                yield from send(*_added(*(np.concatenate(x) for x in zip(*held, strict=True))))
                held, n = [], 0
            held.append(np.unique(keys, return_counts=True))
            n += len(held[-1][0])
    if held:
        yield from send(*_added(*(np.concatenate(x) for x in zip(*held, strict=True))))


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys and counts as bytes; the upper half of the keys as differences."""
    high = (keys >> U(32)).astype(np.uint32)
    low = (keys & U(0xFFFFFFFF)).astype(np.uint32)
    step = np.diff(high, prepend=np.uint32(0))
    big = step >= 0xFFFF
    size = np.array([len(keys), big.sum()], np.int64)
    small = counts < 255
    return b"".join(x.tobytes() for x in (
        size, np.where(big, 0xFFFF, step).astype(np.uint16), step[big].astype(np.uint32), low,
        np.where(small, counts, 255).astype(np.uint8), counts[~small].astype(np.int64),
    ))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n_big = np.frombuffer(raw, np.int64, 2)
    at = 16
    step = np.frombuffer(raw, np.uint16, n, at).astype(np.uint32)
    at += 2 * n
    step[step == 0xFFFF] = np.frombuffer(raw, np.uint32, n_big, at)
    at += 4 * n_big
    low = np.frombuffer(raw, np.uint32, n, at)
    at += 4 * n
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    at += n
    counts[counts == 255] = np.frombuffer(raw, np.int64, offset=at)
    return (np.cumsum(step.astype(U)) << U(32)) | low.astype(U), counts


def _split(piece: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (piece, run) for each piece that occurs."""
    order = np.argsort(piece, kind="stable")
    ends = np.flatnonzero(np.diff(piece[order])) + 1
    parts = np.split(order, ends) if len(order) else []
    if parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(piece[p[0]]) for p in parts], pa.int64()), pa.array([_pack(keys[p], counts[p]) for p in parts], pa.binary())],
            ["piece", "run"],
        )


def _merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    runs = [_unpack(x) for x in group.column("run").to_pylist()]
    return _added(*(np.concatenate(x) for x in zip(*runs, strict=True)))


@dataclass
class Model:
    words: arrays.HashArrays  # counts of the words
    tokens: int  # N
    folder: str
    pieces: int  # of the bigrams
    hot: np.ndarray  # ids of first words that are dealt by both words
    d2: tuple[float, float, float]  # discounts of bigrams that occur once, twice, more often
    d1: tuple[float, float, float]  # the same for continuation counts
    bigrams: int  # different ones
    kinds: tuple[int, int, int]  # words with one, two, more predecessors

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def _array(self, name: str) -> np.ndarray:
        files = self.__dict__.setdefault("_open", {})
        if name not in files:
            path = os.path.join(self.folder, f"{name}.npy")
            try:
                files[name] = np.load(path, mmap_mode="r")
            except ValueError:  # an empty array cannot be mapped
                files[name] = np.load(path)
        return files[name]

    def count(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """How often the pairs of ids occur."""
        out = np.zeros(len(first), np.int64)
        keys = (first.astype(U) << U(32)) | second.astype(U)
        for p, at in arrays.by_piece(piece_of_pairs(first, second, self.pieces, self.hot), self.pieces):
            have, n = self._array(f"pairs-{p}"), self._array(f"counts-{p}")
            if not len(have):
                continue
            own = keys if at is None else keys[at]
            i = np.minimum(np.searchsorted(have, own), len(have) - 1)
            got = np.where(have[i] == own, n[i], 0)
            if at is None:
                return got
            out[at] = got
        return out

    def by_word(self, ids: np.ndarray) -> np.ndarray:
        """For each id: tokens after it, different words after it once, twice, more often, different words before it."""
        out = np.zeros((len(ids), 5), np.int64)
        for p, at in arrays.by_piece(ids // SPAN, 1 << 30):
            table = self._array(f"words-{p}")
            out[at] = table[ids[at] % SPAN]
        return out


def piece_of_pairs(first: np.ndarray, second: np.ndarray, pieces: int, hot: np.ndarray) -> np.ndarray:
    salt = np.where(np.isin(first, hot), shared.mix(second.astype(U) + U(1)) % U(SALTS), U(0)) if len(hot) else U(0)
    return (shared.mix(first.astype(U) * U(SALTS) + salt) % U(pieces)).astype(np.int64)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things that occur once, twice, three and four times."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True))


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3)]


def fit(training: DataFrame) -> Model | None:
    """The model of all texts of `training`; None if it has no rows."""
    spark = training.sparkSession
    folder = shared.mounted_folder(spark, "lm")
    texts = training.select("text")
    rough = max(1, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // 6  # tokens, about
    bits = arrays.piece_bits(rough // 8)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = lambda batch: (h for _, _, h, _ in _tokens(batch))
        yield from _counted(batches, hashes, lambda keys, n: _split(arrays.piece_of(keys, bits), keys, n))

    def merge(group: pa.Table) -> dict[str, np.ndarray]:
        keys, counts = _merged(group)
        return {"hash": keys, "count": counts}

    vocabulary = arrays.write_pieces(texts.mapInArrow(words, "piece long, run binary"), bits, folder, merge)
    size = sum(vocabulary.sizes)
    if not size:
        return None
    if size >= 2**32 - 1:
        raise ValueError("more than 2**32 - 2 different words")
    begin = size  # the id of the start of a text

    # tokens of each piece, and the words with a large share of them
    pieces = max(1, rough // PER_PIECE)

    def masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                n = vocabulary.array("count", p) if vocabulary.sizes[p] else np.zeros(0, np.int64)
                large = np.flatnonzero(n > rough // (4 * pieces))  # fewer than about 4 * pieces words in all
                ids = (large + vocabulary.starts[p]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([ids], pa.list_(pa.int64()))], ["n", "ids"])

    found = spark.range(1 << bits).mapInArrow(masses, "n long, ids array<long>").collect()
    tokens = sum(r["n"] for r in found)
    hot = np.array(sorted({begin, *(i for r in found for i in r["ids"])}), np.int64)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys_of(batch):
            for _, _, h, row in _tokens(batch):
                ids = vocabulary.find(h).astype(U)
                before = np.concatenate(([U(begin)], ids[:-1]))
                before[np.concatenate(([True], row[1:] != row[:-1]))] = begin
                yield (before << U(32)) | ids

        def send(keys, counts):
            yield from _split(piece_of_pairs(keys >> U(32), keys & U(0xFFFFFFFF), pieces, hot), keys, counts)

        yield from _counted(batches, keys_of, send)

    def merge_pairs(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        p = key[0].as_py()
        shared.write_array(os.path.join(folder, f"pairs-{p}.npy"), keys)
        shared.write_array(os.path.join(folder, f"counts-{p}.npy"), counts.astype(np.int32 if counts.max(initial=0) < 2**31 else np.int64))
        if not len(keys):
            return pa.table({"piece": pa.array([], pa.int64()), "run": pa.array([], pa.binary())})
        out = []
        # kinds 0 to 3: by first word; 4: by second word; the id is the upper half of a packed key
        first, at = np.unique(keys >> U(32), return_inverse=True)
        for kind, weights in enumerate((counts, counts == 1, counts == 2, counts > 2)):
            n = np.bincount(at, weights).astype(np.int64)
            out.append(((first[n > 0] << U(32)) | U(kind), n[n > 0]))
        second, n = np.unique(keys & U(0xFFFFFFFF), return_counts=True)
        out.append(((second << U(32)) | U(4), n))
        out.append((np.array([(size + 1 + k) << 32 for k in range(5)], U) | U(5), np.array([len(keys), *(np.sum(counts == k) for k in (1, 2, 3, 4))])))
        keys, counts = _added(*(np.concatenate(x) for x in zip(*out, strict=True)))
        keys, counts = keys[counts > 0], counts[counts > 0]
        return pa.Table.from_batches(list(_split((keys >> U(32)).astype(np.int64) // SPAN, keys, counts)))

    def merge_words(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        keys, counts = _merged(group)
        p = key[0].as_py()
        table = np.zeros((SPAN, 5), np.int64)
        own = (keys & U(0xFFFFFFFF)) < U(5)
        table[((keys[own] >> U(32)) % U(SPAN)).astype(np.int64), (keys[own] & U(0xFFFFFFFF)).astype(np.int64)] = counts[own]
        shared.write_array(os.path.join(folder, f"words-{p}.npy"), table[: max(0, min(SPAN, size + 1 - p * SPAN))])
        before = table[:, 4]
        stats = [int(np.sum(before == k)) for k in (1, 2, 3, 4)] + [int(np.sum(before > 2))] + [0] * 5
        for k, n in zip(keys[~own] >> U(32), counts[~own], strict=True):
            stats[5 + int(k) - size - 1] = int(n)
        return pa.table({"stats": pa.array([stats], pa.list_(pa.int64()))})

    # every piece is written, also one without bigrams, so a file that is not there when it is read is an error
    no_bigrams = spark.range(pieces).select(F.col("id").alias("piece"), F.lit(_pack(np.zeros(0, U), np.zeros(0, np.int64))).alias("run"))
    runs = texts.mapInArrow(pairs, "piece long, run binary").unionByName(no_bigrams)
    by_word = runs.groupBy("piece").applyInArrow(merge_pairs, "piece long, run binary")
    stats = np.sum([r[0] for r in by_word.groupBy("piece").applyInArrow(merge_words, "stats array<long>").collect()], axis=0)
    n1, n2, n3, n4, more, kinds, b1, b2, b3, b4 = (int(x) for x in stats)
    return Model(vocabulary, tokens, folder, pieces, hot, _discounts([b1, b2, b3, b4]), _discounts([n1, n2, n3, n4]), kinds, (n1, n2, more))


def score(docs: DataFrame, model: Model | None, *keep: str) -> DataFrame:
    """The columns of `keep` and n_tokens, n_known, base_score, score (log10 probabilities of the whole text)."""
    schema = docs.select(*keep).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)

    def probabilities(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = sum(model.words.sizes)
        ids = model.words.find(h)
        known = ids >= 0
        c = np.zeros(len(h), np.int64)
        c[known] = model.words.values("count", ids[known])
        base = (c + 1) / (model.tokens + size + 1)  # sums to 1 over all words and the unknown
        start = np.concatenate(([True], row[1:] != row[:-1]))
        before = np.where(start, size, np.concatenate(([0], ids[:-1])))
        # lowest order: in how many contexts a word occurs, mixed with one share for every word and the unknown
        cont = np.zeros(len(h), np.int64)
        cont[known] = model.by_word(ids[known])[:, 4]
        rest = sum(d * k for d, k in zip(model.d1, model.kinds, strict=True)) / model.bigrams
        low = (cont - _discount(cont, model.d1)) / model.bigrams + rest / (size + 1)
        p = low.copy()
        at = np.flatnonzero(before >= 0)
        after = model.by_word(before[at])
        total = np.maximum(after[:, 0], 1)
        weight = (after[:, 1:4] * np.array(model.d2)).sum(axis=1) / total
        both = np.flatnonzero(known[at])
        seen = np.zeros(len(at), np.int64)
        seen[both] = model.count(before[at[both]], ids[at[both]])
        p[at] = (seen - _discount(seen, model.d2)) / total + np.where(after[:, 0] > 0, weight, 1.0) * low[at]
        return known, base, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = np.zeros((2, batch.num_rows), np.int64)
            base, full = np.zeros((2, batch.num_rows))
            for lo, hi, h, row in _tokens(batch):
                add = lambda x, row=row, lo=lo, hi=hi: np.bincount(row, x, minlength=hi - lo)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                if model is None:
                    continue
                known, b, p = probabilities(h, row)
                found[lo:hi], base[lo:hi], full[lo:hi] = add(known), add(np.log10(b)), add(np.log10(p))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(x) for x in (n, found, base, full))], [*keep, "n_tokens", "n_known", "base_score", "score"]
            )

    return docs.select("text", *keep).mapInArrow(run, schema)
