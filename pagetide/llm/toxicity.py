"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

In how many toxic and clean texts each hashed n-gram occurs is counted over all labelled training rows. Its
ratio r = log of (share among toxic / share among clean) scales the feature; n-grams whose ratio is within the noise
are left out. A logistic regression on the scaled features is fitted on a sample of at most SAMPLE rows of each class
(the different rows with the smallest hashes of doc_id), and its intercept is corrected to the real shares of the classes.

Defined results: a null or empty text gets the score of a text without any known n-gram. Rows without a label are not
learned from; of several labels of a document the largest counts. Without both classes every score is the share of
toxic rows (0 without rows). Repeated rows get equal scores. Whole texts are used. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm import shared
from pagetide.session import stage

ORDERS = (3, 4, 5)
BITS = 20
PARTS = 16  # pieces of the count vectors
SAMPLE = 2_000  # rows of each class for the regression
NOISE = 4.0  # standard errors that a ratio must differ from 0
CHARS = 1 << 19


def _features(texts: list[str], wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, end, rows and buckets of the distinct n-grams of at most 512 texts (only buckets that are wanted)."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= CHARS):
            n += len(texts[hi])
            hi += 1
        part = [f" {t.lower()} " for t in texts[lo:hi]]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(hi - lo, dtype=np.uint32), [len(t) for t in part])
        keys = []
        h = np.zeros(len(codes), np.uint32)
        for k in range(max(ORDERS)):  # one chain of hashes: each order goes on from the shorter one
            size = len(codes) - k
            if size <= 0:
                break
            h = (h[:size] ^ codes[k:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if k + 1 not in ORDERS:
                continue
            bucket = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            keep = row[:size] == row[k:]
            if wanted is not None:
                keep &= wanted[bucket]
            keys.append((row[:size][keep] << np.uint32(BITS)) | bucket[keep])
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new].astype(np.int64)
        yield lo, hi, key >> BITS, key & ((1 << BITS) - 1)
        lo = hi


@dataclass
class Model:
    weight: np.ndarray  # for each bucket, ratio included
    bias: float


def _counts(training: DataFrame) -> np.ndarray:
    """Texts with each bucket, for clean and toxic rows; the last column has the rows. 2**BITS + 1 numbers each."""
    width = (1 << BITS) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in shared.few_rows(batches):
            texts = shared.text_column(batch).to_pylist()
            label = np.array(batch.column(1).to_pylist(), np.int64)
            rows += np.bincount(label, minlength=2)
            for lo, _, row, bucket in _features(texts):
                toxic = label[lo + row] == 1
                for k in (0, 1):
                    total[k] += np.bincount(bucket[toxic == k], minlength=1 << BITS)
        if rows.any():
            parts = [total[:, p * width : (p + 1) * width] for p in range(PARTS)] + [rows]
            parts = [zlib.compress(x.tobytes(), 1) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS + 1), pa.int32()), pa.array(parts, pa.binary())], ["part", "n"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        n = np.sum([np.frombuffer(zlib.decompress(x), np.int64) for x in group.column("n").to_pylist()], axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n.tobytes()], pa.binary())})

    out = np.zeros((2, (1 << BITS) + 1), np.int64)
    sent = training.select("text", "toxic").mapInArrow(run, "part int, n binary")
    # as many numbers as there are buckets, whatever the input
    for part, n in sent.groupBy("part").applyInArrow(add, "part int, n binary").collect():
        values = np.frombuffer(n, np.int64).reshape(2, -1)
        at = part * width
        out[:, at : at + values.shape[1]] = values
    return out


def _regression(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the scaled features and the intercept, by gradient descent with momentum."""
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    bucket = np.concatenate([*rows, np.zeros(0, np.int32)])
    seen = np.zeros(len(ratio), bool)
    seen[bucket] = True
    feature = np.flatnonzero(seen)
    index = (np.cumsum(seen, dtype=np.int32) - 1)[bucket]
    x = ratio.astype(np.float32)[bucket]
    del bucket
    slices = [slice(i, i + CHARS) for i in range(0, len(index), CHARS)]  # few numbers at a time beside the sample itself
    added = lambda where, values, size: sum((np.bincount(where[s], values(s), minlength=size) for s in slices), np.zeros(size))
    w, b = np.zeros(len(feature)), 0.0
    m, v, mb, vb = np.zeros(len(feature)), np.zeros(len(feature)), 0.0, 0.0
    n = len(rows)
    for step in range(1, 151):
        z = added(at, lambda s: w[index[s]] * x[s], n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        gradient = added(index, lambda s: error[at[s]] * x[s], len(feature)) / n + 1e-3 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * error.mean(), 0.99 * vb + 0.01 * error.mean() ** 2
        rate = 0.03 if step < 110 else 0.005
        fix, fix2 = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        b -= rate * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    weight = np.zeros(len(ratio))
    weight[feature] = w * ratio[feature]
    return weight, b


def fit(training: DataFrame) -> Model:
    """A model of training rows: doc_id, text and toxic (0 or 1)."""
    training = training.filter("toxic IN (0, 1)")
    counts = _counts(training)
    clean, toxic = (int(x) for x in counts[:, -1])
    size = 1 << BITS
    if not clean or not toxic:
        share = 1.0 if toxic else 0.0
        return Model(np.zeros(size, np.float32), 30.0 if share else -30.0)
    q, p = counts[0, :-1] + 1.0, counts[1, :-1] + 1.0
    ratio = np.log(p / (toxic + 2)) - np.log(q / (clean + 2))
    wanted = np.abs(ratio) > NOISE * np.sqrt(1 / p + 1 / q)
    # a row that stands there several times fills the sample once
    ids = training.select("toxic", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("k")).distinct()
    chosen = [ids.filter(f"toxic = {k}").orderBy("h", "k").limit(SAMPLE) for k in (0, 1)]
    chosen = stage(chosen[0].unionByName(chosen[1]).select(F.col("k").alias("chosen")).distinct(), "sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shared.few_rows(batches):
            out = []
            for lo, hi, row, bucket in _features(shared.text_column(batch).to_pylist(), wanted):
                out += np.split(bucket, np.searchsorted(row, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.astype(np.int32).tobytes() for x in out], pa.binary())], ["toxic", "f"])

    # at most 2 * SAMPLE rows by construction
    sample = training.select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("k"))
    sample = sample.join(F.broadcast(chosen), F.col("k") == F.col("chosen"), "left_semi").dropDuplicates(["toxic", "k"]).select("text", "toxic")
    rows = sample.mapInArrow(features, "toxic int, f binary").collect()
    label = np.array([r["toxic"] for r in rows], float)
    weight, bias = _regression([np.frombuffer(r["f"], np.int32) for r in rows], label, np.where(wanted, ratio, 0.0))
    ones = max(label.sum(), 1)
    bias += np.log(toxic / clean) - np.log(ones / max(len(label) - ones, 1))
    return Model(weight.astype(np.float32), float(bias))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns of `keep` and score (0 to 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = model.weight != 0
        for batch in shared.few_rows(batches):
            z = np.zeros(batch.num_rows)
            for lo, hi, row, bucket in _features(shared.text_column(batch).to_pylist(), wanted):
                z[lo:hi] = np.bincount(row, model.weight[bucket], minlength=hi - lo)
            s = 1 / (1 + np.exp(-np.clip(z + model.bias, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s)], [*keep, "score"])

    return docs.select("text", *keep).mapInArrow(run, docs.select(*keep).schema.add("score", "double"))
