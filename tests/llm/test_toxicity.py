"""Toxicity through its query and against plain loops over character n-grams."""

import math
import random
import zlib

import numpy as np
import pytest

from pagetide.llm import queries, toxicity

MASK = 2**32 - 1


def buckets(text):
    """The buckets of the distinct n-grams of a text, one by one."""
    out, padded = set(), f" {(text or '').lower()} "
    for order in toxicity.ORDERS:
        for i in range(len(padded) - order + 1):
            h = 0
            for c in padded[i : i + order]:
                h = ((h ^ ord(c)) * 0x9E3779B1) & MASK
                h ^= h >> 15
            out.add(((h * 0x85EBCA6B) & MASK) >> (32 - toxicity.BITS))
    return out


def sentence(rng, toxic):
    words = [rng.choice("red fox jumps over lazy dogs while seven cats sleep é \U0001f600".split()) for _ in range(25)]
    if toxic:
        words[rng.randrange(25)] = rng.choice(["zorkish", "Blagfool"])
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = [(i, sentence(rng, i % 3 == 0), i % 3 == 0) for i in range(400)]
    return [*out, (None, sentence(rng, True), None), (500, None, False), (501, "", False), (502, "x" * 300_000, False), (3, out[3][1], True)]


def test_counts_and_scores_equal_loops(spark, rows):
    known = [(i, t, int(bool(x))) for i, t, x in rows if x is not None]
    df = spark.createDataFrame(known, "doc_id long, text string, toxic int").repartition(3)
    counts = np.zeros((2, 2**toxicity.BITS + 1), np.int64)
    for _, text, label in known:
        counts[label, list(buckets(text))] += 1
        counts[label, -1] += 1
    assert (toxicity._counts(df) == counts).all()
    model = toxicity.fit(df)
    got = {}
    for r in toxicity.score(df, model, "doc_id").collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    for i, text, _ in known:
        z = sum(float(model.weight[b]) for b in sorted(buckets(text))) + model.bias
        assert all(s == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) for s in got[i])
    assert len(got[3]) == 2


def test_repeated_rows_fill_the_sample_once(spark, rows, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    held = []
    fit = toxicity._regression
    monkeypatch.setattr(toxicity, "_regression", lambda found, label, ratio: held.append(len(found)) or fit(found, label, ratio))
    known = [(i, t, int(bool(x))) for i, t, x in rows if x is not None]
    df = spark.createDataFrame(known + [known[0]] * 500, "doc_id long, text string, toxic int")
    toxicity.fit(df)
    assert held == [40]


def test_query(spark, rows, tmp_path):
    documents = [(i, t, "id", 7, 0.5) for i, t, _ in rows]
    spark.createDataFrame(documents, "doc_id long, text string, id string, toxic int, score double").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(bool(x))) for i, _, x in rows if x is not None] + [(None, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.op3_toxicity(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    truth = {i: x for i, _, x in rows if x is not None}
    unseen = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["doc_id"] < 400]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.95
    for name in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert queries.op3_toxicity(spark, f"{tmp_path}/empty").collect() == []
