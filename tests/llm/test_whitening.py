"""Whitening against plain eigenvectors of the exact covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pagetide.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, component string, x int, label int"
INF, NAN = float("inf"), float("nan")


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "c", 1, 0) for i, v in vectors], SCHEMA).repartition(parts)


def check(rows, vectors, most=16):
    """Compare with numpy; vectors are (vec_id, entries)."""
    usable = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(Fraction(float(np.float32(c))) * 64) + 1_000_000 for c in v] for _, v in usable]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in fit])
    e, vectors_ = np.linalg.eigh(y.T @ y / n)
    e, vectors_ = e[::-1], vectors_[:, ::-1]
    size = min(most, int((e > 1e-12 * e[0]).sum())) if n > 1 else 0
    assert len(rows) == size * len(usable)
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    signs = {}
    for (i, _), row in zip(usable, x, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True))
        own = got[i, deviation]
        centre = np.array([float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)])
        for k in range(size):
            r = own[k + 1][0]
            expected = centre @ vectors_[:, k] / np.sqrt(e[k])
            if abs(expected) > 1e-3:
                signs.setdefault(k, np.sign(r["whitened"] * expected))
            assert r["whitened"] * signs.get(k, 1) == pytest.approx(expected, abs=1e-7)
            assert r["n"] == n and r["explained"] == pytest.approx(e[k] / np.trace(y.T @ y / n), rel=1e-9)
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("shape", [(300, 20), (7, 20), (40, 3)])
def test_equals_eigenvectors(spark, shape):
    rng = np.random.default_rng(4)
    n, dim = shape
    data = rng.normal(size=(n, dim)) * np.geomspace(9, 0.1, dim) @ np.linalg.qr(rng.normal(size=(dim, dim)))[0] + 5
    vectors = [(i, [float(c) for c in row]) for i, row in enumerate(data.astype(np.float32))]
    vectors += [(1000 + i, v) for i, v in vectors[:5]] + [(None, vectors[0][1]), (3, vectors[3][1])]
    bad = [(2000, None), (2001, [None] * dim), (2002, [NAN] * dim), (2003, [0.0] * (dim - 1) + [INF])]
    odd = [(2004, [1.0]), (2005, []), (2006, [2.0, 1.0])]
    out = whitening.whiten(table(spark, vectors + bad + odd))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(out.collect(), vectors + bad)


def test_little_and_no_variance(spark):
    rng = np.random.default_rng(5)
    flat = [(i, [float(a), 7.0, float(2 * a), float(rng.integers(1 << 14)) / 64]) for i, a in enumerate(rng.integers(0, 50, 60))]
    check(whitening.whiten(table(spark, flat)).collect(), flat)
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(table(spark, few)).collect() == []


def test_large_entries_are_exact(spark):
    vectors = [(i, [float(v), 0.5]) for i, v in enumerate([-3e38, 3e38, 0.0, 1.0, 2.0**40])]
    rows = whitening.whiten(table(spark, vectors)).collect()
    assert {r["n"] for r in rows} == {5} and {r["deviation"] for r in rows if r["vec_id"] < 2} == {None}


def test_factors_of_many_rows_in_parts(spark, monkeypatch):
    """Sums do not depend on how the rows lie in tasks, and few groups add up the same matrices."""
    rng = np.random.default_rng(6)
    vectors = [(i, [float(c) for c in row]) for i, row in enumerate(rng.normal(size=(500, 6)).astype(np.float32))]
    monkeypatch.setattr(whitening, "GROUPS", 2)
    check(whitening.whiten(table(spark, vectors, 17)).collect(), vectors)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.op12_embedding_whitening(spark, sf).collect(), given)
