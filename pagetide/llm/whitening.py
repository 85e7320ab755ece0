"""Embedding whitening by shifted CholeskyQR.

Entries become whole numbers x = floor(64 * c) + 1000000, so sums and deviations are exact. The fit list holds each
different x vector once; its rows, less the mean, form a tall matrix A. A pass over A forms the Gram matrix of the
rows as they stand, its Cholesky factor R, and from then on every row is solved by R (a triangular solve) wherever
it is met. The first Gram matrix gets a small shift on its diagonal, so that it has a factor also if directions
are nearly or wholly without variance; the next passes undo the shift and orthogonalise further, until the Gram matrix
is the identity within rounding. The product of the factors is the R of A, a matrix of dimension by dimension,
and its singular values and right vectors are the deviations and components of the vectors.

Tasks send one matrix each; these are added in GROUPS tasks, then on the driver, so what the driver holds depends on the
dimension alone. The fit list is written once and read by every pass.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; so are vectors with another
length than most different ones have (of equally frequent lengths the longest stays). Entries beyond 2**52 / 64 count as
that. Repeated rows and null ids are kept and get equal values. Directions without variance (below 1e-13 of the
largest) are no components, so there are fewer than 16 rows for a vector if there are fewer such directions, and none
if all vectors are equal. Components of equal variance come in any order. A deviation outside the range of long is null.
An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.session import stage

COMPONENTS = 16
GROUPS = 64  # tasks that add up matrices
PASSES = 6  # at most; three will do unless the vectors are close to a subspace
LARGEST = float(2**52)
UNIT = 2.0**-53


def whole(vector: Column) -> Column:
    """The vector in whole numbers, or null if it has an entry that is no finite number."""
    entries = vector.cast("array<double>")
    finite = F.forall(entries, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    scaled = lambda c: F.greatest(F.least(c * 64, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(finite, F.transform(entries, lambda c: F.floor(scaled(c)).cast("long") + 1_000_000))


def _matrix(column: pa.Array) -> np.ndarray:
    """A row for each vector of the column."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """The rows times the inverse of each upper triangular factor, by forward substitution."""
    for r in factors:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


@dataclass
class Fit:
    """Sums of the fit list, its components as columns, and their variances."""

    n: int
    sums: list[int]
    trace: float
    components: np.ndarray
    variances: np.ndarray
    identity_error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: in Python's integers where 64 bits do not hold it."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) < 2**61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.variances)

    def squared(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of each row's deviations."""
        d = self.deviations(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, d.shape[1]) < 2**63:
            return (d * d).sum(axis=1).tolist()
        sums = [sum(int(v) ** 2 for v in row) for row in d]
        return [s if s < 2**63 else None for s in sums]


def _added(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of part(vectors) over all batches of the fit list; a matrix of this shape."""
    kind = part(np.zeros((0, shape[-1]), np.int64)).dtype
    groups = max(1, min(GROUPS, (64 << 20) // (8 * max(1, int(np.prod(shape))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape, kind), False
        for batch in batches:
            if batch.num_rows:
                total += part(_matrix(batch.column(0)))
                some = True
        if some:
            at = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([at % groups], pa.int32()), pa.array([at]), pa.array([total.tobytes()], pa.binary())], ["g", "at", "m"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for batch in batches:
            for raw in batch.column("m"):
                total += np.frombuffer(raw.as_buffer(), kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "m"])

    sent = fit.select("x").mapInArrow(run, "g int, at long, m binary")
    found = sent.groupBy("g").applyInArrow(add, "g int, m binary").collect()  # at most GROUPS matrices
    return sum((np.frombuffer(m, kind).reshape(shape) for _, m in sorted((r["g"], bytes(r["m"])) for r in found)), np.zeros(shape, kind))


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """The upper triangular Cholesky factor of the matrix, with as much shift as it takes."""
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(100 * shift, UNIT * max(np.trace(gram), 2.0**-900))


def fit_list(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """x: each different vector of whole numbers once, of the most frequent length."""
    staged = stage(rows.select(whole(F.col(vector)).alias("x")).filter("x IS NOT NULL").distinct(), "vectors")
    lengths = staged.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return staged.filter(F.size("x") == (lengths["size"] if lengths else 0))


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Fit | None:
    """Components of a fit list; None without any direction that has variance."""
    first = vectors.first()
    dim = len(first["x"]) if first else 0
    if not dim:
        return None
    # sums in halves, so that they stay exact
    count = lambda x: np.array([x & (2**26 - 1), x >> 26, np.ones_like(x)]).sum(axis=1)
    low, high, ones = _added(vectors, count, (3, dim))
    n = int(ones[0])
    start = Fit(n, [int(a) + (int(b) << 26) for a, b in zip(low, high, strict=True)], 0.0, np.zeros((dim, 0)), np.zeros(0))
    factors: list[np.ndarray] = []
    trace = 0.0
    for turn in range(PASSES):
        known = list(factors)

        def gram(x: np.ndarray) -> np.ndarray:
            q = _solved(start.centred(x), known)
            return q.T @ q

        g = _added(vectors, gram, (dim, dim))
        g = (g + g.T) / 2
        if not turn:
            trace = float(np.trace(g)) / n
            if trace <= 0:
                return None
        elif np.abs(g - np.eye(dim)).max() <= 16 * dim * UNIT:
            break
        factors.append(_factor(g, 11 * dim * (dim + 1) * UNIT * np.trace(g) if not turn else 0.0))
    r = np.eye(dim)
    for factor in factors:
        r = factor @ r
    _, sigma, right = np.linalg.svd(r / np.sqrt(n))
    keep = min(most, int((sigma**2 > 1e-13 * sigma[0] ** 2).sum()))
    right = right[:keep]
    right *= np.where(right[np.arange(keep), np.abs(right).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    found = Fit(n, start.sums, trace, np.ascontiguousarray(right.T), sigma[:keep] ** 2)

    def covariance(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return w.T @ w

    found.identity_error = float(np.abs(_added_square(vectors, covariance, dim, keep) / n - np.eye(keep)).max())
    return found


def _added_square(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray], dim: int, size: int) -> np.ndarray:
    """Like _added, for a matrix that is smaller than the dimension."""

    def padded(x: np.ndarray) -> np.ndarray:
        out = np.zeros((size, max(size, dim)))
        if len(x):
            out[:, :size] = part(x)
        return out

    return _added(vectors, padded, (size, max(size, dim)))[:, :size]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error for each usable row and component."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(fit_list(rows, vector), most)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    dim, size = model.components.shape
    usable = rows.select(F.col(key).alias("key"), whole(F.col(vector)).alias("x")).filter(F.size("x") == dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            x = _matrix(batch.column(1))
            each = np.repeat(np.arange(k), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), k)),
                    pa.array(np.full(len(each), model.n, np.int64)),
                    pa.array(model.squared(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.variances / model.trace, k)),
                    pa.array(np.full(len(each), model.identity_error)),
                ],
                ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(run, schema).withColumnRenamed("key", key)
