"""Whitening of embeddings: the leading components of their covariance, and each vector along them in units of their deviation.

Each entry becomes an integer (floor of SCALE times it, plus SHIFT).  The fit list is each distinct vector of integers once; Spark makes them
distinct (partly in each task, so that a vector that fills a third of the table is one row a task before the shuffle), and it is written to the shared folder.  Sums are exact; the
covariance is that of entries less their mean, summed in each task and then by Spark.  It is a matrix of the dimension squared, whatever the number of rows: the driver
brings it to tridiagonal form by Householder reflections, finds the leading eigenvalues by bisection on Sturm counts and their vectors
by inverse iteration, made orthogonal anew within clusters of near eigenvalues.  The projection (dimension times components numbers) goes to all tasks.

Vectors that are null or hold null or non-finite entries are dropped; shorter ones count as filled up with zeros.  Entries beyond 2 ** 52 / SCALE count as that.
Repeated rows and null ids stay, each with its own rows of the result.  A component whose
eigenvalue is nothing but rounding has no unit deviation and is left out, so that equal vectors and an empty table give an empty result.  A deviation beyond a long is null.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .storage import written
from .vectors import dimension, floored, in_steps, summed, whole
from .words import bounded

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
#: Rows of a batch that are worked on at a time.
STEP = 4096
#: Eigenvalues nearer than this share of the matrix' norm are a cluster.
CLUSTER = 1e-3
_EPS = np.finfo(float).eps


def householder(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The diagonal and off-diagonal of an equal symmetric tridiagonal matrix, and the reflections that lead there."""
    a = matrix.astype(float).copy()
    mirrors = []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        target = -np.copysign(np.linalg.norm(v), v[0])
        v[0] -= target
        size = np.linalg.norm(v)
        if size:
            v /= size
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            p -= (v @ p) * v
            rest -= 2 * (np.outer(v, p) + np.outer(p, v))
            a[k + 1, k] = target
        mirrors.append(v)
    return a.diagonal().copy(), a.diagonal(-1).copy(), mirrors


def counts_below(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix are smaller than each value (Sturm)."""
    least = np.finfo(float).tiny / _EPS
    squares = off * off
    q = diagonal[0] - values
    n = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[i] - values - squares[i - 1] / q
        n += q < 0
    return n


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each halved down to neighbouring doubles or to the rounding of the norm."""
    around = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    norm = max(np.max(np.abs(diagonal) + around), np.finfo(float).tiny)
    lo, hi = np.full(k, np.min(diagonal - around) - norm * _EPS), np.full(k, np.max(diagonal + around) + norm * _EPS)
    place = len(diagonal) - 1 - np.arange(k)
    for _ in range(200):
        mid = (lo + hi) / 2
        if np.all((mid <= lo) | (mid >= hi) | (hi - lo <= _EPS * norm * 0.25)):
            break
        up = counts_below(diagonal, off, mid) <= place
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2


def solve_tridiagonal(diagonal: np.ndarray, off: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Solves by elimination with row exchanges; pivots below `least` are raised to it."""
    n = len(diagonal)
    a, b, c, x = diagonal.tolist(), [*off.tolist(), 0.0], [0.0] * n, right.tolist()
    low = off.tolist()
    for i in range(n - 1):
        if abs(low[i]) > abs(a[i]):
            f, a[i] = a[i] / low[i], low[i]
            b[i], a[i + 1] = a[i + 1], b[i] - f * a[i + 1]
            if i + 1 < n - 1:
                c[i], b[i + 1] = b[i + 1], -f * b[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
        else:
            if abs(a[i]) < least:
                a[i] = least
            f = low[i] / a[i]
            a[i + 1] -= f * b[i]
            x[i + 1] -= f * x[i]
    for i in reversed(range(n)):
        if abs(a[i]) < least:
            a[i] = least
        x[i] = (x[i] - (b[i] * x[i + 1] if i + 1 < n else 0) - (c[i] * x[i + 2] if i + 2 < n else 0)) / a[i]
    return np.array(x)


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) of falling eigenvalues by inverse iteration."""
    norm = max(np.max(np.abs(diagonal)), np.max(np.abs(off), initial=0), np.finfo(float).tiny)
    found, rng, first, last = [], np.random.default_rng(1), 0, None
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first, last = j, None
        at = value if last is None else min(value, last - 4 * _EPS * norm)  # equal eigenvalues are parted by a hair
        last = at
        y = rng.standard_normal(len(diagonal))
        for _ in range(5):
            y = solve_tridiagonal(diagonal - at, off, y / np.linalg.norm(y), _EPS * norm)
            y /= np.max(np.abs(y))
            for _ in range(2):
                for other in found[first:j]:
                    y -= (other @ y) * other
            y /= np.linalg.norm(y)
        found.append(y)
    return np.array(found).reshape(len(values), len(diagonal))


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, falling, and their unit eigenvectors as rows (their largest entry is positive); those of mere rounding are left out."""
    d = len(covariance)
    scale = np.max(np.abs(covariance), initial=0)
    if not scale:
        return np.zeros(0), np.zeros((0, d))
    diagonal, off, mirrors = householder(covariance / scale)
    values = leading_values(diagonal, off, min(k, d))
    values = values[values > d * 8 * _EPS * values[0]]
    vectors = leading_vectors(diagonal, off, values)
    for at, v in reversed(list(enumerate(mirrors))):
        part = vectors[:, at + 1 :]
        part -= 2 * np.outer(part @ v, v)
    vectors *= np.sign(vectors[np.arange(len(vectors)), np.argmax(np.abs(vectors), axis=1)])[:, None]
    return values * scale, vectors


@dataclass
class Whitening:
    """n and the exact sums of the fit list, its leading components and what they explain."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: less its whole part as integers, then less the rest."""
        floor, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return (x - np.array(floor)).astype(float) - np.array([r / self.n for r in rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S) ** 2."""
        floor, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        x = x - np.array(floor)
        most = self.n * (int(np.max(np.abs(x), initial=0)) + 1)
        if most * most * len(self.sums) < 1 << 63:
            return pa.array(np.sum((self.n * x - np.array(rest)) ** 2, axis=1))
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in x.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _integers(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    good, matrix = whole(column, d)
    return good, floored(matrix, SCALE, 1 << 52) + SHIFT


def _of_bytes(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<i8").reshape(-1, d)


def fit_list(vectors: DataFrame, d: int) -> DataFrame:
    """x: the bytes of each distinct vector of integers."""

    def run(batches):
        for batch in batches:
            for step in in_steps(batch, STEP):
                x = _integers(step.column(0), d)[1].astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row.tobytes() for row in x], pa.binary())], names=["x"])

    return bounded(vectors.select("embedding")).mapInArrow(run, "x binary").distinct()


def fit(fit_rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a written fit list; None if it is empty."""

    def sums(batch):
        x = _of_bytes(batch, d)
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    total = summed(fit_rows, sums, "long")
    n = int(total.get(0, 0))
    if not n:
        return None
    of = [(int(total.get(1 + i, 0)) << 32) + int(total.get(1 + d + i, 0)) for i in range(d)]
    found = Whitening(n, of, np.zeros(0), np.zeros((0, d)), np.zeros(0))

    def products(batch):
        x = found.centred(_of_bytes(batch, d))
        return (x.T @ x).ravel()

    covariance = np.zeros(d * d)
    for place, v in summed(fit_rows, products).items():
        covariance[place] = v / n
    covariance = covariance.reshape(d, d)
    covariance = (covariance + covariance.T) / 2
    values, found.vectors = leading_components(covariance, components)
    found.values, found.explained = values, values / max(np.trace(covariance), np.finfo(float).tiny)
    k = len(values)

    def whitened(batch):
        w = found.project(_of_bytes(batch, d))
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    if k:
        again = np.zeros(k + k * k)
        for place, v in summed(fit_rows, whitened).items():
            again[place] = v / n
        mean = again[:k]
        found.identity_error = float(np.max(np.abs(again[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k))))
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per row with a whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.  vectors: vec_id and embedding."""
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), *[T.StructField(c, T.IntegerType() if c == "component" else T.LongType() if c in ("n", "deviation") else T.DoubleType()) for c in ("component", "n", "deviation", "whitened", "explained", "identity_error")]])
    d = dimension(vectors)
    found = fit(written(fit_list(vectors, d), "fit"), d, components) if d else None
    if found is None or not len(found.values):
        return spark.createDataFrame([], schema)
    k = len(found.values)

    def run(batches):
        for batch in batches:
            for step in in_steps(batch, STEP):
                good, x = _integers(step.column(1), d)
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                made = [
                    step.column(0).filter(pa.array(good)).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n)),
                    found.deviation(x).take(each),
                    pa.array(found.project(x).ravel()),
                    pa.array(np.tile(found.explained, m)),
                    pa.array(np.full(m * k, found.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return bounded(vectors.select("vec_id", "embedding")).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
