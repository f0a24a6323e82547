"""Operator 11: embedding whitening by FEAST contour integration.

Two passes over the vectors give the exact sums of the whole numbers x and the covariance of x, centred before it is
multiplied; each task adds up one matrix and Spark adds the tasks' matrices row by row. What then meets on the driver is
one matrix of dimension x dimension, whatever the number of vectors. Its largest eigenvalues are searched there: inertia
counts (an LDL' factorisation of V - t I has as many positive pivots as V has eigenvalues above t) cut the spectrum into
intervals of few eigenvalues; for each interval a circle around it is integrated by Gauss-Legendre quadrature of complex
shifted solves (z I - V)^-1 Y, which projects onto the eigenvectors inside; Rayleigh-Ritz extracts them, and the projection
is repeated until the residuals are those of rounding. The number found is held against the inertia counts, so none is
missed. A last pass projects the vectors and keeps the results in the shared folder; the covariance of the whitened values
is counted from there.

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out; so are vectors whose length
is not that of most vectors (of the larger length, if equally many); equal and repeated rows are rows like any other, a
null id included; components whose eigenvalue is nothing but rounding (equal vectors, fewer vectors than dimensions) are
left out, so a single vector gives no rows; equal eigenvalues give any orthogonal components of their space; columns beyond
the id and the vector are ignored, whatever their names; an empty table gives an empty result. Entries are meant to be
below 2^40 in size, so that x and its sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transloom.llm.common import small_batches, written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Quadrature points on a half circle, eigenvalues of an interval at most, projections at most.
POINTS, IN_INTERVAL, ROUNDS = 8, 4, 40
#: Eigenvalues below this share of the trace are rounding.
LEAST_SHARE = 1e-12
#: Two doubles of a digit each hold a sum exactly while it is multiplied.
_HALF = 1 << 32


def positive(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: the signs of the pivots of LDL' with pivots of one or two rows."""
    a, count = a.copy(), 0
    least = np.finfo(float).eps * max(1e-300, float(np.abs(a).max(initial=0.0)))
    while len(a):
        n = len(a)
        d = int(np.abs(np.diag(a)).argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), n)
        if max(abs(a[d, d]), off[i, j]) <= least:
            break  # what is left is zero
        rows = [d] if abs(a[d, d]) >= 0.64 * off[i, j] else [i, j]
        rest = np.setdiff1d(np.arange(n), rows)
        pivot = a[np.ix_(rows, rows)]
        count += int(a[d, d] > 0) if len(rows) == 1 else 1  # a pivot of two rows has one eigenvalue of each sign
        side = a[np.ix_(rest, rows)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        a = (a + a.T) / 2
    return count


def above(v: np.ndarray, at: float) -> int:
    """Eigenvalues of ``v`` that are larger than ``at``."""
    return positive(v - at * np.eye(len(v)))


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in between) from the top, together ``wanted`` eigenvalues or a few more; an interval holds
    IN_INTERVAL eigenvalues at most, or more that are the same in double precision."""
    top = float(np.abs(v).sum(axis=1).max()) * 1.001 + 1e-300  # no eigenvalue is larger
    out: list[tuple[float, float, int]] = []
    open_ = [(-top, top, len(v))]
    while open_ and sum(n for *_, n in out) < wanted:
        low, high, n = open_.pop()
        middle = (low + high) / 2
        if n and n <= IN_INTERVAL or high - low <= 1e-13 * top or not low < middle < high:
            out.append((low, high, n))
        elif n:
            upper = above(v, middle) - sum(m for *_, m in out)
            open_ += [(low, middle, n - upper), (middle, high, upper)]
    return [x for x in out if x[2]]


def feast(v: np.ndarray, low: float, high: float, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenvalues of ``v`` between ``low`` and ``high`` with their eigenvectors (columns)."""
    size, scale = len(v), float(np.abs(v).max())
    y = np.random.default_rng(seed).standard_normal((size, min(size, 2 * n + 4)))
    centre, radius = (low + high) / 2, max((high - low) / 2, 1e-9 * scale)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(0.5j * np.pi * (nodes + 1))  # upper half; the lower one is its conjugate
    shifted = [centre + radius * t for t in turn]
    values, vectors, before = np.empty(0), y, np.inf
    for _ in range(ROUNDS):
        projected = np.zeros_like(y)
        for z, w, t in zip(shifted, weights, turn, strict=True):
            projected += 0.5 * w * np.real(radius * t * np.linalg.solve(z * np.eye(size) - v, y))
        q, _ = np.linalg.qr(projected)
        values, ritz = np.linalg.eigh(q.T @ v @ q)
        y = q @ ritz
        # those nearest to the interval; the others of the subspace lie outside
        inside = np.sort(np.argsort(np.maximum(low - values, values - high))[:n])
        vectors = y[:, inside]
        error = float(np.abs(v @ vectors - vectors * values[inside]).max())
        if error <= 4 * np.finfo(float).eps * scale or error >= before / 2 and error <= 1e-12 * scale * size:
            break
        before = error
    return values[inside], vectors


def largest(v: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their eigenvectors as rows; an error if one were missed."""
    wanted = min(wanted, len(v))
    cuts = intervals(v, wanted)
    found = [feast(v, *cut, seed=i) for i, cut in enumerate(cuts)]
    q, _ = np.linalg.qr(np.concatenate([x for _, x in found], axis=1))
    values, ritz = np.linalg.eigh(q.T @ v @ q)  # orthogonal over all intervals
    slack = 1e-10 * float(np.abs(v).max())
    for low, high, n in cuts:
        if ((values >= low - slack) & (values <= high + slack)).sum() < n:
            raise ArithmeticError(f"{n} eigenvalues lie between {low} and {high}; not all were found")
    order = np.argsort(-values)[:wanted]
    return values[order], (q @ ritz[:, order]).T


def _vectors(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Column ``i`` (lists of one length, without nulls) as rows of whole numbers."""
    flat = batch.column(i).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.reshape(batch.num_rows, -1)).astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, exact sum of x in each dimension)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, 0).sum(axis=0)
                n, total = n + batch.num_rows, x if total is None else total + x
        if total is not None:
            places = np.arange(len(total) + 1) - 1  # place -1 has the number of rows
            yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(np.concatenate([[n], total]))], ["place", "x"])

    found = rows.select("v").mapInArrow(run, "place long, x long").groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    total = {r["place"]: int(r["x"]) for r in found.collect()}  # one row a dimension
    return total.pop(-1, 0), [total[i] for i in range(len(total))]


def _covariance(rows: DataFrame, n: int, mean: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if batch.num_rows:
                d = _vectors(batch, 0) - mean
                total += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean))), pa.array(list(total), pa.list_(pa.float64()))], ["line", "x"])

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(mean))
        for t in tables:
            total += t.column("x").flatten().to_numpy().reshape(t.num_rows, -1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total], pa.list_(pa.float64()))], ["line", "x"])

    parts = rows.select("v").mapInArrow(run, "line long, x array<double>")
    lines = {r["line"]: r["x"] for r in parts.groupBy("line").applyInArrow(add, "line long, x array<double>").collect()}
    v = np.array([lines[i] for i in range(len(mean))]) / n
    return (v + v.T) / 2


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error), a row for each vector and component."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
    most = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == most["length"])
    n, sums = _sums(rows)
    mean = np.array([float(s // n) + float(s % n) / n for s in sums])
    cov = _covariance(rows, n, mean)
    trace = float(np.trace(cov))
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, axes = largest(cov, components)
    real = values > LEAST_SHARE * trace
    values, axes = values[real], axes[real]
    project = (axes / np.sqrt(values)[:, None]).T
    high, low = (np.array(x, np.int64) for x in zip(*(divmod(s, _HALF) for s in sums), strict=True))
    squares = sum(s * s for s in sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, 1)
            # the sum of (n x - S)^2, multiplied out and exact
            own, by_high, by_low = (x * x).sum(axis=1).tolist(), (x @ high).tolist(), (x @ low).tolist()
            far = [Decimal(n * n * a - 2 * n * (h * _HALF + b) + squares) for a, h, b in zip(own, by_high, by_low, strict=True)]
            w = (x - mean) @ project
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    white = written(rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>"))
    m = len(values)
    error = float(np.abs(_covariance_of(white, n, m) - np.eye(m)).max())
    shares = F.array(*[F.lit(float(e / trace)) for e in values])
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"))


def _covariance_of(white: DataFrame, n: int, m: int) -> np.ndarray:
    """The covariance of the written whitened values, centred by their own mean."""
    w = [F.col("w")[i] for i in range(m)]
    mean = white.agg(*[F.sum(x) / n for x in w]).first()
    d = [x - F.lit(float(c)) for x, c in zip(w, mean, strict=True)]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    found = white.agg(*[F.sum(d[i] * d[j]) / n for i, j in pairs]).first()
    out = np.empty((m, m))
    for (i, j), x in zip(pairs, found, strict=True):
        out[i, j] = out[j, i] = x
    return out
