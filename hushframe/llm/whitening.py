"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Spark adds up what the fit needs: sums, then the scatter of the centred vectors (never the vectors
themselves reach the driver, only dimension x dimension numbers, each task's added up before the
shuffle). The scatter is factored with diagonal pivoting, P'AP = LL', and Jacobi rotations are
applied to the columns of L directly until these are orthogonal: their squared norms are the
eigenvalues of the scatter, the normalised columns its eigenvectors. The scatter is never squared
or reduced further, so that small eigenvalues keep their digits.

Vectors are taken as whole numbers x = floor(64 c) + 1000000. Their mean is split into its whole
part, which is subtracted exactly, and a fraction, so that nothing is lost by the offset.

Defined results: rows whose vector is null, holds a null or a number that is not finite, or has
another length than most vectors, are left out. A component without variance (beyond the rank of
the data) has no scale: ``whitened`` is null there and ``explained`` 0. Components of equal
eigenvalue are numbered in the order of their first entries. Numbers beyond 2^52 in size stay at
that; a deviation beyond a long is null. Equal rows count as often as they are there. Without
vectors there are no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import dimension, matrix, usable

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
WIDEST = float(1 << 52)
LONGEST = (1 << 63) - 1
#: Sweeps after which Jacobi has long converged (it does so quadratically, in less than ten).
SWEEPS = 60
#: Rows that are worked on together.
ROWS = 8192


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    return (np.clip(np.floor(SCALE * vectors), -WIDEST, WIDEST)).astype(np.int64) + OFFSET


@dataclass
class Mean:
    """Sums of n vectors of whole numbers, exact."""

    n: int
    sums: list[int]

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.float64) / self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part exactly, then the fraction."""
        return (x - self.floor) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum over dimensions of (n*x - S)^2, exact; null beyond a long."""
        # n*x - S = n*(x - floor) - remainder, which is small although n*x is not.
        apart, rest = x - self.floor, np.array([s % self.n for s in self.sums], np.int64)
        top = (int(np.abs(apart).max()) + 1) * self.n if apart.size else 0
        if top * top * x.shape[1] <= LONGEST:
            scaled = apart * self.n - rest
            return (scaled * scaled).sum(axis=1).tolist()
        exact = [sum((int(a) * self.n - int(r)) ** 2 for a, r in zip(row, rest, strict=True)) for row in apart]
        return [e if e <= LONGEST else None for e in exact]


def _groups(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, whole_numbers(matrix(part.column(column), d))


def summed(rows: DataFrame, vector: str, d: int) -> Mean | None:
    """Number and exact sums of the vectors, each task's added up before the shuffle; None if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in _groups(batches, 0, d):
            n += len(x)
            wide = np.abs(x).max() > 1 << 40
            total = [a + int(b) for a, b in zip(total, (x.astype(object) if wide else x).sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(t) for t in total]), pa.array([n] * d, pa.int64())], ["at", "total", "n"])

    found = rows.select(vector).mapInArrow(run, "at int, total string, n long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    if not found:
        return None
    return Mean(found[0]["n"], [int(r["total"]) for r in sorted(found, key=lambda r: r["at"])])


def scatter(rows: DataFrame, vector: str, mean: Mean, turn: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of the centred vectors, or of these turned by a matrix: one row of numbers a task is shuffled, dimension x dimension in all reach the driver."""
    d = len(mean.sums)
    k = d if turn is None else turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((k, k)), False
        for _, x in _groups(batches, 0, d):
            seen, c = True, mean.centred(x)
            c = c if turn is None else c @ turn
            total += c.T @ c
        if seen:
            for i in range(k):
                yield pa.RecordBatch.from_arrays([pa.array([i] * (i + 1), pa.int32()), pa.array(range(i + 1), pa.int32()), pa.array(total[i, : i + 1])], ["i", "j", "x"])

    out = np.zeros((k, k))
    for r in rows.select(vector).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow().to_pylist():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["x"]
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(L, order)`` with a[order][:, order] = LL', L lower trapezoidal with as many columns as ``a`` has rank, its diagonal falling."""
    a, n = a.copy(), len(a)
    order, factor, rank = np.arange(n), np.zeros((n, n)), 0
    rest = np.diagonal(a).copy()
    least = n * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    while rank < n:
        p = rank + int(rest[rank:].argmax())
        if rest[p] <= least:
            break
        swap = [rank, p], [p, rank]
        order[swap[0]], rest[swap[0]], factor[swap[0]] = order[swap[1]], rest[swap[1]], factor[swap[1]]
        a[swap[0]] = a[swap[1]]
        a[:, swap[0]] = a[:, swap[1]]
        factor[rank, rank] = np.sqrt(rest[rank])
        below = slice(rank + 1, n)
        factor[below, rank] = (a[below, rank] - factor[below, :rank] @ factor[rank, :rank]) / factor[rank, rank]
        rest[below] -= factor[below, rank] ** 2
        rank += 1
    return factor[:, :rank], order


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """``factor`` with its columns rotated in pairs until all are orthogonal to working precision."""
    columns, k = np.ascontiguousarray(factor.T), factor.shape[1]
    tiny = np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for i in range(k - 1):
            for j in range(i + 1, k):
                x, y = columns[i], columns[j]
                a, b, c = x @ x, y @ y, x @ y
                if abs(c) <= tiny * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                columns[i], columns[j] = cos * (x - t * y), cos * (t * x + y)
        if not turned:
            break
    return columns.T


def principal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a scatter, falling, and its unit eigenvectors as columns, as many as its rank; each vector's largest entry is positive."""
    factor, order = pivoted_cholesky(a)
    rotated = one_sided_jacobi(factor)
    values = (rotated**2).sum(axis=0)
    vectors = np.empty_like(rotated)
    vectors[order] = rotated / np.sqrt(values)
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    falling = sorted(range(len(values)), key=lambda i: (-values[i], tuple(vectors[:, i])))
    return values[falling], vectors[:, falling]


@dataclass
class Whitening:
    mean: Mean
    values: np.ndarray  #: eigenvalues of the covariance, falling
    turn: np.ndarray  #: eigenvectors as columns, each over the root of its eigenvalue
    explained: np.ndarray
    identity_error: float


def fitted(rows: DataFrame, vector: str, d: int, components: int) -> Whitening | None:
    """The whitening of ``rows``, in three passes: sums, scatter, and the covariance of what comes out."""
    mean = summed(rows, vector, d)
    if mean is None:
        return None
    covariance = scatter(rows, vector, mean) / mean.n
    values, vectors = principal(covariance)
    values, vectors = values[:components], vectors[:, :components]
    turn = vectors / np.sqrt(values)
    trace = float(np.trace(covariance))
    error = np.abs(scatter(rows, vector, mean, turn) / mean.n - np.eye(len(values))).max(initial=0.0)
    return Whitening(mean, values, turn, values / trace if trace else values, float(error))


def whiten(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id_, component, n, deviation, whitened, explained, identity_error``, a row for each usable vector and component."""
    d = dimension(vectors, vector)
    rows = usable(vectors.select(id_, vector), vector, d)
    kind = rows.schema[id_].dataType.simpleString()
    fit = fitted(rows, vector, d, components) if d else None
    k = min(components, d)
    if fit is None:
        none = {c: F.lit(0).cast(t) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))}
        return rows.limit(0).select(id_).withColumns(none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _groups(batches, 1, d):
            white = (fit.mean.centred(x) @ fit.turn).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * fit.turn.shape[1]), pa.array(white))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fit.mean.deviation(x), pa.int64()), lists], ["id", "deviation", "white"])

    done = rows.mapInArrow(run, f"id {kind}, deviation long, white array<double>")
    each = done.select("id", "deviation", "white", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("component"))
    explained = F.coalesce(F.get(F.array(*[F.lit(float(e)) for e in fit.explained]).cast("array<double>"), F.col("component") - 1), F.lit(0.0))
    return each.select(F.col("id").alias(id_), "component", F.lit(fit.mean.n).cast("long").alias("n"), "deviation", F.get("white", F.col("component") - 1).alias("whitened"), explained.alias("explained"), F.lit(fit.identity_error).alias("identity_error"))
