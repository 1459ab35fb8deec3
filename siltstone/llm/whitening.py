"""Embedding whitening: Welford updates in partitions, merged in a tree, and a symmetric QR eigen-solve.

A partition reads its vectors as a stream and updates count, mean and the matrix of
co-moments by one rank-one update a vector, so values far from zero lose no digits. Partial
states meet by the parallel update formula, ``FAN`` of them a task, in as many levels as it
takes; only the last one, a matrix of the dimension squared, reaches the driver. There it is
made tridiagonal by Householder reflections and diagonal by QR steps with Wilkinson shifts.
Whitening itself is one narrow pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm.shared import materialise, require

#: Steps of a component in a unit, what is added to each, and components returned.
STEPS, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Partial states that one task merges.
FAN = 32
STATE = "part long, n long, sums array<long>, mean array<double>, moments array<double>"


class Moments:
    """Count, exact sums (of whole numbers), mean and co-moments of the vectors seen."""

    def __init__(self, n: int = 0, sums: np.ndarray | None = None, mean: np.ndarray | None = None, moments: np.ndarray | None = None):
        self.n, self.sums, self.mean, self.moments = n, sums, mean, moments

    def add(self, x: np.ndarray) -> None:
        """Welford's update by one vector."""
        if self.mean is None:
            self.sums, self.mean, self.moments = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros((len(x), len(x)))
        if len(x) != len(self.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(x)} components")
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        self.moments += before[:, None] * (before * ((self.n - 1) / self.n))

    def merge(self, other: "Moments") -> None:
        """The parallel update formula."""
        if not other.n:
            return
        if not self.n:
            self.n, self.sums, self.mean, self.moments = other.n, other.sums, other.mean, other.moments
            return
        if len(other.mean) != len(self.mean):
            raise ValueError(f"vectors of {len(self.mean)} and of {len(other.mean)} components")
        n, apart = self.n + other.n, other.mean - self.mean
        self.moments = self.moments + other.moments + np.outer(apart, apart) * (self.n * other.n / n)
        self.mean = self.mean + apart * (other.n / n)
        self.sums = self.sums + other.sums
        self.n = n

    def covariance(self) -> np.ndarray:
        return (self.moments + self.moments.T) / (2 * self.n)


def _row(part: int, m: Moments) -> pa.RecordBatch:
    held = [] if m.n == 0 else [(part, m.n, m.sums.tolist(), m.mean.tolist(), m.moments.ravel().tolist())]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    columns = list(zip(*held)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["part", "n", "sums", "mean", "moments"])


def vectors(column: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a list column without nulls, as doubles."""
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b].astype(np.float64)


def moments(rows: DataFrame, whole: bool) -> Moments:
    """Moments of the only column of ``rows``, an array of doubles without nulls; sums are kept if the numbers are ``whole``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = Moments()
        for batch in batches:
            for x in vectors(batch.column(0)):
                state.add(x)
                if whole:
                    state.sums += x.astype(np.int64)
        yield _row(TaskContext.get().partitionId(), state)

    def meet(held: pa.Table) -> pa.Table:
        state, rows = Moments(), held.sort_by("part").to_pylist()  # at most FAN states
        for r in rows:
            d = len(r["mean"])
            state.merge(Moments(r["n"], np.array(r["sums"], np.int64), np.array(r["mean"]), np.array(r["moments"]).reshape(d, d)))
        return pa.Table.from_batches([_row(rows[0]["part"] // FAN, state)])

    parts = materialise(rows.mapInArrow(fold, STATE), "white-moments")
    left = parts.count()
    while left > 1:
        parts = materialise(parts.groupBy(F.expr(f"part div {FAN}")).applyInArrow(meet, STATE), "white-moments")
        left = parts.count()
    last = parts.first()
    if last is None:
        return Moments()
    d = len(last["mean"])
    return Moments(last["n"], np.array(last["sums"], np.int64), np.array(last["mean"]), np.array(last["moments"]).reshape(d, d))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q) with a = q t q', by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        x[0] += math.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by QR steps with Wilkinson shifts."""
    d, e, q = tridiagonal(a)
    q, end = np.ascontiguousarray(q.T), len(d) - 1  # rows are vectors
    tiny = np.finfo(float).eps
    while end > 0:
        small = np.abs(e[:end]) <= tiny * (np.abs(d[:end]) + np.abs(d[1 : end + 1]))
        e[:end][small] = 0
        if e[end - 1] == 0:
            end -= 1
            continue
        start = end - 1
        while start > 0 and e[start - 1] != 0:
            start -= 1
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + math.copysign(math.hypot(half, e[end - 1]), half))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):  # chase the bulge down
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            low, high, off = d[k], d[k + 1], e[k]
            d[k] = c * c * low + 2 * c * s * off + s * s * high
            d[k + 1] = s * s * low - 2 * c * s * off + c * c * high
            e[k] = c * s * (high - low) + (c * c - s * s) * off
            x = e[k]
            if k < end - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            first = q[k].copy()
            q[k] = c * first + s * q[k + 1]
            q[k + 1] = c * q[k + 1] - s * first
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(column).isNotNull() & F.forall(column, lambda x: F.coalesce(fine(x), F.lit(False)))


def fits(apart: np.ndarray, near: np.ndarray) -> bool:
    """Whether the sum of squares of each row fits a long; near: about the same numbers, as doubles, which do not wrap."""
    if np.abs(near).max(initial=0) >= 2**62:
        return False
    size = np.square(apart.astype(np.float64)).sum(axis=1)
    if size.max(initial=0) >= 2**63 * (1 + 1e-9):
        return False
    return all(sum(a * a for a in row) < 2**63 for row in apart[size >= 2**63 * (1 - 1e-9)].tolist())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Vectors that are null or hold a null or non-finite entry are dropped; the others must
    have one length. All of them are the fit list, repeated rows as often as they stand. A
    component without variance (an eigenvalue of at most 1e-13 of the largest, as with equal
    vectors) has a null ``whitened`` and is left out of ``identity_error``, which is 0 where
    no component is left; ``explained`` is null if no component has variance. Null and
    repeated vec_ids are rows of their own; extra columns are ignored. An empty table, or one
    of empty vectors, gives an empty one. Equal eigenvalues leave the choice of components
    free. ``deviation`` is exact and must fit a long, by its own value: with unit vectors it
    does up to some 2.8 million of them, and beyond the job fails and says so.
    """
    require(embeddings, ["vec_id", "embedding"])
    kept = embeddings.where(usable()).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * STEPS) + SHIFT).alias("x"))
    fit = moments(kept.select(F.col("x").cast("array<double>").alias("x")), True)
    d = 0 if fit.mean is None else len(fit.mean)
    count = min(components, d)
    kind = f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double"
    if not count:
        return embeddings.sparkSession.createDataFrame([], f"{kind}, explained double, identity_error double")
    values, vecs = symmetric_qr(fit.covariance())
    real = values[:count] > max(values[0], 0) * 1e-13
    scale = np.where(real, 1 / np.sqrt(np.where(real, values[:count], 1)), np.nan)
    shared = embeddings.sparkSession.sparkContext.broadcast((fit.n, fit.sums, fit.mean, vecs[:, :count] * scale))  # dimension x components

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, axes = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = batch.column(1).flatten().to_numpy().reshape(len(batch), len(sums))
            apart = x * n - sums  # right if it fits a long, as steps between may wrap
            if not fits(apart, (x - mean) * n):
                raise OverflowError(f"the deviation of a vector among {n} does not fit a long")
            white = (apart / n) @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((apart * apart).sum(axis=1)), pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "white"])

    white = kept.mapInArrow(project, f"vec_id {kind.split(',')[0].split()[1]}, deviation long, white array<double>")
    error = 0.0
    if real.any():
        good = [int(i) + 1 for i in np.flatnonzero(real)]
        again = moments(white.select(F.array(*(F.element_at("white", i) for i in good)).alias("x")), False)
        error = float(np.abs(again.covariance() - np.eye(len(good))).max())
    trace = float(values.sum())
    explained = F.element_at(F.array(*(F.lit(float(v / trace) if real.any() else None).cast("double") for v in values[:count])), F.col("component"))
    rows = white.select("vec_id", "deviation", F.posexplode("white").alias("component", "whitened")).withColumn("component", F.col("component") + 1)
    return rows.select("vec_id", F.col("component").cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", F.nanvl("whitened", F.lit(None).cast("double")).alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"))
