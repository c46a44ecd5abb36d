"""Whitening of vectors by an incremental eigendecomposition."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: x = floor(GRID * entry) + SHIFT.
GRID, SHIFT = 64, 1_000_000
#: Spectra that one task combines.
FAN = 8
#: From this size on a whole number needs no floor, and a double has no room for the grid.
LARGEST = 2.0**46
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', for strictly rising ``d``, positive ``z2`` (squares of z) and ``rho``.

    Each lies between its d and the next one. Returned are the eigenvalues and the matrix of their distances to every
    d, each taken from the nearer end of its interval, so that small distances keep their digits.
    """
    n = len(d)
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    middle = (d + upper) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        at_middle = 1 / rho + (z2 / (d[None, :] - middle[:, None])).sum(1)
    near_left = at_middle >= 0
    near_left[-1] = True
    origin = np.where(near_left, d, upper)
    poles = d[None, :] - origin[:, None]
    left, right = d - origin, upper - origin
    low, high = np.where(near_left, 0.0, left / 2), np.where(near_left, right / 2, 0.0)
    high[-1] = right[-1]
    tau = (low + high) / 2
    below = np.tri(n, dtype=bool)
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            apart = poles - tau[:, None]
            terms = z2 / apart
            f = 1 / rho + terms.sum(1)
            slopes = terms / apart
            slope_left = np.where(below, slopes, 0).sum(1)
            slope_right = slopes.sum(1) - slope_left
            low, high = np.where(f <= 0, np.maximum(low, tau), low), np.where(f > 0, np.minimum(high, tau), high)
            done = np.abs(f) <= 4 * _EPS * (1 / rho + np.abs(terms).sum(1))
            done |= high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high))
            if done.all():
                break
            # the function as constant and two poles, those next to the root
            a, b = left - tau, right - tau
            p, q, c = (a + b) * f - a * b * (slope_left + slope_right), a * b * f, f - a * slope_left - b * slope_right
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            new = tau + step
        fine = np.isfinite(new) & (new > low) & (new < high)
        tau = np.where(done, tau, np.where(fine, new, (low + high) / 2))
    return origin + tau, tau[:, None] - poles


@dataclass
class Spectrum:
    """Rows seen, their mean, and the eigenpairs of their scatter (ascending; only the span they reach)."""

    count: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dimension: int) -> Spectrum:
        return cls(0, np.zeros(dimension), np.zeros(0), np.zeros((dimension, 0)))

    def add(self, x: np.ndarray) -> None:
        """One more row: the scatter grows by the centred row's square times count / (count + 1)."""
        gap = x - self.mean
        self.update(gap * math.sqrt(self.count / (self.count + 1)))
        self.count += 1
        self.mean = self.mean + gap / self.count

    def merge(self, other: Spectrum) -> None:
        """The rows of both: the other's eigenpairs and the gap of the means, each a rank-one update."""
        if not other.count:
            return
        total = self.count + other.count
        gap = other.mean - self.mean
        if self.count:
            self.update(gap * math.sqrt(self.count * (other.count / total)))
        for value, vector in zip(other.values, other.vectors.T):
            self.update(vector * math.sqrt(max(value, 0)))
        self.mean = self.mean + gap * (other.count / total)
        self.count = total

    def update(self, v: np.ndarray) -> None:
        """Eigenpairs of scatter + v v'."""
        size = math.sqrt(v @ v)
        if not size:
            return
        z = self.vectors.T @ v
        rest = v - self.vectors @ z
        again = self.vectors.T @ rest
        z, rest = z + again, rest - self.vectors @ again
        beyond = math.sqrt(rest @ rest)
        if beyond > 16 * _EPS * size and len(self.values) < len(v):  # a direction not seen before, without variance yet
            self.vectors = np.column_stack((rest / beyond, self.vectors))
            self.values = np.append(0.0, self.values)
            z = np.append(beyond, z)
        rho = z @ z
        if not rho:
            return
        self._solve(z / math.sqrt(rho), rho)

    def _solve(self, z: np.ndarray, rho: float) -> None:
        order = np.argsort(self.values, kind="stable")
        d, z, q = np.maximum(self.values[order], 0), z[order], self.vectors[:, order]
        small = 8 * _EPS * max(d[-1], rho)
        # deflation: a direction that v hardly has keeps its pair; of two equal values one direction is turned away from v
        moved = rho * np.abs(z) > small
        kept = np.flatnonzero(moved)
        if len(kept) > 1 and np.diff(d[kept]).min() <= 2 * small:
            last = kept[0]
            for i in kept[1:]:
                length = math.hypot(z[last], z[i])
                c, s = z[i] / length, z[last] / length
                if abs((d[i] - d[last]) * c * s) <= small:
                    q[:, last], q[:, i] = c * q[:, last] - s * q[:, i], s * q[:, last] + c * q[:, i]
                    d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
                    z[last], z[i], moved[last] = 0.0, length, False
                last = i
            kept = np.flatnonzero(moved)
            kept = kept[np.argsort(d[kept], kind="stable")]
        if len(kept):
            values, distances = secular_roots(d[kept], z[kept] ** 2, rho)
            q[:, kept] = q[:, kept] @ _vectors(d[kept], z[kept], distances)
            d[kept] = values
        self.values, self.vectors = d, q


def _vectors(d: np.ndarray, z: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, from the z that has the computed roots for its exact ones: these are orthogonal."""
    gaps = d[:, None] - d[None, :]
    np.fill_diagonal(gaps, 1.0)
    exact = np.sqrt(np.abs((distances / gaps).prod(0)))
    exact = np.where(z < 0, -exact, exact)
    columns = (exact / distances).T
    return columns / np.linalg.norm(columns, axis=0)


def grid(vector: str | Column) -> Column:
    """The vector as whole numbers, null where an entry is null, not finite, or of 2^46 and more."""
    column = F.col(vector) if isinstance(vector, str) else vector
    numbers = F.transform(column, lambda c: c.cast("double"))
    fine = F.forall(numbers, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False)))
    return F.when(fine, F.transform(numbers, lambda c: F.floor(c * GRID) + SHIFT))


def _matrix(batch: pa.RecordBatch, column: int, dimension: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


@dataclass
class Fit:
    """The fit list, its size and sums, and its components by falling eigenvalue."""

    rows: DataFrame
    dimension: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _whole(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: as Python's numbers where 64 bits could overflow."""
    if len(x) and max(n * (int(np.abs(x).max()) + 1), *map(abs, sums)) >= 1 << 62:
        return x.astype(object) * n - np.array(sums, object)
    return x * np.int64(n) - np.array(sums, np.int64)


def _sum_of(rows: DataFrame, outer, dimension: int) -> np.ndarray:
    """Sums of the matrices that ``outer`` makes of blocks of rows: each task adds its own, Spark adds the tasks'
    entry by entry. ``dimension`` squared numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            total += outer(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    sums = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    out = np.zeros(dimension * dimension)
    for r in sums.collect():
        out[r["at"]] = r["value"]
    return out.reshape(dimension, dimension)


def spectrum(rows: DataFrame, dimension: int) -> Spectrum | None:
    """Spectrum of all ``rows (x)``: each task takes its own up row by row, and ``FAN`` spectra at a time are combined
    until one is left. A spectrum is ``dimension`` squared numbers."""
    schema = "part long, n long, mean array<double>, values array<double>, vectors array<double>"

    def row(part: int, s: Spectrum) -> pa.RecordBatch:
        arrays = [[part], [s.count], [s.mean.tolist()], [s.values.tolist()], [s.vectors.ravel().tolist()]]
        kinds = [pa.int64()] * 2 + [pa.list_(pa.float64())] * 3
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds)], names=["part", "n", "mean", "values", "vectors"])

    def back(r: dict) -> Spectrum:
        return Spectrum(r["n"], np.array(r["mean"]), np.array(r["values"]), np.array(r["vectors"]).reshape(dimension, -1))

    def take_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(dimension)
        for batch in batches:
            for x in _matrix(batch, 0, dimension) - SHIFT:
                own.add(x.astype(float))
        if own.count:
            yield row(TaskContext.get().partitionId(), own)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if group is not None and r["part"] // FAN != group:
                    yield row(group, own)
                    own = None
                if own is None:
                    own, group = back(r), r["part"] // FAN
                else:
                    own.merge(back(r))
        if own is not None:
            yield row(group, own)

    found = stored(rows.mapInArrow(take_up, schema))
    while (parts := found.agg(F.max("part")).first()[0]) is not None:
        if parts == 0 and found.count() == 1:
            return back(found.first().asDict())
        groups = int(parts) // FAN + 1
        dealt = found.repartition(groups, F.floor(F.col("part") / FAN)).sortWithinPartitions("part")
        found = stored(dealt.mapInArrow(combine, schema))
    return None


def fit(vectors: DataFrame, vector: str = "embedding") -> Fit | None:
    """Components of the distinct whole-number vectors; None if there is no vector with entries.

    Vectors of the most frequent length (of the shortest such) count, others are left out. The spectrum that the
    tasks' updates lead to gives a basis; the covariance in that basis is summed up again over all rows, centred
    exactly, and its eigenvectors turn the basis, so no error of the updates is left. Matrices of the dimension's
    square pass through the driver, no rows.
    """
    spark = vectors.sparkSession
    x = vectors.select(grid(vector).alias("x")).filter("x is not null and size(x) > 0")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(x.distinct().repartition(shuffles, "x"))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    dimension, n = lengths
    rows = rows.filter(F.size("x") == dimension)
    entries = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")))
    sums = [int(s) for _, s in sorted(map(tuple, entries.collect()))]

    basis = np.linalg.qr(spectrum(rows, dimension).vectors[:, ::-1])[0]
    if basis.shape[1] < dimension:  # the rest of the space, without variance
        basis = np.linalg.qr(np.column_stack((basis, np.eye(dimension))))[0][:, :dimension]
    centred = _centring(n, sums)

    def outer(batch: pa.RecordBatch) -> np.ndarray:
        y = centred(_matrix(batch, 0, dimension)) @ basis
        return y.T @ y

    small = _sum_of(rows, outer, dimension) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return Fit(rows, dimension, n, sums, np.maximum(values[::-1], 0), basis @ turn[:, ::-1], float(np.trace(small)))


def _centring(n: int, sums: list[int]):
    """``x - S / n`` with one rounding: whole numbers are centred, then divided."""
    return lambda x: _whole(x, n, sums).astype(float) / n


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)``: a row for each vector and component.

    Entries become ``floor(64 * entry) + 1000000``. Rows whose vector is null, empty, or holds a null or non-finite
    entry or one of 2^46 and more are dropped, and so are those of another length than the most frequent one.
    Components come from each distinct vector once and are numbered from 1 by falling eigenvalue; there are as many as
    the dimension at most. A component without variance (up to rounding) has null ``whitened`` and takes no part in
    ``identity_error``, which is null if none has any; ``explained`` is null if the trace is zero. ``deviation`` is
    exact, null where it does not fit in a long. Repeated rows and ids stay; other columns are not read.
    """
    kind = vectors.schema[id].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vector)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id)
    dimension, n, sums, trace = model.dimension, model.n, model.sums, model.trace
    k = min(components, dimension)
    values, turn, centred = model.values[:k], model.vectors[:, :k], _centring(n, sums)
    varied = values > dimension * _EPS * max(values[0], 0)
    scale = np.where(varied, 1 / np.sqrt(np.where(varied, values, 1)), 0)

    def outer(batch: pa.RecordBatch) -> np.ndarray:
        w = (centred(_matrix(batch, 0, dimension)) @ turn) * scale
        return w.T @ w

    error = None
    if varied.any():
        error = float(np.abs(_sum_of(model.rows, outer, k) / n - np.eye(k))[varied][:, varied].max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 1, dimension)
            rows = len(x)
            whole = _whole(x, n, sums)
            if rows and whole.dtype != object and dimension * float(np.abs(whole).max()) ** 2 < 2.0**62:
                deviation = pa.array((whole * whole).sum(1))
            else:
                exact = [sum(int(v) ** 2 for v in row) for row in whole]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            w = ((whole.astype(float) / n) @ turn) * scale
            at = pa.array(np.repeat(np.arange(rows), k))
            hidden = np.tile(~varied, rows)
            share = np.tile(values / trace if trace else np.zeros(k), rows)
            columns = [
                batch.column(0).take(at),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, n)),
                deviation.take(at),
                pa.array(w.ravel(), mask=hidden),
                pa.array(share, mask=np.full(rows * k, not trace)),
                pa.array([error] * (rows * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col(id).alias("id"), grid(vector).alias("x")).filter(F.size("x") == dimension)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)
