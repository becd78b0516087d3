"""Whitening of embeddings by cyclic Jacobi rotations.

Three passes over the vectors, each of which sends the driver an amount that depends on their dimensions only:

* per-dimension sums of whole numbers give an exact mean;
* a distributed scatter of the vectors, centred before they are multiplied: whole numbers, summed exactly, so neither the
  partitioning nor the order of rows changes a bit of the covariance;
* the driver turns the covariance by symmetric Jacobi rotations until its off-diagonal entries vanish against their own
  diagonals, which gives small eigenvalues to full relative accuracy, and sorts them. The whitening matrix, of at most
  MAX_DIM times the components asked for, goes to the tasks; a pass measures the covariance of what it makes.

Vectors are never gathered and no row meets another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: The covariance, its square root and the rotations live on the driver: 2,048 dimensions are 32 MB each.
MAX_DIM = 2048
#: |scale * c| below this, so that whole numbers and their sums over 2 ** 23 vectors of a partition stay in 63 bits.
LARGEST = 2.0**40
SWEEPS = 60
#: An eigenvalue this much smaller than the largest is rounding of a dependent dimension: it cannot be whitened.
LEAST = 1e-13
_EPS = float(np.finfo(float).eps)


def whole(column: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * c) + shift of each entry, c as double; null for vectors that are null or hold a null or non-finite entry."""
    v = F.transform(F.col(column), lambda c: c.cast("double"))
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(~odd, F.transform(v, lambda c: F.floor(c * scale).cast("long") + shift))


def _matrix(column: pa.Array, d: int, fill: int) -> np.ndarray:
    """Vectors as the rows of a matrix of d columns, shorter ones filled up."""
    size = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), d), fill, dtype=np.int64)
    out[np.arange(d)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _sums(vectors: DataFrame) -> DataFrame:
    """``dim, n, s, low, high`` for each dimension, and the number of vectors as dimension -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, low, high, rows = (np.zeros(0, np.int64) for _ in range(5))
        rows = 0
        for batch in batches:
            v = batch.column(0)
            d = int(np.diff(v.offsets.to_numpy()).max(initial=0))
            if d > MAX_DIM:
                raise ValueError(f"a vector of {d} dimensions: at most {MAX_DIM} are whitened")
            if d > len(s):
                more = d - len(s)
                n, s = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (n, s))
                low, high = np.concatenate([low, np.full(more, np.iinfo(np.int64).max)]), np.concatenate([high, np.full(more, np.iinfo(np.int64).min)])
            there = np.arange(d)[None, :] < np.diff(v.offsets.to_numpy())[:, None]
            x = _matrix(v, d, 0)
            n[:d] += there.sum(axis=0)
            s[:d] += x.sum(axis=0)
            low[:d] = np.minimum(low[:d], np.where(there, x, np.iinfo(np.int64).max).min(axis=0, initial=np.iinfo(np.int64).max))
            high[:d] = np.maximum(high[:d], np.where(there, x, np.iinfo(np.int64).min).max(axis=0, initial=np.iinfo(np.int64).min))
            rows += batch.num_rows
        dim = np.arange(-1, len(s), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(dim), *[pa.array(np.append(a, b)) for a, b in ((rows, n), (0, s), (0, low), (0, high))]], ["dim", "n", "s", "low", "high"])

    per = vectors.select("x").mapInArrow(run, "dim int, n bigint, s bigint, low bigint, high bigint")
    return per.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))


def _scatter(vectors: DataFrame, mean: np.ndarray, fill: int, reach: int) -> dict[tuple[int, int], int]:
    """Exact sums of z z' over all vectors, z the vector less the whole ``mean``; |z| is at most ``reach``. (i, -1) is the sum of z."""
    d = len(mean)
    i, j = np.triu_indices(d)
    # products of whole numbers are exact in float64 while their sum is below 2 ** 53
    rows = max(1, min(4096, ((1 << 53) - 1) // max(1, reach * reach)))
    fast = reach * reach < 1 << 53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(i), dtype=np.int64 if fast else object)
        first = np.zeros(d, dtype=object)
        held, room = [], 1 << 62
        for batch in batches:
            z = _matrix(batch.column(0), d, fill) - mean
            first += z.sum(axis=0)
            for at in range(0, len(z), rows):
                part = z[at : at + rows]
                if fast:
                    f = part.astype(np.float64)
                    total += (f.T @ f)[i, j].astype(np.int64)
                    room -= len(part) * reach * reach
                    if room < 1 << 54:  # before a sum can pass 63 bits
                        held.append(total)
                        total, room = np.zeros(len(i), dtype=np.int64), 1 << 62
                else:
                    o = part.astype(object)
                    total = total + np.array([int(o[:, a] @ o[:, b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=object)
        for t in [*held, total]:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(v) for v in t.tolist()])], ["i", "j", "v"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, -1, np.int32)), pa.array([str(v) for v in first.tolist()])], ["i", "j", "v"])

    got = vectors.select("x").mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).toArrow()
    return {(a, b): int(v) for a, b, v in zip(got["i"].to_pylist(), got["j"].to_pylist(), got["v"].to_pylist(), strict=True)}


def jacobi(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix.

    A sweep turns every pair of dimensions once, in rounds of disjoint pairs. A pair is turned while its entry is more
    than rounding against the geometric mean of its two diagonal entries; a sweep without a turn is the end.
    """
    d = len(a)
    a, v = np.array(a, dtype=np.float64), np.eye(d)
    size = max(float(np.abs(a).max(initial=0.0)), np.finfo(float).tiny)
    seats = np.arange(d + d % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            p, q = np.minimum(p, q), np.maximum(p, q)
            pair = q < d
            p, q = p[pair], q[pair]
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            some = np.abs(off) > np.maximum(_EPS * np.sqrt(np.abs(app * aqq)), 1e-300 + 1e-22 * size)
            if some.any():
                turned = True
                p, q, off, app, aqq = p[some], q[some], off[some], app[some], aqq[some]
                half = (aqq - app) / (2 * off)
                t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(1.0, half))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                rows_p, rows_q = a[p], a[q]
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                cols_p, cols_q = a[:, p], a[:, q]
                a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
                # what the rotation makes exactly
                a[p, p], a[q, q], a[p, q], a[q, p] = app - t * off, aqq + t * off, 0.0, 0.0
                cols_p, cols_q = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])  # a round robin: all but the first move on
        if not turned:
            break
    else:
        if np.abs(a - np.diag(np.diag(a))).max() > 1e-12 * size:
            raise RuntimeError(f"no diagonal after {SWEEPS} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening. ``matrix``: a row for each component, its unit eigenvector over the root of its eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    matrix: np.ndarray
    trace: float
    column: str = "embedding"
    scale: float = SCALE
    shift: int = SHIFT

    def _projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact, and the whitened vectors."""
        most = max((abs(v) for v in self.sums), default=0)
        reach = self.n * int(np.abs(x).max(initial=0)) + most
        s = np.array(self.sums, dtype=np.int64 if most < 1 << 62 else object)
        far = x * self.n - s if reach < 1 << 62 else x.astype(object) * self.n - s
        return far, (far / self.n).astype(np.float64) @ self.matrix.T

    def _spread(self, vectors: DataFrame) -> float:
        """The largest absolute entry of the whitened vectors' covariance less the identity, measured over ``vectors``."""
        k = len(self.values)
        if not k:
            return 0.0
        i, j = np.triu_indices(k)
        fill, d = self.shift, len(self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, first = np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                _, w = self._projected(_matrix(batch.column(0), d, fill))
                total += w.T @ w
                first += w.sum(axis=0)
            ends = np.full(k, -1, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i.astype(np.int32), np.arange(k, dtype=np.int32))), pa.array(np.append(j.astype(np.int32), ends)), pa.array(np.append(total[i, j], first))], ["i", "j", "v"])

        got = vectors.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        a, b, v = (got[c].to_numpy() for c in ("i", "j", "v"))
        mean, cov = np.zeros(k), np.zeros((k, k))
        mean[a[b < 0]] = v[b < 0] / self.n
        a, b, v = a[b >= 0], b[b >= 0], v[b >= 0]
        cov[a, b] = v / self.n - mean[a] * mean[b]
        return float(np.abs(np.triu(cov) - np.eye(k)).max())

    def apply(self, vectors: DataFrame) -> DataFrame:
        """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component.

        deviation, the squared distance of n * x from S over all dimensions, is exact (decimal(38,0)). ``vectors`` is the
        fitted table or another of vectors no longer than it had; identity_error is measured over it.
        """
        own = _rows(vectors, self.column, self.scale, self.shift)
        error = self._spread(own)
        k, d, fill = len(self.values), len(self.sums), self.shift
        component, explained = np.arange(1, k + 1, dtype=np.int32), self.values / self.trace if k else self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.num_rows
                far, w = self._projected(_matrix(batch.column(1), d, fill))
                if far.dtype != object and d * int(np.abs(far).max(initial=0)) ** 2 < 1 << 62:
                    deviation = (far * far).sum(axis=1)
                else:
                    deviation = (far.astype(object) ** 2).sum(axis=1)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
                said = np.repeat(np.array([str(v) for v in deviation.tolist()], dtype=object), k)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(component, rows)), pa.array(said, pa.string()), pa.array(w.ravel()), pa.array(np.tile(explained, rows))], ["vec_id", "component", "deviation", "whitened", "explained"])

        out = own.mapInArrow(run, "vec_id bigint, component int, deviation string, whitened double, explained double")
        return out.select("vec_id", "component", F.lit(self.n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))


def _rows(vectors: DataFrame, column: str, scale: float, shift: int) -> DataFrame:
    own = bounded_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    far = F.exists("v", lambda c: (F.abs(c.cast("double")) * scale >= LARGEST) & (F.abs(c.cast("double")) < float("inf")))
    x = F.when(F.coalesce(far, F.lit(False)), F.raise_error(F.lit("an entry is too large to be whitened")).cast("array<bigint>")).otherwise(whole("v", scale, shift))
    return own.select("vec_id", x.alias("x")).filter("x is not null")


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> Whitening:
    """The whitening of ``vectors`` (vec_id, and ``column``, an array of numbers), fitted on all of them.

    Vectors that are null or hold a null or non-finite entry take no part, here and in :meth:`Whitening.apply`. An entry
    beyond LARGEST / scale is an error, as are more than MAX_DIM dimensions. A vector shorter than others counts as filled up with zeros
    (an empty one is all zeros). Repeated rows count each, ids are not looked at, and may be null. Components whose
    eigenvalue is less than LEAST of the largest, of dimensions that depend on others or do not vary, cannot be whitened and are left out,
    so equal vectors, a single one or an empty table have no components and give no rows. Equal eigenvalues are told apart by no rule but the rotations' own,
    which reruns repeat.
    """
    own = _rows(vectors, column, scale, shift)
    got = {r.dim: r for r in _sums(own).collect()}
    n = got[-1].n if -1 in got else 0
    d = max(got, default=-1) + 1
    if not n or not d:
        return Whitening(n, [], np.zeros(0), np.zeros((0, 0)), 0.0, column, scale, shift)
    sums = [int(got[i].s) + shift * (n - got[i].n) for i in range(d)]
    mean = np.array([s // n for s in sums], dtype=np.int64)
    ends = [(min(got[i].low, shift), max(got[i].high, shift)) if got[i].n < n else (got[i].low, got[i].high) for i in range(d)]
    reach = max(max(int(m) - low, high - int(m)) for m, (low, high) in zip(mean.tolist(), ends, strict=True))
    z = _scatter(own, mean, shift, reach)
    # the covariance about the true mean, exact until it becomes a double
    v = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            v[i, j] = v[j, i] = (n * z[i, j] - z[i, -1] * z[j, -1]) / (n * n)
    trace = float(sum(Fraction(n * z[i, i] - z[i, -1] ** 2, n * n) for i in range(d)))
    values, vectors_ = jacobi(v)
    kept = np.flatnonzero(values > LEAST * max(float(values[0]), 0.0))[:components] if values[0] > 0 else np.zeros(0, np.int64)
    values, vectors_ = values[kept], vectors_[:, kept]
    largest = np.abs(vectors_).argmax(axis=0) if len(kept) else np.zeros(0, np.int64)
    vectors_ = vectors_ * np.sign(vectors_[largest, np.arange(len(kept))])
    return Whitening(n, sums, values, (vectors_ / np.sqrt(values)).T, trace, column, scale, shift)
