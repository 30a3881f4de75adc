"""Whitening of embeddings by moments that merge.

Components become integers ``floor(SCALE * c)``; the fit list has every distinct vector once.
Each partition of it computes its count, its sums (exact integers), its mean and the scatter
about that mean.  Two such summaries merge by the pairwise formula of Chan, Golub and LeVeque
-- the scatters and the outer product of the difference of the means, weighted -- so nothing
is ever centred by subtracting large squares.  ``treeReduce`` merges them, the driver takes
the eigenvectors of the one matrix that is left, and a second pass over the fit list holds
the covariance of the whitened vectors against the identity.

A summary has ``dims ** 2`` numbers; that is all that moves, whatever the number of rows.

Defined results: rows whose vector is null or holds a null or non-finite component are
dropped; repeated rows are returned each and fitted once, rows without ``vec_id`` too.
Vectors of different lengths are fitted each with their own length; the empty vector has no
component and no row.  A component without variance (fewer distinct vectors than components,
or constant ones) can't be scaled: its ``whitened`` is null, and it takes no part in
``identity_error``, which is 0 where none is left.  ``deviation`` is null where it does not
fit 64 bits.  Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, tidy

SCALE, COMPONENTS = 256, 4
#: Share of the greatest eigenvalue under which a component has no variance but for rounding.
NOTHING = 1e-12


@dataclass
class Moments:
    """Count, sums, mean and scatter about the mean of some vectors."""

    n: int
    total: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        # the mean is close to the exact one, and what it lacks is corrected in the scatter
        mean = rows.mean(axis=0, dtype=np.float64)
        away = rows - mean
        left = away.mean(axis=0)
        return Moments(len(rows), rows.sum(axis=0), mean + left, away.T @ away - len(rows) * np.outer(left, left))

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.total + other.total, self.mean + apart * (other.n / n), scatter)


def merged(a: dict[int, Moments], b: dict[int, Moments]) -> dict[int, Moments]:
    """Summaries by length."""
    return {d: a[d].merge(b[d]) if d in a and d in b else a.get(d) or b[d] for d in a.keys() | b.keys()}


def _matrix(lists: pa.ListArray) -> dict[int, np.ndarray]:
    """Rows of an Arrow column of lists by their length, those of none left out."""
    length = lists.value_lengths().to_numpy()
    return {int(d): lists.filter(pa.array(length == d)).flatten().to_numpy().reshape(-1, d) for d in np.unique(length) if d}


def moments(fit: DataFrame, seen: Callable[[int, np.ndarray], np.ndarray | None]) -> dict[int, Moments]:
    """The summary of ``seen(dims, rows)`` over ``fit(x)`` for each length, merged in a tree."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for dims, rows in _matrix(batch.column(0)).items():
                for at in range(0, len(rows), 8192):
                    got = seen(dims, rows[at : at + 8192])
                    if got is not None and got.shape[1]:  # some component has variance
                        held = merged(held, {dims: Moments.of(got)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["m"])

    parts = fit.select("x").mapInArrow(lambda it: tidy(task(it)), "m binary").rdd.map(lambda r: pickle.loads(r["m"]))
    return parts.treeReduce(merged) if parts.getNumPartitions() else {}


@dataclass
class Whitening:
    """What whitens vectors of one length: ``x -> (x - mean) @ axes``, and what it is made from."""

    n: int
    total: list[int]
    mean: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    scaled: np.ndarray
    identity_error: float = 0.0

    @staticmethod
    def of(m: Moments, components: int) -> Whitening:
        cov = m.scatter / m.n
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        values, vectors = values[order], vectors[:, order]
        # either sign would do; the largest coordinate is made positive
        big = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[big, np.arange(len(order))] < 0, -1.0, 1.0)
        scaled = values > NOTHING * max(values.max(initial=0.0), 0.0)
        trace = float(np.trace(cov))
        total = [int(t) for t in m.total]
        return Whitening(
            m.n, total, np.array([t / m.n for t in total]), vectors / np.sqrt(np.where(scaled, values, 1.0)),
            np.maximum(values, 0.0) / trace if trace > 0 else np.zeros(len(order)), scaled,
        )

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return (rows - self.mean) @ self.axes

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """sum((n * x - total) ** 2) of each row, exact."""
        most = self.n * int(np.abs(rows).max(initial=0)) + max(map(abs, self.total), default=0)
        if most * most * max(1, rows.shape[1]) < 1 << 63:
            return ((self.n * rows - np.array(self.total, np.int64)) ** 2).sum(axis=1).tolist()
        exact = (sum((self.n * x - t) ** 2 for x, t in zip(row, self.total)) for row in rows.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: the vectors that take part, as integers."""
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(good)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c * float(scale)).cast("long")).alias("x"))


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """What whitens the vectors ``x`` of each length, with its error in a second pass."""
    fit = cut(rows.select("x").distinct(), "fit")
    found = {d: Whitening.of(m, components) for d, m in moments(fit, lambda d, x: x).items()}
    held = rows.sparkSession.sparkContext.broadcast(found)

    def whitened(dims: int, x: np.ndarray) -> np.ndarray | None:
        w = held.value.get(dims)
        return w.apply(x)[:, w.scaled] if w else None

    for d, m in moments(fit, whitened).items():
        found[d].identity_error = float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max())
    drop(fit)
    return found


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``RESULT``: a row for each vector and component, components by falling variance from 1."""
    rows = integers(vectors, scale)
    held = vectors.sparkSession.sparkContext.broadcast(fit_whitening(rows, components))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            length = lists.value_lengths().to_numpy()
            for dims, x in _matrix(lists).items():
                w = held.value.get(dims)
                if w is None:
                    continue
                k = len(w.scaled)
                values = w.apply(x).ravel()
                none = np.tile(~w.scaled, len(x))
                again = pa.array(np.repeat(np.arange(len(x)), k))
                mine = ids.filter(pa.array(length == dims))
                yield pa.RecordBatch.from_arrays(
                    [
                        mine.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(values), w.n), pa.int64()),
                        pa.array(w.deviations(x), pa.int64()).take(again), pa.array(values, pa.float64(), mask=none),
                        pa.array(np.tile(w.explained, len(x))), pa.array(np.full(len(values), w.identity_error)),
                    ],
                    names=[c.split()[0] for c in RESULT.split(", ")],
                )

    return rows.mapInArrow(lambda it: tidy(task(it)), RESULT)
