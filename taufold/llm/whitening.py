"""Whitening of embeddings by spectral divide and conquer.

Vectors are read as whole numbers x = floor(1024 c) + 100000, so counts and sums
are exact; the covariance is summed per task from centred vectors.  Its spectrum
is split recursively: the orthogonal polar factor U of the shifted covariance, by
the QR- and Cholesky-based dynamically weighted Halley iteration, gives the
projector (U + I) / 2 on the eigenvectors above the shift; the covariance is
restricted to that subspace and to its complement, until a subspace has a single
eigenvalue.  Only d x d matrices reach the driver, d being the length of a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET = 1024, 100_000
#: Rows that are worked on together.
ROWS = 4_096
EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley iterations.

    The lower bound of the singular values starts at the rounding unit, so any
    matrix that is not singular converges in at most seven steps.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS / 4
    for _ in range(12):
        r = (4 * (1 - low**2) / low**4) ** (1 / 3)
        p = np.sqrt(1 + r) + 0.5 * np.sqrt(max(0.0, 8 - 4 * r + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + r))))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        before = x
        if c > 100:
            both, _ = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(n)]))
            x = (q / c) * x + (p - q / c) / np.sqrt(c) * (both[:n] @ both[n:].T)
        else:
            w = np.linalg.cholesky(np.eye(n) + c * (x.T @ x))
            x = (q / c) * x + (p - q / c) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        x = (x + x.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + c * low**2))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - before) < (5 * EPS) ** (1 / 3) * np.sqrt(n):
            break
    return x


def _bases(projector: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range, of dimension ``k``, and of the rest."""
    n = len(projector)
    probe = np.random.default_rng(n).standard_normal((n, k))
    q, _ = np.linalg.qr(projector @ probe)
    whole, _ = np.linalg.qr(projector @ q, mode="complete")
    return whole[:, :k], whole[:, k:]


def _split(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of two invariant subspaces, the one of larger eigenvalues first; None when all eigenvalues are one to rounding."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    middle = diagonal.mean()
    if np.linalg.norm(a - middle * np.eye(n)) <= n * EPS * size:
        return None
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)
    # The mean of the eigenvalues lies between them; the median halves them better.  A shift that meets an eigenvalue is moved.
    shifts = [np.median(diagonal), middle] + [middle + spread * s for s in (0.01, -0.01, 0.1, -0.1, 0.3, -0.3)]
    best = None
    for shift in shifts:
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        upper, lower = _bases(projector, k)
        left = np.linalg.norm(lower.T @ a @ upper)
        if best is None or left < best[0]:
            best = (left, upper, lower)
        if left <= 10 * n * EPS * size:
            break
    if best is None:
        return None
    return best[1], best[2]


def leading_components(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns; the largest entry of each is positive."""
    size = np.linalg.norm(covariance)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    todo = [np.eye(len(covariance))] if len(covariance) and size else []
    while todo and len(values) < wanted:
        basis = todo.pop()
        inner = basis.T @ covariance @ basis
        inner = (inner + inner.T) / 2
        parts = _split(inner, size) if len(inner) > 1 else None
        if parts:
            # Larger eigenvalues are at the top of the stack; the columns stay orthonormal through one more QR step.
            todo += [np.linalg.qr(basis @ part)[0] for part in reversed(parts)]
        else:
            values += np.diag(inner).tolist()
            vectors += list(basis.T)
    if not values:
        return np.zeros(0), np.zeros((len(covariance), 0))
    found = np.array(vectors).T
    # Rounding may leave close eigenvalues in another order.
    values = np.einsum("ij,ij->j", found, covariance @ found)
    order = np.argsort(-values, kind="stable")[:wanted]
    found, values = found[:, order], values[order]
    return values, found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(values))])


def entries(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row has ``dim`` finite entries, and those rows as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (bad[ends] == bad[ends - size]) & (size == dim) & column.is_valid().to_numpy(zero_copy_only=False)
    kept = values[np.repeat(good, size)].reshape(int(good.sum()), dim)
    return good, np.floor(kept * SCALE).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            yield part, *entries(part.column(at), dim)


def _summed(rows: DataFrame, spec: str) -> np.ndarray:
    """Position-wise sums of a single array column; tasks give one row each, so the sums combine before the shuffle."""
    values = rows.select(F.posexplode("sums").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").toArrow()
    return values.column(1).to_numpy().astype(spec)


@dataclass(frozen=True)
class Whitener:
    """What whitening needs: n vectors, their sums, components as columns with eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - S) squared; None where a long can't hold it."""
        apart = self.n * x - self.sums
        most = int(np.abs(apart).max(initial=0))
        if most * most * max(1, apart.shape[1]) < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
        found = [sum(v * v for v in row) for row in apart.tolist()]
        return [v if v < 1 << 63 else None for v in found]


def vector_length(rows: DataFrame, vector: str) -> int:
    """The commonest length of a vector that is not NULL, the larger one of equally common ones; 0 without vectors."""
    sizes = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).count()
    found = sizes.agg(F.max(F.struct("count", "dim"))).first()[0]
    return found["dim"] if found else 0


def fit(rows: DataFrame, vector: str = "embedding", components: int = 8) -> Whitener:
    """Counts, sums and components of all usable vectors: two scans, one row per task each."""
    dim = vector_length(rows, vector)
    source = rows.select(vector)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(dim + 1, np.int64)
        for _, _, x in _blocks(batches, dim):
            sums[0] += len(x)
            sums[1:] += x.sum(axis=0)
        yield pa.record_batch([pa.array([sums.tolist()], pa.list_(pa.int64()))], ["sums"])

    found = _summed(source.mapInArrow(add, "sums array<long>"), "int64")
    found = found if len(found) else np.zeros(dim + 1, np.int64)
    n, sums = int(found[0]), found[1:]
    if not n or not dim:
        return Whitener(n, sums, np.zeros((dim, 0)), np.zeros(0), 0.0)
    upper = np.triu_indices(dim)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for _, _, x in _blocks(batches, dim):
            apart = (n * x - sums) / n
            total += apart.T @ apart
        yield pa.record_batch([pa.array([total[upper].tolist()], pa.list_(pa.float64()))], ["sums"])

    covariance = np.zeros((dim, dim))
    covariance[upper] = _summed(source.mapInArrow(multiply, "sums array<double>"), "float64") / n
    covariance += np.triu(covariance, 1).T
    trace = float(np.trace(covariance))
    values, vectors = leading_components(covariance, min(components, dim))
    sound = values > dim * EPS * trace  # nothing can be whitened along a direction without variance
    return Whitener(n, sums, vectors[:, sound], values[sound], trace)


def identity_error(rows: DataFrame, whitener: Whitener, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity; None without components."""
    k = len(whitener.values)
    if not k:
        return None
    shared = rows.sparkSession.sparkContext.broadcast(whitener)
    dim = len(whitener.sums)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, _, x in _blocks(batches, dim):
            w = shared.value.whitened(x)  # centred, as x is
            total += w.T @ w
        yield pa.record_batch([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], ["sums"])

    found = _summed(rows.select(vector).mapInArrow(multiply, "sums array<double>"), "float64").reshape(k, k) / whitener.n
    return float(np.abs(found - np.eye(k)).max())


def whiten(rows: DataFrame, whitener: Whitener, vector: str = "embedding") -> DataFrame:
    """(row, deviation, whitened) of each row of ``rows`` with a usable vector; ``row`` holds all other columns.

    There must be another column.  Usable are vectors of the commonest length whose entries are neither NULL,
    NaN nor infinite; the others are left out, as they are from the fit.  Equal
    vectors get equal results.  Directions without variance are left out, so
    ``whitened`` may be shorter than asked for, and is empty when all vectors are
    equal.  Entries up to about 2 ** 40 are meant; ``deviation`` is NULL where
    it exceeds a long.
    """
    shared = rows.sparkSession.sparkContext.broadcast(whitener)
    dim = len(whitener.sums)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, good, x in _blocks(batches, dim):
            w = shared.value.whitened(x)
            cuts = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            whitened = pa.ListArray.from_arrays(cuts, pa.array(w.reshape(-1)))
            deviation = pa.array(shared.value.deviation(x), pa.int64())
            yield pa.record_batch([part.column(1).filter(pa.array(good)), deviation, whitened], ["row", "deviation", "whitened"])

    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != vector]).alias("row")
    source = rows.select(vector, row)
    return source.mapInArrow(scan, f"row {source.schema['row'].dataType.simpleString()}, deviation long, whitened array<double>")
