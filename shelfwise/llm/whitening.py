"""Whitening of embeddings by shifted CholeskyQR.

The centred rows form a tall matrix Y. A pass over the stored rows sums Gram blocks
per task, the driver factors the small sum into R, and the next pass works on
Y R^-1, which each task makes again by triangular solves. The first Gram matrix is
shifted, so that its factor exists however ill-conditioned Y is; later passes bring
the rows to orthonormality. The product of all factors is the R of Y, and its SVD
gives the components and their variances without ever squaring Y's condition number.

Defined results: rows whose vector is null, empty, or holds null, non-finite or
over-large entries (beyond 2^46, which have no exact long) are dropped, as are
vectors of another length than the most frequent one (the longer at a tie); a null
id is kept as null; repeated rows are returned each but count once in the fit;
components without variance (below 1e-12 of the total) are not returned, so that
equal vectors alone give no rows; ``deviation`` is null where it exceeds a long; of
the two signs of a component the one with a positive largest entry is taken; an
empty table gives an empty result; other columns are passed over.

The driver holds a few matrices of the vectors' dimension squared, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE = 64
OFFSET = 1_000_000
LARGEST = 2.0**46
COMPONENTS = 16
MOST_PASSES = 5
LEAST_SHARE = 1e-12
FAN_IN = 32
UNIT = np.finfo(np.float64).eps / 2


def integer_vectors(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): floor(scale * c) + offset of every entry c, for the usable rows of the most frequent length."""
    c = F.col("embedding").cast("array<double>")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > LARGEST))
    usable = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)))
    x = usable.select("vec_id", F.transform(c, lambda e: F.floor(e * scale) + F.lit(offset).cast("long")).alias("x"))
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return x.where(F.size("x") == F.lit(lengths["d"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists all have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, part, kind: type) -> tuple[int, np.ndarray] | None:
    """(rows, sum of ``part(x)`` over blocks of rows); matrices meet in a tree, in the order of their tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                one = part(matrix(batch.column(0)))
                n, total = n + batch.num_rows, one if total is None else total + one
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, total = None, 0, None
        for batch in batches:
            for p, k, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = np.frombuffer(m, kind)
                first, n, total = p if first is None else first, n + k, one if total is None else total + one
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["part", "n", "m"])

    shape = "part int, n long, m binary"
    parts = rows.select("x").mapInArrow(scan, shape)
    for fan in (FAN_IN, 1):
        parts = parts.repartition(fan, "part").sortWithinPartitions("part").mapInArrow(add, shape)
    found = parts.first()
    return (found["n"], np.frombuffer(found["m"], kind)) if found else None


def right_solve(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y r^-1 for an upper triangular r, column after column."""
    q = np.empty_like(y)
    for j in range(len(r)):
        q[:, j] = (y[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def shifted_factor(g: np.ndarray, always: bool) -> np.ndarray:
    """Upper triangular r with r^T r = g + s I; the shift s covers the rounding errors of g."""
    d = len(g)
    shift = 11 * d * (d + 1) * UNIT * float(np.trace(g))
    while True:
        try:
            return np.linalg.cholesky(g + (shift * np.eye(d) if always else 0)).T
        except np.linalg.LinAlgError:
            shift, always = shift * (10 if always else 1), True


@dataclass
class Whitening:
    """A fit: ``n`` distinct vectors with sums ``sums``, unit ``components`` by rows and their ``variances``."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0
    passes: int = 0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, from the exact integers n x - sums."""
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.variances)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of (vec_id, x); None if there are none."""
    distinct = stored(vectors.select("x").distinct(), "vectors")
    found = summed(distinct, lambda x: x.sum(0), np.int64)
    if found is None:
        return None
    n, sums = found
    d = len(sums)
    plain = Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)
    r, factors = np.eye(d), []
    for turn in range(MOST_PASSES):
        held = tuple(factors)

        def block(x: np.ndarray, held=held) -> np.ndarray:
            y = plain.centred(x)
            for f in held:
                y = right_solve(y, f)
            return (y.T @ y).ravel()

        g = summed(distinct, block, np.float64)[1].reshape(d, d)
        if not np.trace(g) > 0:
            return plain
        if turn and np.abs(g - np.eye(d)).max() < 64 * d * UNIT:
            break
        step = shifted_factor((g + g.T) / 2, always=turn == 0)
        factors.append(step)
        r = step @ r
    _, s, axes = np.linalg.svd(r)
    variances = s**2 / n
    keep = min(components, int((variances > LEAST_SHARE * variances.sum()).sum()))
    axes = axes[:keep]
    axes = axes * np.where(axes[np.arange(keep), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    model = Whitening(n, sums, axes, variances[:keep], float(variances.sum()), passes=len(factors))

    def moments(x: np.ndarray) -> np.ndarray:
        z = model.whitened(x)
        return np.concatenate([z.sum(0), (z.T @ z).ravel()])

    both = summed(distinct, moments, np.float64)[1] / n
    mean, second = both[:keep], both[keep:].reshape(keep, keep)
    model.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(keep)).max())
    return model


def deviations(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over the dimensions of (n x - sums)^2, in integers."""
    gap = model.n * x - model.sums
    largest = float(np.abs(gap).max(initial=0))
    if largest**2 * x.shape[1] < 2.0**62:
        return pa.array((gap * gap).sum(1), pa.int64())
    exact = [sum(v * v for v in row) for row in gap.tolist()]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector of (vec_id, x) and component: whitened value, share of the variance, deviation from the mean."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = stored(vectors, "integers")
    model = fit(vectors, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(model.variances)
    explained = model.variances / model.total

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x, at = matrix(batch.column(1)), pa.array(np.repeat(np.arange(rows), k))
            columns = [
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), deviations(x, model).take(at),
                pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return vectors.mapInArrow(scan, schema)
