"""Embedding whitening by a matrix-free block Lanczos iteration.

A component c becomes the integer floor(64 * c) + 1,000,000; the model is fitted to the distinct integer vectors.
The covariance is never formed: a pass multiplies it with a block of directions, task by task, as the sum of
(x - S/n) ((x - S/n)' v), centred from the exact integer n * x - S; a task sends one row a dimension. The driver
keeps the basis (dimensions x at most ``basis`` columns), reorthogonalises each new block against all of it twice,
replaces directions that break down by fresh random ones, restarts with the best Ritz vectors when the basis is
full, and stops by the residuals of the wanted pairs. The trace is the exact sum of deviations over n^3.

Defined results: vectors that are null or hold null or non-finite entries go; one shorter than the longest counts
as filled up with 0.0; repeated rows and ids each give rows, null ids too; components are those of positive variance
(over 1e-12 of the largest), so a table of one distinct vector gives no rows, as does an empty one; integers beyond
2^55 either way count as that bound, and a deviation that no long holds is null; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, finite, floored, staged

SCALE, OFFSET, COMPONENTS, BLOCK, BASIS, TOLERANCE, PASSES = 64.0, 1_000_000, 16, 16, 512, 1e-13, 400
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _blocks(batches, place: int, dims: int, kind, rows: int = 2**20):
    """(batch, first row, integer matrix) of each batch, cut so that a matrix stays small."""
    step = max(1, rows // dims)
    for b in batches:
        for lo in range(0, b.num_rows, step):
            column = b.column(place).slice(lo, step)
            yield b, lo, column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dims)


class Fit:
    """Exact sums over the distinct vectors, and the passes that need them."""

    def __init__(self, distinct: DataFrame, dims: int, most: int):
        self.distinct, self.dims = distinct, dims
        self.n = distinct.count()
        # machine integers where n * x - S and its squares fit them, else Python's
        self.kind = np.int64 if 2 * most * self.n < 2**62 else object
        kind = self.kind

        def add(batches):
            total = np.zeros(dims, kind)
            for _, _, x in _blocks(batches, 0, dims, kind):
                total = total + x.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([str(v) for v in total.tolist()], pa.string())], ["dim", "total"])

        found = distinct.mapInArrow(add, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        self.sums = np.array([int(r.total) for r in sorted(found, key=lambda r: r.dim)], kind)
        self.centre = _centre(self.n, self.sums)
        deviations, centre = _deviations, self.centre

        def spread(batches):
            total = 0
            for _, _, x in _blocks(batches, 0, dims, kind):
                total += sum(deviations(centre(x)))
            yield pa.RecordBatch.from_arrays([pa.array([str(total)])], ["total"])

        total = distinct.mapInArrow(spread, "total string").agg(F.sum(F.col("total").cast("decimal(38,0)"))).first()[0]
        self.trace = float(Decimal(total) / Decimal(self.n) ** 3)

    def _summed(self, task: Callable, rows: int, cols: int) -> np.ndarray:
        """The sum over tasks of what ``task`` makes of the centred doubles: a matrix of rows x cols."""
        dims, kind, centre, n = self.dims, self.kind, self.centre, self.n

        def of(batches):
            total = np.zeros((rows, cols))
            for _, _, x in _blocks(batches, 0, dims, kind):
                total += task((centre(x) / n).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "y"])

        sums = self.distinct.mapInArrow(of, "row int, y array<double>").groupBy("row").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(cols)])
        out = np.zeros((rows, cols))
        for r in sums.collect():  # rows x cols numbers
            out[r[0]] = r[1:]
        return out

    def multiplied(self, block: np.ndarray) -> np.ndarray:
        """The covariance times a block of directions: one pass."""
        return self._summed(lambda c: c.T @ (c @ block), self.dims, block.shape[1]) / self.n

    def gram(self, axes: np.ndarray) -> np.ndarray:
        """The covariance of the centred vectors' projections on ``axes``."""
        return self._summed(lambda c: (c @ axes).T @ (c @ axes), axes.shape[1], axes.shape[1]) / self.n


def _centre(n: int, sums: np.ndarray):
    return lambda x: x * n - sums


def _deviations(c: np.ndarray) -> list[int]:
    """Each row's exact sum of squares."""
    most = int(np.abs(c).max()) if c.size else 0
    if most * most * c.shape[1] >= 2**62:
        c = c.astype(object)
    return [int(v) for v in (c * c).sum(1)]


def _orthonormal(block: np.ndarray, basis: np.ndarray, scale: float, draw: np.random.Generator) -> np.ndarray:
    """``block`` made orthonormal and orthogonal to ``basis``; a column that breaks down gives way to a random one."""
    out = np.zeros((len(block), 0))
    for column in block.T:
        fresh, floor = column, 1e-11 * scale
        while True:
            for _ in range(2):
                for known in (basis, out):
                    fresh = fresh - known @ (known.T @ fresh)
            size = np.linalg.norm(fresh)
            if size > floor:
                break
            fresh, floor = draw.standard_normal(len(column)), 1e-8
        fresh = fresh / size
        for known in (basis, out):
            fresh = fresh - known @ (known.T @ fresh)
        out = np.column_stack([out, fresh / np.linalg.norm(fresh)])
    return out


def largest(multiplied: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, basis: int = BASIS, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix of ``dims`` that is only multiplied with.

    Raises when ``passes`` don't reach residuals of ``tolerance`` times the largest eigenvalue.
    """
    draw, wanted, block = np.random.default_rng(seed), min(wanted, dims), min(block, dims)
    basis = max(basis, 2 * (wanted + block))
    q, w = np.zeros((dims, 0)), np.zeros((dims, 0))
    new = _orthonormal(draw.standard_normal((dims, block)), q, 0.0, draw)
    for _ in range(passes):
        image = multiplied(new)
        q, w = np.column_stack([q, new]), np.column_stack([w, image])
        t = q.T @ w
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        best = s[:, :wanted]
        residual = np.linalg.norm(w @ best - q @ best * e[:wanted], axis=0)
        if q.shape[1] >= dims or q.shape[1] >= wanted and residual.max() <= tolerance * max(e[0], 0.0):
            vectors = q @ best
            return e[:wanted], vectors / np.linalg.norm(vectors, axis=0)
        more = min(block, dims - q.shape[1])
        new = _orthonormal(image[:, :more], q, max(abs(e[0]), 1e-300), draw)
        if q.shape[1] + more > basis:  # restart with the best Ritz vectors; the new block is orthogonal to them too
            kept = s[:, : wanted + block]
            q, w = q @ kept, w @ kept
    raise RuntimeError(f"no convergence in {passes} passes")


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET, block: int = BLOCK) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for every kept row and component."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(finite(F.col("v"))).select("vec_id", floored(F.col("v"), scale, offset).alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.max(F.greatest(F.array_max("x").cast("double"), -F.array_min("x").cast("double"))).alias("most")).first()
    if not size.n or not size.dims:
        return spark.createDataFrame([], SCHEMA)
    dims = size.dims
    rows = rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(dims) - F.size("x"))).alias("x"))
    distinct = staged(rows.select("x").distinct(), "distinct-vectors")
    fit = Fit(distinct, dims, max(int(size.most) + 1, offset))
    if fit.trace <= 0:
        dropped(distinct)
        return spark.createDataFrame([], SCHEMA)
    e, axes = largest(fit.multiplied, dims, components, block)
    real = e > 1e-12 * e[0]
    e, axes = e[real], axes[:, real] / np.sqrt(e[real])
    error = float(np.abs(fit.gram(axes) - np.eye(len(e))).max())
    dropped(distinct)
    n, k, kind, centre, explained, deviations = fit.n, len(e), fit.kind, fit.centre, e / fit.trace, _deviations

    def project(batches):
        for b, lo, x in _blocks(batches, 1, dims, kind):
            c = centre(x)
            deviation = [v if v < 2**63 else None for v in deviations(c)]
            white = (c / n).astype(np.float64) @ axes
            at = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [b.column(0).slice(lo, len(x)).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(deviation, pa.int64()).take(at)]
            columns += [pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, SCHEMA)
