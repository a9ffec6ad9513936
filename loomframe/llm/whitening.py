"""Whitening by the leading principal components, found with LOBPCG over distributed covariance products.

The covariance matrix is never formed.  Each round multiplies it with a block of directions: tasks
centre their rows, multiply them with the block and back, and only sums of the block's shape come
to the driver (dimensions times block width).  The Rayleigh-Ritz step runs on an orthonormal basis
of the iterate, the previous direction and the residual block; only the residuals' product needs a
pass, since the other two follow from earlier products by the same turns.  The block holds
``guard`` directions more than are asked for, which makes the wanted ones converge fast.  Rounds
end when all wanted residuals are below ``tolerance`` of the largest eigenvalue; a last pass
multiplies the components anew, and only residuals from this product certify them.

Components x hold floor(scale * c) + shift.  Sums are whole numbers, n * x - S is exact, and its
quotient by n is the centred value, so a large common shift costs no digits.

Defined cases: vectors that are null or hold null or non-finite components are dropped; shorter
vectors are padded with zeros before scaling; scaled components are held within +-2**31; rows that
repeat, share an id or have a null id are vectors of their own; a table whose vectors span fewer
dimensions than ``components`` has that many components fewer, and none if all vectors are equal;
``deviation`` is null where it doesn't fit in a long; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_batches, discard, durable
from .vectors import scaled

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Directions beyond the wanted ones.
GUARD = 16
#: Residual norms against the largest eigenvalue.
TOLERANCE = 1e-13
MAX_ROUNDS = 200
#: Rows multiplied at a time.
ROWS = 4096
#: Eigenvalues below this share of the largest count as zero.
RANK = 1e-12


def _matrix(column: pa.Array, dim: int, shift: int) -> np.ndarray:
    x = np.full((len(column), dim), shift, np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(x) and (sizes == dim).all():
        return column.flatten().to_numpy().reshape(len(x), dim)
    for i, v in enumerate(column.to_pylist()):
        x[i, : len(v)] = v
    return x


def _sums(dim: int, shift: int):
    """(n, S) of a task's rows as one list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for batch in batches:
            total += np.append(_matrix(batch.column(0), dim, shift).sum(axis=0), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["s"])

    return run


def _product(dim: int, shift: int, n: int, total: np.ndarray, block: np.ndarray):
    """The sum of xc (xc' block) over a task's centred rows, a row (i, v) for each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(block.shape)
        for batch in batches:
            c = (_matrix(batch.column(0), dim, shift) * n - total) / n
            out += c.T @ (c @ block)
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    return run


def _projector(dim: int, shift: int, n: int, total: np.ndarray, axes: np.ndarray):
    """(row, id, x) to (id, deviation, spread, w): the exact squared deviation, the centred row's square and the whitened components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column(2), dim, shift) * n - total
            if float(np.abs(y).max(initial=0)) ** 2 * dim < 2**62:
                deviation = (y * y).sum(axis=1).tolist()
            else:
                deviation = [d if d < 2**63 else None for d in (y.astype(object) ** 2).sum(axis=1)]
            c = y / n
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(deviation, pa.int64()), pa.array((c * c).sum(axis=1)), pa.array((c @ axes).tolist(), pa.list_(pa.float64()))], names=["id", "deviation", "spread", "w"])

    return run


def _clean(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns of what ``block`` adds to an orthonormal ``basis``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s.max(initial=1e-300)]
    return block[:, : max(0, basis.shape[0] - basis.shape[1])]


def lobpcg(multiply, dim: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors, certified residual norms, passes) of a symmetric matrix known by ``multiply`` only."""
    width = min(dim, wanted + guard)
    wanted = min(wanted, width)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, width)))[0]
    vx, passes = multiply(x), 1
    p = vp = np.zeros((dim, 0))
    turn = lambda g: (lambda e, y: (e[::-1], y[:, ::-1]))(*np.linalg.eigh((g + g.T) / 2))
    e, y = turn(x.T @ vx)
    x, vx = x @ y, vx @ y
    for _ in range(max_rounds):
        residual = vx - x * e
        if (np.linalg.norm(residual[:, :wanted], axis=0) <= tolerance * e[0]).all():
            true, passes = multiply(x[:, :wanted]), passes + 1
            vx[:, :wanted] = true
            e[:wanted] = (x[:, :wanted] * true).sum(axis=0)
            norms = np.linalg.norm(true - x[:, :wanted] * e[:wanted], axis=0)
            if (norms <= 4 * tolerance * e[0]).all():
                return e[:wanted], x[:, :wanted], norms, passes
            residual = vx - x * e
        w = _clean(residual, np.hstack([x, p]))
        if w.shape[1]:
            vw, passes = multiply(w), passes + 1
        else:
            vw = np.zeros((dim, 0))
        q, vq = np.hstack([x, p, w]), np.hstack([vx, vp, vw])
        e, y = turn(q.T @ vq)
        e, lead = e[:width], y[:, :width]
        way = lead.copy()
        way[:width] = 0  # the previous direction: what came from beside the iterate
        way = _clean(way, lead)
        x, vx, p, vp = q @ lead, vq @ lead, q @ way, vq @ way
    raise ArithmeticError(f"no convergence to {tolerance} in {max_rounds} rounds")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, guard: int = GUARD, tolerance: float = TOLERANCE, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component."""
    spark = vectors.sparkSession
    made = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with arrow_batches(spark, ROWS):
        rows = durable(scaled(vectors, scale, shift, key=key, embedding=embedding))
        dim = rows.agg(F.max(F.size("x"))).first()[0]
        if not dim:
            discard(rows)
            return spark.createDataFrame([], made)
        x = rows.select("x")
        s = x.mapInArrow(_sums(dim, shift), "s array<long>")
        *total, n = s.agg(*[F.sum(F.col("s")[i]) for i in range(dim + 1)]).first()
        total = np.array(total, np.int64)

        def multiply(block: np.ndarray) -> np.ndarray:
            parts = x.mapInArrow(_product(dim, shift, n, total, block), "i int, v array<double>")
            summed = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]) for j in range(block.shape[1])]).collect()  # a row for each dimension
            return np.array([r[1:] for r in sorted(summed)]) / n

        e, axes, _, _ = lobpcg(multiply, dim, components, guard, tolerance)
        kept = int((e > RANK * max(e[0], 1e-300)).sum())
        if not kept:
            return spark.createDataFrame([], made)
        seen = durable(rows.mapInArrow(_projector(dim, shift, n, total, axes[:, :kept] / np.sqrt(e[:kept])), "id long, deviation long, spread double, w array<double>"))
        discard(rows)
    w = [F.col("w")[i] for i in range(kept)]
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    sums = seen.agg(*[F.sum(w[i] * w[j]) for i, j in pairs], *[F.sum(c) for c in w], F.sum("spread")).first()
    means, trace = np.array(sums[len(pairs) : -1]) / n, sums[-1] / n
    error = max(abs(sums[k] / n - means[i] * means[j] - (i == j)) for k, (i, j) in enumerate(pairs))
    share = F.element_at(F.array(*[F.lit(float(v) / trace) for v in e[:kept]]), F.col("component"))
    out = seen.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return out.select(F.col("id").alias(key), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
