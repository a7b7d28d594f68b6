"""Whitening of embeddings by matrix-free block Lanczos.

The covariance matrix is never made. A pass over the fit list (each distinct vector once) multiplies it with a block of
directions: every task centres its vectors, x - S/n with the difference n*x - S exact in whole numbers, and adds up
Xᵀ(X Q); Spark sums the tasks' parts, and only d x block numbers come to the driver. A new block is orthogonalised
twice against all blocks before it (full reorthogonalisation); columns that vanish are replaced by random
directions (a restart), so that a block that meets an invariant subspace does not end the search. The
projected matrix is block tridiagonal; its eigenvectors give the components, and the search ends when every
residual is small against the gap to the next eigenvalue, or when the blocks fill the whole space.

Explained shares divide by the trace, which is the mean of the squared deviations and needs no eigenvalue.

Defined results: rows whose vector is null, empty or has a null or non-finite entry are dropped; vectors of several
lengths, and entries that a long cannot hold exactly, are errors; rows that repeat an id or a vector are rows of the
result each, while the fit counts a vector once; a null id is kept. A component without variance (constant entries, fewer
distinct vectors than components) has ``whitened`` null and ``explained`` 0, and is no part of ``identity_error``, which is
null without a component of variance. An empty table gives an empty table; further columns, whatever their names,
do not matter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .vectors import dimension, integers, matrix, summed, usable

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned, at most.
COMPONENTS = 16
#: Directions of a block, at least. A block is never narrower than the components asked for: of equal eigenvalues a
#: search finds as many as a block has directions.
BLOCK = 16
#: A residual counts as small below this share of the gap to the nearest other eigenvalue, or below ``ROUNDING`` of the largest.
RESIDUAL, ROUNDING = 1e-10, 1e-15
#: Eigenvalues below this share of the largest are variance that only rounding made.
NO_VARIANCE = 1e-13

Multiply = Callable[[np.ndarray], np.ndarray]


def fresh_block(z: np.ndarray, basis: np.ndarray, width: int, floor: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(q, r): up to ``width`` orthonormal columns orthogonal to ``basis``, and r with z = basis @ ... + q @ r.

    A column of ``z`` that is no longer than ``floor`` once the others are taken out starts anew at random.
    """
    width = min(width, basis.shape[0] - basis.shape[1])
    known, r = basis, np.zeros((width, z.shape[1]))
    k0 = basis.shape[1]

    def rest(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.zeros(known.shape[1])
        for _ in range(2):
            g = known.T @ c
            c, h = c - known @ g, h + g
        return c, h

    for j in range(z.shape[1]):
        c, h = rest(z[:, j])
        r[: known.shape[1] - k0, j] = h[k0:]
        size = np.linalg.norm(c)
        if size > floor and known.shape[1] - k0 < width:
            r[known.shape[1] - k0, j] = size
            known = np.column_stack([known, rest(c / size)[0]])
            known[:, -1] /= np.linalg.norm(known[:, -1])
    while known.shape[1] - k0 < width:
        c, _ = rest(rng.standard_normal(basis.shape[0]))
        c, _ = rest(c / np.linalg.norm(c))
        known = np.column_stack([known, c / np.linalg.norm(c)])
    return known[:, k0:], r


def block_lanczos(multiply: Multiply, d: int, k: int = COMPONENTS, block: int = BLOCK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues (falling) and their unit eigenvectors (columns) of a symmetric d x d operator."""
    rng, k = np.random.default_rng(seed), min(k, d)
    block = max(block, k)
    basis = np.zeros((d, 0))
    q, _ = fresh_block(np.zeros((d, 0)), basis, block, 0.0, rng)
    t = np.zeros((0, 0))
    link = np.zeros((q.shape[1], 0))  # of the block before to this one
    while True:
        z = multiply(q)
        basis, m = np.column_stack([basis, q]), t.shape[0]
        a = q.T @ z
        t = np.block([[t, np.zeros((m, len(a)))], [np.zeros((len(a), m)), (a + a.T) / 2]])
        if m:
            t[m:, m - link.shape[1] : m] = link
            t[m - link.shape[1] : m, m:] = link.T
        e, s = np.linalg.eigh(t)
        e, s = e[::-1], s[:, ::-1]
        if basis.shape[1] == d:
            break
        q, link = fresh_block(z, basis, block, 1e-14 * max(abs(e[0]), np.finfo(float).tiny), rng)
        if len(e) > k:
            residual = np.linalg.norm(link @ s[-link.shape[1] :, :k], axis=0)
            gap = np.minimum(np.abs(np.diff(e[: k + 1])), np.concatenate([[np.inf], np.abs(np.diff(e[:k]))]))
            if (residual <= np.maximum(RESIDUAL * gap, ROUNDING * abs(e[0]))).all():
                break
    u, _ = np.linalg.qr(basis @ s[:, :k])
    return e[:k], u * np.sign(np.sum(u * (basis @ s[:, :k]), axis=0))


@dataclass(frozen=True)
class Whitening:
    """Sums of the fit list and its components: n, S by dimension, eigenvalues, directions (d x k), trace, and how far the
    whitened covariance is from the identity."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def real(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > NO_VARIANCE * max(float(self.values[0]) if len(self.values) else 0.0, 0.0)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n*x - S, exact."""
    most = int(np.abs(x).max(initial=0))
    if most * n + int(np.abs(sums).max(initial=0)) >= 2**63:
        raise ValueError("n*x - S does not fit a long")
    return x * np.int64(n) - sums


def squared(y: np.ndarray) -> np.ndarray:
    """The sum of squares of each row, exact."""
    if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2**63:
        raise ValueError("a deviation does not fit a long")
    return (y * y).sum(axis=1)


def _parts(table: DataFrame, part: Callable[[np.ndarray], np.ndarray], d: int, kind: str) -> DataFrame:
    """(at, value): what ``part`` makes of each batch of x-vectors, added up within a task."""

    def run(it):
        total = None
        for batch in it:
            if batch.num_rows:
                got = part(matrix(batch.column(0), d))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"])

    return table.select("x").mapInArrow(run, f"at int, value {kind}")


def _dense(found: dict[int, float], n: int) -> np.ndarray:
    return np.array([found.get(k, 0.0) for k in range(n)])


def fit(x: DataFrame, d: int, k: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """Fit on the distinct x-vectors of a table (x array<long>)."""
    table = stored(x.select("x").distinct(), "whitening-fit")
    # sums of longs as decimals: no overflow between tasks
    got = summed(_parts(table, lambda m: np.append(m.sum(axis=0), len(m)), d, "bigint").select("at", F.col("value").cast("decimal(38,0)").alias("value")))
    n, sums = int(got[d]), np.array([int(got[j]) for j in range(d)], dtype=np.int64)

    def centred(m: np.ndarray) -> np.ndarray:
        return deviations(m, n, sums) / float(n)

    def multiply(q: np.ndarray) -> np.ndarray:
        parts = _parts(table, lambda m: ((c := centred(m)).T @ (c @ q)).ravel(), d, "double")
        return _dense(summed(parts), q.size).reshape(q.shape) / n

    trace = summed(_parts(table, lambda m: np.array([(centred(m) ** 2).sum()]), d, "double"))[0] / n
    values, directions = block_lanczos(multiply, d, k, block)
    found = Whitening(n, tuple(int(s) for s in sums), values, directions, trace, None)
    real = int(found.real.sum())
    error = None
    if real:
        scaled = directions[:, :real] / np.sqrt(values[:real])
        means = _dense(summed(_parts(table, lambda m: (centred(m) @ scaled).sum(axis=0), d, "double")), real) / n
        parts = _parts(table, lambda m: ((w := centred(m) @ scaled - means).T @ w).ravel(), d, "double")
        error = float(np.abs(_dense(summed(parts), real * real).reshape(real, real) / n - np.eye(real)).max())
    discard(table)
    return Whitening(n, found.sums, values, directions, trace, error)


def whitened(x: DataFrame, w: Whitening) -> DataFrame:
    """Of (vec_id, x): one row for each vector and component."""
    d, k = w.directions.shape
    sums, real = np.array(w.sums, dtype=np.int64), w.real
    scaled = w.directions / np.sqrt(np.where(real, w.values, 1.0))
    shares = np.where(real, w.values / w.trace if w.trace else 0.0, 0.0)

    def run(it):
        for batch in it:
            y = deviations(matrix(batch.column(1), d), w.n, sums)
            m = len(y)
            value = (y / float(w.n)) @ scaled
            where = pa.array(np.repeat(np.arange(m), k))
            columns = [
                batch.column(0).take(where),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.n, np.int64)),
                pa.array(np.repeat(squared(y), k)),
                pa.array(value.ravel(), mask=np.tile(~real, m)),
                pa.array(np.tile(shares, m)),
                pa.array([w.identity_error], pa.float64()).take(pa.array(np.zeros(m * k, np.int64))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", "x").mapInArrow(run, f"vec_id {dict(x.dtypes)['vec_id']}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row."""
    vectors = usable(table, id_col, vector_col)
    d = dimension(vectors)
    x = integers(vectors, d or 1, SCALE, SHIFT)
    w = fit(x, d, k) if d else Whitening(0, (0,), np.zeros(1), np.zeros((1, 1)), 0.0, None)
    return whitened(x, w).withColumnRenamed("vec_id", id_col)
