"""Embedding whitening by one-sided Jacobi SVD (operator 11).

Vectors become whole numbers x = floor(1024 c) + 100000, so their sums are exact whatever the order. Centred rows are
compressed to a triangle R blockwise: a task stacks its triangle on the next batch of rows and factors again, and the tasks'
triangles are merged sixteen at a time until one is left (TSQR). Plane rotations then make R's columns orthogonal; their
lengths are the standard deviations, to the full relative accuracy of a double, and the rotations' product is the components.
Nothing is squared before it is centred. What meets in one place is a few matrices of dims x dims, whatever the number of rows.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, as are vectors that haven't
the length of most (of the longest, where several lengths are as frequent) and empty ones; ids may be null or repeated,
each row is one; components without variance (equal rows, fewer rows than dimensions) have no whitened values and
are left out; an empty table gives no rows; ties of variance give any orthonormal basis, the same for all rows; deviations
beyond a long fail rather than wrap; other columns, whatever their names, have no influence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, stored, tidy

SCALE, SHIFT = 1024, 100_000
#: Partial results that are merged in a task.
FAN = 16
#: Columns are orthogonal when their cosine is below this; sweeps end there (convergence is quadratic).
ORTHOGONAL = 1e-15
#: Standard deviations below this share of the largest are rounding, not variance.
RANK = 1e-11
MATRIX = "rows long, m array<double>, s array<long>"


def usable(c: Column) -> Column:
    """A vector without null or non-finite entries."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(finite(x), F.lit(False)))


def whole(c: Column) -> Column:
    return F.transform(c, lambda x: F.floor(x.cast("double") * SCALE).cast("long") + SHIFT)


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=kind).reshape(-1, dims)


def _tree(parts: DataFrame, merge) -> DataFrame:
    """One row of MATRIX from many: ``merge`` takes the list of (rows, m, s) of up to about FAN of them at a time."""

    def merged(table: pa.Table) -> pa.Table:
        rows, m, s = merge([(r["rows"], np.array(r["m"], float), np.array(r["s"], dtype=np.int64)) for r in table.to_pylist()])
        return pa.table({"rows": pa.array([rows], pa.int64()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64())), "s": pa.array([s.ravel().tolist()], pa.list_(pa.int64()))})

    n = parts.count()
    while n > 1:
        groups = -(-n // FAN)
        numbered = parts.withColumn("node", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        parts = stored(numbered.groupBy("node").applyInArrow(merged, MATRIX), "whiten-merge")
        n = parts.count()
    return parts


def _one(parts: DataFrame, merge) -> tuple[int, np.ndarray, np.ndarray]:
    r = _tree(parts, merge).first()
    return (0, np.zeros(0), np.zeros(0, dtype=np.int64)) if r is None else (r["rows"], np.array(r["m"]), np.array(r["s"], dtype=np.int64))


def _partial(x: DataFrame, dims: int, start, step) -> DataFrame:
    """A row of MATRIX for each task that has vectors: ``step`` folds its batches of whole numbers."""

    @lean
    def run(batches):
        state = None
        for b in batches:
            if b.num_rows:
                state = step(start() if state is None else state, _matrix(b.column("x"), dims, np.int64))
        if state is not None:
            rows, m, s = state
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64()), "m": pa.array([np.ravel(m).tolist()], pa.list_(pa.float64())), "s": pa.array([np.ravel(s).tolist()], pa.list_(pa.int64()))})

    return x.select("x").mapInArrow(run, MATRIX)


def totals(x: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Number of vectors, and the exact sum of each dimension."""
    nothing = np.zeros(0)
    parts = _partial(x, dims, lambda: (0, nothing, np.zeros(dims, dtype=np.int64)), lambda z, a: (z[0] + len(a), nothing, z[2] + a.sum(axis=0)))
    n, _, s = _one(stored(parts, "whiten-sums"), lambda zs: (sum(z[0] for z in zs), nothing, sum(z[2] for z in zs)))
    return n, s


def centred(a: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S/n, each rounded once: n x - S is exact while n is under 10^13."""
    return (a * n - s) / float(n)


def triangle(x: DataFrame, dims: int, n: int, s: np.ndarray) -> np.ndarray:
    """R of the centred vectors' QR factors, at most dims x dims."""
    empty = np.zeros((0, dims))
    none = np.zeros(0, dtype=np.int64)
    stack = lambda r, a: np.linalg.qr(np.vstack([r, a]), mode="r")
    parts = _partial(x, dims, lambda: (0, empty, none), lambda z, a: (z[0] + len(a), stack(z[1], centred(a, n, s)), none))
    _, r, _ = _one(stored(parts, "whiten-triangles"), lambda zs: (sum(z[0] for z in zs), stack(empty, np.vstack([z[1].reshape(-1, dims) for z in zs])), none))
    return r.reshape(-1, dims)


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of ``r``, falling, and its right singular vectors as columns, by one-sided plane rotations.

    A sweep meets every pair of columns once, in rounds of disjoint pairs that are rotated together; it ends with one that rotates nothing.
    """
    dims = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    # Column vectors as rows, so that a rotation touches memory in one piece; an odd number plays with a column of zeros.
    a = np.zeros((dims + dims % 2, r.shape[0]))
    a[:dims] = r.T[order]
    v = np.eye(len(a), dims)
    seats = np.arange(len(a))
    turned = len(a) > 1
    while turned:
        turned = False
        for _ in range(len(a) - 1):
            p, q = seats[: len(a) // 2], seats[: len(a) // 2 - 1 : -1]
            alpha, beta, gamma = (a[p] ** 2).sum(1), (a[q] ** 2).sum(1), (a[p] * a[q]).sum(1)
            hit = (np.abs(gamma) > ORTHOGONAL * len(a) * np.sqrt(alpha * beta)) & (alpha > 0) & (beta > 0)
            if hit.any():
                turned = True
                p, q, gamma = p[hit], q[hit], gamma[hit]
                zeta = (beta[hit] - alpha[hit]) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = (1 / np.hypot(1, t))[:, None]
                sn = c * t[:, None]
                for z in (a, v):
                    z[p], z[q] = c * z[p] - sn * z[q], sn * z[p] + c * z[q]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
    sigma = np.linalg.norm(a, axis=1)
    best = np.argsort(-sigma, kind="stable")[:dims]
    components = np.zeros((dims, len(best)))
    components[order] = v[best].T
    return sigma[best], components / np.linalg.norm(components, axis=0)


def _covariance(x: DataFrame, dims: int, n: int, s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Covariance of the whitened vectors, measured on all of them: centred co-moments of blocks, merged pairwise."""
    k = w.shape[1]
    none = np.zeros(0, dtype=np.int64)

    def join(z, y):
        if z[0] == 0:
            return y
        (na, ma, _), (nb, mb, _) = z, y
        total, d = na + nb, mb[0] - ma[0]
        return total, np.vstack([[ma[0] + d * nb / total], ma[1:] + mb[1:] + np.outer(d, d) * na * nb / total]), none

    def block(a):
        y = centred(a, n, s) @ w
        mean = y.mean(axis=0)
        return len(a), np.vstack([[mean], (y - mean).T @ (y - mean)]), none

    def merge(zs):
        state = (0, None, none)
        for z in zs:
            state = join(state, (z[0], z[1].reshape(k + 1, k), none))
        return state

    parts = _partial(x, dims, lambda: (0, None, none), lambda z, a: join(z, block(a)))
    rows, m, _ = _one(stored(parts, "whiten-moments"), merge)
    return m.reshape(k + 1, k)[1:] / rows


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each remaining row and component."""
    spark = vectors.sparkSession
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    v = vectors.select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("c")).filter(usable(F.col("c")))
    lengths = v.groupBy(F.size("c").alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if lengths is None:
        return spark.createDataFrame([], shape)
    dims = lengths["dims"]
    x = v.filter(F.size("c") == dims).select("vec_id", whole(F.col("c")).alias("x"))
    with tidy(spark):
        n, s = totals(x, dims)
        sigma, basis = jacobi(triangle(x, dims, n, s))
        share = sigma**2 / max((sigma**2).sum(), np.finfo(float).tiny)
        k = int((sigma > RANK * sigma.max(initial=0))[:components].sum())
        if k == 0:
            return spark.createDataFrame([], shape)
        w = basis[:, :k] / (sigma[:k] / np.sqrt(n))
        error = float(np.abs(_covariance(x, dims, n, s, w) - np.eye(k)).max())

    @lean
    def run(batches):
        for b in batches:
            a = _matrix(b.column("x"), dims, np.int64)
            if not len(a):
                continue
            off = a * n - s
            if float(np.abs(off).max()) ** 2 * dims < 2.0**62:
                deviation = pa.array((off * off).sum(axis=1), pa.int64())
            else:
                deviation = pa.array([sum(int(e) ** 2 for e in row) for row in off], pa.int64())
            y = (off / float(n)) @ w
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column("vec_id").take(pa.array(np.repeat(np.arange(len(a)), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(a))),
                "n": pa.array(np.full(len(a) * k, n)), "deviation": deviation.take(pa.array(np.repeat(np.arange(len(a)), k))), "whitened": pa.array(y.ravel()),
                "explained": pa.array(np.tile(share[:k], len(a))), "identity_error": pa.array(np.full(len(a) * k, error)),
            })

    return x.mapInArrow(run, shape)
