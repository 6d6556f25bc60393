"""Exact nearest neighbours from inverted cells: what can't be among the best is not read.

Cells are spherical clusters, fitted on a bounded sample; every vector is stored in the cell of its nearest centroid, in
tiles (a row each, sorted by angle) that a task can multiply at once. For a query q and a vector x whose angles to a
centroid are a and b, q.x is at most |q| |x| cos(a - b) (the triangle inequality of angles). So a query visits cells in the
order of their bounds, in rounds, and stops when no cell can beat its n-th score; inside a tile only the ring of angles
that may still count is multiplied. Nothing is approximate: bounds, not probabilities, rule vectors out. How much they rule
out depends on the data: near nothing of directions that are spread evenly in many dimensions, nearly all of clustered ones.

Defined results: rows with a null vector are in no ranking; vectors have one length; ids may have any type that sorts, and
a repeated one is ranked for each of its rows; ties of the rounded score go to the smaller id; no vectors or queries, no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import top
from tessera.scratch import stored

#: Bounds: vectors that centroids are fitted on, centroids, vectors of a tile, queries of a block.
SAMPLE, CELLS, TILE, BLOCK = 20_000, 4096, 4096, 512
#: A query's first visits, and how many times more it makes in each round.
FIRST, PACE = 2, 8
PLACES = 9
#: Vectors met with all centroids at a time, and bytes of a round's visits up to which they are broadcast.
STEP, SENT = 1024, 8 << 20
#: Slack for rounding, of angles and of scores.
SLACK = 1e-7


@dataclass
class Cells:
    """tiles (cell, slice, n, ids, vectors, norms, angles), and for each cell its centroid, size, angles and greatest norm."""

    tiles: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    lowest: np.ndarray
    highest: np.ndarray
    norms: np.ndarray

    @property
    def n(self) -> int:
        return int(self.sizes.sum())


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, dims)


def _angles(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of rows, and their angles to each centroid; a zero vector is at a right angle to all."""
    norms = np.linalg.norm(v, axis=1)
    cosines = (v / np.where(norms > 0, norms, 1)[:, None]) @ centroids.T
    return norms, np.arccos(np.clip(cosines, -1, 1))


def centroids_of(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from evenly drawn rows; the centroids are ordered along their main direction, so neighbours are near."""
    norms = np.linalg.norm(sample, axis=1, keepdims=True)
    x = np.unique((sample / np.where(norms > 0, norms, 1))[norms[:, 0] > 0], axis=0)
    if not len(x):
        return np.eye(1, sample.shape[1])
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + STEP] @ c.T).argmax(axis=1) for i in range(0, len(x), STEP)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 1e-12, sums / np.where(length > 0, length, 1), c)
    main = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0]
    return c[np.argsort(c @ main, kind="stable")]


def fit(chunks: DataFrame, path: str | None = None, key: str = "chunk_id", vector: str = "embedding", sample: int = SAMPLE) -> Cells:
    """Every vector in its cell, stored (at ``path``). Two narrow passes and one shuffle; the driver sees the sample and a row for each cell."""
    rows = chunks.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    n = rows.count()
    drawn = rows.filter(F.pmod(F.xxhash64("v"), F.lit(max(1, n // sample))) == 0).limit(2 * sample).select("v").toArrow() if n else None
    if not n or not len(drawn):
        drawn = rows.limit(sample).select("v").toArrow()
    if not len(drawn):
        none = np.zeros(0)
        shape = f"cell int, slice int, n int, ids array<{dict(rows.dtypes)['id']}>, vectors array<double>, norms array<double>, angles array<double>"
        return Cells(chunks.sparkSession.createDataFrame([], shape), np.zeros((0, 0)), none, none, none, none)
    dims = len(drawn["v"][0])
    data = _matrix(drawn["v"].combine_chunks(), dims)
    centroids = centroids_of(data, max(1, min(CELLS, math.isqrt(n), len(data) // 4)))

    def assign(batches):
        for b in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            v = _matrix(b.column("v"), dims)
            norms, angles = _angles(v, centroids)
            cell = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), pa.array(norms), pa.array(angles[np.arange(len(v)), cell])], ["id", "v", "cell", "norm", "angle"]
            )

    known = dict(rows.dtypes)["id"]
    dealt = rows.mapInArrow(assign, f"id {known}, v array<double>, cell int, norm double, angle double")
    dealt = stored(dealt, "cells")
    said = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.max("norm").alias("norm")).collect()
    sizes, lowest, highest, norms = (np.zeros(len(centroids)) for _ in range(4))
    for r in said:
        sizes[r["cell"]], lowest[r["cell"]], highest[r["cell"]], norms[r["cell"]] = r["n"], r["lo"], r["hi"], r["norm"]
    # A cell, however large, is cut into slices of a tile's size: rings of its angles would need its quantiles, a hash needs nothing.
    slices = F.broadcast(chunks.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // TILE)) for r in said], "cell int, slices int"))
    sliced = dealt.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("slices")).cast("int"))

    def tile(t: pa.Table) -> pa.Table:
        t = t.sort_by("angle").combine_chunks()
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        column = lambda c: t[c].combine_chunks()
        lists = [one(column("id")), one(column("v").flatten()), one(column("norm")), one(column("angle"))]
        return pa.table([column("cell")[:1], column("slice")[:1], pa.array([len(t)], pa.int32()), *lists], ["cell", "slice", "n", "ids", "vectors", "norms", "angles"])

    shape = f"cell int, slice int, n int, ids array<{known}>, vectors array<double>, norms array<double>, angles array<double>"
    tiles = sliced.select("cell", "slice", "id", "v", "norm", "angle").groupBy("cell", "slice").applyInArrow(tile, shape)
    return Cells(stored(tiles, "tiles", path), centroids, sizes, lowest, highest, norms)


def _bounds(norms: np.ndarray, angles: np.ndarray, cells: Cells) -> np.ndarray:
    """The most that any vector of each cell can score with each query."""
    gap = np.maximum(0, np.maximum(angles - cells.highest, cells.lowest - angles) - SLACK)
    bound = norms[:, None] * cells.norms * np.cos(gap)
    # Beyond a right angle the shortest vector is the best of them: nothing longer than 0 is promised.
    return np.where(cells.sizes > 0, np.where(bound < 0, 0, bound), -np.inf)


def _visits(cells: Cells, begin: int, end: int):
    """From a block of queries and their n-th scores, the cells that they visit in a round: a row for each cell with the queries that go there."""
    dims, k = cells.centroids.shape[1], len(cells.centroids)

    def run(t: pa.Table) -> pa.Table:
        q, tau = _matrix(t["q"].combine_chunks(), dims), np.array([-np.inf if x is None else x for x in t["tau"].to_pylist()])
        norms, angles = _angles(q, cells.centroids)
        bound = _bounds(norms, angles, cells)
        order = np.argsort(-bound, axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(k)[None, :].repeat(len(q), 0), axis=1)
        due = (place >= begin) & (place < end) & (bound > -np.inf) & (bound >= tau[:, None] - SLACK)
        qi = t["qi"].to_numpy()
        out = [(int(c), qi[m].tolist(), q[m].ravel().tolist(), tau[m].tolist(), angles[m, c].tolist()) for c in np.flatnonzero(due.any(axis=0)) if (m := due[:, c]).any()]
        kinds = (pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3)
        columns = [list(c) for c in zip(*out)] or [[]] * 5
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["cell", "qis", "qs", "taus", "own"])

    return run


def _best(score: np.ndarray, ids: list, tau: float, n: int) -> list[int]:
    """Where the best n of a query's scores are, of those not under ``tau``: the rounded score counts, then the smaller id."""
    rounded = np.round(score, PLACES)
    least = np.partition(rounded, -n)[-n] if len(ids) > n else -np.inf
    at = np.flatnonzero(rounded >= max(least, round(tau, PLACES) if math.isfinite(tau) else -np.inf))
    if len(at) <= n:
        return at.tolist()
    above, ties = at[rounded[at] > least], at[rounded[at] == least]
    return [*above.tolist(), *sorted(ties.tolist(), key=lambda x: ids[x])[: n - len(above)]]


def _multiply(dims: int, n: int):
    """Rows (qi, chunk_id, score) of the best n of each query in a tile; a row without a query says how many pairs were multiplied."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                value = lambda c, i=i: b.column(c)[i].values
                qi, t, own = value("qis").to_pylist(), value("taus").to_numpy(), value("own").to_numpy()
                q, angles, norms = value("qs").to_numpy().reshape(-1, dims), value("angles").to_numpy(), value("norms").to_numpy()
                # The ring of angles that may still count for any of these queries.
                reach = np.linalg.norm(q, axis=1) * norms.max()
                some = (t > 0) & (reach > 0)
                wide = np.where(some, np.arccos(np.clip(np.where(some, t - SLACK, 0) / np.where(some, reach, 1), -1, 1)) + SLACK, np.pi)
                lo, hi = np.searchsorted(angles, (own - wide).min()), np.searchsorted(angles, (own + wide).max(), "right")
                ids = value("ids")[lo:hi].to_pylist()
                scores = q @ value("vectors").to_numpy().reshape(-1, dims)[lo:hi].T
                found = [(x, ids[at], float(row[at])) for x, row, tau in zip(qi, scores, t.tolist()) if ids for at in _best(row, ids, tau, n)]
                found.append((None, None, float(scores.size)))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int64(), b.column("ids").type.value_type, pa.float64()))], ["qi", "chunk_id", "score"])

    return run


def topk(queries: DataFrame, cells: Cells, n: int) -> tuple[DataFrame, float]:
    """(qid, chunk_id, score, rank) of the best ``n`` dot products of each query (qid, q), and the share of all (query, vector) pairs that was multiplied."""
    spark, dims, k = queries.sparkSession, cells.centroids.shape[1], len(cells.centroids)
    known = dict(cells.tiles.dtypes)["ids"][len("array<") : -1]
    numbered = stored(queries.select("qid", F.col("q").cast("array<double>").alias("q")).filter("q IS NOT NULL").withColumn("qi", F.monotonically_increasing_id()), "queries")
    n_queries = numbered.count()
    shape = f"qi long, chunk_id {known}, score double"
    if not k or not n_queries:
        empty = spark.createDataFrame([], f"chunk_id {known}, score double, rank int")
        return queries.select("qid").limit(0).join(empty).select("qid", "chunk_id", "score", "rank"), 0.0
    blocks = -(-n_queries // BLOCK)
    bare = Cells(None, cells.centroids, cells.sizes, cells.lowest, cells.highest, cells.norms)

    def home(batches):
        for b in batches:
            q = _matrix(b.column("q"), dims)
            near = (q @ bare.centroids.T).argmax(axis=1) if len(q) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("qi"), b.column("q"), pa.array((near * blocks // k).astype(np.int32))], ["qi", "q", "block"])

    housed = numbered.select("qi", "q").mapInArrow(home, "qi long, q array<double>, block int")
    crowd = F.broadcast(housed.groupBy("block").agg((F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("parts")))
    asked = stored(housed.join(crowd, "block").withColumn("part", F.pmod(F.xxhash64("qi"), F.col("parts")).cast("int")).drop("parts"), "asked")
    best = spark.createDataFrame([], shape)
    begin, end, multiplied = 0, FIRST, 0
    while begin < k:
        tau = best.groupBy("qi").agg(F.when(F.count(F.lit(1)) >= n, F.min("score")).alias("tau"))
        # A number of partitions of its own, as the few bytes of all blocks would be coalesced to one task.
        due = asked.join(tau, "qi", "left").repartition(blocks, "block", "part").groupBy("block", "part").applyInArrow(_visits(bare, begin, end), "cell int, qis array<long>, qs array<double>, taus array<double>, own array<double>")
        # A round's visits carry their queries: far more than the planner guesses from the queries' own size, which it would broadcast.
        most = n_queries * (min(end, k) - begin) * (8 * dims + 24)
        due = F.broadcast(due) if most <= SENT else due.hint("merge")
        seen = Observation()
        # A row without a query says how many pairs were multiplied.
        found = due.join(cells.tiles.select("cell", "ids", "vectors", "norms", "angles"), "cell").select("qis", "qs", "taus", "own", "ids", "vectors", "norms", "angles").mapInArrow(_multiply(dims, n), shape)
        found = found.observe(seen, F.sum(F.when(F.col("qi").isNull(), F.col("score"))).alias("pairs"), F.count(F.lit(1)).alias("visits"))
        best = stored(top(best.unionByName(found.filter("qi IS NOT NULL")), n, ("qi",)).drop("rank"), "best")
        multiplied += seen.get["pairs"] or 0
        if begin and not seen.get["visits"]:
            break
        begin, end = end, end * PACE + FIRST
    ranked = top(best.join(numbered.select("qi", "qid"), "qi"), n, ("qi",))
    return ranked.select("qid", "chunk_id", "score", "rank"), multiplied / (n_queries * cells.n)
