"""Pruned neighbours against all dot products, on clustered, even and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import vectors as V


def exact(queries, rows, n):
    """(qid, rank, id, score): every product, rounded to nine places, ties by id."""
    out = []
    for qid, q in queries:
        scored = sorted(((-round(float(np.dot(q, v)), 9), i) for i, v in rows if v is not None))
        out += [(qid, k + 1, i, -s) for k, (s, i) in enumerate(scored[:n])]
    return sorted(out)


def found(df):
    return sorted((r["qid"], r["rank"], r["chunk_id"], round(r["score"], 9)) for r in df.collect())


def frames(spark, queries, rows, kind="long"):
    as_list = lambda v: None if v is None else [float(x) for x in v]
    chunks = spark.createDataFrame([(i, as_list(v)) for i, v in rows], f"chunk_id {kind}, embedding array<double>")
    return spark.createDataFrame([(q, as_list(v)) for q, v in queries], "qid int, q array<double>"), chunks


def clustered(n, centres, dims, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_clusters_are_read_in_part(spark):
    x = clustered(3000, 40, 24, 0.05, 1)
    rows, queries = list(enumerate(x)), [(i, x[i]) for i in range(0, 3000, 100)]
    q, chunks = frames(spark, queries, rows)
    got, share = V.topk(q, V.fit(chunks.repartition(6)), 5)
    assert found(got) == exact(queries, rows, 5)
    assert share < 0.2


def test_even_directions_lengths_and_ties(spark, monkeypatch):
    """No unit vectors, a hot vector that a third of the rows have, zeros, nulls, and tiles and blocks of a few rows."""
    monkeypatch.setattr(V, "TILE", 16)
    monkeypatch.setattr(V, "BLOCK", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * rng.exponential(size=(200, 1))
    rows = [(f"v{i:03}", v) for i, v in enumerate(x)] + [(f"hot{i:03}", x[7]) for i in range(100)] + [("zero", np.zeros(5)), ("none", None), ("v003", x[3])]
    queries = [(i, x[i]) for i in range(12)] + [(50, np.zeros(5)), (51, -x[7]), (52, x[7])]
    q, chunks = frames(spark, queries, rows, "string")
    for n in (1, 7, 40):
        got, share = V.topk(q, V.fit(chunks.repartition(5)), n)
        assert found(got) == exact(queries, rows, n)
        assert 0 < share <= 1


def test_more_asked_than_there_is(spark):
    rows, queries = [(1, np.array([1.0, 0.0])), (2, np.array([0.6, 0.8]))], [(1, np.array([0.0, 1.0]))]
    q, chunks = frames(spark, queries, rows)
    cells = V.fit(chunks)
    assert found(V.topk(q, cells, 9)[0]) == exact(queries, rows, 9)
    assert V.topk(q.limit(0), cells, 9)[0].count() == 0
    assert V.topk(q, V.fit(chunks.limit(0)), 9)[0].count() == 0
    assert V.topk(q, V.fit(chunks.withColumn("embedding", F.lit(None).cast("array<double>"))), 9)[0].count() == 0


def test_only_few_visits_are_broadcast(spark, monkeypatch):
    """Visits over the bound go by a shuffle, whatever the planner takes their size for; the rows are the same."""
    monkeypatch.setattr(V, "SENT", 20_000)
    plans, write = [], V.stored

    def seen(df, what, *path):
        if what == "best":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString())
        return write(df, what, *path)

    monkeypatch.setattr(V, "stored", seen)
    x = np.random.default_rng(5).normal(size=(600, 8))
    rows, queries = list(enumerate(x)), [(i, x[i]) for i in range(0, 600, 10)]
    q, chunks = frames(spark, queries, rows)
    assert found(V.topk(q, V.fit(chunks.repartition(4)), 5)[0]) == exact(queries, rows, 5)
    assert len(plans) > 1 and "BroadcastHashJoin [cell" in plans[0]
    assert all("SortMergeJoin [cell" in p for p in plans[1:])


@pytest.mark.parametrize("k", [1, 3, 50])
def test_centroids_are_unit_vectors_of_distinct_rows(k):
    x = np.vstack([np.eye(4), np.zeros((2, 4)), np.eye(4)])
    c = V.centroids_of(x, k)
    assert len(c) == min(k, 4) and np.allclose(np.linalg.norm(c, axis=1), 1)
