"""Block-bounded BM25 against the formula, and what it reads."""

import random

from tests.test_retrieval import plain_bm25

from tessera.operators import blockmax as B


def expected(docs, asked, n):
    out = set()
    for q, text in asked.items():
        scores = {d: round(x, 9) for d, x in plain_bm25(docs, text).items() if round(x, 9) > 0}
        out |= {(q, k + 1, d) for k, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:n])}
    return out


def told(df):
    return {(r["qid"], r["rank"], r["chunk_id"]) for r in df.collect()}


def corpus(n, seed):
    """Rows of very different lengths, a word in every row, one in a third of them, rare ones, and equal rows."""
    draw = random.Random(seed)
    text = lambda: " ".join(draw.choice(["the", "Tide", "moor", "kiln", f"w{draw.randrange(40)}", f"r{draw.randrange(n)}"]) for _ in range(draw.choice([2, 8, 40])))
    docs = {f"d{i:03}": "the " + text() for i in range(n)}
    return docs | {f"e{i:03}": "the same rare tide" for i in range(n // 3)}


ASKED = {1: "tide moor", 2: "the the kiln", 3: "w7 w8 absent", 4: "absent", 5: "rare", 6: "", 7: "r1 r2 r3 kiln the"}


def test_same_rows_as_the_formula(spark, tmp_path, monkeypatch):
    docs = corpus(120, 4)
    chunks, queries = spark.createDataFrame(list(docs.items()), "chunk_id string, text string"), spark.createDataFrame(list(ASKED.items()), "qid int, text string")
    B.build(chunks.repartition(3), str(tmp_path), shard=30, run=4)
    index = B.load(spark, str(tmp_path))
    for n in (1, 6, 200):
        assert told(B.topk(queries, index, n)[0]) == expected(docs, ASKED, n)
    # Queries that go to the shards in several blocks find the same.
    monkeypatch.setattr(B, "TERMS", 3)
    assert told(B.topk(queries, index, 6)[0]) == expected(docs, ASKED, 6)


def test_runs_beyond_the_pivot_are_not_read(spark):
    """Two rows have a rare word and a common one; rows with the common one alone can't be among the best two."""
    docs = {f"d{i:04}": "sea " + " ".join(f"x{i % 7}" for _ in range(5)) for i in range(2000)} | {"a": "sea glass glass", "b": "sea glass"} | {f"o{i:04}": "land" for i in range(3000)}
    queries = spark.createDataFrame([(1, "sea glass")], "qid int, text string")
    ranked, work = B.topk(queries, B.build(spark.createDataFrame(list(docs.items()), "chunk_id string, text string"), shard=100_000, run=32), 2)
    assert told(ranked) == expected(docs, {1: "sea glass"}, 2)
    row = work.first()
    assert row["n_postings"] == 2004 and row["n_read"] <= 2 * 32 + 2


def test_nothing_to_rank(spark):
    chunks, queries = spark.createDataFrame([("a", "x y"), ("b", None)], "chunk_id string, text string"), spark.createDataFrame([(1, "x")], "qid int, text string")
    assert B.topk(queries.limit(0), B.build(chunks), 3)[0].count() == 0
    assert B.topk(queries, B.build(chunks.limit(0)), 3)[0].count() == 0
    assert B.topk(queries, B.build(chunks.filter("text IS NULL")), 3)[0].count() == 0


def test_shards_are_bounded_by_bytes_and_texts_are_shuffled_once(spark, monkeypatch):
    """Long rows make more shards, of which a task holds one; words and postings are grouped where the texts are."""
    plans, write = {}, B.stored

    def stored(df, what, path=None):
        plans[what] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, what, path)

    monkeypatch.setattr(B, "stored", stored)
    monkeypatch.setattr(B, "SHARD_BYTES", 2000)
    docs = corpus(120, 9)
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id string, text string")
    index = B.build(chunks, run=4)
    assert plans["blocks"].count("Exchange hashpartitioning") == 1
    bytes_ = sum(len(t) for t in docs.values())
    assert index.rows.select("shard").distinct().count() > bytes_ / 2000 / 2
    queries = spark.createDataFrame(list(ASKED.items()), "qid int, text string")
    assert told(B.topk(queries, index, 6)[0]) == expected(docs, ASKED, 6)
