"""What the hybrid queries share: texts are read for the rankings alone, and gold is no table of all pairs."""

from tessera.operators import arms as A
from tessera.plans import arms, retrieval

SF = "/root/testdata/sf0.01"


def test_lists_are_written_and_read_no_text_again(spark):
    lists = retrieval._rankings(spark, SF)
    plan = lists._jdf.queryExecution().toString()
    assert "documents.parquet" not in plan and "embeddings.parquet" not in plan
    queries, chunks = retrieval._hybrid(spark, SF)
    assert "Join" not in chunks._jdf.queryExecution().toString()
    assert chunks.rdd.getNumPartitions() > 1
    # The same lists from a corpus that is given.
    assert sorted(map(tuple, retrieval._rankings(spark, SF, (queries, chunks)).collect())) == sorted(map(tuple, lists.collect()))


def test_gold_is_what_is_listed_and_one_other(spark, monkeypatch):
    """Clusters are tenths of the corpus: all pairs of a query and its cluster grow with the square of it."""
    seen = {}

    def scores(ranked, gold, queries, *rest):
        seen["gold"], seen["queries"] = gold.count(), queries.count()
        return score(ranked, gold, queries, *rest)

    score = A.scores
    monkeypatch.setattr(A, "scores", scores)
    arms._judged(spark, SF).count()
    clusters = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").count()
    assert seen["queries"] == clusters
    assert seen["gold"] <= seen["queries"] * (1 + 2 * 60) and seen["gold"] < 150
