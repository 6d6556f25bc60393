import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import library as L


def boot(spark, rows):
    s = spark.createDataFrame(rows, "cluster string, value double")
    return E.bootstrap(E.clusters(s, F.col("value")), n_boot=300).first()


def test_one_cluster_has_no_spread(spark):
    assert boot(spark, [("p", float(i % 2)) for i in range(20)])["se"] == pytest.approx(0)


def test_known_gap_is_clear_of_zero(spark):
    r = boot(spark, [(f"p{i}", 0.3 + (0.05 if i % 2 else -0.05)) for i in range(20)])
    assert r["point"] == pytest.approx(0.3) and r["ci_lo"] > 0 and r["n_clusters"] == 20


def test_null_straddles_zero(spark):
    r = boot(spark, [(f"p{i}", 0.2 if i % 2 else -0.2) for i in range(20)])
    assert r["ci_lo"] < 0 < r["ci_hi"]


def test_pairs_need_both_arms(spark):
    schema = "qid int, cluster string, eligible boolean, value double"
    a = spark.createDataFrame([(1, "p", True, 1.0), (2, "p", True, 1.0)], schema)
    b = spark.createDataFrame([(1, "p", True, 0.5), (2, "p", False, 0.0)], schema)
    assert E.paired(a, b).collect()[0]["value"] == 0.5 and E.paired(a, b).count() == 1


def test_scores(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (3, "c", 1)], "qid int, chunk_id string, rank int")
    gold = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "qid int, chunk_id string")
    queries = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, "p")], "qid int, cluster string")
    r = E.summary(E.query_scores(ranked, gold, queries, 3, 20)).first()
    assert r["success"] == pytest.approx(2 / 3) and r["mrr"] == pytest.approx((1 + 1 / 3) / 2) and r["n_ungoldable"] == 1


def test_comparative_needs_every_paper(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 3)], "qid int, chunk_id string, rank int")
    gold = spark.createDataFrame([(1, "pa", "a"), (1, "pb", "b")], "qid int, paper_id string, chunk_id string")
    assert E.comparative_scores(ranked, gold, 5).first()["rr"] == pytest.approx(1 / 3)
    assert not E.comparative_scores(ranked.filter("rank = 1"), gold, 5).first()["in_pool"]


def test_cited_by(spark):
    edges = spark.createDataFrame([("A", "3333.33333", "x", 1), ("A", "4444.44444", "y", 2), ("A", "2222.22222", "z", 3), ("B", "3333.33333", "w", 1)], "paper_id string, arxiv_id string, label string, pos int")
    pooled = spark.createDataFrame([("1111.11111",), ("2222.22222",)], "arxiv_id string")
    assert [tuple(r)[:2] for r in L.cited_by(edges, pooled).collect()] == [("3333.33333", 2), ("4444.44444", 1)]


def test_tags(spark):
    m = spark.createDataFrame([("a", ["moe", "rl"]), ("b", ["moe"])], "paper_id string, tags array<string>")
    assert [tuple(r) for r in L.tag_counts(m).collect()] == [("moe", 2), ("rl", 1)]
    assert [r["tag"] for r in L.discriminating_tags(m).collect()] == ["rl"]


def test_threshold_search_is_exhaustive(spark):
    """Every pair of distinct scores, each judged on all scores in plain Python; ties go to the smaller thresholds."""
    import random

    labels = ("contradiction", "neutral", "entailment")
    draw = random.Random(6)
    rows = [(g, round(min(1.0, max(0.0, draw.gauss(m, 0.2))), 1)) for g, m in zip(labels, (0.2, 0.4, 0.8)) for _ in range(30)] + [("neutral", None)]
    pairs = [(g, s) for g, s in rows if s is not None]

    def judged(c, e):
        pred = [labels[0] if s <= c else labels[2] if s >= e else labels[1] for _, s in pairs]
        out = []
        for x in labels:
            tp, said, gold = sum(p == x == g for p, (g, _) in zip(pred, pairs)), pred.count(x), sum(g == x for g, _ in pairs)
            p, r = tp / said if said else 0.0, tp / gold if gold else 0.0
            out += [p, r, 2 * p * r / (p + r) if p + r else 0.0]
        return out

    values = sorted({s for _, s in pairs})
    every = [(c, e, judged(c, e)) for c in values for e in values if c < e]
    every.sort(key=lambda x: (-round(sum(x[2][2::3]) / 3, 9), x[0], x[1]))
    got = E.threshold_search(spark.createDataFrame(rows, "gold string, score double"), labels, best=7).collect()
    assert [(r["rank"], r["cmax"], r["emin"]) for r in got] == [(k + 1, c, e) for k, (c, e, _) in enumerate(every[:7])]
    for r, (_, _, want) in zip(got, every):
        assert all(abs(a - b) < 1e-9 for a, b in zip([*r][4:], want))
    assert E.threshold_search(spark.createDataFrame([], "gold string, score double"), labels).count() == 0
