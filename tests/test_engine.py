"""The index's life, search with models, configuration, and the command line, on small pools."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera import __main__ as cli
from tessera import config as K
from tessera import models as M
from tessera.index import Index, ingest
from tessera.operators import arms as A
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.search import Searcher

TOPICS = {"tide": "tide moon harbour wave salt", "kiln": "kiln clay glaze fire oven", "moss": "moss bog peat rain fern"}


def paper(topic, n=3, seed=1):
    draw = random.Random(f"{topic}{seed}")
    words = TOPICS[topic].split()
    body = lambda: " ".join(draw.choice([*words, "the", "and", "of"]) for _ in range(60))
    return f"## On {topic}\n{body()}\n" + "".join(f"## {i} Part {topic} {i}\n{body()}\n\n{body()}\n" for i in range(1, n + 1))


def pool(spark, **papers):
    return spark.createDataFrame([(p, md) for p, md in papers.items()], "paper_id string, markdown string")


def test_index_life(spark, tmp_path):
    at = str(tmp_path / "index")
    index = Index(spark, at, M.HashingEmbedder(), buckets=4)
    assert index.count() == 0 and index.manifest().count() == 0
    rows = {r["paper_id"]: r for r in index.add(pool(spark, a=paper("tide"), b=paper("kiln"))).collect()}
    assert rows["a"]["title"] == "On tide" and rows["a"]["n_chunks"] == index.where(paper_id="a").count() > 0
    before = {r["chunk_id"] for r in index.ids_of("a").collect()}
    whole = index.count()
    # The same again changes nothing; a shorter version takes its stale chunks along, and leaves the other paper.
    index.add(pool(spark, a=paper("tide")))
    assert index.count() == whole and {r["chunk_id"] for r in index.ids_of("a").collect()} == before
    index.add(pool(spark, a=paper("tide", 1)))
    left = {r["chunk_id"] for r in index.ids_of("a").collect()}
    assert left < before and index.ids_of("b").count() == rows["b"]["n_chunks"]
    assert index.by_ids(spark.createDataFrame([(i,) for i in left], "chunk_id string")).count() == len(left)
    assert index.where(paper_id="b", section_number="1").count() == 1
    # Opened again it is the same; another embedder is refused.
    assert Index(spark, at, M.HashingEmbedder()).count() == index.count()
    with pytest.raises(ValueError, match="hashing-32"):
        Index(spark, at, M.HashingEmbedder(16))
    index.remove(pool(spark, a="", b=""))
    assert index.count() == 0 and index.manifest().count() == 0
    assert Index(spark, at, M.HashingEmbedder(16), reset=True).count() == 0


def test_lexical_tables_follow_the_index(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), M.HashingEmbedder(), buckets=2)
    index.add(pool(spark, a=paper("tide")))
    first = index.lexical().corpus.first()["n_docs"]
    assert first == index.count()
    asked = spark.createDataFrame([(1, "kiln glaze")], "qid int, text string")
    assert R.bm25_topk(asked, index.lexical(), 5).count() == 0
    # A term in half of the chunks weighs nothing, so there are two more papers.
    index.add(pool(spark, b=paper("kiln"), c=paper("moss")))
    assert R.bm25_topk(asked, index.lexical(), 5).count() > 0 and index.lexical().corpus.first()["n_docs"] == index.count() > first


def test_ingestion_takes_what_is_missing(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"), M.HashingEmbedder(), buckets=2)
    papers = pool(spark, a=paper("tide"), b=paper("kiln"), c="  ")
    with pytest.raises(ValueError, match="c"):
        ingest(index, papers, fail_fast=True)
    assert [tuple(r) for r in ingest(index, papers).collect()] == [("c", "no text")]
    assert index.manifest().count() == 2
    stamp = {r["chunk_id"] for r in index.chunks().collect()}
    assert ingest(index, papers).count() == 1 and {r["chunk_id"] for r in index.chunks().collect()} == stamp


class Failing:
    def score(self, query, texts):
        if "kiln" in query:
            raise RuntimeError("no model")
        return [1.0] * (len(texts) + ("moss" in query))


class Rewording:
    def complete(self, system, user, max_tokens=0):
        if "moss" in user:
            raise RuntimeError("no answer")
        return f"{user.upper()}\nclay fire\nCLAY fire\nfern rain"


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("s")), M.HashingEmbedder(), buckets=2)
    index.add(pool(spark, a=paper("tide", 6), b=paper("kiln", 6), c=paper("moss", 6)))
    return index


def queries(spark):
    return spark.createDataFrame([(1, "tide and moon"), (2, "kiln glaze"), (3, "moss of the bog")], "qid int, text string")


def test_search_against_plain_python(spark, chunks):
    rows = chunks.chunks().collect()
    found = Searcher(chunks.chunks(), M.HashingEmbedder(), M.OverlapScorer()).search(queries(spark), 2, 5, 8)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for q in queries(spark).collect():
        v = M.HashingEmbedder().query(q["text"])
        dense = sorted(rows, key=lambda r: (-round(cos(v, r["embedding"]), 9), r["chunk_id"]))[:8]
        scores = M.OverlapScorer().score(q["text"], [r["text"] for r in dense])
        order = sorted(range(8), key=lambda i: (-scores[i], i))
        got = sorted((r for r in found.results.collect() if r["qid"] == q["qid"]), key=lambda r: r["rank"])
        assert [r["chunk_id"] for r in got] == [dense[i]["chunk_id"] for i in order][: len(got)] and 2 <= len(got) <= 5
        assert {r["source"] for r in got} == {"dense"}


def test_reasons_and_scopes(spark, chunks):
    reason = lambda found: {r["qid"]: (r["returned"], r["reason"]) for r in found.outcomes.collect()}
    s = Searcher(chunks.chunks(), M.HashingEmbedder(), Failing())
    assert reason(s.search(queries(spark), 2, 4, 6, elbow=False)) == {1: (4, "disabled"), 2: (4, "no_rerank"), 3: (4, "no_rerank")}
    assert reason(s.search(queries(spark), 2, 4, 6, rerank=False)) == {q: (4, "no_rerank") for q in (1, 2, 3)}
    assert reason(s.search(queries(spark), 2, 4, 6))[1] == (4, "no_elbow")
    with pytest.raises(ValueError, match="min_k"):
        s.search(queries(spark), 5, 4)
    with pytest.raises(ValueError, match="scopes"):
        s.recall(queries(spark), per_paper=True)
    scopes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "nowhere")], "qid int, paper_id string")
    assert reason(s.search(queries(spark), 2, 4, 6, scopes, elbow=False)) == {1: (4, "disabled"), 2: (0, "pool_exhausted"), 3: (0, "pool_exhausted")}
    each = s.recall(queries(spark), 7, 2, scopes, per_paper=True).groupBy("qid", "paper_id").count().collect()
    assert {(r["qid"], r["paper_id"]): r["count"] for r in each} == {(1, "a"): 3, (1, "b"): 3}


def test_hybrid_and_variants(spark, chunks):
    s = Searcher(chunks.chunks(), M.HashingEmbedder(), lexical=chunks.lexical(), model=Rewording())
    pool_ = s.recall(queries(spark), 6).collect()
    assert {r["source"] for r in pool_} <= {"dense", "sparse", "both"} and "both" in {r["source"] for r in pool_}
    by = lambda q: {r["paper_id"] for r in pool_ if r["qid"] == q}
    assert "b" in by(1)  # a variant of the first query asks for clay
    assert all(len([r for r in pool_ if r["qid"] == q]) == 6 for q in (1, 2, 3))
    kept = R.distinct_variants(queries(spark), M.variants(queries(spark), Rewording(), 4), 4).collect()
    assert sorted((r["qid"], r["list_no"], r["text"]) for r in kept) == [(q, i, t) for q in (1, 2) for i, t in enumerate(("clay fire", "fern rain"))]


def test_an_arm_is_what_a_search_of_its_own_finds(spark, chunks):
    """Slices of one deep snapshot against recall at each arm's own depth."""
    s = Searcher(chunks.chunks(), M.HashingEmbedder(), lexical=chunks.lexical())
    q, arms = queries(spark), [A.Arm("c4", 4), A.Arm("c9", 9), A.Arm("h4", 4, sparse=True), A.Arm("h6", 6, sparse=True)]
    dense = s._dense(M.query_vectors(q, s.embedder), None, 60, ("qid",)).select("qid", "chunk_id", "rank")
    sparse = s._sparse(q, None, 60, ("qid",)).select("qid", "chunk_id", "rank")
    got = {(r["arm"], r["qid"], r["rank"]): r["chunk_id"] for r in A.pools(R.snapshot(dense, sparse), A.table(spark, arms)).collect()}
    for arm in arms:
        own = Searcher(s.chunks, s.embedder, lexical=s.lexical if arm.sparse else None).recall(q, arm.candidates).collect()
        assert {(arm.arm, r["qid"], r["rank"]): r["chunk_id"] for r in own} == {k: v for k, v in got.items() if k[0] == arm.arm}


def test_report_of_arms(spark):
    """An arm that is better by a mile on thirty papers, and one that is the same."""
    rows = [(arm, q, q % 30, True, True, 1.0 if arm == "good" else 0.25) for arm in ("default", "good", "same") for q in range(90)]
    scored = spark.createDataFrame(rows, "arm string, qid int, cluster int, goldable boolean, in_pool boolean, rr double")
    r = {x["arm"]: x for x in A.confirmed(A.report(scored, "default", 60)).collect()}
    assert r["good"]["mrr_delta_point"] == 0.75 and r["good"]["mrr_delta_detectable"] and r["good"]["confirmed"]
    assert not r["same"]["mrr_delta_detectable"] and not r["same"]["confirmed"] and r["default"]["mrr_delta_point"] is None
    assert r["good"]["weakest"] == 30 and r["good"]["warnings"] == ["saturated"]
    assert tuple(A.candidate_points(A.report(scored, "default", 60)).first()) == (1, "good")
    from tessera import reports

    text = reports.screen(A.report(scored, "default", 60), "default")
    assert text.splitlines()[2].startswith("default") and "better than default: good" in text


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], "qid int, cluster string, value double")
    assert tuple(E.bootstrap(E.clusters(none, F.col("value")), 50).first()) == (0.0, 0.0, 0.0, 0.0, 0, 0)


def test_configuration(tmp_path, monkeypatch):
    file = tmp_path / "tessera.json"
    file.write_text(json.dumps({"data_path": "d", "index_path": "${data_path}/i", "retrieval": {"max_k": 5, "candidates": 9}, "papers": [{"name": "x", "arxiv_id": "2401.00001"}]}))
    below = tmp_path / "a" / "b"
    below.mkdir(parents=True)
    c = K.load(start=below, arguments=["--data_path=e", "--retrieval.min_k=3"])
    assert c.index_path == str((tmp_path / "e/i").resolve()) and (c.retrieval.min_k, c.retrieval.max_k) == (3, 5) and c.papers[0].name == "x"
    for wrong in (["--retrieval.max_k=99"], ["--chunking.overlap_tokens=600"], ["--nothing=1"], ["--papers=[{\"name\": \"a_display\"}]"], ["--faithfulness.entailment_min=0.01"], ["nope"], ["--data_path=${data_path}"]):
        with pytest.raises(ValueError):
            K.load(str(file), wrong)
    monkeypatch.setenv(K.VARIABLE, str(tmp_path / "missing.json"))
    with pytest.raises(FileNotFoundError):
        K.load()
    assert K.add_paper(file, "y", "2401.00001") == "x" and K.add_paper(file, "y", "2402.00002") is None
    assert [p.name for p in K.load(str(file)).papers] == ["x", "y"] and K.remove_paper(file, "x") and not K.remove_paper(file, "x")
    assert K.grid("40,10, 10") == [10, 40] and json.loads(K.block(retrieval__max_k=7)) == {"retrieval": {"max_k": 7}}
    with pytest.raises(ValueError, match="unknown model"):
        M.build(M.EMBEDDERS, "other")


def test_command_line(spark, tmp_path):
    (tmp_path / "pool").mkdir()
    for topic in TOPICS:
        (tmp_path / "pool" / f"{topic}.md").write_text(paper(topic, 4))
    (tmp_path / "tessera.json").write_text(json.dumps({"index_path": "index", "pool_path": "pool", "lexical": {"enabled": True}, "resamples": 60}))
    items = [{"query": f"{TOPICS[t]} {i}", "paper_id": t, "section_number": str(i), "section_title": f"Part {t} {i}"} for t in TOPICS for i in (1, 2)]
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, items)))
    say = lambda *a: cli.main([a[0], f"--config={tmp_path / 'tessera.json'}", *a[1:]], spark)
    assert say("index").startswith("3 papers") and say("index").startswith("3 papers")
    assert "On tide" in say("search", "tide", "moon") and say("search", "tide").splitlines()[-1].startswith("(")
    assert say("run", str(tmp_path / "items.jsonl")).startswith("success@20 1.000")
    text = say("screen", str(tmp_path / "items.jsonl"), "5,20")
    assert [x.split("  ")[0] for x in text.splitlines()[2:6]] == ["default", "candidates=5", "hybrid=on", "rerank=off"]
    compared = [{"query": "tide and kiln 1", "sections": [{"paper_id": t, "number": "1", "title": f"Part {t} 1"} for t in ("tide", "kiln")]}]
    (tmp_path / "two.jsonl").write_text("\n".join(map(json.dumps, compared)))
    grid = say("sweep", str(tmp_path / "items.jsonl"), "64,512", "5").splitlines()
    assert len(grid) == 6 and grid[0].split()[:3] == ["tokens", "candidates", "rerank"]
    groups = say("per-paper", str(tmp_path / "items.jsonl"), "2", "4")
    assert groups.splitlines()[2].startswith("off 20") and "matched 4" in groups and "confirmed: none" in groups and "mean pool: " in groups
    both = say("comparative", str(tmp_path / "two.jsonl"), "4")
    assert both.splitlines()[2].startswith("off 20") and "few" in both
    first = say("confirm", str(tmp_path / "items.jsonl"), "5", str(tmp_path / "marker"))
    assert "confirmed: no" in first and "note: these items" not in first and "looked at 1 times" in say("confirm", str(tmp_path / "items.jsonl"), "6", str(tmp_path / "marker"))
    made = cli.main(["generate", f"--config={tmp_path / 'tessera.json'}", '--model={"kind": "tests.test_agent:Writer"}', str(tmp_path / "made")], spark)
    assert "dev:" in made and "test:" in made and (tmp_path / "made" / "split=dev").exists()
    assert say("cells", "64,128").splitlines()[2].startswith("default") and say("remove", "tide") == "removed: tide"
    with pytest.raises(SystemExit):
        cli.main(["nothing"])
