"""Scorers and embedders over clients, replies with a schema, tags, and small lookups."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import models as M
from tessera.functions import text as T
from tessera.operators import library as L
from tessera.sources import files


class Says:
    def __init__(self, *replies):
        self.replies, self.asked = list(replies), []

    def complete(self, system, user, max_tokens=0):
        self.asked.append(user)
        return self.replies.pop(0)


def predict(pairs):
    return [float(len(q) * len(t)) for q, t in pairs]


def vectors(texts, kind):
    return [[float(len(t)), 1.0 if kind == "query" else 0.0] for t in texts]


def test_scorers():
    assert M.build(M.SCORERS, "pairs", predict="tests.test_models:predict", batch=2).score("ab", ["x", "yy", "zzz"]) == [2.0, 4.0, 6.0]
    model = Says("Sure: [7, \"x\", null", "[1]", "scores [3, 2.5, \"4\"]")
    scorer = M.ModelScorer(model, most=5, batch=3)
    assert scorer.score("q", ["a", "b", "c", "long text here"]) == [0.0, 0.0, 0.0, 1.0] and "long " in model.asked[1] and "long t" not in model.asked[1]
    assert scorer.score("q", ["a", "b"]) == [3.0, 2.5] and scorer.score("q", []) == []
    found = lambda q, texts: [{"index": 2, "relevance_score": 0.9}, {"index": 9, "score": 1}, {"index": 0, "score": 0.5}]
    assert M.ServiceScorer(found).score("q", ["a", "b", "c"]) == [0.5, 0.0, 0.9] and M.ServiceScorer(found).score("q", []) == []


def test_the_column_twin_reads_the_same_numbers(spark):
    replies = ["scores: [1, 2.5, \"x\", null, 4]", "none", "[7]", "[1, 2, 3]", "[oops", "a [] b [9]"]
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string").select("i", T.first_numbers(F.col("r"), F.lit(3)).alias("n")).collect()
    assert {r["i"]: r["n"] for r in rows} == {i: M.numbers_of(r, 3) for i, r in enumerate(replies)}


def test_embedders_tell_documents_from_queries():
    e = M.build(M.EMBEDDERS, "service", name="s", client="tests.test_models:vectors", document_prefix="d: ", query_prefix="query: ", batch=1)
    assert e.documents(["ab", "c"]) == [[5.0, 0.0], [4.0, 0.0]] and e.query("ab") == [9.0, 1.0]
    unit = M.ServiceEmbedder("s", lambda texts, kind: [[3.0, 4.0], [0.0, 0.0]][: len(texts)], unit=True)
    assert unit.documents(["a", "b"]) == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(ValueError, match="1 vectors of 2"):
        M.ServiceEmbedder("s", lambda texts, kind: [[1.0]]).documents(["a", "b"])


def test_replies_with_a_schema():
    schema = {"title": "string", "n": "integer", "tags": "array"}
    good = {"title": "a } b", "n": 3, "tags": [], "more": 1}
    assert M.structured(Says(f"Here {{you}} go: {json.dumps(good)} and more"), "s", "u", schema) == {k: good[k] for k in schema}
    model = Says("no", json.dumps(good | {"n": True}), json.dumps(good))
    assert M.structured(model, "s", "u", schema)["n"] == 3 and "no JSON" in model.asked[1] and "n must be of type integer" in model.asked[2]
    with pytest.raises(ValueError, match="title must be"):
        M.structured(Says(*['{"n": 1, "tags": []}'] * 3), "s", "u", schema)


def test_snippets_stay_in_their_section(spark):
    same = "the very same passage stands here twice"
    text = f"First: {same}. Second:  {same.replace(' ', '  ')}."
    second = text.index("Second")
    row = spark.createDataFrame([(text, same, second, len(text))], "t string, s string, a int, b int")
    at = lambda a, b: row.select(T.reanchored_in(F.col("t"), F.col("s"), a, b).alias("x")).first()["x"]
    assert at(F.col("a"), F.col("b"))["start"] == text.index("the  very") and at(F.lit(None).cast("int"), F.col("b"))["start"] == text.index("the very")
    assert at(F.lit(0), F.lit(10)) is None


def test_papers_to_show_and_the_first_ones(spark, tmp_path):
    for name, text in {"b": "text", "a": "plain", "a_display": "pretty", "c": "x"}.items():
        (tmp_path / f"{name}.md").write_text(text)
    asked = spark.createDataFrame([("a",), ("b",), ("z",)], "paper_id string")
    assert {r["paper_id"]: r["markdown"] for r in files.shown(spark, str(tmp_path), asked).collect()} == {"a": "pretty", "b": "text", "z": None}
    assert [r["paper_id"] for r in files.load_pool(spark, str(tmp_path), 2).collect()] == ["a", "b"]


def test_chats_are_deleted(spark):
    turns = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "chat_id string, turn int")
    assert [tuple(r) for r in L.without_chat(turns, turns.filter("turn = 1").select("chat_id")).collect()] == [("b", 0)]
