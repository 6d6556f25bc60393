"""Text rules, records and readers that no named query shows whole, against written cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import models as M
from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import evaluation as E
from tessera.operators import exports as X
from tessera.operators import library as L
from tessera.sources import files
from tessera.streaming import streams as S


def said(spark, rule, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", rule(F.col("t")).alias("x")).orderBy("i").collect()]


def test_small_rules(spark):
    assert said(spark, T.title, "<!-- ## no -->x\n## One  \n## Two", "none") == ["One", ""]
    assert said(spark, T.slug, "A b/C: d!", "x" * 100) == ["a-b-c-d", "x" * 80]
    assert said(spark, T.heading_slug, " 2.1 Multi-Head: Ärger_x ") == ["21-multi-head-ärger_x"]
    assert said(spark, T.first_json_object, 'x {"a": {"b": 1}} y', "none") == ['{"a": {"b": 1}}', None]
    assert said(spark, T.first_json_array, "x [1, 2] y [3]", "none") == ["[1, 2]", None]
    assert said(spark, T.mode, "COMPARE. then", " compare!_", "I would compare", "", "COMPARED") == ["COMPARE", "COMPARE", "ASK", "ASK", "ASK"]
    assert said(spark, T.sanitised_error, "E: <b>a</b>\n\tb <> c", "x" * 299 + " yz") == ["E: a b <> c", "x" * 299 + "…"]
    assert said(spark, T.approx_tokens, "a b c d", "") == [6, 1]
    assert said(spark, lambda t: F.array_join(T.citation_refs(t), ","), "a [r1, r2] 【r1】 [ r3 ] [r4,r10]") == ["r1,r2,r4,r10"]


def test_tagging_excerpt(spark):
    md = "## Title\nauthors\n## ABSTRACT of it\n" + "\n".join(f"line {i}" for i in range(30)) + "\n## End\nx"
    (got,) = said(spark, T.tagging_excerpt, md)
    assert got.startswith("Title\nline 0\nline 1") and "line 23" in got and "line 24" not in got and got.endswith("Title\nABSTRACT of it\nEnd")
    assert len(said(spark, lambda t: T.tagging_excerpt(t, most=10), md)[0]) == 10


def test_snippets_find_their_place_again(spark):
    text = "Start. The tide (of the moon)\n\nrises   twice a day, every day of the year. End."
    find = lambda snippet: spark.createDataFrame([(text, snippet)], "t string, s string").select(T.reanchored(F.col("t"), F.col("s")).alias("x")).first()["x"]
    got = find("The tide (of the moon) rises twice a day, every day of the year.")
    assert text[got["start"] : got["start"] + got["length"]] == "The tide (of the moon)\n\nrises   twice a day, every day of the year."
    longer = find("The tide (of the moon) rises twice a day, every day of the moon and of the sun and then some more words")
    assert text[longer["start"] : longer["start"] + longer["length"]].startswith("The tide") and longer["length"] < got["length"]
    assert find("too short") is None and find("nothing like this stands in the text at all") is None


def test_images_and_signatures(spark):
    a, b = "0123456789abcdef", "fedcba9876543210"
    md = f"![x](i/p_{a}.png) t ![y](i/q_{b}.png) ![z](i/r_{a}.png)"
    got = C.repeated_images(spark.createDataFrame([("p", md)], "paper_id string, markdown string")).orderBy("pos").collect()
    assert [(r["hash"], r["keep"]) for r in got] == [(a, True), (b, True), (a, False)]
    assert C.cell_signature("e", a=1, b=2) == C.cell_signature("e", b=2, a=1) != C.cell_signature("e", a=1, b=3)
    pool = spark.createDataFrame([(f"p{i}", "x" * i) for i in range(50)], "paper_id string, markdown string")
    one = C.fingerprint(pool, 8).first()[0]
    assert one == C.fingerprint(pool.repartition(3), 8).first()[0] != C.fingerprint(pool.filter("paper_id != 'p7'"), 8).first()[0]


def test_holdout_is_the_least_hashes(spark):
    for n in (1, 2, 3, 200):
        papers = spark.range(n).select(F.concat(F.lit("p"), "id").alias("paper_id"))
        rows = papers.withColumn("h", T.hashed_int(F.lit("7"), F.col("paper_id"))).collect()
        want = {r["paper_id"] for r in sorted(rows, key=lambda r: (r["h"], r["paper_id"]))[: round(n * 0.25) if n > 1 else 0]}
        got = E.holdout(papers).collect()
        assert {r["paper_id"] for r in got if r["split"] == "test"} == want and len(got) == n
    assert E.holdout(papers.limit(0)).count() == 0


def test_judgements(spark):
    rows = spark.createDataFrame([(30, 0.5, 0.2, 0.1, 0.3, 0.1), (10, 0.99, 0.2, -0.1, 0.3, 0.1), (30, 0.5, 0.05, 0.01, 0.2, 0.1)], "n int, p double, d double, lo double, hi double, mdd double")
    got = rows.select(E.warnings(F.col("n"), F.col("p")).alias("w"), E.detectable(F.col("d"), F.col("lo"), F.col("hi"), F.col("mdd")).alias("x")).collect()
    assert [(r["w"], r["x"]) for r in got] == [([], True), (["few_clusters", "saturated"], False), ([], False)]


def test_a_paper_goes_everywhere(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "paper_id string, n int")
    config, chunks = L.remove_everywhere(spark.createDataFrame([("a",)], "paper_id string"), t, t.union(t))
    assert [r["paper_id"] for r in config.collect()] == ["b"] and chunks.count() == 2
    notes = spark.createDataFrame([("a", "Tide", "see MOON", 1), ("a", "x", "later", 2), ("b", "y", "z", 3)], "paper_id string, snippet string, note string, created_at int")
    manifest = spark.createDataFrame([("a", "Paper A"), ("b", "Paper B")], "paper_id string, title string")
    assert [r["note"] for r in L.notes(notes, manifest).collect()] == ["later", "see MOON", "z"]
    assert [r["note"] for r in L.notes(notes, manifest, "moon").collect()] == ["see MOON"]
    assert L.markdown_notes(L.notes(notes, manifest)).orderBy("title").first()["markdown"] == "## Paper A\n\n> x\n\nlater\n\n> Tide\n\nsee MOON"
    with pytest.raises(ValueError, match="vote"):
        L.feedback(t, F.lit("a"), F.lit(1), "maybe")


def test_readers(spark, tmp_path):
    item = {"query": "q", "paper_id": "p", "gold_span": [1, 2], "section_title": "t"}
    (tmp_path / "ok.jsonl").write_text(json.dumps(item) + "\n\n" + json.dumps({**item, "query": "r"}))
    assert [r["query"] for r in files.read_items(spark, str(tmp_path / "ok.jsonl")).orderBy("query").collect()] == ["q", "r"]
    (tmp_path / "old.jsonl").write_text(json.dumps({"query": "q", "paper_id": "p"}))
    with pytest.raises(ValueError, match="section_title"):
        files.read_items(spark, str(tmp_path / "old.jsonl"))
    (tmp_path / "two.jsonl").write_text(json.dumps({"query": "q", "sections": [{"paper_id": "a", "title": "x", "start": 0, "end": 3}, {"paper_id": "b", "title": "y"}]}))
    assert [s["paper_id"] for s in files.read_comparative(spark, str(tmp_path / "two.jsonl")).first()["sections"]] == ["a", "b"]
    (tmp_path / "chats").mkdir()
    (tmp_path / "chats" / "a.json").write_text('{"id": "a",\n "n": 1}')
    (tmp_path / "chats" / "b.json").write_text('{"id": "b", ')
    assert [r["id"] for r in files.read_records(spark, str(tmp_path / "chats"), "id string, n int").collect()] == ["a"]
    rows = spark.createDataFrame([(1, "dev", False), (2, "test", None), (3, "dev", True)], "i int, split string, leaked boolean")
    files.write_splits(rows, str(tmp_path / "out"), "leaked")
    assert {(r["i"], r["split"]) for r in spark.read.json(str(tmp_path / "out")).collect()} == {(1, "dev"), (2, "test"), (3, "leaked")}


def test_streams_with_watermarks(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(200)
    events.unionByName(events.limit(50)).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, plan, mode in (("once", S.without_repeats(stream), "append"), ("sessions", S.sessions(stream, late="1 hour"), "append")):
        q = plan.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(120)
    assert spark.table("once").count() == events.select("event_id").distinct().count()
    assert spark.table("sessions").agg(F.sum("n")).first()[0] is not None


def test_checkers(spark):
    pairs = spark.createDataFrame([("the tide rises twice", "tide rises"), ("nothing", "tide"), (None, "")], "passage string, sentence string")
    assert [r["score"] for r in M.checked(pairs, M.OverlapChecker()).collect()] == [1.0, 0.0, 0.0]


def test_a_conversation_as_markdown(spark):
    cite = [("r2", "p", "Paper", "Method", "2401.00001", None, "it says so", "neutral"), ("r1", None, "Page", None, None, "https://h.example/x", "a page", None), ("r9", "q", "Unused", "s", None, None, "", None)]
    turns = [
        ("c", 0, "# What <b>is</b> it?\n1. first", "It is [r2, r1], so [r7].", cite, [("thought", "think ``` it", None), ("action", "tides", "p")], 1, 0, 1250, "down", "no"),
        ("c", 1, "And?", "Again [r1].", cite, [], None, None, 900, None, None),
    ]
    schema = f"chat_id string, turn int, question string, answer string, citations array<{X.CITATION}>, trace array<struct<kind:string,text:string,paper:string>>, input_tokens long, output_tokens long, latency_ms long, vote string, note string"
    (text,) = [r["markdown"] for r in X.conversations(spark.createDataFrame(turns, schema), "My chat").collect()]
    assert text == (
        "# My chat\n\n## Turn 1\n\n**Q:** \\# What &lt;b&gt;is&lt;/b&gt; it?\n1\\. first\n\nIt is [^t1-2][^t1-1], so [r7].\n\n"
        '<details>\n<summary>Reasoning</summary>\n\n````\nThought: think ``` it\n\nAction: search "tides" (p)\n````\n\n</details>\n\n'
        "<details>\n<summary>Sources</summary>\n\n```\nPaper — https://arxiv.org/abs/2401.00001\n\n[2] Method  ⚠️ the passage doesn't say so\nit says so\n\nFrom the web:\n\n[1] Page — https://h.example/x\na page\n```\n\n</details>\n\n"
        "_1 token · 1.3s_\n\n**Feedback:** 👎 — no\n\n---\n\n## Turn 2\n\n**Q:** And?\n\nAgain [^t2-1].\n\n"
        "<details>\n<summary>Sources</summary>\n\n```\nFrom the web:\n\n[1] Page — https://h.example/x\na page\n```\n\n</details>\n\n_0.9s_\n\n"
        "## References\n\n[^t1-1]: **Page** — https://h.example/x\n\n[^t1-2]: **Paper** — Method, https://arxiv.org/abs/2401.00001\n\n[^t2-1]: **Page** — https://h.example/x"
    )


def test_sentence_spans_of_a_long_text(spark):
    """Some 6,000 sentences in a text: what is looked up for each sentence is worked out once, so this takes seconds."""
    import time

    from pyspark.sql import functions as F

    from tessera.functions import text as T

    said = " " + "  ".join(f"Sentence {i} of many, é and 𝄞." for i in range(6000)) + "\n"
    df = spark.createDataFrame([(said,), ("",), (" . ",), ("no end",)], "text string")
    begin = time.time()
    rows = df.select("text", T.sentence_spans(F.col("text")).alias("s")).collect()
    assert time.time() - begin < 30
    assert len(rows[0]["s"]) == 6000
    for r in rows:
        assert all(r["text"][s["start"] : s["end"]] == s["sentence"] and s["sentence"].strip() for s in r["s"])
