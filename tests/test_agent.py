"""Agent, generation and fetching with models and clients that say what the test wrote."""

import json

import pytest
from pyspark.sql import functions as F

from tessera import agent as G
from tessera import generation as Q
from tessera import models as M
from tessera.index import Index
from tessera.search import Searcher
from tessera.sources import fetch
from tests.test_engine import paper, pool


class Script:
    """Replies in order, and what it was asked with."""

    def __init__(self, *replies):
        self.replies, self.seen = list(replies), []

    def reply(self, system, messages, tools):
        self.seen.append((system, list(messages), list(tools)))
        r = self.replies[min(len(self.seen), len(self.replies)) - 1]
        if isinstance(r, Exception):
            raise r
        return r


def call(query, **more):
    return G.Reply("looking", [("search_papers", {"query": query, **more})], 10, 1)


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    index = Index(spark, str(tmp_path_factory.mktemp("agent")), M.HashingEmbedder(), buckets=2)
    index.add(pool(spark, a=paper("tide"), b=paper("kiln"), c=paper("moss")))
    tags = spark.createDataFrame([("a", ["sea", "all"]), ("b", ["oven", "all"]), ("c", ["all"])], "paper_id string, tags array<string>")
    return index.chunks(), index.manifest().drop("tags").join(tags, "paper_id")


def made(spark, library, script, **more):
    return G.Agent(spark, Searcher(library[0], M.HashingEmbedder(), M.OverlapScorer()), library[1], script, min_k=1, max_k=2, candidates=4, **more)


def test_catalogue_and_mode(library):
    assert G.catalogue(library[1]) == "a (On tide; sea, all), b (On kiln; oven, all), c (On moss; all)"
    assert G.catalogue(library[1], ["c"]) == "c (On moss; all)" and G.catalogue(library[1], []) == "(none)"

    class Says:
        def __init__(self, text):
            self.text = text

        def complete(self, system, user, max_tokens=0):
            if self.text is None:
                raise RuntimeError
            return self.text

    assert [G.classify("q", ["a", "b"], Says(t)) for t in ("COMPARE.", "compare", "I compare", "", None)] == ["compare", "compare", "ask", "ask", "ask"]
    assert G.classify("q", ["a"], Says("COMPARE")) == "ask"


def test_a_run_searches_cites_and_ends(spark, library):
    script = Script(call("tide moon"), call("kiln", paper="b"), G.Reply("It is so [r1].", [], 5, 5))
    got = made(spark, library, script, checker=M.OverlapChecker()).run([{"role": "user", "content": "?"}], first_ref=3)
    assert got.text == "It is so [r1]." and [c["ref"] for c in got.citations] == [f"r{i}" for i in range(4, 4 + len(got.citations))]
    assert {c["paper_id"] for c in got.citations[-2:]} == {"b"} and (got.input_tokens, got.output_tokens) == (25, 7)
    assert [t["kind"] for t in got.trace] == ["thought", "action", "observation"] * 2 and "faithfulness" not in got.citations[0]
    assert script.seen[0][2] == ["search_papers"] and "a (On tide" in script.seen[0][0]
    # A scope rules papers out, also those that the model names; an empty query and an unknown tool are told so.
    out = made(spark, library, Script(call("tide", paper="b"), call(""), G.Reply("", [("fly", {"query": "x"})], 1, None), G.Reply("done"))).run([], scope=["a"])
    assert not out.citations and out.output_tokens is None and [t["text"] for t in out.trace if t["kind"] == "observation"] == ["Nothing found."]


def test_the_last_round_has_no_tools_and_a_stop_is_heeded(spark, library):
    script = Script(call("tide"), call("tide"), G.Reply("at last"))
    got = made(spark, library, script, rounds=2).run([])
    assert [s[2] for s in script.seen] == [["search_papers"], []] and got.text == "looking"
    assert made(spark, library, Script(call("tide"))).run([], stop=lambda: True).text == ""


def test_claims_are_checked_sentence_by_sentence(spark, library):
    agent = made(spark, library, Script(G.Reply("x")), checker=M.OverlapChecker())
    out = G.Answer("The tide rises [r1]. Pigs fly over it [r1, r2]! Nobody said this [r9].", [{"ref": "r1", "paper_id": "a", "body": "The moon pulls. The tide rises daily."}, {"ref": "r2", "paper_id": None, "body": "web"}])
    agent.check(out)
    claims = {c["sentence"]: (c["label"], round(c["score"], 2)) for c in out.citations[0]["faithfulness"]}
    assert claims["The tide rises ."] == ("entailment", 1.0) if "The tide rises ." in claims else claims["The tide rises."] == ("entailment", 1.0)
    assert any(label == "contradiction" for label, _ in claims.values()) and "faithfulness" not in out.citations[1]


def test_comparison_keeps_a_failed_paper(spark, library):
    script = Script(call("tide"), G.Reply("A says [r1].", [], 1, 1), RuntimeError("down"), G.Reply("Both.", [], 2, 2))
    rows = []
    out, told = made(spark, library, script).compare([{"role": "user", "content": "?"}], ["a", "b"], on_row=rows.append)
    assert out.text == "Both." and [r["text"] for r in told] == ["A says [r1].", G.FAILED] and rows == told and told[0]["title"] == "On tide"
    assert out.citations == told[0]["citations"] and (out.input_tokens, out.output_tokens) == (13, 4)
    with pytest.raises(ValueError, match="two papers"):
        made(spark, library, script).compare([], ["a"])


def test_web_results_are_cited_to_their_pages(spark, library):
    search = lambda q: [{"url": "https://h.example/x", "title": "X", "body": "page"}]
    out = made(spark, library, Script(G.Reply("", [("web_search", {"query": "x"})]), G.Reply("[r1]")), web=search).run([])
    assert out.citations == [{"ref": "r1", "paper_id": None, "url": "https://h.example/x", "title": "X", "body": "page", "snippet": "page"}]


class Writer:
    def complete(self, system, user, max_tokens=0):
        if system == Q.SPOT:
            names = [line.split(":")[0].removeprefix("Paper ") for line in user.splitlines() if line.startswith("Paper ")]
            group = [{"paper_id": p, "section_number": "1", "section_title": f"Part {t} 1"} for p, t in (("a", "tide"), ("b", "kiln"), ("c", "moss")) if p in names]
            return "groups: " + json.dumps([group, group[:1], [{**group[0], "section_title": "invented"}, group[-1]]])
        if "kiln 2" in user:
            raise RuntimeError("busy")
        if "tide 3" in user and system == Q.ASK:
            return "no question comes to mind"
        return 'Here: {"question": " What of ' + user.split()[1] + '? ", "answer": "the moon"} ok'


class Knowing:
    def complete(self, system, user, max_tokens=0):
        if "kiln" in user:
            raise RuntimeError("busy")
        return "The moon." if "tide" in user else "no idea"


def test_questions_on_sections(spark):
    md = pool(spark, a=paper("tide"), b=paper("kiln"))
    rows = Q.items(md, Writer()).collect()
    good, bad = [r for r in rows if r["query"]], [r for r in rows if r["error"]]
    assert {(r["paper_id"], r["section_number"]) for r in good} == {("a", "1"), ("a", "2"), ("b", "1"), ("b", "3")} and [r["section_title"] for r in bad] == ["Part kiln 2"]
    text = paper("tide")
    assert good[0]["query"].startswith("What of") and all(text[r["gold_span"][0] : r["gold_span"][1]].strip() for r in good if r["paper_id"] == "a")
    checked = {r["paper_id"]: (r["leaked"], r["check_error"] is None) for r in Q.leak_check(Q.items(md, Writer()).filter("query IS NOT NULL"), Knowing()).collect()}
    assert checked == {"a": (True, True), "b": (False, False)}


def test_trials_end_at_their_target(spark):
    md, seen = pool(spark, a=paper("tide"), b=paper("kiln"), c=paper("moss")), []
    got = Q.comparisons(md, Writer(), target=3, trials=10, each=seen.append)
    assert 3 <= len(got.items) == len(seen) and got.trials <= 10 and got.hit_rate() == len(got.items) / got.trials and sum(got.pairs.values()) >= 3
    assert all(len({s["paper_id"] for s in i["sections"]}) == len(i["sections"]) >= 2 and i["query"] for i in got.items)
    with pytest.raises(ValueError):
        Q.comparisons(md, Writer(), least=5, most=4)
    with pytest.raises(ValueError, match="fewer"):
        Q.comparisons(md, Writer(), least=4, most=9)


def client(url):
    if "down" in url:
        raise OSError("no route")
    kind = {"png": "image/png", "html": "text/html; charset=utf-8"}.get(url.rsplit(".", 1)[-1], "text/html")
    return (b"x" * 50 if "big" in url else b"<p>arXiv:2401.00001v3</p>"), kind


def test_fetching(spark):
    urls = spark.createDataFrame([(u,) for u in ("https://arxiv.org/a.png", "https://arxiv.org/a.png", "https://x.arxiv.org/big.png", "https://evil.example/b.png", "javascript:x", "https://arxiv.org/down.png", None)], "url string")
    got = {r["url"]: (r["name"], r["error"]) for r in fetch.figures(urls, client, most=40).collect()}
    assert got["https://arxiv.org/a.png"][0].endswith(".png") and got["https://x.arxiv.org/big.png"][1] == "more than 40 bytes" and len(got) == 5
    assert got["https://evil.example/b.png"][1] == got["javascript:x"][1] == "address not allowed" and got["https://arxiv.org/down.png"][1] == "OSError: no route"
    ids = spark.createDataFrame([("p", "2401.00001"), ("q", "down"), ("r", "z.png")], "paper_id string, arxiv_id string")
    pages = {r["paper_id"]: r for r in fetch.papers(ids, client).collect()}
    assert pages["p"]["version"] == "2401.00001v3" and "OSError" in pages["q"]["error"] and pages["r"]["error"].startswith("not text/html")
    known = spark.createDataFrame([("https://arxiv.org/down.png", bytearray(b"old"), "image/png", None)], fetch.FETCHED)
    again = fetch.fetched(urls.filter("url LIKE '%down%'"), client, known).collect()
    assert [(bytes(r["body"]), r["error"]) for r in again] == [(b"old", None)]
    files = spark.createDataFrame([("a", bytearray(b"pdf")), ("b", bytearray(b"bad"))], "path string, content binary")
    assert {r["path"]: (r["markdown"], r["error"]) for r in fetch.converted(files, lambda d: d.decode().replace("bad", "") or 1 // 0).collect()} == {"a": ("pdf", None), "b": (None, "ZeroDivisionError: integer division or modulo by zero")}
    found = fetch.web_results(spark.createDataFrame([("ok",), ("fail",)], "query string"), lambda q, k: [{"href": "https://h/1", "title": "t", "body": "b"}, {"href": "javascript:x"}] if q == "ok" else 1 // 0).collect()
    assert [(r["query"], r["url"]) for r in found] == [("ok", "https://h/1")]


def test_documents_and_their_links(spark):
    links = spark.createDataFrame([("README", "a", None), ("a", "b", "one"), ("b", "c", "none"), ("a", "gone", None)], "page string, target string, fragment string")
    anchors = spark.createDataFrame([(p, None) for p in ("README", "a", "b", "c")] + [("b", "one")], "page string, anchor string")
    assert [r["page"] for r in G.unreachable(links, anchors.select("page").distinct(), "README").collect()] == ["c"]
    assert {(r["page"], r["error"]) for r in G.broken_links(links, anchors).collect()} == {("a", "missing page"), ("b", "missing heading")}
    assert G.MANY_PAPERS == 12 and links.filter(F.col("fragment").isNull()).count() == 2
