"""Answers over an index: tools, a bounded loop of rounds, comparisons paper by paper, and checks of what is cited.

The driver orchestrates; each search is a plan. A model here decides, round by round, between tool calls and an answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import models as M
from tessera.functions import text as T
from tessera.operators import library as L
from tessera.search import Searcher

#: From how many papers on a comparison should be confirmed first, and what stands for a paper whose run failed.
MANY_PAPERS, FAILED = 12, "*Nothing could be looked up in this paper.*"
SNIPPET = 500


@dataclass
class Reply:
    """One round of a model: text, and the calls (tool, arguments) it wants answered; without calls the text is the answer."""

    text: str = ""
    calls: list[tuple[str, dict]] = field(default_factory=list)
    input_tokens: int | None = None
    output_tokens: int | None = None


class Decider(Protocol):
    def reply(self, system: str, messages: list[dict], tools: list[str]) -> Reply: ...


@dataclass
class Answer:
    text: str = ""
    citations: list[dict] = field(default_factory=list)
    trace: list[dict] = field(default_factory=list)
    input_tokens: int | None = 0
    output_tokens: int | None = 0

    def count(self, r: Reply) -> None:
        """A sum is unknown as soon as one round's number is."""
        for name in ("input_tokens", "output_tokens"):
            mine, more = getattr(self, name), getattr(r, name)
            setattr(self, name, None if mine is None or more is None else mine + more)


def catalogue(manifest: DataFrame, scope: list[str] | None = None) -> str:
    """The papers in scope as one line each would say: id, title and their rarest tags. ``(none)`` without papers."""
    m = manifest if scope is None else manifest.filter(F.col("paper_id").isin(scope))
    tags = L.rarest_tags(m).groupBy("paper_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]), ", ").alias("said"))
    rows = m.join(tags, "paper_id", "left").select("paper_id", "title", F.coalesce("said", F.lit("")).alias("tags")).orderBy("paper_id").collect()
    return ", ".join(f"{r['paper_id']} ({r['title']}{'; ' + r['tags'] if r['tags'] else ''})" for r in rows) or "(none)"


def classify(question: str, scope: list[str], model: M.LanguageModel) -> str:
    """``compare`` or ``ask``; with fewer than two papers there is nothing to compare and no model is asked, and a failure asks."""
    if len(scope) < 2:
        return "ask"
    try:
        first = (model.complete("Say COMPARE if the question sets papers side by side, else ASK.", question, 16).split() or [""])[0]
    except Exception:
        return "ask"
    return "compare" if first.upper().rstrip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") == "COMPARE" else "ask"


@dataclass
class Agent:
    spark: SparkSession
    searcher: Searcher
    manifest: DataFrame
    decider: Decider
    rounds: int = 8
    min_k: int = 2
    max_k: int = 10
    candidates: int = 20
    checker: M.Checker | None = None
    web: Callable[[str], list[dict]] | None = None

    def _search(self, query: str, scope: list[str] | None, per_paper: bool) -> list[dict]:
        asked = self.spark.createDataFrame([(0, query)], "qid int, text string")
        scopes = None if scope is None else self.spark.createDataFrame([(0, p) for p in scope], "qid int, paper_id string")
        deep = max(self.candidates, 4 * self.max_k)
        found = self.searcher.search(asked, self.min_k, self.max_k, deep, scopes, per_paper and scopes is not None)
        named = L.with_titles(found.results, self.manifest if "arxiv_id" in self.manifest.columns else self.manifest.withColumn("arxiv_id", F.lit(None).cast("string")))
        rows = named.orderBy("rank").collect()
        return [{k: r[k] for k in ("paper_id", "title", "arxiv_id", "breadcrumb", "section_title", "section_number", "source", "body")} for r in rows]

    def _tool(self, name: str, args: dict, scope: list[str] | None, per_paper: bool, out: Answer, first_ref: int) -> str:
        """What a tool says; passages and pages become citations, numbered on through the chat."""
        query = str(args.get("query") or "").strip()
        if not query:
            return "Error: empty query."
        out.trace.append({"kind": "action", "text": query, "paper": args.get("paper")})
        if name == "search_papers":
            mine = scope if not args.get("paper") else [p for p in (scope if scope is not None else [args["paper"]]) if p == args["paper"]]
            hits = self._search(query, mine, per_paper) if mine is None or mine else []
        elif name == "web_search" and self.web is not None:
            try:
                hits = [{"paper_id": None, "url": h["url"], "title": h.get("title", ""), "body": h.get("body", "")} for h in self.web(query)]
            except Exception as e:
                return f"Error: {e}"
        else:
            return f"Error: no tool {name}."
        lines = []
        for hit in hits:
            ref = f"r{first_ref + len(out.citations) + 1}"
            out.citations.append({"ref": ref, **hit, "snippet": hit["body"][:SNIPPET]})
            lines.append(f"[{ref}] {hit.get('breadcrumb') or hit['title']}\n{hit['body']}")
        said = "\n\n".join(lines) or "Nothing found."
        out.trace.append({"kind": "observation", "text": said, "paper": None})
        return said

    def run(self, messages: list[dict], scope: list[str] | None = None, per_paper: bool = False, first_ref: int = 0, stop: Callable[[], bool] = lambda: False) -> Answer:
        """Up to ``rounds`` replies; the last has no tools, so that it must answer from what is there."""
        if per_paper and scope is None:
            scope = [r["paper_id"] for r in self.manifest.select("paper_id").orderBy("paper_id").collect()]
        out, said = Answer(), list(messages)
        tools = ["search_papers"] + ["web_search"] * (self.web is not None)
        system = f"Papers in scope: {catalogue(self.manifest, scope)}"
        for n in range(self.rounds):
            if stop():
                break
            reply = self.decider.reply(system, said, tools if n < self.rounds - 1 else [])
            out.count(reply)
            if not reply.calls or n == self.rounds - 1:
                out.text = reply.text
                break
            if reply.text:
                out.trace.append({"kind": "thought", "text": reply.text, "paper": None})
            said.append({"role": "assistant", "content": reply.text, "calls": reply.calls})
            said += [{"role": "tool", "content": self._tool(name, args, scope, per_paper, out, first_ref)} for name, args in reply.calls]
        if self.checker is not None:
            self.check(out)
        return out

    def compare(self, messages: list[dict], scope: list[str] | None = None, first_ref: int = 0, on_row: Callable[[dict], None] = lambda row: None, stop: Callable[[], bool] = lambda: False) -> tuple[Answer, list[dict]]:
        """A run for each paper, and one answer that puts them side by side; a paper whose run fails keeps its place."""
        manifest = {r["paper_id"]: r for r in self.manifest.collect()} if scope is None else {r["paper_id"]: r for r in self.manifest.filter(F.col("paper_id").isin(scope)).collect()}
        scope = sorted(manifest) if scope is None else scope
        if len(scope) < 2:
            raise ValueError("a comparison needs two papers at least")
        out, rows, known = Answer(), [], [[], []]
        for paper in scope:
            if stop():
                break
            try:
                one = self.run(messages, [paper], first_ref=first_ref + len(out.citations), stop=stop)
            except Exception:
                one = Answer(FAILED, input_tokens=None, output_tokens=None)
            for total, n in zip(known, (one.input_tokens, one.output_tokens)):
                total += [n] * (n is not None)
            out.citations += one.citations
            r = manifest.get(paper)
            rows.append({"paper_id": paper, "title": r["title"] if r else paper, "text": one.text, "citations": one.citations, "trace": one.trace})
            on_row(rows[-1])
        told = "\n\n".join(f"{r['title']}:\n{r['text']}" for r in rows)
        last = self.decider.reply("Answer by comparing what was found in each paper; keep the marks.", [*messages, {"role": "user", "content": told}], [])
        for total, n in zip(known, (last.input_tokens, last.output_tokens)):
            total += [n] * (n is not None)
        out.text = last.text
        out.input_tokens, out.output_tokens = (sum(x) if x else None for x in known)
        if self.checker is not None:
            self.check(out)
        return out, rows

    def check(self, out: Answer, contradiction: float = 0.05, entailment: float = 0.3) -> None:
        """``faithfulness`` for each cited passage: a claim (sentence, label, score) for each sentence that cites it.

        A sentence is held against each sentence of the passage, and the best of them counts.
        """
        bodies = {c["ref"]: c["body"] for c in out.citations if c.get("paper_id") is not None}
        if not bodies or not out.text:
            return
        answer = self.spark.createDataFrame([(out.text,)], "t string").select(F.explode(T.sentences(F.col("t"))).alias("said"))
        cited = answer.select(F.explode(T.citation_refs(F.col("said"))).alias("ref"), F.trim(F.regexp_replace("said", T.MARK, "")).alias("sentence")).filter("sentence != ''").distinct()
        passages = self.spark.createDataFrame(list(bodies.items()), "ref string, body string").select("ref", F.explode(T.sentences(F.col("body"))).alias("passage"))
        scored = M.checked(cited.join(passages, "ref"), self.checker).withColumn("label", T.label_of(F.col("score"), F.lit(contradiction), F.lit(entailment)))
        for r in L.support(scored).orderBy("ref", "sentence").collect():
            next(c for c in out.citations if c["ref"] == r["ref"]).setdefault("faithfulness", []).append({"sentence": r["sentence"], "label": r["label"], "score": r["score"]})


def unreachable(links: DataFrame, pages: DataFrame, start: str, clicks: int = 2) -> DataFrame:
    """Pages (page) that no chain of at most ``clicks`` links (page, target) leads to from the start."""
    seen = pages.filter(F.col("page") == start).select("page")
    for _ in range(clicks):
        seen = seen.unionByName(links.join(seen, "page", "left_semi").select(F.col("target").alias("page"))).distinct()
    return pages.join(seen, "page", "left_anti").select("page")


def broken_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links (page, target, fragment) whose target isn't there (anchors: page, anchor; null for the page itself), or has no such heading."""
    there = anchors.select(F.col("page").alias("target")).distinct()
    lost = links.join(there, "target", "left_anti").select("page", "target", "fragment", F.lit("missing page").alias("error"))
    named = anchors.select(F.col("page").alias("target"), F.col("anchor").alias("fragment")).filter("fragment IS NOT NULL").distinct()
    no_heading = links.filter("fragment IS NOT NULL").join(there, "target", "left_semi").join(named, ["target", "fragment"], "left_anti")
    return lost.unionByName(no_heading.select("page", "target", "fragment", F.lit("missing heading").alias("error")))
