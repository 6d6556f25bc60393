"""Answers and conversations as Markdown, with footnotes for what they cite.

A citation is a struct (ref, paper_id, title, section_title, arxiv_id, url, snippet, label): of a paper, or of a web page
where paper_id is null. A conversation is rows (chat_id, turn, question, answer, citations, trace, input_tokens,
output_tokens, latency_ms, vote, note); trace is an array of structs (kind, text, paper). Everything happens in the row;
a conversation's turns meet in one row at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

CITATION = "struct<ref:string,paper_id:string,title:string,section_title:string,arxiv_id:string,url:string,snippet:string,label:string>"
#: What a verdict other than support says beside its source.
VERDICTS = {"contradiction": "the passage says otherwise", "neutral": "the passage doesn't say so"}


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def number(ref: Column) -> Column:
    return F.regexp_replace(ref, "^r", "")


def cited(text: Column, citations: Column) -> Column:
    """The citations that the text has a mark of, in order of first mention."""
    refs = T.citation_refs(text)
    return F.filter(F.transform(refs, lambda r: F.get(F.filter(citations, lambda c: c["ref"] == r), F.lit(0))), lambda c: c.isNotNull())


def with_footnotes(text: Column, citations: Column, prefix: Column | str = "") -> Column:
    """Marks become footnotes, one for each ref of a bracket that is known; a bracket without any stays."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    known = F.transform(citations, lambda c: c["ref"])

    def noted(group: Column, whole: Column) -> Column:
        refs = F.filter(F.regexp_extract_all(group, F.lit(r"(r\d+)"), F.lit(1)), lambda r: F.array_contains(known, r))
        notes = F.array_join(F.transform(refs, lambda r: F.concat(F.lit("[^"), prefix, number(r), F.lit("]"))), "")
        return F.when(F.size(refs) > 0, notes).otherwise(whole)

    groups, wholes = F.regexp_extract_all(text, F.lit(T.MARK), F.lit(1)), F.regexp_extract_all(text, F.lit(T.MARK), F.lit(0))
    return _let(
        F.struct(F.split(text, T.MARK, -1).alias("p"), groups.alias("g"), wholes.alias("w")),
        lambda z: F.array_join(F.transform(z["p"], lambda p, i: F.concat(p, F.when(i < F.size(z["g"]), noted(F.get(z["g"], i), F.get(z["w"], i))).otherwise(""))), ""),
    )


def reference(label: Column, c: Column) -> Column:
    """The definition of a footnote: a paper's section and address, or a web page's."""
    web = F.when(T.is_safe_url(c["url"]), c["url"]).otherwise("invalid web URL omitted")
    paper = F.concat(c["section_title"], F.when(F.coalesce(c["arxiv_id"], F.lit("")) != "", F.concat(F.lit(", https://arxiv.org/abs/"), c["arxiv_id"])).otherwise(""))
    return F.concat(F.lit("[^"), label, F.lit("]: **"), c["title"], F.lit("** — "), F.when(c["paper_id"].isNull(), web).otherwise(paper))


def answer_markdown(text: Column, citations: Column) -> Column:
    """An answer with footnotes and its references by number; one that cites nothing stays as it is."""

    def whole(used: Column) -> Column:
        by_number = F.array_sort(F.transform(used, lambda c: F.struct(number(c["ref"]).cast("long").alias("n"), c.alias("c"))), lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
        lines = F.array_join(F.transform(by_number, lambda x: reference(number(x["c"]["ref"]), x["c"])), "\n")
        return F.when(F.size(used) == 0, text).otherwise(F.concat(with_footnotes(text, citations), F.lit("\n\n## References\n\n"), lines))

    return _let(cited(text, citations), whole)


def fenced(text: Column) -> Column:
    """A code block whose fence is longer than any run of backticks inside."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.char_length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def inline(text: Column) -> Column:
    """Free text that can't change the document around it: no HTML, and nothing at a line's start that opens a block."""
    plain = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = F.regexp_replace(plain, r"(?m)^(\s{0,3})([#>`~*+\-=_])", r"$1\\$2")
    return F.regexp_replace(plain, r"(?m)^(\s{0,3}\d+)([.)])(\s)", r"$1\\$2$3")


def folded(summary: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(f"<details>\n<summary>{summary}</summary>\n\n"), fenced(text), F.lit("\n\n</details>")))


def trace_text(trace: Column) -> Column:
    """Thoughts, searches and what they found, one below the other."""
    one = lambda e: (
        F.when(e["kind"] == "thought", F.concat(F.lit("Thought: "), e["text"]))
        .when(e["kind"] == "action", F.concat(F.lit('Action: search "'), e["text"], F.lit('"'), F.coalesce(F.concat(F.lit(" ("), e["paper"], F.lit(")")), F.lit(""))))
        .otherwise(F.concat(F.lit("Observation:\n"), e["text"]))
    )
    return F.array_join(F.transform(trace, one), "\n\n")


def sources_text(used: Column) -> Column:
    """The cited passages by paper, first seen first, then those from the web."""
    said = lambda c: F.coalesce(F.concat(F.lit("  ⚠️ "), F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])[c["label"]]), F.lit(""))
    passage = lambda c: F.concat(F.lit("["), number(c["ref"]), F.lit("] "), c["section_title"], said(c), F.lit("\n"), c["snippet"])

    def paper(p: Column) -> Column:
        mine = F.filter(used, lambda c: c["paper_id"] == p)
        link = F.when(F.coalesce(mine[0]["arxiv_id"], F.lit("")) != "", F.concat(F.lit(" — https://arxiv.org/abs/"), mine[0]["arxiv_id"])).otherwise("")
        return F.concat(mine[0]["title"], link, F.lit("\n\n"), F.array_join(F.transform(mine, passage), "\n\n"))

    papers = F.transform(F.array_distinct(F.transform(F.filter(used, lambda c: c["paper_id"].isNotNull()), lambda c: c["paper_id"])), paper)
    pages = F.transform(F.filter(used, lambda c: c["paper_id"].isNull()), lambda c: F.concat(F.lit("["), number(c["ref"]), F.lit("] "), c["title"], F.lit(" — "), c["url"], F.lit("\n"), c["snippet"]))
    web = F.when(F.size(pages) > 0, F.array(F.concat(F.lit("From the web:\n\n"), F.array_join(pages, "\n\n")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(papers, web), "\n\n")


def conversations(turns: DataFrame, title: str = "Conversation") -> DataFrame:
    """chat_id, markdown: each conversation as one document, questions and answers in sight, all else folded below them.

    Footnotes carry their turn's number, and are listed by turn and then by number.
    """
    n = F.row_number().over(Window.partitionBy("chat_id").orderBy("turn")).cast("string")
    t = turns.withColumn("__n", n).withColumn("__used", cited(F.coalesce("answer", F.lit("")), F.col("citations")))
    prefix = F.concat(F.lit("t"), F.col("__n"), F.lit("-"))
    vote = F.when(F.col("vote") == "up", "👍").when(F.col("vote") == "down", "👎")
    blocks = F.array(
        F.concat(F.lit("## Turn "), F.col("__n")),
        F.concat(F.lit("**Q:** "), inline(F.col("question"))),
        F.when(F.coalesce("answer", F.lit("")) != "", with_footnotes(F.col("answer"), F.col("__used"), prefix)),
        folded("Reasoning", trace_text(F.col("trace"))),
        folded("Sources", sources_text(F.col("__used"))),
        F.nullif(T.usage_line(F.col("input_tokens"), F.col("output_tokens"), F.col("latency_ms")), F.lit("")),
        F.concat(F.lit("**Feedback:** "), vote, F.coalesce(F.concat(F.lit(" — "), inline(F.col("note"))), F.lit(""))),
    )
    notes = F.transform("__used", lambda c: F.struct(F.col("__n").cast("int").alias("turn"), number(c["ref"]).cast("long").alias("n"), reference(F.concat(prefix, number(c["ref"])), c).alias("line")))
    rows = t.select("chat_id", F.struct(F.col("__n").cast("int").alias("n"), F.array_join(F.array_compact(blocks), "\n\n").alias("text"), notes.alias("notes")).alias("x"))
    whole = rows.groupBy("chat_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    lines = F.array_join(F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda r: r["notes"])))), lambda r: r["line"]), "\n\n")
    body = F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("x", lambda r: r["text"]), "\n\n---\n\n"))
    return whole.select("chat_id", F.when(lines == "", body).otherwise(F.concat(body, F.lit("\n\n## References\n\n"), lines)).alias("markdown"))

