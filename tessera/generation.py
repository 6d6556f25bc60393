"""Evaluation items written by a language model: questions on sections, and on sections of several papers."""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.models import LanguageModel
from tessera.operators import chunking as C
from tessera.operators import library as L

ITEM = "query string, paper_id string, gold_span array<int>, source_unit string, section_number string, section_title string, answer string, error string"
ASK = "Write one question that only this section answers, and its short answer, as a JSON object with question and answer."
SPOT = "Name sections of different papers that can be compared: a JSON array of groups, each an array of objects with paper_id, section_number and section_title."
COMPARE = "Write one question that compares these sections, and its short answer, as a JSON object with question and answer."


def first_object(reply: str) -> dict | None:
    found = re.search(r"\{.*\}", reply or "", re.S)
    try:
        value = json.loads(found[0]) if found else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def asked(reply: str) -> tuple[str, str] | None:
    """Question and answer of a reply, if it has a question."""
    said = first_object(reply) or {}
    question = str(said.get("question") or "").strip()
    return (question, str(said.get("answer") or "").strip()) if question else None


def items(pool: DataFrame, model: LanguageModel, min_tokens: int = C.MIN_TOKENS, most: int = 6000) -> DataFrame:
    """One item for each section of (paper_id, markdown) that the model has a question on.

    A section that fails is a row with an error and no query; a reply without a question leaves no row.
    """
    s = C.section_spans(pool, min_tokens)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, number, title, start, end, body in zip(*(b[c] for c in ("paper_id", "number", "title", "start", "end", "body"))):
                unit = f"{number} {title}" if number else title
                try:
                    found, error = asked(model.complete(ASK, f"{title}\n\n{body[:most]}")), None
                except Exception as e:
                    found, error = None, f"{type(e).__name__}: {e}"[:300]
                if found or error:
                    rows.append((found[0] if found else None, paper, [start, end], unit, number or "", title, found[1] if found else None, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEM.split(", ")])

    return s.select(F.col("paper_id").cast("string").alias("paper_id"), "number", "title", "start", "end", "body").mapInPandas(run, ITEM)


def leak_check(items_: DataFrame, model: LanguageModel, threshold: float = 0.5) -> DataFrame:
    """The items with what the model answers without any passage, how that overlaps with the answer, and ``leaked``.

    An item whose check fails is kept: it is not leaked, and the error is noted.
    """
    from pyspark.sql import types as S

    schema = S.StructType([*items_.schema.fields, S.StructField("predicted", S.StringType()), S.StructField("check_error", S.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said, errors = [], []
            for q in b["query"]:
                try:
                    said.append(model.complete("Answer in a few words, from what you know.", q))
                    errors.append(None)
                except Exception as e:
                    said.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:300])
            yield b.assign(predicted=said, check_error=errors)

    score = F.when(F.col("predicted").isNotNull(), T.answer_f1(F.col("predicted"), F.col("answer")))
    return items_.mapInPandas(run, schema).withColumn("f1", score).withColumn("leaked", F.coalesce(F.col("f1") >= threshold, F.lit(False)))


@dataclass
class Trials:
    """What a loop of trials brought: items (query, answer, sections), how many trials, and how often papers met."""

    items: list[dict] = field(default_factory=list)
    trials: int = 0
    pairs: Counter = field(default_factory=Counter)

    def hit_rate(self) -> float:
        return len(self.items) / self.trials if self.trials else 0.0


def comparisons(pool: DataFrame, model: LanguageModel, target: int = 20, trials: int = 200, least: int = 2, most: int = 4, seed: int = 0, chars: int = 6000, each: Callable[[dict], None] | None = None) -> Trials:
    """Draw papers, let the model spot what they have in common, and write a question on each valid group.

    The loop ends after the trial that reaches ``target``, or after ``trials``; a trial or a question that fails is left
    out. A trial's sections are bounded by the papers that it draws, so only theirs come to the driver.
    """
    if least > most:
        raise ValueError(f"least ({least}) must be at most most ({most})")
    names = sorted(str(r["paper_id"]) for r in pool.select("paper_id").distinct().collect())
    if len(names) < least:
        raise ValueError(f"{len(names)} papers are fewer than the {least} of a trial")
    sections = C.section_spans(pool, C.MIN_TOKENS).withColumn("paper_id", F.col("paper_id").cast("string"))
    outlines = C.outline_text(C.split_sections(pool)).withColumn("paper_id", F.col("paper_id").cast("string"))
    spark, draw, out = pool.sparkSession, random.Random(seed), Trials()
    while len(out.items) < target and out.trials < trials:
        out.trials += 1
        drawn = draw.sample(names, draw.randint(least, min(most, len(names))))
        said = {r["paper_id"]: r["outline"] for r in outlines.filter(F.col("paper_id").isin(drawn)).collect()}
        try:
            reply = model.complete(SPOT, "\n\n".join(said[p] for p in drawn if p in said))
            found = re.search(r"\[.*\]", reply, re.S)
            groups = [g for g in json.loads(found[0]) if isinstance(g, list) and all(isinstance(e, dict) for e in g)] if found else []
        except Exception:
            continue
        rows = [(i, str(e.get("paper_id", "")), str(e.get("section_number") or ""), str(e.get("section_title", ""))) for i, g in enumerate(groups) for e in g]
        if not rows:
            continue
        here = sections.filter(F.col("paper_id").isin(drawn))
        named = spark.createDataFrame(rows, "group_id int, paper_id string, section_number string, section_title string")
        valid = L.valid_groups(named, here)
        told = here.withColumn("section_number", F.coalesce("number", F.lit(""))).withColumnRenamed("title", "section_title").dropDuplicates(["paper_id", "section_number", "section_title"])
        full = named.join(valid, "group_id", "left_semi").join(told, ["paper_id", "section_number", "section_title"]).collect()
        for group in sorted({r["group_id"] for r in full}):
            parts = sorted((r for r in full if r["group_id"] == group), key=lambda r: drawn.index(r["paper_id"]))
            try:
                question = asked(model.complete(COMPARE, "\n\n".join(f"{r['paper_id']}: {r['section_title']}\n{r['body'][:chars]}" for r in parts)))
            except Exception:
                continue
            if question is None:
                continue
            item = {
                "query": question[0], "answer": question[1],
                "sections": [{"paper_id": r["paper_id"], "number": r["section_number"], "title": r["section_title"], "body": r["body"], "start": r["start"], "end": r["end"]} for r in parts],
            }
            out.items.append(item)
            papers = sorted(r["paper_id"] for r in parts)
            out.pairs.update((a, b) for i, a in enumerate(papers) for b in papers[i + 1 :])
            if each is not None:
                each(item)
    return out
