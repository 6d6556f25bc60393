"""Models as plug-ins: what the engine asks of them, deterministic ones that need no download, and how they run on columns.

A model is a plain object that workers unpickle once for each task. Texts reach it in Arrow batches.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X


class Embedder(Protocol):
    name: str

    def documents(self, texts: list[str]) -> list[list[float]]: ...

    def query(self, text: str) -> list[float]: ...


class Scorer(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Checker(Protocol):
    def check(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class LanguageModel(Protocol):
    def complete(self, system: str, user: str, max_tokens: int = 1024) -> str: ...


@lru_cache(1 << 18)
def _dimension(word: str, dims: int) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest(), "big") % dims


class HashingEmbedder:
    """Bags of words: each word counts in the dimension that its md5 gives; the last one is 1, so no vector is zero.

    Fixed values: md5 read as one number, 31 dimensions of words, and the last.
    """

    def __init__(self, dims: int = 32):
        self.dims, self.name = dims, f"hashing-{dims}"

    def query(self, text: str) -> list[float]:
        v = [0.0] * (self.dims - 1) + [1.0]
        for word in text.lower().split():
            v[_dimension(word, self.dims - 1)] += 1.0
        return v

    def documents(self, texts: list[str]) -> list[list[float]]:
        return [self.query(t) for t in texts]


class OverlapScorer:
    """Distinct words that a text shares with the query."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        asked = set(re.findall(r"\w+", query.lower()))
        return [float(len(asked & set(re.findall(r"\w+", t.lower())))) for t in texts]


class OverlapChecker:
    """The share of a claim's words that its passage has."""

    def check(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = [[set(re.findall(r"\w+", t.lower())) for t in pair] for pair in pairs]
        return [len(passage & claim) / len(claim) if claim else 0.0 for passage, claim in words]


class PairScorer:
    """A cross-encoder: ``predict`` takes (query, text) pairs and gives a score for each; pairs go to it in batches."""

    def __init__(self, predict: Callable[[list[tuple[str, str]]], list[float]], batch: int = 32):
        self.predict, self.batch = predict, batch

    def score(self, query: str, texts: list[str]) -> list[float]:
        pairs = [(query, t) for t in texts]
        return [float(x) for i in range(0, len(pairs), self.batch) for x in self.predict(pairs[i : i + self.batch])]


def numbers_of(reply: str, n: int) -> list[float]:
    """The first array of a reply as n numbers, as ``text.first_numbers`` says of columns: what is none is 0, and so is what is missing."""
    found = re.search(r"\[[^\]]*\]", reply)
    try:
        said = json.loads(found[0]) if found else []
    except ValueError:
        said = []

    def number(x) -> float:
        try:
            return float(x)
        except (TypeError, ValueError):
            return 0.0

    return ([number(x) for x in said] + [0.0] * n)[:n]


class ModelScorer:
    """A language model that rates passages from 0 to 10, up to ``batch`` in a question; what it doesn't rate has 0, so the order before stays."""

    def __init__(self, model: LanguageModel, most: int = 600, batch: int = 50):
        self.model, self.most, self.batch = model, most, batch

    def score(self, query: str, texts: list[str]) -> list[float]:
        out = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            passages = "\n".join(f"({k + 1}) {' '.join(t.split())[: self.most]}" for k, t in enumerate(part))
            asked = f"Question: {query}\n{passages}\nHow well does each passage answer the question, from 0 to 10? Reply with a JSON array of {len(part)} numbers in this order."
            out += numbers_of(self.model.complete("You rate passages of papers.", asked, 40 + 8 * len(part)), len(part))
        return out


class ServiceScorer:
    """A rerank service: ``client`` takes a query and texts and gives dicts with index and score, in any order; others than its texts' are passed over."""

    def __init__(self, client: Callable[[str, list[str]], list[dict]]):
        self.client = client

    def score(self, query: str, texts: list[str]) -> list[float]:
        out = [0.0] * len(texts)
        for r in self.client(query, texts) if texts else []:
            if 0 <= r["index"] < len(texts):
                out[r["index"]] = float(r.get("score", r.get("relevance_score", 0.0)))
        return out


class ServiceEmbedder:
    """Vectors from a function of texts and of what they are (document or query), with a prefix for each, made unit vectors where asked."""

    def __init__(self, name: str, client: Callable[[list[str], str], list[list[float]]], document_prefix: str = "", query_prefix: str = "", unit: bool = False, batch: int = 96):
        self.name, self.client, self.prefixes, self.unit, self.batch = name, client, {"document": document_prefix, "query": query_prefix}, unit, batch

    def _vectors(self, texts: list[str], kind: str) -> list[list[float]]:
        said = [self.prefixes[kind] + t for t in texts]
        out = [v for i in range(0, len(said), self.batch) for v in self.client(said[i : i + self.batch], kind)]
        if len(out) != len(texts):
            raise ValueError(f"{self.name}: {len(out)} vectors of {len(texts)} texts")
        return [[x / (sum(y * y for y in v) ** 0.5 or 1.0) for x in v] for v in out] if self.unit else out

    def documents(self, texts: list[str]) -> list[list[float]]:
        return self._vectors(texts, "document")

    def query(self, text: str) -> list[float]:
        return self._vectors([text], "query")[0]


#: Types of a schema's fields, and what of JSON they may be.
JSON_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def first_object(reply: str):
    """The first JSON object or array of a reply that is whole, braces inside strings and all; None where there is none."""
    for m in re.finditer(r"[{\[]", reply):
        try:
            return json.JSONDecoder().raw_decode(reply, m.start())[0]
        except ValueError:
            continue
    return None


def structured(model: LanguageModel, system: str, user: str, schema: dict[str, str], max_tokens: int = 1024, repairs: int = 2) -> dict:
    """A reply with the schema's fields (name to a key of JSON_TYPES). A wrong one is sent back with what is wrong, up to ``repairs`` times; then it is an error."""
    told = f"{system}\nReply with one JSON object: " + ", ".join(f'"{k}": {kind}' for k, kind in schema.items())
    asked, wrong = user, ""
    for _ in range(repairs + 1):
        said = first_object(model.complete(told, asked, max_tokens))
        if not isinstance(said, dict):
            wrong = "there is no JSON object"
        else:
            bad = [k for k, kind in schema.items() if not isinstance(said.get(k), JSON_TYPES[kind]) or kind in ("integer", "number") and isinstance(said.get(k), bool)]
            if not bad:
                return {k: said[k] for k in schema}
            wrong = "; ".join(f"{k} must be of type {schema[k]}" for k in bad)
        asked = f"{user}\n\nYour last reply was no good: {wrong}."
    raise ValueError(f"no reply of the schema: {wrong}")


#: Kinds that can be asked for by name. Those of a package import it when they are built; none is a dependency.
EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": lambda dims=32, **_: HashingEmbedder(dims), "service": lambda name, client, **more: ServiceEmbedder(name, named(client), **more)}
SCORERS: dict[str, Callable[..., Scorer]] = {
    "overlap": lambda **_: OverlapScorer(),
    "pairs": lambda predict, **more: PairScorer(named(predict), **more),
    "model": lambda model, **more: ModelScorer(build(LANGUAGE_MODELS, **model), **more),
    "service": lambda client, **more: ServiceScorer(named(client), **more),
}
CHECKERS: dict[str, Callable[..., Checker]] = {"overlap": lambda **_: OverlapChecker()}
LANGUAGE_MODELS: dict[str, Callable[..., LanguageModel]] = {}


def named(what: str):
    """The object that ``package.module:name`` says."""
    module, _, name = what.partition(":")
    return getattr(importlib.import_module(module), name)


def build(registry: dict, kind: str, **settings):
    """The model of a kind; ``package.module:factory`` names one of one's own."""
    if kind in registry:
        return registry[kind](**settings)
    if ":" in kind:
        module, factory = kind.split(":", 1)
        return getattr(importlib.import_module(module), factory)(**settings)
    raise ValueError(f"unknown model {kind!r}: one of {sorted(registry)}, or package.module:factory")


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding", batch: int = 32, asked: bool = False) -> DataFrame:
    """The rows with the vectors of their texts, as documents or as what is asked; a null text is an empty one."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b[text]]
            parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
            vectors = [embedder.query(t) for t in texts] if asked else [v for p in parts for v in embedder.documents(p)]
            yield b.assign(**{out: vectors})

    return rows.mapInPandas(run, schema)


def query_vectors(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """qid, q: each distinct text is embedded once, however many queries or scopes have it."""
    once = embedded(queries.select("text").distinct(), embedder, out="q", asked=True)
    return queries.select("qid", "text").join(once, "text").select("qid", "q")


def scored(pool: DataFrame, scorer: Scorer) -> DataFrame:
    """The pool (qid, query, chunk_id, text, ...) with the scorer's ``score``; null for a whole query where it fails.

    It fails when it raises, or gives another number of scores than texts. A query's pool is bounded by its candidates.
    """
    fields = [f for f in pool.schema.fields if f.name != "score"]

    def one(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("rank")
        try:
            found = [float(x) for x in scorer.score(b["query"].iloc[0], [t or "" for t in b["text"]])]
            ok = len(found) == len(b)
        except Exception:
            ok = False
        return b[[f.name for f in fields]].assign(score=found if ok else None)

    return pool.groupBy("qid").applyInPandas(one, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def checked(pairs: DataFrame, checker: Checker, batch: int = 64) -> DataFrame:
    """(…, passage, sentence) with the checker's ``score`` of each pair."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = list(zip(b["passage"].fillna(""), b["sentence"].fillna("")))
            yield b.assign(score=[float(x) for i in range(0, len(both), batch) for x in checker.check(both[i : i + batch])])

    return pairs.mapInPandas(run, schema)


def variants(queries: DataFrame, model: LanguageModel, n: int = 3) -> DataFrame:
    """(qid, pos, text) of up to n other wordings of each query, one on a line of the reply; none where the model fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for qid, text in zip(b["qid"], b["text"]):
                try:
                    lines = [x.strip() for x in model.complete(f"Reword the question in {n} other ways, one on each line.", text, 40 * n).splitlines() if x.strip()]
                except Exception:
                    lines = []
                rows += [(qid, i, x) for i, x in enumerate(lines[:n])]
            yield pd.DataFrame(rows, columns=["qid", "pos", "text"])

    return queries.select("qid", F.col("text")).mapInPandas(run, T.StructType([queries.schema["qid"], T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType())]))


TAGS = "paper_id string, tags array<string>"


def tagged(pool: DataFrame, model: LanguageModel, known: list[str] | None = None, most: int = 6) -> DataFrame:
    """(paper_id, tags) of (paper_id, markdown): up to ``most`` kebab-case tags by the model, none where it fails or says no list.

    It reads a paper's title, abstract and headings, and is told the tags that are in use, so that it may choose those.
    """
    asked = pool.select(F.col("paper_id").cast("string").alias("paper_id"), X.tagging_excerpt(F.coalesce("markdown", F.lit(""))).alias("text"))
    system = f"Give at most {most} short topic tags as a JSON array of strings." + (f" Prefer these where they fit: {', '.join(sorted(known))}." if known else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for paper, text in zip(b["paper_id"], b["text"]):
                try:
                    said = model.complete(system, text, 60 * most)
                except Exception:
                    said = ""
                rows.append((paper, said))
            yield pd.DataFrame(rows, columns=["paper_id", "said"])

    said = asked.mapInPandas(run, "paper_id string, said string")
    listed = F.from_json(X.first_json_array(F.col("said")), "array<string>")
    tags = F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda t: X.kebab(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return said.select("paper_id", F.slice(F.array_distinct(tags), 1, most).alias("tags"))
