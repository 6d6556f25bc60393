"""``search``: recall, fusion, rerank and cutoff composed, for many queries at a time.

Results are rows; why a query's list ends where it does is a row of the outcomes: ``pool_exhausted``, ``no_rerank``,
``disabled``, ``elbow`` or ``no_elbow``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import models as M
from tessera.operators import retrieval as R


@dataclass
class Found:
    results: DataFrame  # qid, rank, chunk_id, score, source, cutoff_reason, and the chunk's columns
    outcomes: DataFrame  # qid, returned, reason: a row for every query


@dataclass
class Searcher:
    """Chunks (chunk_id, paper_id, text, embedding, ...) with the models that are asked about them."""

    chunks: DataFrame
    embedder: M.Embedder
    scorer: M.Scorer | None = None
    lexical: R.LexicalIndex | None = None
    model: M.LanguageModel | None = None
    n_variants: int = 3
    rrf_k: int = R.RRF_K
    multiplier: int = 3

    def _dense(self, asked: DataFrame, scopes: DataFrame | None, depth, by: tuple[str, ...]) -> DataFrame:
        """Rankings (qid, [paper_id,] chunk_id, score, rank) of (qid, q): within a scope the papers' chunks only."""
        chunks = self.chunks.select("chunk_id", "paper_id", "embedding")
        if scopes is None:
            return R.dense_topk(asked, chunks, depth, by, unit=False)
        wanted = R.sized_broadcast(scopes.select("qid", "paper_id").join(asked, "qid"))
        pairs = chunks.join(wanted, "paper_id").withColumn("score", R.cosine(F.col("q"), F.col("embedding"))).drop("q", "embedding")
        return R.top(pairs, depth, by)

    def _sparse(self, texts: DataFrame, scopes: DataFrame | None, depth, by: tuple[str, ...]) -> DataFrame:
        hits = R.bm25_scores(texts, self.lexical).join(self.chunks.select("chunk_id", "paper_id"), "chunk_id")
        if scopes is not None:
            hits = hits.join(scopes.select("qid", "paper_id"), ["qid", "paper_id"], "left_semi")
        return R.top(hits, depth, by)

    def ranked(self, queries: DataFrame, scopes: DataFrame | None, depth: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
        """The dense rankings of (qid, text), as deep as asked."""
        return self._dense(M.query_vectors(queries, self.embedder), scopes, depth, by)

    def ranked_lexically(self, queries: DataFrame, scopes: DataFrame | None, depth: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
        return self._sparse(queries.select("qid", "text"), scopes, depth, by)

    def recall(self, queries: DataFrame, candidates: int = 20, max_k: int = 10, scopes: DataFrame | None = None, per_paper: bool = False, floor: int | None = None) -> DataFrame:
        """The pools before rerank: qid, paper_id, chunk_id, score, rank, source.

        scopes: (qid, paper_id); without it every paper is asked, and a query without a row in it asks none. With
        ``per_paper`` each paper of a scope has a pool of its own, of at least ``floor`` (else max_k) candidates.
        """
        if per_paper and scopes is None:
            raise ValueError("per_paper needs scopes: say which papers each query is about")
        scopes = None if scopes is None else scopes.select("qid", "paper_id").distinct()
        by = ("qid", "paper_id") if per_paper else ("qid",)
        depth = max(candidates, max_k if floor is None else floor) * self.multiplier
        vectors = M.query_vectors(queries, self.embedder)
        more = None
        if self.model is not None:
            other = R.distinct_variants(queries, M.variants(queries, self.model, self.n_variants), self.n_variants)
            keyed = other.select(F.struct("qid", "list_no").alias("qid"), "text")
            inner = None if scopes is None else other.join(scopes, "qid").select(F.struct("qid", "list_no").alias("qid"), "paper_id")
            lists = [(0, "dense", self._dense(M.query_vectors(keyed, self.embedder), inner, depth, by))]
            if self.lexical is not None:
                lists.append((1, "sparse", self._sparse(keyed, inner, depth, by)))
            parts = [x.select("qid.qid", "paper_id", (F.col("qid.list_no") * 2 + i).alias("list_no"), F.lit(s).alias("source"), "chunk_id", "rank", "score") for i, s, x in lists]
            more = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        dense = self._dense(vectors, scopes, depth, by)
        fused = self.lexical is not None or more is not None
        columns = ("qid", "paper_id", "list_no", "source", "chunk_id", "rank", "score")
        lists = dense.withColumns({"list_no": F.lit(0), "source": F.lit("dense")}).select(*columns)
        if self.lexical is not None:
            lists = lists.unionByName(self._sparse(queries.select("qid", "text"), scopes, depth, by).withColumns({"list_no": F.lit(1), "source": F.lit("sparse")}).select(*columns))
        if more is not None:
            lists = lists.unionByName(more.withColumn("list_no", F.col("list_no") + 2).select(*columns))

        budget = F.lit(candidates)
        if per_paper:
            sizes = scopes.groupBy("qid").agg(F.count(F.lit(1)).alias("groups"))
            lists = lists.join(R.sized_broadcast(sizes), "qid")
            budget = R.group_budget(candidates, F.col("groups"), max_k if floor is None else floor)
        lists = lists.withColumn("budget", budget)
        if fused:
            cut = lists.filter(F.col("rank") <= F.col("budget") * self.multiplier)
            key = F.struct(*by)
            pool = R.rrf(cut.withColumn("qid", key), self.rrf_k).select("qid.*", "chunk_id", "score", "rank", R.provenance().alias("source"))
            where = self.chunks.select("chunk_id", "paper_id") if "paper_id" not in by else None
            pool = pool.join(where, "chunk_id") if where is not None else pool
            limits = lists.select("qid", "budget").distinct()
            pool = pool.join(limits, "qid").filter(F.col("rank") <= F.col("budget")).drop("budget")
        else:
            pool = lists.filter(F.col("rank") <= F.col("budget")).select("qid", "paper_id", "chunk_id", "score", "rank", "source")
        if per_paper:
            w = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "paper_id", "rank")
            pool = pool.withColumn("rank", F.row_number().over(w))
        return pool.select("qid", "paper_id", "chunk_id", "score", "rank", "source")

    def search(
        self, queries: DataFrame, min_k: int = 2, max_k: int = 10, candidates: int = 20, scopes: DataFrame | None = None, per_paper: bool = False,
        rerank: bool = True, elbow: bool = True, mad_multiplier: float = 3.0, prominence: float = 0.15,
    ) -> Found:
        """The chunks that answer each query (qid, text), best first."""
        if min_k > max_k:
            raise ValueError(f"min_k ({min_k}) must be at most max_k ({max_k})")
        pool = self.recall(queries, candidates, max_k, scopes, per_paper).join(self.chunks.drop("paper_id", "embedding"), "chunk_id")
        asked = queries.select("qid", F.col("text").alias("query"))
        if rerank and self.scorer is not None:
            pool = pool.withColumnRenamed("score", "recalled").join(asked, "qid")
            pool = M.scored(pool, self.scorer).withColumn("failed", F.col("score").isNull())
            ranked = R.rerank(pool, F.col("score")).withColumn("score", F.coalesce("score", "recalled")).drop("recalled", "query")
        else:
            ranked = pool.withColumn("failed", F.lit(True))
        whole = F.sort_array(F.collect_list(F.struct("rank", "score")))
        lists = ranked.groupBy("qid").agg(whole.alias("x"), F.bool_or("failed").alias("failed")).select("qid", "failed", F.transform("x", lambda r: r["score"]).alias("scores"))
        cut = R.cutoff(F.col("scores"), min_k, max_k, mad_multiplier, prominence)
        plain = lambda why: F.struct(F.least(F.size("scores"), F.lit(max_k)).cast("int").alias("cutoff"), F.lit(why).alias("reason"))
        judged = lists.select("qid", F.when(F.col("failed"), plain("no_rerank")).otherwise(cut if elbow else plain("disabled")).alias("c"))
        judged = judged.select("qid", "c.cutoff", "c.reason")
        kept = ranked.join(judged, "qid").filter(F.col("rank") <= F.col("cutoff")).drop("failed", "cutoff").withColumnRenamed("reason", "cutoff_reason")
        every = queries.select("qid").join(judged, "qid", "left")
        return Found(kept, every.select("qid", F.coalesce("cutoff", F.lit(0)).alias("returned"), F.coalesce("reason", F.lit("pool_exhausted")).alias("reason")))
