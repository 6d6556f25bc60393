"""``python -m tessera COMMAND [--config FILE] [--setting=value ...]``: index a pool, search it, and judge retrieval on items."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config as K
from tessera import generation as Q
from tessera import models as M
from tessera import reports
from tessera.index import Index, ingest
from tessera.operators import arms as A
from tessera.operators import chunking as C
from tessera.operators import documents as D
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.search import Searcher
from tessera.sources import files


def opened(spark: SparkSession, config: K.Config, reset: bool = False) -> Index:
    embedder = M.build(M.EMBEDDERS, config.embedder.kind, **config.embedder.settings)
    c = config.chunking
    knobs = {"max_tokens": c.max_tokens, "overlap_tokens": c.overlap_tokens, "min_tokens": c.min_tokens, "noise_ratio": c.noise_ratio, "extra_skip": tuple(c.extra_skip)}
    return Index(spark, config.index_path, embedder, reset=reset, **knobs)


def searcher(config: K.Config, index: Index) -> Searcher:
    scorer = M.build(M.SCORERS, config.scorer.kind, **config.scorer.settings) if config.scorer.enabled else None
    lexical = index.lexical(config.lexical.k1, config.lexical.b) if config.lexical.enabled else None
    return Searcher(index.chunks(), index.embedder, scorer, lexical, rrf_k=config.lexical.rrf_k, multiplier=config.lexical.fetch_multiplier)


def command_index(spark: SparkSession, config: K.Config, limit: str = "0") -> str:
    """Take in what the pool has and the index hasn't, of the first so many papers by name."""
    bad = ingest(opened(spark, config), files.load_pool(spark, config.pool_path, int(limit))).collect()
    index = opened(spark, config)
    return "\n".join([f"{index.manifest().count()} papers, {index.count()} chunks", *(f"left out: {r['paper_id']}: {r['error']}" for r in bad)])


def command_remove(spark: SparkSession, config: K.Config, *names: str) -> str:
    opened(spark, config).remove(spark.createDataFrame([(n,) for n in names], "paper_id string"))
    return f"removed: {', '.join(names)}"


def command_search(spark: SparkSession, config: K.Config, *words: str) -> str:
    """The passages that answer a question, best first."""
    asked = spark.createDataFrame([(0, " ".join(words))], "qid int, text string")
    r = config.retrieval
    found = searcher(config, opened(spark, config)).search(asked, r.min_k, r.max_k, r.candidates, elbow=r.elbow, mad_multiplier=r.mad_multiplier, prominence=r.prominence)
    rows = found.results.orderBy("rank").collect()
    return "\n\n".join([f"{x['rank']}. {x['breadcrumb']}  ({x['score']:.3f}, {x['source']})\n{x['body'][:300]}" for x in rows] + [f"({found.outcomes.first()['reason']})"])


def _items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    items = files.read_items(spark, path)
    numbered = items.withColumn("qid", F.sha2(F.concat_ws("|", "query", "paper_id", "section_title"), 256)).dropDuplicates(["qid"])
    return numbered.orderBy("paper_id", "qid").limit(limit) if limit else numbered


def _judged(config: K.Config, s: Searcher, items: DataFrame, arms: list[A.Arm]) -> DataFrame:
    """(arm, qid, cluster, goldable, in_pool, rr): rankings and rerank scores are made once, at the depth of the deepest arm."""
    deep = max(a.candidates for a in arms) * config.lexical.fetch_multiplier
    queries = items.select("qid", F.col("query").alias("text"))
    dense = s.ranked(queries, None, deep).select("qid", "chunk_id", "rank")
    sparse = s.ranked_lexically(queries, None, deep).select("qid", "chunk_id", "rank") if any(a.sparse for a in arms) and s.lexical else None
    lists = R.snapshot(dense, sparse).persist()
    table = A.table(items.sparkSession, arms)
    ranked = A.reranked(A.pools(lists, table, config.lexical.fetch_multiplier, config.lexical.rrf_k), table, _scored(s, queries, lists))
    clusters = items.select("qid", F.col("paper_id").alias("cluster"))
    return A.scores(ranked, A.gold_sections(items, s.chunks), clusters, table, config.retrieval.max_k).persist()


def _scored(s: Searcher, queries: DataFrame, lists: DataFrame) -> DataFrame:
    """(qid, chunk_id, score) of all that any list holds; without a scorer, the order it is in."""
    asked = lists.groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank")).join(s.chunks.select("chunk_id", "text"), "chunk_id").join(queries.withColumnRenamed("text", "query"), "qid")
    return M.scored(asked, s.scorer).select("qid", "chunk_id", "score") if s.scorer else asked.select("qid", "chunk_id", (-F.col("rank")).cast("double").alias("score"))


def command_run(spark: SparkSession, config: K.Config, path: str, limit: str = "0") -> str:
    arm = A.Arm("default", config.retrieval.candidates, config.scorer.enabled, config.lexical.enabled)
    judged = _judged(config, searcher(config, opened(spark, config)), _items(spark, path, int(limit)), [arm])
    return reports.run(E.summary(judged), config.retrieval.max_k, arm.candidates)


def command_screen(spark: SparkSession, config: K.Config, path: str, candidates: str = "10,20,40") -> str:
    """One setting at a time against the default."""
    default = A.Arm("default", config.retrieval.candidates, config.scorer.enabled)
    arms = A.one_at_a_time(default, K.grid(candidates), sparse=config.lexical.enabled)
    return reports.screen(A.report(_judged(config, searcher(config, opened(spark, config)), _items(spark, path), arms), "default", config.resamples), "default")


def command_cells(spark: SparkSession, config: K.Config, sizes: str = "128,256,512") -> str:
    """How many chunks each size makes of the pool."""
    cells = {f"max_tokens={n}": {"max_tokens": n, "overlap_tokens": min(config.chunking.overlap_tokens, n // 4)} for n in K.grid(sizes)}
    pool = files.load_pool(spark, config.pool_path)
    default = "default"
    return reports.cells(A.cell_sizes(A.chunk_cells(pool, {default: {}, **cells}).select("arm", "chunk_id"), default))


def command_generate(spark: SparkSession, config: K.Config, out: str, *_: str) -> str:
    """Items on the pool's sections by the model of the settings, whole papers held out for test; leaked ones are kept apart."""
    model = M.build(M.LANGUAGE_MODELS, config.model.kind, **config.model.settings)
    pool = files.load_pool(spark, config.pool_path)
    made = Q.leak_check(Q.items(pool, model, config.chunking.min_tokens).filter("query IS NOT NULL"), model).join(E.holdout(pool.select("paper_id")), "paper_id").persist()
    files.write_splits(made, out, "leaked")
    rows = made.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaked").alias("leaked")).orderBy("split").collect()
    return "\n".join(f"{r['split']}: {r['n']} items, {r['leaked']} of them leaked" for r in rows) or "no items"


def command_sweep(spark: SparkSession, config: K.Config, path: str, sizes: str = "128,256,512", candidates: str = "10,20,40") -> str:
    """Every size of chunks with every number of candidates, with and without rerank; the pool is chunked once for each size."""
    items, pool, rows = _items(spark, path), files.load_pool(spark, config.pool_path), []
    embedder = M.build(M.EMBEDDERS, config.embedder.kind, **config.embedder.settings)
    scorer = M.build(M.SCORERS, config.scorer.kind, **config.scorer.settings)
    for size in K.grid(sizes):
        chunks = M.embedded(D.chunks(pool, size, min(config.chunking.overlap_tokens, size // 4), config.chunking.min_tokens, config.chunking.noise_ratio, tuple(config.chunking.extra_skip)), embedder).persist()
        arms = [A.Arm(f"{size:>6} {c:>10} {'on' if r else 'off':>6}", c, r) for c in K.grid(candidates) for r in (True, False)]
        rows += E.summary(_judged(config, Searcher(chunks, embedder, scorer), items, arms), ("arm",)).collect()
    cells = [[*r["arm"].split(), f"{r['success']:.3f}", f"{r['mrr']:.3f}", str(r["n_ungoldable"])] for r in sorted(rows, key=lambda r: (-r["mrr"], r["arm"]))]
    return reports.table(["tokens", "candidates", "rerank", "success", "mrr", "without gold"], cells)


def _per_paper(spark: SparkSession, config: K.Config, items: DataFrame, scopes: DataFrame, arms: list[A.Arm], gold: DataFrame, comparative: bool) -> tuple[DataFrame, DataFrame]:
    """Scores and mean pool sizes of arms that recall within scopes, whole or paper by paper."""
    s, k = searcher(config, opened(spark, config)), config.retrieval.max_k
    queries, table = items.select("qid", F.col("query").alias("text")), A.table(spark, arms)
    ranked = s.ranked(queries, scopes, max(a.candidates for a in arms), ("qid", "paper_id")).persist()
    pool = A.per_paper_pools(ranked, scopes, table, k)
    judged = A.reranked(pool.drop("score"), table, _scored(s, queries, ranked))
    if comparative:
        return A.comparative_scores(judged, gold, table, k).persist(), A.pool_sizes(pool, queries, table)
    return A.scores(judged, gold, items.select("qid", F.col("paper_id").alias("cluster")), table, k).persist(), A.pool_sizes(pool, queries, table)


def _group_arms(config: K.Config, candidates: list[int], papers: int) -> list[A.Arm]:
    """Off, each paper's production share, and its matched one where that is below what production gives it."""
    r, on = config.retrieval, config.scorer.enabled
    arms = [A.Arm(f"{kind} {c}", c, on, per_paper=kind) for c in candidates for kind in ("off", "production", "matched") if kind != "matched" or c // papers < r.max_k]
    return sorted(arms, key=lambda a: (a.arm != f"off {r.candidates}", a.arm))


def _said(scored: DataFrame, sizes: DataFrame, default: str, resamples: int) -> str:
    report = A.confirmed(A.report(scored, default, resamples)).persist()
    pools = {r["arm"]: r["mean_pool"] for r in sizes.collect()}
    sure = [r["arm"] for r in report.filter("confirmed").orderBy("arm").collect()]
    return "\n".join([reports.screen(report, default), "mean pool: " + ", ".join(f"{a} {n:.1f}" for a, n in sorted(pools.items())), f"confirmed: {', '.join(sure) or 'none'}"])


def command_per_paper(spark: SparkSession, config: K.Config, path: str, papers: str = "4", candidates: str = "10,20,30,50") -> str:
    """Items asked of their own paper and others drawn for them: one pool for all, or one for each paper."""
    items = _items(spark, path)
    pool = opened(spark, config).manifest().select("paper_id")
    scopes = E.scopes(items.select("qid", "paper_id"), pool, int(papers)).persist()
    arms = _group_arms(config, sorted({*K.grid(candidates), config.retrieval.candidates}), int(papers))
    gold = A.gold_sections(items, opened(spark, config).chunks())
    return _said(*_per_paper(spark, config, items, scopes, arms, gold, False), arms[0].arm, config.resamples)


def command_comparative(spark: SparkSession, config: K.Config, path: str, candidates: str = "10,20,30,50") -> str:
    """Comparative items asked of the papers that they compare: every paper's section must be found."""
    items = files.read_comparative(spark, path).withColumn("qid", F.sha2(F.concat_ws("|", "query", F.to_json("sections")), 256)).dropDuplicates(["qid"]).persist()
    scopes = items.select("qid", F.explode("sections.paper_id").alias("paper_id")).distinct()
    widest = scopes.groupBy("qid").count().agg(F.max("count")).first()[0] or 2
    arms = _group_arms(config, sorted({*K.grid(candidates), config.retrieval.candidates}), widest)
    gold = A.gold_of_comparisons(items, opened(spark, config).chunks())
    return _said(*_per_paper(spark, config, items, scopes, arms, gold, True), arms[0].arm, config.resamples)


def command_confirm(spark: SparkSession, config: K.Config, path: str, candidates: str, marker: str) -> str:
    """One other number of candidates against the default, on items kept for it; a second look at the same items is noted."""
    items = _items(spark, path).persist()
    known = C.items_fingerprint(items.select("query")).first()["fingerprint"]
    before = files.confirmations(spark, marker).filter(F.col("items") == known).count()
    d = config.retrieval.candidates
    arms = [A.Arm("default", d, config.scorer.enabled), A.Arm(f"candidates={int(candidates)}", int(candidates), config.scorer.enabled)]
    report = A.confirmed(A.report(_judged(config, searcher(config, opened(spark, config)), items, arms), "default", config.resamples), E.MIN_CLUSTERS).persist()
    sure = not report.filter("confirmed").isEmpty()
    files.confirm(spark, marker, known, arms[1].arm, sure)
    seen = [f"note: these items were looked at {before} times before; this is no fresh evidence"] * bool(before)
    paste = [K.block(retrieval__candidates=int(candidates))] * sure
    return "\n".join([reports.screen(report, "default"), f"confirmed: {'yes' if sure else 'no'}", *seen, *paste])


COMMANDS = {n.removeprefix("command_").replace("_", "-"): f for n, f in list(globals().items()) if n.startswith("command_")}


def main(arguments: list[str], spark: SparkSession | None = None) -> str:
    if not arguments or arguments[0] not in COMMANDS:
        raise SystemExit(f"{__doc__}\ncommands: {', '.join(COMMANDS)}")
    named = [a.split("=", 1)[1] for a in arguments if a.startswith("--config=")]
    settings = [a for a in arguments[1:] if a.startswith("--") and not a.startswith("--config=")]
    plain = [a for a in arguments[1:] if not a.startswith("--")]
    config = K.load(named[0] if named else None, settings, Path.cwd())
    return COMMANDS[arguments[0]](spark or SparkSession.builder.getOrCreate(), config, *plain)


if __name__ == "__main__":
    print(main(sys.argv[1:]))
