"""Screens and sweeps: many settings of retrieval judged on the same queries, as one plan with an ``arm`` column.

Rankings are made once, as deep as any arm needs them, and rerank scores once for every (query, chunk) that is ranked;
an arm is a slice of them. Arms are few (a grid that was typed), so their table is broadcast.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import documents as D
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R


@dataclass(frozen=True)
class Arm:
    arm: str
    candidates: int = 20
    rerank: bool = True
    sparse: bool = False
    variants: bool = False
    per_paper: str = "off"  # off, production (at least k for each paper) or matched (the whole budget shared)


def table(spark: SparkSession, arms: list[Arm]) -> DataFrame:
    kinds = {"str": "string", "int": "int", "bool": "boolean"}
    return F.broadcast(spark.createDataFrame([astuple(a) for a in arms], ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Arm))))


def one_at_a_time(default: Arm, candidates: list[int], sparse: bool = False, variants: bool = False) -> list[Arm]:
    """The default, the rerank toggle, each other number of candidates, and the optional hybrid and multi-query arms."""
    d = default
    arms = [d, Arm(f"rerank={'off' if d.rerank else 'on'}", d.candidates, not d.rerank)]
    arms += [Arm(f"candidates={c}", c, d.rerank) for c in sorted(set(candidates) - {d.candidates})]
    arms += [Arm("hybrid=on", d.candidates, d.rerank, sparse=True)] * sparse
    return arms + [Arm("multi_query=on", d.candidates, d.rerank, variants=True)] * variants


def pools(lists: DataFrame, arms: DataFrame, multiplier: int = 3, k: int = R.RRF_K) -> DataFrame:
    """(arm, qid, chunk_id, rank): the candidates of every arm, from (qid, list_no, source, chunk_id, rank)."""
    fused = F.col("sparse") | F.col("variants")
    mine = (F.col("list_no") == 0) | (F.col("variants")) | (F.col("sparse") & (F.col("list_no") == 1))
    deep = F.when(fused, F.col("candidates") * multiplier).otherwise(F.col("candidates"))
    cut = lists.join(arms).filter(mine & (F.col("rank") <= deep))
    key = F.struct("arm", "qid")
    pool = R.rrf(cut.select(key.alias("qid"), "list_no", "source", "chunk_id", "rank"), k).select("qid.arm", "qid.qid", "chunk_id", "rank")
    return pool.join(arms.select("arm", "candidates"), "arm").filter(F.col("rank") <= F.col("candidates")).drop("candidates")


def reranked(pool: DataFrame, arms: DataFrame, scores: DataFrame) -> DataFrame:
    """(arm, qid, chunk_id, rank, pool_rank): arms that rerank take the order of (qid, chunk_id, score), ties as they were."""
    p = pool.join(arms.select("arm", "rerank"), "arm").join(scores.select("qid", "chunk_id", "score"), ["qid", "chunk_id"], "left")
    p = p.withColumn("score", F.when(F.col("rerank"), F.col("score"))).withColumn("pool_rank", F.col("rank"))
    out = R.rerank(p.withColumn("qid", F.struct("arm", "qid")).drop("arm"), F.col("score"))
    return out.select("qid.arm", "qid.qid", "chunk_id", "rank", "pool_rank", "score")


def scores(ranked: DataFrame, gold: DataFrame, queries: DataFrame, arms: DataFrame, k: int) -> DataFrame:
    """(arm, qid, cluster, goldable, in_pool, rr): in_pool of all candidates, rr of the first k as ranked."""
    hits = ranked.join(gold.select("qid", "chunk_id").distinct(), ["qid", "chunk_id"], "left_semi").groupBy("arm", "qid").agg(F.min("rank").alias("best"))
    every = queries.join(arms.select("arm")).join(gold.select("qid").distinct().withColumn("goldable", F.lit(True)), "qid", "left").join(hits, ["arm", "qid"], "left")
    return every.select(
        "arm", "qid", "cluster", F.coalesce("goldable", F.lit(False)).alias("goldable"), F.col("best").isNotNull().alias("in_pool"),
        F.when(F.col("best") <= k, 1.0 / F.col("best")).otherwise(0.0).alias("rr"),
    )


def samples(scored: DataFrame) -> dict[str, DataFrame]:
    """What is resampled: success over goldable queries, reciprocal ranks over those with gold in the pool."""
    g, p = F.col("goldable"), F.col("in_pool")
    return {
        "success": scored.select("arm", "qid", "cluster", g.alias("eligible"), p.cast("double").alias("value")),
        "mrr": scored.select("arm", "qid", "cluster", (g & p).alias("eligible"), F.col("rr").alias("value")),
    }


def _resampled(scored: DataFrame, default: str) -> DataFrame:
    """(what, arm, cluster, value): each metric over its eligible queries, and each other arm's differences to the default over the queries eligible in both."""
    parts = []
    for name, sampled in samples(scored).items():
        eligible = sampled.filter("eligible")
        base = eligible.filter(F.col("arm") == default).select("qid", F.col("value").alias("base"))
        pairs = eligible.filter(F.col("arm") != default).join(base, "qid")
        parts.append(eligible.select(F.lit(name).alias("what"), "arm", "cluster", "value"))
        parts.append(pairs.select(F.lit(f"{name}_delta").alias("what"), "arm", "cluster", (F.col("value") - F.col("base")).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def report(scored: DataFrame, default: str, n_boot: int = 2000) -> DataFrame:
    """A row for each arm: metrics with their intervals, paired differences to the default (the least detectable one, and
    whether they are), and what stands against them. One bootstrap for all.

    ``weakest`` is the least number of clusters that any comparison of the report rests on.
    """
    by = ("what", "arm")
    b = E.bootstrap(E.clusters(_resampled(scored, default), F.col("value"), by), n_boot, by=by).withColumn("mdd", E.mdd(F.col("se")))
    b = b.withColumn("detectable", E.detectable(F.col("point"), F.col("ci_lo"), F.col("ci_hi"), F.col("mdd")))
    of_metric, of_delta = ("point", "ci_lo", "ci_hi", "se", "n_clusters", "n_eligible"), ("point", "ci_lo", "ci_hi", "mdd", "n_clusters", "detectable")
    shown = {w: of_delta if w.endswith("_delta") else of_metric for name in ("success", "mrr") for w in (name, f"{name}_delta")}
    value = lambda w, c: F.max(F.when(F.col("what") == w, F.col(c))).alias(f"{w}_{c}")
    out = b.groupBy("arm").agg(*[value(w, c) for w, columns in shown.items() for c in columns])
    least = out.agg(F.min(F.least("success_delta_n_clusters", "mrr_delta_n_clusters")).alias("d"), F.min(F.when(F.col("arm") == default, F.col("success_n_clusters"))).alias("s"))
    out = out.join(F.broadcast(least.select(F.least("d", "s").alias("weakest"))))
    return out.withColumn("warnings", E.warnings(F.col("weakest"), F.col("success_point")))


def candidate_points(reports: DataFrame) -> DataFrame:
    """Arms that are detectably better than the default in a metric, as one row: n, arms in order of their names."""
    won = lambda m: F.coalesce(F.col(f"{m}_delta_detectable") & (F.col(f"{m}_delta_point") > 0), F.lit(False))
    found = reports.filter(won("success") | won("mrr"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("arm")), ", ").alias("arms"))


def elbow_screen(ranked: DataFrame, gold: DataFrame, knobs: list[tuple[str, float, float]], min_k: int = 2, max_k: int = 10) -> DataFrame:
    """(arm, mean_returned, recall, precision) for each (arm, mad_multiplier, prominence): the same lists, cut anew."""
    spark = ranked.sparkSession
    arms = F.broadcast(spark.createDataFrame(knobs, "arm string, mad double, prominence double"))
    marked = ranked.join(gold.select("qid", "chunk_id").distinct().withColumn("hit", F.lit(True)), ["qid", "chunk_id"], "left")
    lists = marked.filter(F.col("rank") <= max_k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "hit"))).alias("x"))
    lists = lists.join(marked.filter("hit").select("qid").distinct(), "qid", "left_semi").join(arms)
    lists = lists.withColumn("c", R.cutoff(F.transform("x", lambda r: r["score"]), min_k, max_k, F.col("mad"), F.col("prominence"))["cutoff"])
    hit = F.exists(F.slice("x", F.lit(1), F.col("c")), lambda r: F.coalesce(r["hit"], F.lit(False)))
    per = lists.select("arm", "c", hit.alias("hit"))
    return per.groupBy("arm").agg(
        F.avg("c").alias("mean_returned"), F.avg(F.col("hit").cast("int")).alias("recall"), F.avg(F.when(F.col("hit"), 1.0 / F.col("c")).otherwise(0.0)).alias("precision")
    )


def chunk_cells(pool: DataFrame, cells: dict[str, dict]) -> DataFrame:
    """The chunk tables of several settings, with an ``arm`` column: each its own index, none sees another's. One parse for all."""
    return D.cells(pool, cells)


def judge_cells(chunks: DataFrame, items: DataFrame, queries: DataFrame, candidates: int = 20, k: int = 10) -> DataFrame:
    """(arm, qid, cluster, goldable, in_pool, rr) of cells: chunks (arm, chunk_id, paper_id, section_number, section_title, embedding), queries (qid, q).

    Every cell is searched by itself: a query is ranked within (qid, arm), and its gold are that cell's chunks of the section
    that the item was made from. Chunks of ``documents.embedded_cells``, whose ``arms`` share them, meet a query once: the best
    of an arm are among the best of each set of arms that it is in.
    """
    shared = chunks if "arms" in chunks.columns else chunks.withColumnRenamed("arm", "arms")
    apart = lambda df: df.withColumn("arm", F.explode(F.split("arms", D.BETWEEN)))
    arms = apart(shared.select("arms").distinct()).select("arm").distinct()
    best = R.dense_topk(queries, shared.select("arms", "chunk_id", "embedding"), candidates, ("qid", "arms"), unit=False).drop("rank")
    ranked = R.top(apart(best), candidates, ("qid", "arm")).select("arm", "qid", "chunk_id", "rank")
    gold = apart(gold_sections(items, shared, "arms")).drop("arms")
    hits = ranked.join(gold.distinct(), ["arm", "qid", "chunk_id"], "left_semi").groupBy("arm", "qid").agg(F.min("rank").alias("best"))
    told = gold.select("arm", "qid").distinct().withColumn("goldable", F.lit(True))
    every = items.select("qid", F.col("paper_id").alias("cluster")).join(F.broadcast(arms)).join(told, ["arm", "qid"], "left").join(hits, ["arm", "qid"], "left")
    return every.select(
        "arm", "qid", "cluster", F.coalesce("goldable", F.lit(False)).alias("goldable"), F.col("best").isNotNull().alias("in_pool"),
        F.when(F.col("best") <= k, 1.0 / F.col("best")).otherwise(0.0).alias("rr"),
    )


def cell_sizes(chunks: DataFrame, default: str) -> DataFrame:
    """(arm, n_chunks, change, collisions): against the default's number; ids that two chunks share lose one of them."""
    sizes = chunks.groupBy("arm").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk_id").alias("n_ids"))
    base = sizes.filter(F.col("arm") == default).select(F.col("n_chunks").alias("base"))
    return sizes.join(F.broadcast(base)).select("arm", "n_chunks", (F.col("n_chunks") - F.col("base")).alias("change"), (F.col("n_chunks") - F.col("n_ids")).alias("collisions"))


def gold_sections(items: DataFrame, chunks: DataFrame, *more: str) -> DataFrame:
    """(qid, chunk_id[, ...]): all chunks of the section that an item was made from, by paper, number and title."""
    same = items.select("qid", "paper_id", F.coalesce("section_number", F.lit("")).alias("section_number"), "section_title")
    return chunks.join(R.sized_broadcast(same), ["paper_id", "section_number", "section_title"]).select("qid", "chunk_id", *more)


def gold_of_comparisons(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, paper_id, chunk_id) of comparative items (qid, sections): gold for each of the compared papers."""
    each = items.select("qid", F.explode("sections").alias("s")).select("qid", "s.paper_id", F.col("s.number").alias("section_number"), F.col("s.title").alias("section_title"))
    return gold_sections(each, chunks, "paper_id")


def per_paper_pools(ranked: DataFrame, scopes: DataFrame, arms: DataFrame, k: int) -> DataFrame:
    """(arm, qid, chunk_id, score, rank) for the per-paper arms, from lists ranked within (qid, paper_id).

    off: one pool over the whole scope; production: each paper's share of the candidates, k at least; matched: its
    share, 1 at least, so that the whole pool is no larger than the others'.
    """
    sizes = scopes.groupBy("qid").agg(F.count(F.lit(1)).alias("groups"))
    inside = ranked.join(scopes.select("qid", "paper_id"), ["qid", "paper_id"], "left_semi").join(sizes, "qid").join(arms)
    floor = F.when(F.col("per_paper") == "production", F.lit(k)).otherwise(F.lit(1))
    share = F.greatest(floor, F.floor(F.col("candidates") / F.col("groups")).cast("int"))
    kept = inside.filter((F.col("per_paper") == "off") | (F.col("rank") <= share))
    pool = R.top(kept.select(F.struct("arm", "qid").alias("qid"), "chunk_id", "score", "candidates", "per_paper"), 1 << 30)
    whole = (F.col("per_paper") != "off") | (F.col("rank") <= F.col("candidates"))
    return pool.filter(whole).select("qid.arm", "qid.qid", "chunk_id", "score", "rank")


def pool_sizes(pool: DataFrame, queries: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, mean_pool): over all queries, those with an empty pool too."""
    n = pool.groupBy("arm", "qid").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("qid").join(arms.select("arm")).join(n, ["arm", "qid"], "left").groupBy("arm").agg(F.avg(F.coalesce("n", F.lit(0))).alias("mean_pool"))


def comparative_scores(ranked: DataFrame, gold: DataFrame, arms: DataFrame, k: int) -> DataFrame:
    """(arm, qid, cluster, goldable, in_pool, rr): every paper's gold must be there, and the worst paper's rank counts.

    The cluster is the item's first paper.
    """
    keyed = ranked.select("arm", "qid", "chunk_id", "rank")
    best = gold.join(arms.select("arm")).join(keyed, ["arm", "qid", "chunk_id"], "left").groupBy("arm", "qid", "paper_id").agg(F.min("rank").alias("best"))
    return best.groupBy("arm", "qid").agg(
        F.min("paper_id").alias("cluster"), F.lit(True).alias("goldable"), F.bool_and(F.col("best").isNotNull()).alias("in_pool"),
        F.min(F.when(F.col("best") <= k, 1.0 / F.col("best")).otherwise(0.0)).alias("rr"),
    )


def confirmed(report_: DataFrame, least: int = E.COMPARATIVE_FLOOR) -> DataFrame:
    """The report with ``confirmed``: a detectable gain that rests on enough clusters."""
    gain = lambda m: F.coalesce(F.col(f"{m}_delta_detectable") & (F.col(f"{m}_delta_point") > 0) & (F.col(f"{m}_delta_n_clusters") >= least), F.lit(False))
    return report_.withColumn("confirmed", gain("success") | gain("mrr"))


def remaining(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds that are left at the pace so far."""
    return F.when(done > 0, elapsed / done * (total - done))
