"""Retrieval quality and its uncertainty: success at depth, reciprocal ranks, clustered bootstrap, paired deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import hashed_int
from tessera.operators.retrieval import cutoff, score_lists, sized_broadcast

#: Normal quantiles of a two-sided 5 % test and of 80 % power.
Z_ALPHA, Z_POWER = 1.959964, 0.841621
MIN_CLUSTERS, SATURATION, COMPARATIVE_FLOOR = 25, 0.98, 8


def query_scores(ranked: DataFrame, gold: DataFrame, queries: DataFrame, k: int, candidates: int, sizes: DataFrame | None = None) -> DataFrame:
    """One row for each query: goldable, in_pool, rr (of the first relevant rank up to k, else 0).

    ranked: (qid, chunk_id, rank); gold: (qid, chunk_id); queries: (qid, cluster). Queries without gold stay, as not goldable.
    With ``sizes`` (qid, n_gold), ``gold`` need only hold what is ranked.
    """
    sizes = gold.groupBy("qid").agg(F.count(F.lit(1)).alias("n_gold")) if sizes is None else sizes
    hits = ranked.filter(F.col("rank") <= candidates).join(gold, ["qid", "chunk_id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("best"))
    q = queries.join(sizes, "qid", "left").join(hits, "qid", "left")
    return q.select(
        "qid", "cluster", F.coalesce(F.col("n_gold") > 0, F.lit(False)).alias("goldable"), F.col("best").isNotNull().alias("in_pool"),
        F.when(F.col("best") <= k, 1.0 / F.col("best")).otherwise(0.0).alias("rr"),
    )


def summary(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """success over goldable queries, mrr over those with gold in the pool, and the counts behind them."""
    g = F.col("goldable")
    return scores.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(g, F.col("in_pool").cast("double"))), F.lit(0.0)).alias("success"),
        F.coalesce(F.avg(F.when(g & F.col("in_pool"), F.col("rr"))), F.lit(0.0)).alias("mrr"),
        F.count_if(g & F.col("in_pool")).alias("n_conditioned"),
        F.count_if(~g).alias("n_ungoldable"),
    )


def elbow_metrics(ranked: DataFrame, gold: DataFrame, max_k: int, **knobs) -> DataFrame:
    """mean_returned, recall, precision of the adaptive cutoff on the best ``max_k``, over queries with gold in the pool."""
    marked = ranked.join(gold.select("qid", "chunk_id").distinct().withColumn("hit", F.lit(True)), ["qid", "chunk_id"], "left")
    top = marked.filter(F.col("rank") <= max_k).select("qid", "chunk_id", "rank", "score", "hit")
    pooled = marked.filter("hit").select("qid").distinct()
    cuts = score_lists(top.join(pooled, "qid", "left_semi")).select("qid", cutoff(F.col("scores"), max_k=max_k, **knobs)["cutoff"].alias("cutoff"))
    per = cuts.join(top, "qid").groupBy("qid", "cutoff").agg(F.coalesce(F.bool_or(F.col("hit") & (F.col("rank") <= F.col("cutoff"))), F.lit(False)).alias("hit"))
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return per.agg(mean("cutoff", "mean_returned"), mean(F.col("hit").cast("int"), "recall"), mean(F.when(F.col("hit"), 1.0 / F.col("cutoff")).otherwise(0.0), "precision"))


def comparative_scores(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """For gold (qid, paper_id, chunk_id): in_pool only if every paper's gold is there; rr of the worst paper."""
    best = gold.join(ranked, ["qid", "chunk_id"], "left").groupBy("qid", "paper_id").agg(F.min("rank").alias("best"))
    return best.groupBy("qid").agg(
        F.bool_and(F.col("best").isNotNull()).alias("in_pool"),
        F.min(F.when(F.col("best") <= k, 1.0 / F.col("best")).otherwise(0.0)).alias("rr"),
    )


def clusters(samples: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums and counts of each cluster, numbered from 0 in order of its id: all that resampling needs.

    Clusters are the papers of a set of evaluation items; a resample draws as many, so their number is what n_boot allows.
    """
    c = samples.groupBy(*by, "cluster").agg(F.sum(value).alias("s"), F.count(value).alias("n")).filter("n > 0")
    return c.withColumn("idx", F.row_number().over(Window.partitionBy(*by).orderBy("cluster")) - 1)


def bootstrap(cl: DataFrame, n_boot: int = 2000, seed: str = "7", by: tuple[str, ...] = ()) -> DataFrame:
    """point, ci_lo, ci_hi, se, n_clusters, n_eligible: clusters drawn with replacement, pooled mean of each draw.

    Without clusters all of them are 0.

    Draw d of resample b is the hash of (seed, b, d): the same in any engine and any plan.
    """
    totals = cl.groupBy(*by).agg(F.count(F.lit(1)).alias("g"), (F.sum("s") / F.sum("n")).alias("point"), F.sum("n").alias("n_eligible"))
    spark = cl.sparkSession
    draws = spark.range(n_boot).withColumnRenamed("id", "b").join(F.broadcast(totals.select(*by, "g")))
    draws = draws.select(*by, "b", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)).alias("d"))
    picked = draws.withColumn("idx", hashed_int(F.lit(seed), F.col("b").cast("string"), F.col("d").cast("string")) % F.col("g"))
    means = picked.join(cl.select(*by, F.col("idx").cast("long").alias("idx"), "s", "n"), [*by, "idx"]).groupBy(*by, "b").agg((F.sum("s") / F.sum("n")).alias("m"))
    spread = means.groupBy(*by).agg(F.expr("percentile(m, 0.025)").alias("ci_lo"), F.expr("percentile(m, 0.975)").alias("ci_hi"), F.stddev_samp("m").alias("se"))
    j = totals.join(spread, list(by)) if by else totals.join(spread)
    known = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("point", "ci_lo", "ci_hi", "se")]
    return j.select(*by, *known, F.col("g").alias("n_clusters"), F.coalesce("n_eligible", F.lit(0).cast("long")).alias("n_eligible"))


def mdd(se: Column) -> Column:
    """The smallest difference that such an error can tell from none."""
    return (Z_ALPHA + Z_POWER) * se


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences of the queries that are eligible in both arms: (qid, cluster, eligible, value) each."""
    left = a.filter("eligible").select("qid", "cluster", F.col("value").alias("x"))
    right = b.filter("eligible").select("qid", F.col("value").alias("y"))
    return left.join(right, "qid").select("qid", "cluster", (F.col("x") - F.col("y")).alias("value"))


def detectable(delta: Column, lo: Column, hi: Column, least: Column) -> Column:
    return ((lo > 0) | (hi < 0)) & (F.abs(delta) >= least)


def warnings(n_clusters: Column, point: Column) -> Column:
    """What stands against reading much into a result."""
    few = F.when(n_clusters < MIN_CLUSTERS, F.lit("few_clusters"))
    full = F.when(point >= SATURATION, F.lit("saturated"))
    return F.array_compact(F.array(few, full))


def cooccurrence(items: DataFrame) -> DataFrame:
    """Unordered pairs of papers that one item names, and how many items do: (item_id, papers)."""
    p = items.select("item_id", F.explode(F.array_distinct("papers")).alias("a"))
    q = p.select("item_id", F.col("a").alias("b"))
    return p.join(q, "item_id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def holdout(papers: DataFrame, share: float = 0.25, seed: str = "7") -> DataFrame:
    """Whole papers go to test: the least hashes, round(n * share) of them, none of a single paper.

    A histogram of the hashes' upper halves tells where the last of them is; only the papers of that one step are ranked.
    """
    hashed = papers.withColumn("h", hashed_int(F.lit(seed), F.col("paper_id").cast("string"))).withColumn("step", F.floor(F.col("h") / 65536))
    steps = sorted(hashed.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["step"])
    n = sum(r["n"] for r in steps)
    wanted = round(n * share) if n > 1 else 0
    last, left = -1, wanted
    for r in steps:
        last = r["step"]
        if left <= r["n"]:
            break
        left -= r["n"]
    here = hashed.filter(F.col("step") == last).withColumn("r", F.row_number().over(Window.partitionBy("step").orderBy("h", "paper_id")))
    inside = here.select("paper_id", F.when(F.col("r") <= left, "test").otherwise("dev").alias("split"))
    outside = hashed.filter(F.col("step") != last).select("paper_id", F.when(F.col("step") < last, "test").otherwise("dev").alias("split"))
    return inside.unionByName(outside)


def scopes(items: DataFrame, papers: DataFrame, n: int, seed: str = "7") -> DataFrame:
    """For each item its own paper and n - 1 others, by seeded hash; all papers where there are fewer."""
    others = items.select("qid", F.col("paper_id").alias("gold")).join(sized_broadcast(papers))
    own = F.when(F.col("paper_id") == F.col("gold"), -1).otherwise(hashed_int(F.lit(seed), F.col("qid").cast("string"), F.col("paper_id").cast("string")))
    w = Window.partitionBy("qid").orderBy("h", "paper_id")
    return others.withColumn("h", own).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("qid", "paper_id")


def confusion(pairs: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return pairs.groupBy("gold").pivot("pred", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def macro_f1(pairs: DataFrame, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean F1 over the labels of (gold, pred)."""
    each = pairs.select(*by, "gold", "pred", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    tp = F.count_if((F.col("gold") == F.col("label")) & (F.col("pred") == F.col("label")))
    either = F.count_if(F.col("gold") == F.col("label")) + F.count_if(F.col("pred") == F.col("label"))
    f1 = each.groupBy(*by, "label").agg(tp.alias("tp"), either.alias("__either")).withColumn("f1", F.when(F.col("__either") > 0, 2.0 * F.col("tp") / F.col("__either")).otherwise(0.0))
    return f1.groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def label_scores(pairs: DataFrame, labels: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """label, precision, recall, f1 and support of (gold, pred): counts by the nine pairs of labels first, so little is exploded."""
    counted = pairs.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select(*by, "gold", "pred", "n", F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0).cast("long")))
    gold, pred = F.col("gold") == F.col("label"), F.col("pred") == F.col("label")
    c = each.groupBy(*by, "label").agg(total(gold & pred).alias("tp"), total(gold).alias("support"), total(pred).alias("said"))
    return c.select(*by, "label", *_prf(F.col("tp"), F.col("support"), F.col("said")), "support")


def _prf(tp: Column, support: Column, said: Column) -> tuple[Column, Column, Column]:
    share = lambda whole: F.when(whole > 0, tp / whole).otherwise(F.lit(0.0))
    both = support + said
    return share(said).alias("precision"), share(support).alias("recall"), F.when(both > 0, 2.0 * tp / both).otherwise(F.lit(0.0)).alias("f1")


def score_counts(scored: DataFrame, labels: tuple[str, str, str], places: int = 4) -> DataFrame:
    """score, and for each label the number of pairs of (gold, score) at or below it (le_<label>), under it (lt_<label>) and in all.

    Distinct scores of values from 0 to 1 are at most 10 ** places + 1, whatever the number of pairs: one sort of them gives all sums.
    """
    at = [F.count_if(F.col("gold") == x).alias(f"at_{x}") for x in labels]
    each = scored.filter(F.col("score").isNotNull()).groupBy(F.round("score", places).alias("score")).agg(*at)
    upto, whole = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    sums = [c for x in labels for c in (F.sum(f"at_{x}").over(upto).alias(f"le_{x}"), (F.sum(f"at_{x}").over(upto) - F.col(f"at_{x}")).alias(f"lt_{x}"), F.sum(f"at_{x}").over(whole).alias(f"all_{x}"))]
    return each.select("score", *sums)


def threshold_search(scored: DataFrame, labels: tuple[str, str, str], best: int = 5, places: int = 4) -> DataFrame:
    """The ``best`` pairs of thresholds by macro F1: rank, cmax, emin, macro_f1, and each label's precision, recall and F1.

    ``labels`` are those of scores up to cmax, between, and from emin on. Every pair cmax < emin of the distinct scores is
    judged from running sums, not from the scores; ties go to the smaller cmax, then the smaller emin.
    """
    low, mid, high = labels
    counts = score_counts(scored, labels, places)
    # Bounded by ``places``: at most 10 ** places + 1 rows, also where it is broadcast.
    c = counts.select(F.col("score").alias("cmax"), *[F.col(f"le_{x}").alias(f"c_{x}") for x in labels])
    e = counts.select(F.col("score").alias("emin"), *[F.col(f"lt_{x}").alias(f"e_{x}") for x in labels], *[F.col(f"all_{x}") for x in labels])
    both = c.join(F.broadcast(e), F.col("cmax") < F.col("emin"))
    said = {
        low: lambda x: F.col(f"c_{x}"),
        mid: lambda x: F.col(f"e_{x}") - F.col(f"c_{x}"),
        high: lambda x: F.col(f"all_{x}") - F.col(f"e_{x}"),
    }
    scores = [s.alias(f"{name}_{x}") for x in labels for name, s in zip(("precision", "recall", "f1"), _prf(said[x](x), F.col(f"all_{x}"), sum((said[x](y) for y in labels[1:]), said[x](low))))]
    judged = both.select("cmax", "emin", *scores).withColumn("macro_f1", sum((F.col(f"f1_{x}") for x in labels[1:]), F.col(f"f1_{low}")) / len(labels))
    order = [F.round("macro_f1", 9).desc(), F.col("cmax"), F.col("emin")]
    first = judged.orderBy(*order).limit(best)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "cmax", "emin", "macro_f1", *[f"{m}_{x}" for x in labels for m in ("precision", "recall", "f1")])
