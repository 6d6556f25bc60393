"""Named evaluation queries. Relevant are vectors with the query's label, and documents that contain a benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.plans.catalogue import query, table
from tessera.plans.retrieval import DOT, LEXICAL, _items, _lexical, _vectors, elbow_ctes

K, DEPTH, OPENING = 10, 40, 5


def _dense(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rankings without the query itself, (qid, n_gold), queries with their label as cluster, and labels of all vectors.

    Relevant are the other vectors of the query's label: they are counted by label, and told on the ranked rows.
    """
    queries, chunks = _vectors(spark, sf_dir)
    labels = chunks.select("chunk_id", "label")
    sizes = labels.groupBy(F.col("label").alias("cluster")).agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    q = queries.join(labels, queries["qid"] == labels["chunk_id"]).select("qid", "q", F.col("label").alias("cluster"))
    ranked = R.top(R.dense_topk(q.select("qid", "q"), chunks, DEPTH + 1).filter("chunk_id != qid").drop("rank"), DEPTH)
    known = q.join(sizes, "cluster", "left").select("qid", "cluster", "n_gold")
    return ranked.withColumnRenamed("label", "found"), known.select("qid", "n_gold").filter("n_gold > 0"), q.select("qid", "cluster"), q.select("qid", "cluster")


def _relevant(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """qid, chunk_id of the ranked rows that are relevant."""
    return ranked.join(R.sized_broadcast(labels), "qid").filter(F.col("found") == F.col("cluster")).select("qid", "chunk_id")


DENSE = f"""scored AS (SELECT a.vec_id AS qid, a.label AS cluster, b.vec_id AS chunk_id, b.label, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored) WHERE rank <= {DEPTH}),
hits AS (SELECT qid, min(rank) AS best FROM ranked WHERE cluster = label GROUP BY qid),
gold AS (SELECT qid, count(*) AS n FROM scored WHERE cluster = label GROUP BY qid),
scores AS (
  SELECT q.vec_id AS qid, q.label AS cluster, coalesce(n > 0, false) AS goldable, best IS NOT NULL AS in_pool, CASE WHEN best <= {K} THEN 1.0::DOUBLE / best ELSE 0.0 END::DOUBLE AS rr
  FROM embeddings q LEFT JOIN hits ON hits.qid = q.vec_id LEFT JOIN gold ON gold.qid = q.vec_id WHERE q.vec_id % 100 = 0)"""
SUMMARY = """coalesce(avg(in_pool::INTEGER) FILTER (WHERE goldable), 0.0)::DOUBLE AS success, coalesce(avg(rr) FILTER (WHERE goldable AND in_pool), 0.0)::DOUBLE AS mrr,
count(*) FILTER (WHERE goldable AND in_pool) AS n_conditioned, count(*) FILTER (WHERE NOT goldable) AS n_ungoldable"""
LEX = f"""{LEXICAL},
ranked AS (SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25) WHERE rank <= {DEPTH}),
gold AS (SELECT item_id AS qid, doc_id AS chunk_id, source FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
lexq AS (SELECT item_id AS qid, item_id % 8 AS cluster FROM benchmark),
scores AS (
  SELECT q.qid, cluster, coalesce(n > 0, false) AS goldable, best IS NOT NULL AS in_pool, CASE WHEN best <= {K} THEN 1.0::DOUBLE / best ELSE 0.0 END::DOUBLE AS rr
  FROM lexq q LEFT JOIN (SELECT qid, min(rank) AS best FROM ranked JOIN gold USING (qid, chunk_id) GROUP BY qid) USING (qid) LEFT JOIN (SELECT qid, count(*) AS n FROM gold GROUP BY qid) USING (qid))"""


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item word for word: looked up by the item's first five words, then compared whole.

    The words of a text are the runs between blanks and line ends; items begin and end with whole words.
    """
    runs = lambda text: F.filter(F.split(text, r"[ \n]+"), lambda w: w != "")
    items = _items(spark, sf_dir).select("qid", F.col("text").alias("passage"), F.xxhash64(F.slice(runs("text"), 1, OPENING)).alias("opening"))
    words = _lexical(spark, sf_dir).select("chunk_id", "text", "source", runs("text").alias("w"))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - OPENING + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(F.col("w"), i, OPENING)))
    found = words.select("chunk_id", "source", F.explode(F.array_distinct(starts)).alias("opening")).join(R.sized_broadcast(items), "opening").select("qid", "passage", "chunk_id", "source")
    texts = _lexical(spark, sf_dir).select("chunk_id", "text")
    return found.join(texts, "chunk_id").filter(F.col("text").contains(F.col("passage"))).select("qid", "chunk_id", "source").distinct()


def _dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, sizes, queries, labels = _dense(spark, sf_dir)
    return E.query_scores(ranked, _relevant(ranked, labels), queries, K, DEPTH, sizes)


def _lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    ranked = R.bm25_topk(items, _lexical(spark, sf_dir), DEPTH)
    return E.query_scores(ranked, _gold(spark, sf_dir).select("qid", "chunk_id"), items.select("qid", (F.col("qid") % 8).alias("cluster")), K, DEPTH)


@query(f"WITH {DENSE} SELECT qid, cluster, goldable, in_pool, rr FROM scores")
def query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense_scores(spark, sf_dir)


@query(f"WITH {DENSE} SELECT {SUMMARY} FROM scores")
def success_at_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(_dense_scores(spark, sf_dir))


@query(f"WITH {LEX} SELECT {SUMMARY} FROM scores")
def mrr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that stand in no document are not goldable, and counted."""
    return E.summary(_lexical_scores(spark, sf_dir))


@query(f"""WITH {LEX}, paper AS (SELECT qid, source, min(rank) AS best FROM gold LEFT JOIN ranked USING (qid, chunk_id) GROUP BY ALL)
SELECT qid, bool_and(best IS NOT NULL) AS in_pool, min(CASE WHEN best <= {K} THEN 1.0::DOUBLE / best ELSE 0.0 END)::DOUBLE AS rr FROM paper GROUP BY qid""")
def comparative_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = R.bm25_topk(_items(spark, sf_dir), _lexical(spark, sf_dir), DEPTH).select("qid", "chunk_id", "rank")
    return E.comparative_scores(ranked, _gold(spark, sf_dir).withColumnRenamed("source", "paper_id"), K)


@query(f"""WITH {DENSE}, top10 AS (SELECT * FROM ranked WHERE rank <= {K} AND qid IN (SELECT qid FROM scores WHERE in_pool)), {elbow_ctes("top10", max_k=K)},
per AS (SELECT e.qid, cutoff, count(*) FILTER (WHERE r.rank <= cutoff AND r.cluster = r.label) AS n FROM elbow e JOIN top10 r USING (qid) GROUP BY ALL)
SELECT coalesce(avg(cutoff), 0) AS mean_returned, coalesce(avg((n > 0)::INTEGER), 0) AS recall, coalesce(avg(CASE WHEN n > 0 THEN 1.0::DOUBLE / cutoff ELSE 0 END), 0) AS precision FROM per""")
def elbow_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the adaptive cutoff returns of the best ``K``: how many, and whether a relevant one is among them; over queries with one in the pool."""
    ranked, _, _, labels = _dense(spark, sf_dir)
    return E.elbow_metrics(ranked, _relevant(ranked, labels), K)


ARMS = ((5, 3), (10, 5), (20, 10), (40, 10))


@query(f"""WITH {DENSE}, arms AS (SELECT * FROM (VALUES {", ".join(f"('c{c}_k{k}', {c}, {k})" for c, k in ARMS)}) AS t(arm, c, k)),
hit AS (SELECT arm, qid, min(rank) AS best FROM arms JOIN ranked ON rank <= c WHERE cluster = label GROUP BY ALL),
s AS (SELECT arm, s.qid, goldable, best IS NOT NULL AS in_pool, CASE WHEN best <= k THEN 1.0::DOUBLE / best ELSE 0.0 END::DOUBLE AS rr FROM arms CROSS JOIN scores s LEFT JOIN hit USING (arm, qid))
SELECT arm, {SUMMARY} FROM s GROUP BY arm""")
def arm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All arms of a grid from one deep snapshot: slices of the same rankings, grouped by arm."""
    ranked, sizes, queries, labels = _dense(spark, sf_dir)
    arms = F.broadcast(spark.createDataFrame([(f"c{c}_k{k}", c, k) for c, k in ARMS], "arm string, c int, k int"))
    relevant = ranked.join(_relevant(ranked, labels), ["qid", "chunk_id"], "left_semi").join(arms, F.col("rank") <= F.col("c"))
    hit = relevant.groupBy("arm", "qid").agg(F.min("rank").alias("best"))
    s = queries.join(arms).join(sizes, "qid", "left").join(hit, ["arm", "qid"], "left")
    s = s.select("arm", "qid", F.col("n_gold").isNotNull().alias("goldable"), F.col("best").isNotNull().alias("in_pool"), F.when(F.col("best") <= F.col("k"), 1.0 / F.col("best")).otherwise(0.0).alias("rr"))
    return E.summary(s, ("arm",))


def bootstrap_ctes(samples: str) -> str:
    return f"""cl AS (SELECT cluster, sum(value) AS s, count(value) AS n, row_number() OVER (ORDER BY cluster) - 1 AS idx FROM {samples} GROUP BY cluster HAVING count(value) > 0),
g AS (SELECT count(*) AS g FROM cl),
pick AS (SELECT b, ('0x' || substr(md5('7|' || b || '|' || d), 1, 8))::BIGINT % g AS idx FROM range(2000) AS x(b), g, unnest(range(g)) AS y(d)),
m AS (SELECT b, sum(s) / sum(n) AS m FROM pick JOIN cl USING (idx) GROUP BY b)"""


BOOT = "coalesce(round(quantile_cont(m, 0.025), 9), 0) AS ci_lo, coalesce(round(quantile_cont(m, 0.975), 9), 0) AS ci_hi, coalesce(round(stddev_samp(m), 9), 0) AS se"


def _boot(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) for c in ("point", "ci_lo", "ci_hi", "se")], "n_clusters", "n_eligible")


@query(f"""WITH {LEX}, samples AS (SELECT cluster, in_pool::INTEGER::DOUBLE AS value FROM scores WHERE goldable), {bootstrap_ctes("samples")}
SELECT (SELECT coalesce(round(sum(s) / sum(n), 9), 0) FROM cl) AS point, {BOOT}, (SELECT g FROM g) AS n_clusters, (SELECT coalesce(sum(n), 0)::BIGINT FROM cl) AS n_eligible FROM m""")
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _lexical_scores(spark, sf_dir).filter("goldable")
    return _boot(E.bootstrap(E.clusters(s, F.col("in_pool").cast("double"))))


@query(f"""WITH {LEX}, a AS (SELECT qid, cluster, rr AS x FROM scores WHERE goldable),
b AS (SELECT s.qid, CASE WHEN best <= 1 THEN 1.0::DOUBLE ELSE 0.0 END::DOUBLE AS y FROM scores s LEFT JOIN (SELECT qid, min(rank) AS best FROM ranked JOIN gold USING (qid, chunk_id) GROUP BY qid) USING (qid) WHERE goldable),
samples AS (SELECT cluster, x - y AS value FROM a JOIN b USING (qid)), {bootstrap_ctes("samples")}
SELECT (SELECT round(sum(s) / sum(n), 9) FROM cl) AS point, {BOOT}, (SELECT g FROM g) AS n_clusters, (SELECT sum(n)::BIGINT FROM cl) AS n_eligible, round((1.959964 + 0.841621) * stddev_samp(m), 9) AS mdd FROM m""")
def paired_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arm of depth 10 against depth 1, over the queries eligible in both, with the least detectable difference."""
    items, chunks = _items(spark, sf_dir), _lexical(spark, sf_dir)
    ranked = R.bm25_topk(items, chunks, DEPTH)
    gold, queries = _gold(spark, sf_dir).select("qid", "chunk_id"), items.select("qid", (F.col("qid") % 8).alias("cluster"))
    arm = lambda k: E.query_scores(ranked, gold, queries, k, DEPTH).select("qid", "cluster", F.col("goldable").alias("eligible"), F.col("rr").alias("value"))
    cl = E.clusters(E.paired(arm(K), arm(1)), F.col("value"))
    b = E.bootstrap(cl)
    return b.select(*[F.round(c, 9).alias(c) for c in ("point", "ci_lo", "ci_hi", "se")], "n_clusters", "n_eligible", F.round(E.mdd(F.col("se")), 9).alias("mdd"))


@query("""WITH p AS (SELECT DISTINCT o_custkey % 200 AS item_id, 'p' || (o_orderkey % 12) AS a FROM orders)
SELECT x.a, y.a AS b, count(*) AS n FROM p x JOIN p y ON x.item_id = y.item_id AND x.a < y.a GROUP BY ALL""")
def pair_cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("item_id"), F.concat(F.lit("p"), F.col("o_orderkey") % 12).alias("p"))
    return E.cooccurrence(o.groupBy("item_id").agg(F.collect_set("p").alias("papers")))


@query("""WITH p AS (SELECT DISTINCT source AS paper_id FROM documents), h AS (SELECT paper_id, ('0x' || substr(md5('7|' || paper_id), 1, 8))::BIGINT AS h FROM p),
r AS (SELECT paper_id, row_number() OVER (ORDER BY h, paper_id) AS r, count(*) OVER () AS n FROM h)
SELECT paper_id, CASE WHEN n > 1 AND r <= round_even(n * 0.25, 0) THEN 'test' ELSE 'dev' END AS split FROM r""")
def split_by_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.holdout(table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id")).distinct())


@query("""WITH p AS (SELECT DISTINCT source AS paper_id FROM documents), i AS (SELECT doc_id AS qid, source AS gold FROM documents WHERE doc_id % 100 = 0),
h AS (SELECT qid, paper_id, CASE WHEN paper_id = gold THEN -1 ELSE ('0x' || substr(md5('7|' || qid || '|' || paper_id), 1, 8))::BIGINT END AS h FROM i, p)
SELECT qid, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY h, paper_id) AS r FROM h) WHERE r <= 4""")
def random_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    items = d.filter(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("qid"), F.col("source").alias("paper_id"))
    return E.scopes(items, d.select(F.col("source").alias("paper_id")).distinct(), 4)


LABELS = ("contradiction", "neutral", "entailment")
#: A stand-in scorer: the share of events' values, as the model's score in [0, 1].
SCORED = "SELECT ['contradiction', 'neutral', 'entailment'][event_id % 3 + 1] AS gold, (value - floor(value))::DOUBLE AS score FROM events"
LABEL_SQL = "CASE WHEN score <= {c} THEN 'contradiction' WHEN score >= {e} THEN 'entailment' ELSE 'neutral' END"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(gold.alias("gold"), (F.col("value") - F.floor("value")).alias("score"))


@query(f"""WITH s AS ({SCORED}), p AS (SELECT gold, {LABEL_SQL.format(c=0.05, e=0.3)} AS pred FROM s)
SELECT gold, count(*) FILTER (WHERE pred = 'contradiction') AS contradiction, count(*) FILTER (WHERE pred = 'neutral') AS neutral, count(*) FILTER (WHERE pred = 'entailment') AS entailment FROM p GROUP BY gold""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.text import label_of

    return E.confusion(_scored(spark, sf_dir).select("gold", label_of(F.col("score")).alias("pred")), LABELS)


GRID = tuple((c, e) for c in (0.05, 0.1, 0.2) for e in (0.3, 0.5, 0.7))


@query(f"""WITH s AS ({SCORED}), t AS (SELECT * FROM (VALUES {", ".join(f"({c}::DOUBLE, {e}::DOUBLE)" for c, e in GRID)}) AS t(c, e)),
p AS (SELECT c, e, gold, {LABEL_SQL.format(c="c", e="e")} AS pred FROM s, t),
f AS (SELECT c, e, label, 2.0::DOUBLE * count(*) FILTER (WHERE gold = label AND pred = label) / (count(*) FILTER (WHERE gold = label) + count(*) FILTER (WHERE pred = label)) AS f1
  FROM p, (VALUES ('contradiction'), ('neutral'), ('entailment')) AS l(label) GROUP BY ALL)
SELECT c, e, round(avg(f1), 9) AS macro_f1 FROM f GROUP BY ALL""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair of thresholds over all scores, in one aggregation."""
    from tessera.functions.text import label_of

    grid = F.broadcast(spark.createDataFrame(GRID, "c double, e double"))
    pairs = _scored(spark, sf_dir).join(grid).select("c", "e", "gold", label_of(F.col("score"), F.col("c"), F.col("e")).alias("pred"))
    return E.macro_f1(pairs, LABELS, ("c", "e")).select("c", "e", F.round("macro_f1", 9).alias("macro_f1"))


@query(f"""WITH s AS ({SCORED}), p AS (SELECT gold, {LABEL_SQL.format(c=0.05, e=0.3)} AS pred FROM s),
c AS (SELECT label, count(*) FILTER (WHERE gold = label AND pred = label) AS tp, count(*) FILTER (WHERE gold = label) AS support, count(*) FILTER (WHERE pred = label) AS said
  FROM p, (VALUES ('contradiction'), ('neutral'), ('entailment')) AS l(label) GROUP BY label)
SELECT label, round(CASE WHEN said > 0 THEN tp::DOUBLE / said ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END, 9) AS recall,
  round(CASE WHEN said + support > 0 THEN 2.0::DOUBLE * tp / (said + support) ELSE 0 END, 9) AS f1, support FROM c""")
def label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each label."""
    from tessera.functions.text import label_of

    told = E.label_scores(_scored(spark, sf_dir).select("gold", label_of(F.col("score")).alias("pred")), LABELS)
    return told.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def _search_sql() -> str:
    """Every pair of distinct scores, each judged on the counts of all scores."""
    short = {"contradiction": "a", "neutral": "b", "entailment": "d"}
    total = ", ".join(f"sum(n) FILTER (WHERE gold = '{x}' AND {w}) AS {p}_{short[x]}" for x in LABELS for p, w in (("c", "score <= cmax"), ("m", "score > cmax AND score < emin"), ("e", "score >= emin")))
    tp = {"contradiction": "c_a", "neutral": "m_b", "entailment": "e_d"}
    said = {x: " + ".join(f"coalesce({p}_{s}, 0)" for s in "abd") for x, p in zip(LABELS, "cme")}
    gold = {x: " + ".join(f"coalesce({p}_{short[x]}, 0)" for p in "cme") for x in LABELS}
    rows = ", ".join(
        f"coalesce(coalesce({tp[x]}, 0)::DOUBLE / nullif({said[x]}, 0), 0) AS precision_{x}, coalesce(coalesce({tp[x]}, 0)::DOUBLE / nullif({gold[x]}, 0), 0) AS recall_{x}, "
        f"coalesce(2.0::DOUBLE * coalesce({tp[x]}, 0) / nullif({said[x]} + {gold[x]}, 0), 0) AS f1_{x}" for x in LABELS
    )
    shown = ", ".join(f"round({m}_{x}, 9) AS {m}_{x}" for x in LABELS for m in ("precision", "recall", "f1"))
    return f"""WITH s AS (SELECT gold, round(score, 2) AS score, count(*) AS n FROM ({SCORED}) GROUP BY ALL), v AS (SELECT DISTINCT score AS v FROM s),
t AS (SELECT cmax, emin, {total} FROM s, (SELECT x.v AS cmax, y.v AS emin FROM v x JOIN v y ON x.v < y.v) GROUP BY ALL),
j AS (SELECT cmax, emin, {rows} FROM t), m AS (SELECT *, ({" + ".join(f"f1_{x}" for x in LABELS)}) / 3 AS macro_f1 FROM j)
SELECT rank, cmax, emin, round(macro_f1, 9) AS macro_f1, {shown} FROM (SELECT *, (row_number() OVER (ORDER BY round(macro_f1, 9) DESC, cmax, emin))::INTEGER AS rank FROM m) WHERE rank <= 5"""


@query(_search_sql())
def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of all pairs of thresholds, the lower under the upper one, over all distinct scores of two places."""
    found = E.threshold_search(_scored(spark, sf_dir), LABELS, places=2)
    return found.select("rank", "cmax", "emin", *[F.round(c, 9).alias(c) for c in found.columns[3:]])
