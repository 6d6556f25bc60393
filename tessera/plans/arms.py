"""Named screens: settings of retrieval judged side by side, on the hybrid corpus and on the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import models as M
from tessera.functions import text as T
from tessera.operators import arms as A
from tessera.operators import chunking as C
from tessera.operators import documents as D
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.plans.catalogue import query, table
from tessera.plans.chunks import SECTIONS, WHITE, packed_sql, pool
from tessera.plans.engine import DIMS, VECTORS
from tessera.plans.evaluation import DENSE, DEPTH, LEX, K, _dense, _gold, _relevant
from tessera.plans.retrieval import CANDIDATES, DOT, HYBRID, WORDS, _hybrid, _items, _lexical, _rankings, _vectors, elbow_ctes
from tessera.scratch import stored

ARMS = [A.Arm("default", CANDIDATES, True), *A.one_at_a_time(A.Arm("default", CANDIDATES, True), [10, 20, 40], sparse=True)[1:]]
ARM_SQL = "arms AS (SELECT * FROM (VALUES " + ", ".join(f"('{a.arm}', {a.candidates}, {a.rerank}, {a.sparse})" for a in ARMS) + ") AS t(arm, candidates, rerank, sparse))"
JUDGED = f"""{HYBRID}, {ARM_SQL},
pool AS (
  SELECT arm, qid, chunk_id, rank, rerank FROM arms JOIN rankings ON NOT sparse AND list_no = 0 AND rank <= candidates
  UNION ALL SELECT arm, qid, chunk_id, rank, rerank FROM arms JOIN fused ON sparse AND rank <= candidates),
said AS (
  SELECT p.*, CASE WHEN rerank THEN len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '{WORDS}')), regexp_extract_all(lower(c.text), '{WORDS}'))) ELSE -rank END AS score, c.label, g.label AS cluster
  FROM pool p JOIN queries q USING (qid) JOIN corpus c USING (chunk_id) JOIN corpus g ON g.chunk_id = p.qid),
placed AS (SELECT *, row_number() OVER (PARTITION BY arm, qid ORDER BY score DESC, rank) AS r FROM said),
golds AS (SELECT q.qid, c.label AS cluster, (SELECT count(*) FROM corpus o WHERE o.label = c.label AND o.chunk_id <> q.qid) AS n FROM queries q JOIN corpus c ON c.chunk_id = q.qid),
best AS (SELECT arm, qid, min(r) AS best FROM placed WHERE label = cluster AND chunk_id <> qid GROUP BY ALL),
scores AS (SELECT arm, g.qid, cluster, n > 0 AS goldable, best IS NOT NULL AS in_pool, CASE WHEN best <= {K} THEN 1.0::DOUBLE / best ELSE 0.0 END::DOUBLE AS rr FROM arms CROSS JOIN golds g LEFT JOIN best USING (arm, qid))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, qid, cluster, goldable, in_pool, rr) of all arms, from one set of rankings and of rerank scores."""
    from tessera.functions.text import tokens

    queries, chunks = _hybrid(spark, sf_dir)
    lists, arms = _rankings(spark, sf_dir, (queries, chunks)), A.table(spark, ARMS)
    text = chunks.select("chunk_id", tokens(F.col("text")).alias("b"))
    asked = queries.select("qid", tokens(F.col("text")).alias("a"))
    pairs = lists.select("qid", "chunk_id").distinct()
    overlap = pairs.join(asked, "qid").join(text, "chunk_id").select("qid", "chunk_id", F.size(F.array_intersect("a", "b")).cast("double").alias("score"))
    ranked = A.reranked(A.pools(lists, arms), arms, overlap)
    labels = chunks.select("chunk_id", "label")
    clusters = queries.select("qid").join(labels, queries["qid"] == labels["chunk_id"]).select("qid", F.col("label").alias("cluster"))
    # Gold is every other chunk of a query's cluster: of these only the listed ones can be hits, and one tells that there are any.
    listed = pairs.join(clusters, "qid").join(labels, "chunk_id").filter((F.col("label") == F.col("cluster")) & (F.col("chunk_id") != F.col("qid")))
    ends = labels.groupBy(F.col("label").alias("cluster")).agg(F.min("chunk_id").alias("least"), F.max("chunk_id").alias("most"))
    other = F.when(F.col("least") != F.col("qid"), F.col("least")).otherwise(F.col("most"))
    any_other = clusters.join(F.broadcast(ends), "cluster").select("qid", other.alias("chunk_id")).filter(F.col("chunk_id") != F.col("qid"))
    gold = listed.select("qid", "chunk_id").unionByName(any_other)
    return A.scores(ranked, gold, clusters, arms, K)


@query(f"WITH {JUDGED} SELECT arm, qid, cluster, goldable, in_pool, rr FROM scores")
def screen_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default, the rerank toggle, other numbers of candidates, and hybrid recall."""
    return _judged(spark, sf_dir)


def boot_by_arm(name: str, samples: str) -> str:
    """CTE ``name``: (arm, point, ci_lo, ci_hi, se, n) of a relation with arm, cluster and value."""
    return f"""{name}_cl AS (SELECT arm, cluster, sum(value) AS s, count(value) AS n, row_number() OVER (PARTITION BY arm ORDER BY cluster) - 1 AS idx FROM {samples} GROUP BY arm, cluster HAVING count(value) > 0),
{name}_g AS (SELECT arm, count(*) AS g, sum(s) / sum(n) AS point FROM {name}_cl GROUP BY arm),
{name}_pick AS (SELECT arm, b, ('0x' || substr(md5('7|' || b || '|' || d), 1, 8))::BIGINT % g AS idx FROM range(400) AS x(b), {name}_g, unnest(range(g)) AS y(d)),
{name}_m AS (SELECT arm, b, sum(s) / sum(n) AS m FROM {name}_pick JOIN {name}_cl USING (arm, idx) GROUP BY ALL),
{name} AS (SELECT arm, any_value(point) AS point, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi, stddev_samp(m) AS se, any_value(g) AS n FROM {name}_m JOIN {name}_g USING (arm) GROUP BY arm)"""


@query(f"""WITH {JUDGED}, a AS (SELECT arm, qid, cluster, rr AS value FROM scores WHERE goldable AND in_pool),
diffs AS (SELECT x.arm, x.cluster, x.value - y.value AS value FROM a x JOIN a y ON x.qid = y.qid AND y.arm = 'default' AND x.arm <> 'default'),
{boot_by_arm("own", "a")}, {boot_by_arm("dif", "diffs")}
SELECT arm, round(o.point, 6) AS mrr, round(o.ci_lo, 6) AS ci_lo, round(o.ci_hi, 6) AS ci_hi, round(d.point, 6) AS delta, round(d.ci_lo, 6) AS delta_lo, round(d.ci_hi, 6) AS delta_hi,
  round((1.959964 + 0.841621) * d.se, 6) AS mdd, (d.ci_lo > 0 OR d.ci_hi < 0) AND abs(d.point) >= (1.959964 + 0.841621) * d.se AS detectable, least(o.n, d.n) AS clusters FROM own o LEFT JOIN dif d USING (arm)""")
def screen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each arm's mean reciprocal rank with its interval, and its paired difference to the default."""
    # A row for each arm and query, read by every interval and difference: written, so that the rankings are made once.
    r = A.report(stored(_judged(spark, sf_dir), "judged"), "default", 400)
    say = lambda c, name: F.round(c, 6).alias(name)
    return r.select(
        "arm", say("mrr_point", "mrr"), say("mrr_ci_lo", "ci_lo"), say("mrr_ci_hi", "ci_hi"), say("mrr_delta_point", "delta"), say("mrr_delta_ci_lo", "delta_lo"), say("mrr_delta_ci_hi", "delta_hi"),
        say("mrr_delta_mdd", "mdd"), F.col("mrr_delta_detectable").alias("detectable"), F.least("mrr_n_clusters", "mrr_delta_n_clusters").alias("clusters"),
    )


KNOBS = [("default", 3.0, 0.15), ("mad=1", 1.0, 0.15), ("prominence=0.4", 3.0, 0.4)]


def _elbow_arm(i: int, arm: str, mad: float, prominence: float) -> str:
    """The cutoff's CTEs under names of their own, and the arm's metrics."""
    return f"""m{i} AS (WITH {elbow_ctes("win10", max_k=K, mad=mad, prominence=prominence)}, per AS (
  SELECT e.qid, cutoff, count(*) FILTER (WHERE r.rank <= cutoff AND r.cluster = r.label) AS n FROM elbow e JOIN win10 r USING (qid) GROUP BY ALL)
  SELECT '{arm}' AS arm, avg(cutoff) AS mean_returned, avg((n > 0)::INTEGER) AS recall, avg(CASE WHEN n > 0 THEN 1.0::DOUBLE / cutoff ELSE 0 END) AS precision FROM per)"""


@query(f"""WITH {DENSE}, win10 AS (SELECT * FROM ranked WHERE rank <= {K} AND qid IN (SELECT qid FROM scores WHERE in_pool)), {", ".join(_elbow_arm(i, *k) for i, k in enumerate(KNOBS))}
SELECT arm, round(mean_returned, 9) AS mean_returned, round(recall, 9) AS recall, round(precision, 9) AS precision FROM ({" UNION ALL ".join(f"SELECT * FROM m{i}" for i in range(len(KNOBS)))})""")
def screen_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked, _, _, labels = _dense(spark, sf_dir)
    s = A.elbow_screen(ranked, _relevant(ranked, labels), KNOBS, max_k=K)
    return s.select("arm", *[F.round(c, 9).alias(c) for c in ("mean_returned", "recall", "precision")])


GROUPED = [A.Arm("off", 12, False), A.Arm("production", 12, False, per_paper="production"), A.Arm("matched", 12, False, per_paper="matched")]
SCOPED_K = 5


@query(f"""WITH scopes AS (SELECT DISTINCT v.vec_id AS qid, l.label AS paper_id FROM embeddings v, (SELECT DISTINCT label FROM embeddings) l WHERE v.vec_id % 100 = 0 AND (l.label + v.vec_id // 100) % 3 = 0),
n AS (SELECT qid, count(*) AS n FROM scopes GROUP BY qid),
s AS (SELECT a.vec_id AS qid, b.label AS paper_id, b.vec_id AS chunk_id, {DOT} AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 JOIN scopes ON scopes.qid = a.vec_id AND scopes.paper_id = b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, paper_id ORDER BY round(score, 9) DESC, chunk_id) AS inside, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS whole FROM s JOIN n USING (qid)),
p AS (
  SELECT 'off' AS arm, qid, chunk_id, score FROM r WHERE whole <= 12 UNION ALL
  SELECT 'production', qid, chunk_id, score FROM r WHERE inside <= greatest({SCOPED_K}, 12 // n) UNION ALL
  SELECT 'matched', qid, chunk_id, score FROM r WHERE inside <= greatest(1, 12 // n))
SELECT arm, qid, chunk_id, row_number() OVER (PARTITION BY arm, qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM p""")
def per_paper_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pool for a scope, against a pool for each of its papers with and without a floor; labels stand for papers."""
    queries, chunks = _vectors(spark, sf_dir)
    papers = chunks.select(F.col("label").alias("paper_id")).distinct()
    scopes = queries.select("qid").join(F.broadcast(papers), (F.col("paper_id") + F.floor(F.col("qid") / 100)) % 3 == 0)
    ranked = R.dense_topk(queries, chunks.withColumnRenamed("label", "paper_id"), 12, ("qid", "paper_id"))
    return A.per_paper_pools(ranked, scopes, A.table(spark, GROUPED), SCOPED_K).select("arm", "qid", "chunk_id", F.col("rank").cast("long").alias("rank"))


COMPARED = [A.Arm("c10", 10, False), A.Arm("c20", 20, False), A.Arm("c40", 40, False)]


@query(f"""WITH {LEX}, arms AS (SELECT * FROM (VALUES ('c10', 10), ('c20', 20), ('c40', 40)) AS t(arm, c)),
paper AS (SELECT arm, g.qid, source, min(CASE WHEN rank <= c THEN rank END) AS best FROM arms CROSS JOIN gold g LEFT JOIN ranked USING (qid, chunk_id) GROUP BY ALL)
SELECT arm, qid, min(source) AS cluster, true AS goldable, bool_and(best IS NOT NULL) AS in_pool, min(CASE WHEN best <= {K} THEN 1.0::DOUBLE / best ELSE 0.0 END)::DOUBLE AS rr FROM paper GROUP BY ALL""")
def screen_comparative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with gold in several papers, for pools of three sizes: every paper's must be there."""
    ranked = R.bm25_topk(_items(spark, sf_dir), _lexical(spark, sf_dir), DEPTH).select("qid", "chunk_id", "rank")
    arms = A.table(spark, COMPARED)
    pools = ranked.join(arms.select("arm", "candidates")).filter(F.col("rank") <= F.col("candidates"))
    return A.comparative_scores(pools, _gold(spark, sf_dir).withColumnRenamed("source", "paper_id"), arms, K)


CELLS = {"default": {}, "max_tokens=120": {"max_tokens": 120}, "overlap_tokens=0": {"overlap_tokens": 0}, "min_tokens=60": {"min_tokens": 60}}


def _cell_sql(arm: str, max_tokens: int = C.MAX_TOKENS, overlap_tokens: int = C.OVERLAP_TOKENS, min_tokens: int = C.MIN_TOKENS, columns: str = "paper_id, number, title, chunk_id, text") -> str:
    return f"SELECT '{arm}' AS arm, {columns} FROM ({packed_sql(max_tokens, overlap_tokens, min_tokens)} SELECT * FROM written)"


CELL_CHUNKS = " UNION ALL ".join(_cell_sql(arm, **knobs) for arm, knobs in CELLS.items())


@query(f"""WITH c AS ({CELL_CHUNKS}), n AS (SELECT arm, count(*) AS n_chunks, count(DISTINCT chunk_id) AS n_ids FROM c GROUP BY arm)
SELECT arm, n_chunks, n_chunks - (SELECT n_chunks FROM n WHERE arm = 'default') AS change, n_chunks - n_ids AS collisions FROM n""")
def screen_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of chunks of each cell, its change, and chunks whose id another one has."""
    papers = pool(spark, sf_dir).select(F.col("paper_id").cast("string").alias("paper_id"), "markdown")
    return A.cell_sizes(A.chunk_cells(papers, CELLS).select("arm", "chunk_id"), "default")


#: Items of the judged cells: the second section of every hundredth paper, asked for by its body's first twelve words.
CELL_ITEMS = f"""items AS (
  SELECT paper_id AS id, paper_id::VARCHAR AS paper_id, coalesce(number, '') AS number, title, array_to_string(list_filter(string_split_regex(body, '{WHITE}+'), lambda w: w <> '')[1:12], ' ') AS text
  FROM (WITH {SECTIONS} SELECT * FROM sections) WHERE section_index = 1 AND paper_id % 100 = 0)"""


def _judged_sql() -> str:
    chunk = f"c AS ({CELL_CHUNKS}), docs AS (SELECT row_number() OVER (ORDER BY arm, chunk_id) AS id, * FROM c)"
    return f"""WITH {CELL_ITEMS}, {chunk}, dv AS ({VECTORS.replace("<table>", "docs")}), iv AS ({VECTORS.replace("<table>", "items")}),
dn AS (SELECT id, sum(n * n) AS s FROM dv GROUP BY id), qn AS (SELECT id, sum(n * n) AS s FROM iv GROUP BY id),
x AS (SELECT iv.id AS qid, dv.id AS did, sum(iv.n * dv.n) AS s FROM iv JOIN dv USING (d) GROUP BY ALL),
r AS (SELECT qid, arm, chunk_id, row_number() OVER (PARTITION BY qid, arm ORDER BY round(x.s::DOUBLE / sqrt((qn.s * dn.s)::DOUBLE), 9) DESC, chunk_id) AS rank FROM x JOIN qn ON qn.id = qid JOIN dn ON dn.id = did JOIN docs ON docs.id = did),
g AS (SELECT items.id AS qid, arm, chunk_id FROM items JOIN docs ON docs.paper_id::VARCHAR = items.paper_id AND coalesce(docs.number, '') = items.number AND docs.title = items.title),
b AS (SELECT g.qid, g.arm, min(rank) FILTER (WHERE rank <= 20) AS best FROM g LEFT JOIN r USING (qid, arm, chunk_id) GROUP BY ALL),
e AS (SELECT items.id AS qid, a.arm, b.qid IS NOT NULL AS goldable, best FROM items CROSS JOIN (SELECT DISTINCT arm FROM c) a LEFT JOIN b ON b.qid = items.id AND b.arm = a.arm)
SELECT arm, round(coalesce(avg((best IS NOT NULL)::INTEGER) FILTER (WHERE goldable), 0), 9) AS success,
  round(coalesce(avg(CASE WHEN best <= 10 THEN 1.0::DOUBLE / best ELSE 0 END) FILTER (WHERE goldable AND best IS NOT NULL), 0), 9) AS mrr,
  count(*) FILTER (WHERE goldable AND best IS NOT NULL) AS n_conditioned, count(*) FILTER (WHERE NOT goldable) AS n_ungoldable FROM e GROUP BY arm"""


@query(_judged_sql())
def judge_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success and reciprocal ranks of each cell, every cell an index of its own, from one parse of the papers."""
    papers = pool(spark, sf_dir).select(F.col("paper_id").cast("string").alias("paper_id"), "markdown")
    embedder = M.HashingEmbedder(DIMS)
    second = C.split_sections(pool(spark, sf_dir).filter("paper_id % 100 = 0")).filter("section_index = 1")
    twelve = F.array_join(F.slice(F.filter(F.split("body", f"[{T.WHITE}]+"), lambda w: w != ""), 1, 12), " ")
    items = second.select(F.col("paper_id").alias("qid"), F.col("paper_id").cast("string").alias("paper_id"), F.coalesce("number", F.lit("")).alias("section_number"), F.col("title").alias("section_title"), twelve.alias("text"))
    # Read by the rankings, the gold and the list of arms: written, so that papers are parsed and embedded once.
    chunks = stored(D.embedded_cells(papers, CELLS, embedder), "cells")
    judged = E.summary(A.judge_cells(chunks, items, M.query_vectors(items, embedder)), ("arm",))
    return judged.select("arm", F.round("success", 9).alias("success"), F.round("mrr", 9).alias("mrr"), "n_conditioned", "n_ungoldable")


@query("""WITH p AS (SELECT o_custkey % 200 AS item_id, 'p' || (o_orderkey % 12) AS a FROM orders GROUP BY ALL), g AS (SELECT item_id, count(*) AS n FROM p GROUP BY item_id)
SELECT min(n) AS least, max(n) AS most, round(avg(n), 9) AS mean, round(count(*) / 250.0::DOUBLE, 9) AS hit_rate FROM g""")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many papers the items compare, and items for each of 250 trials."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("item_id"), (F.col("o_orderkey") % 12).alias("p")).distinct()
    g = o.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 9).alias("mean"), F.round(F.count(F.lit(1)) / F.lit(250.0), 9).alias("hit_rate"))


@query("""WITH p AS (SELECT DISTINCT o_custkey % 200 AS item_id, 'p' || (o_orderkey % 12) AS a FROM orders), c AS (SELECT x.a, y.a AS b, count(*) AS n FROM p x JOIN p y ON x.item_id = y.item_id AND x.a < y.a GROUP BY ALL)
SELECT a, b, n FROM c ORDER BY n DESC, a, b LIMIT 5""")
def top_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five pairs of papers that most items name together."""
    from tessera.plans.evaluation import pair_cooccurrence

    return pair_cooccurrence(spark, sf_dir).orderBy(F.desc("n"), "a", "b").limit(5)


@query("""SELECT split, count(*) AS n, count(*) FILTER (WHERE leaked) AS leaked FROM (SELECT CASE WHEN ('0x' || substr(md5('7|' || item_id), 1, 8))::BIGINT % 4 = 0 THEN 'test' ELSE 'dev' END AS split, length(text) % 5 = 0 AS leaked FROM benchmark) GROUP BY split""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that a seeded hash sends to test, one in four, and how many of each side leak."""
    from tessera.functions.text import hashed_int

    b = table(spark, sf_dir, "benchmark").select(F.when(hashed_int(F.lit("7"), F.col("item_id").cast("string")) % 4 == 0, "test").otherwise("dev").alias("split"), (F.char_length("text") % 5 == 0).alias("leaked"))
    return b.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaked").alias("leaked"))
