"""Named searches with the engine's own composition: the hashing embedder, overlap as scorer, ``documents`` as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import models as M
from tessera.functions import text as T
from tessera.operators import retrieval as R
from tessera.plans.catalogue import query, table
from tessera.plans.chunks import WHITE
from tessera.plans.retrieval import HYBRID, WORDS, _rankings, elbow_ctes
from tessera.search import Searcher

DIMS = 32
MIN_K, MAX_K, CANDIDATES = 2, 10, 20

#: (id, d, n): how often a text's words fall into each dimension; the last one is 1 for every text.
VECTORS = rf"""SELECT id, d, count(*) AS n FROM (
  SELECT id, (('0x' || substr(h, 1, 16))::UBIGINT % {DIMS - 1} * {2**64 % (DIMS - 1)} + ('0x' || substr(h, 17, 16))::UBIGINT % {DIMS - 1}) % {DIMS - 1} AS d
  FROM (SELECT id, md5(unnest(list_filter(string_split_regex(lower(text), '{WHITE}+'), lambda w: w <> ''))) AS h FROM <table>)) GROUP BY ALL
  UNION ALL SELECT id, {DIMS - 1}, 1 FROM <table>"""
SEARCH = rf"""docs AS (SELECT doc_id AS id, coalesce(text, '') AS text, source FROM documents), items AS (SELECT item_id AS id, text FROM benchmark),
dv AS ({VECTORS.replace("<table>", "docs")}), iv AS ({VECTORS.replace("<table>", "items")}),
dn AS (SELECT id, sum(n * n) AS s FROM dv GROUP BY id), qn AS (SELECT id, sum(n * n) AS s FROM iv GROUP BY id),
dense AS (
  SELECT x.qid, x.chunk_id, x.s::DOUBLE / sqrt((qn.s * dn.s)::DOUBLE) AS score FROM (SELECT iv.id AS qid, dv.id AS chunk_id, sum(iv.n * dv.n) AS s FROM iv JOIN dv USING (d) GROUP BY ALL) x JOIN qn ON qn.id = x.qid JOIN dn ON dn.id = x.chunk_id)"""
OVERLAP = rf"len(list_intersect(list_distinct(regexp_extract_all(lower(i.text), '{WORDS}')), regexp_extract_all(lower(d.text), '{WORDS}')))::DOUBLE"


def _searcher(spark: SparkSession, sf_dir: str) -> tuple[Searcher, DataFrame]:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = M.embedded(d, M.HashingEmbedder(DIMS))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return Searcher(chunks, M.HashingEmbedder(DIMS), M.OverlapScorer()), queries


def _shown(found, *more: str) -> DataFrame:
    return found.results.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), "cutoff_reason", *more)


@query(f"""WITH {SEARCH}, pool AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS prior FROM dense),
ranked AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prior) AS rank FROM (SELECT p.qid, p.chunk_id, prior, {OVERLAP} AS score FROM pool p JOIN docs d ON d.id = p.chunk_id JOIN items i ON i.id = p.qid WHERE prior <= {CANDIDATES})),
{elbow_ctes("ranked", MIN_K, MAX_K)}
SELECT qid, chunk_id, rank, round(score, 6) AS score, reason AS cutoff_reason FROM ranked JOIN elbow USING (qid) WHERE rank <= cutoff""")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's composition with models in it: embed, recall, rerank, cut."""
    searcher, queries = _searcher(spark, sf_dir)
    return _shown(searcher.search(queries, MIN_K, MAX_K, CANDIDATES))


@query(f"""WITH {SEARCH}, pool AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM dense)
SELECT qid, chunk_id, rank, round(score, 6) AS score, 'no_rerank' AS cutoff_reason FROM pool WHERE rank <= {MAX_K}""")
def search_without_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    searcher, queries = _searcher(spark, sf_dir)
    return _shown(searcher.search(queries, MIN_K, MAX_K, CANDIDATES, rerank=False))


SCOPES = "scopes AS (SELECT DISTINCT item_id AS qid, source AS paper_id FROM benchmark, (SELECT DISTINCT source FROM documents) s WHERE item_id % 5 <> 0 AND (length(source) + item_id + ascii(right(source, 1))) % 3 = 0)"


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some papers for each item, none for every fifth."""
    papers = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id")).distinct()
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).filter("qid % 5 <> 0")
    pick = (F.char_length("paper_id") + F.col("qid") + F.ascii(F.right("paper_id", F.lit(1)))) % 3 == 0
    return papers.join(R.sized_broadcast(items), pick).select("qid", "paper_id").distinct()


@query(f"""WITH {SEARCH}, {SCOPES}, n AS (SELECT qid, count(*) AS n FROM scopes GROUP BY qid),
r AS (SELECT e.qid, paper_id, chunk_id, score, row_number() OVER (PARTITION BY e.qid, paper_id ORDER BY round(score, 9) DESC, chunk_id) AS inside, n FROM dense e JOIN docs d ON d.id = e.chunk_id JOIN scopes ON scopes.qid = e.qid AND paper_id = source JOIN n ON n.qid = e.qid)
SELECT qid, paper_id, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, paper_id, inside) AS rank, round(score, 6) AS score FROM r WHERE inside <= greatest(3, {CANDIDATES} // n)""")
def per_paper_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool for each paper of an item's scope, of its share of the candidates and three at least."""
    searcher, queries = _searcher(spark, sf_dir)
    pool = searcher.recall(queries, CANDIDATES, 3, _scopes(spark, sf_dir), per_paper=True)
    return pool.select("qid", "paper_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {SEARCH}, {SCOPES}, r AS (SELECT e.qid, chunk_id, score, row_number() OVER (PARTITION BY e.qid ORDER BY round(score, 9) DESC, chunk_id) AS prior FROM dense e JOIN docs d ON d.id = e.chunk_id JOIN scopes ON scopes.qid = e.qid AND paper_id = source),
pool AS (SELECT qid, count(*) AS n FROM r WHERE prior <= 6 GROUP BY qid)
SELECT item_id AS qid, least(coalesce(n, 0), 4)::INTEGER AS returned, CASE WHEN n IS NULL THEN 'pool_exhausted' ELSE 'disabled' END AS reason FROM benchmark LEFT JOIN pool ON qid = item_id""")
def search_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why every query's list ends where it does, with the adaptive cutoff off; queries without papers have nothing."""
    searcher, queries = _searcher(spark, sf_dir)
    return searcher.search(queries, 2, 4, 6, _scopes(spark, sf_dir), elbow=False).outcomes.select("qid", "returned", "reason")


PROPOSED = "proposed AS (SELECT o_orderkey AS qid, u.i AS pos, CASE u.i WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN o_comment_ WHEN 2 THEN upper(o_comment_) WHEN 3 THEN o_comment_ || ' again' ELSE 'late' END AS text FROM o, unnest(range(5)) AS u(i))"


@query(f"""WITH o AS (SELECT *, 'about ' || o_orderstatus || o_custkey % 7 AS o_comment_ FROM orders), {PROPOSED},
k AS (SELECT p.* FROM proposed p JOIN o ON o.o_orderkey = p.qid WHERE pos < 4 AND lower(p.text) <> lower(trim(o_orderpriority))),
f AS (SELECT qid, min(pos) AS pos, arg_min(text, pos) AS text FROM k GROUP BY qid, lower(text))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS list_no, text FROM f""")
def variant_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first four proposals those that are not the query or another one in other letters."""
    o = table(spark, sf_dir, "orders").withColumn("c", F.concat(F.lit("about "), "o_orderstatus", (F.col("o_custkey") % 7).cast("string")))
    texts = F.array(F.upper("o_orderpriority"), F.col("c"), F.upper("c"), F.concat("c", F.lit(" again")), F.lit("late"))
    proposed = o.select(F.col("o_orderkey").alias("qid"), F.posexplode(texts).alias("pos", "text"))
    found = R.distinct_variants(o.select(F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("text")), proposed, 4)
    return found.select("qid", F.col("list_no").cast("long").alias("list_no"), "text")


REPLIES = ("scores: [1, 2.5, \"x\", null, 4]", "none at all", "[7]", "[1, 2, 3, 4, 5, 6, 7, 8]", "[oops", "a [] b [9]")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS i FROM orders)
SELECT o_orderkey, CASE i WHEN 0 THEN '1.0,2.5,0.0,0.0,4.0' WHEN 2 THEN '7.0,0.0,0.0,0.0,0.0' WHEN 3 THEN '1.0,2.0,3.0,4.0,5.0' ELSE '0.0,0.0,0.0,0.0,0.0' END AS scores FROM r""")
def rerank_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's replies as five scores: padded, cut, and zeros where there is nothing to read."""
    reply = F.element_at(F.array(*[F.lit(x) for x in REPLIES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    scores = T.first_numbers(reply, F.lit(5))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(scores, lambda x: F.format_string("%.1f", x)), ",").alias("scores"))


@query("""WITH d AS (SELECT l_orderkey AS qid, l_linenumber AS index, l_partkey FROM lineitem), r AS (SELECT l_orderkey AS qid, l_linenumber + l_orderkey % 2 AS index, l_quantity AS score FROM lineitem WHERE l_linenumber % 3 <> 0)
SELECT qid, index, l_partkey, coalesce(score, 0) AS score FROM d LEFT JOIN r USING (qid, index)""")
def rerank_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that name their documents by index, in any order, some out of range and some missing."""
    li = table(spark, sf_dir, "lineitem")
    docs = li.select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("index"), "l_partkey")
    results = li.filter("l_linenumber % 3 <> 0").select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber") + F.col("l_orderkey") % 2).alias("index"), F.col("l_quantity").alias("score"))
    return R.scores_by_index(docs, results).select("qid", "index", "l_partkey", "score")


@query(f"""WITH {HYBRID}, l AS (
  SELECT qid, list_no, chunk_id, rank FROM rankings WHERE rank <= 30 UNION ALL SELECT qid, 2, chunk_id, 31 - rank FROM rankings WHERE list_no = 0 AND rank <= 30),
x AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_no, rank)) AS seen FROM l GROUP BY ALL)
SELECT qid, chunk_id, rank FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM x) WHERE rank <= 10""")
def multi_query_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense list, the lexical one, and a variant's (the dense one turned round): the snapshot's arm with all of them."""
    lists = _rankings(spark, sf_dir).filter("rank <= 30")
    dense, sparse = (lists.filter(F.col("list_no") == i).select("qid", "chunk_id", "rank") for i in range(2))
    variant = dense.select("qid", F.lit(0).alias("list_no"), F.lit("dense").alias("source"), "chunk_id", (31 - F.col("rank")).alias("rank"))
    lists = R.snapshot(dense, sparse, variant)
    return R.arm_pool(lists, 10, sparse=True, variants=True).select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"))
