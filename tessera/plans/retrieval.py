"""Named retrieval queries: vectors are ``embeddings``, lexical corpora ``documents``, queries ``benchmark`` items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blockmax as B
from tessera.operators import retrieval as R
from tessera.operators import vectors as V
from tessera.plans.catalogue import query, table
from tessera.scratch import stored

#: The query set of a search: every hundredth row, against all rows.
ASKED = "{id} % 100 = 0"
WORDS = r"[\p{L}\p{N}\p{M}_]+"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter(ASKED.format(id="vec_id")).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return queries, e.select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")


DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def _dense_sql(by: str = "qid", n: int = 20, where: str = "TRUE") -> str:
    return f"""SELECT qid, chunk_id, label, rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
        SELECT a.vec_id AS qid, b.vec_id AS chunk_id, b.label, {DOT} AS score FROM embeddings a, embeddings b
        WHERE a.vec_id % 100 = 0 AND b.{where})) WHERE rank <= {n}""".replace("b.TRUE", "TRUE")


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(_dense_sql())
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.dense_topk(*_vectors(spark, sf_dir), 20), "qid", "chunk_id", "label")


@query(_dense_sql())
def pruned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``dense_topk`` from inverted cells: exact, and what can't be among the best isn't multiplied."""
    queries, chunks = _vectors(spark, sf_dir)
    ranked, _ = V.topk(queries, V.fit(chunks), 20)
    return _shown(ranked.join(chunks.select("chunk_id", "label"), "chunk_id"), "qid", "chunk_id", "label")


@query(_dense_sql(where="label IN (1, 2, 3)"))
def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, chunks = _vectors(spark, sf_dir)
    return _shown(R.dense_topk(queries, chunks.filter(F.col("label").isin(1, 2, 3)), 20), "qid", "chunk_id", "label")


@query(_dense_sql(by="qid, label", n=3))
def dense_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of its own for each group, so that no group crowds out another."""
    return _shown(R.dense_topk(*_vectors(spark, sf_dir), 3, by=("qid", "label")), "qid", "chunk_id", "label")


def bm25_ctes(corpus: str, queries: str) -> str:
    """CTEs up to ``bm25(qid, chunk_id, score)`` for relations corpus(chunk_id, text, ...) and queries(qid, text)."""
    return rf"""corpus AS ({corpus}), queries AS ({queries}),
tok AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM corpus),
len AS (SELECT chunk_id, len(regexp_extract_all(lower(text), '{WORDS}')) AS dl FROM corpus),
cst AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM len),
post AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, cst),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM queries) GROUP BY ALL),
bm25 AS (
  SELECT qid, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN terms USING (term) JOIN post USING (term) JOIN len USING (chunk_id), cst GROUP BY ALL HAVING round(score, 9) > 0)"""


LEXICAL = bm25_ctes("SELECT doc_id AS chunk_id, text, source FROM documents", "SELECT item_id AS qid, text FROM benchmark")


@query(rf"""WITH t AS (SELECT list_distinct(regexp_extract_all(lower(text), '{WORDS}')) AS t FROM documents), dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(t) AS term FROM t) GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM t) - df + 0.5) - ln(df + 0.5) AS raw FROM dfs)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 9) AS idf FROM raw""")
def bm25_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = R.term_stats(R.vocabulary(_lexical(spark, sf_dir)))
    return stats.select("term", "df", F.round("idf", 9).alias("idf"))


def _lexical_sql(where: str = "TRUE") -> str:
    return f"""WITH {LEXICAL}
    SELECT qid, chunk_id, rank, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25 JOIN corpus USING (chunk_id) WHERE {where})
    WHERE rank <= 10"""


@query(_lexical_sql())
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(R.bm25_topk(_items(spark, sf_dir), _lexical(spark, sf_dir), 10), "qid", "chunk_id")


@query(_lexical_sql())
def bm25_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``bm25_topk`` from postings in blocks with bounds."""
    ranked, _ = B.topk(_items(spark, sf_dir), B.build(_lexical(spark, sf_dir)), 10)
    return _shown(ranked, "qid", "chunk_id")


@query(f"""WITH {LEXICAL} SELECT qid, sum(df)::BIGINT AS n_postings, true AS within FROM qt JOIN dfs USING (term) GROUP BY qid""")
def bm25_block_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings an item's terms have, and whether no more were read to find its best ten."""
    _, work = B.topk(_items(spark, sf_dir), B.build(_lexical(spark, sf_dir)), 10)
    return work.select("qid", "n_postings", (F.col("n_read") <= F.col("n_postings")).alias("within"))


@query(_lexical_sql("source IN ('src1', 'src2', 'src3')"))
def bm25_topk_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _lexical(spark, sf_dir)
    allowed = chunks.filter(F.col("source").isin("src1", "src2", "src3")).select("chunk_id")
    return _shown(R.bm25_topk(_items(spark, sf_dir), chunks, 10, allowed), "qid", "chunk_id")


#: The hybrid corpus: documents that have a vector; queries are some of them, by vector and by their first eight words.
HYBRID_CORPUS = "SELECT doc_id AS chunk_id, text, source, embedding, label FROM documents JOIN embeddings ON doc_id = vec_id"
HYBRID_QUERIES = f"SELECT chunk_id AS qid, array_to_string(regexp_extract_all(text, '[^ \\n]+')[1:8], ' ') AS text, embedding AS q FROM corpus WHERE chunk_id % 100 = 0"
CANDIDATES, MULTIPLIER = 20, 3


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and chunks; the corpus is joined once, dealt to all cores, and written, as both rankings read it several times."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    joined = d.join(R.sized_broadcast(e), "chunk_id").repartition(2 * spark.sparkContext.defaultParallelism, "chunk_id")
    chunks = stored(joined, "hybrid")
    eight = F.array_join(F.slice(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""), 1, 8), " ")
    queries = chunks.filter(ASKED.format(id="chunk_id")).select(F.col("chunk_id").alias("qid"), eight.alias("text"), F.col("embedding").alias("q"))
    return queries, chunks


def _rankings(spark: SparkSession, sf_dir: str, corpus: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Dense and lexical lists of all queries, as deep as any arm needs them: written, as arms and pools read them several times."""
    queries, chunks = corpus or _hybrid(spark, sf_dir)
    depth = CANDIDATES * MULTIPLIER
    dense = R.dense_topk(queries.select("qid", "q"), chunks.select("chunk_id", "embedding"), depth)
    sparse = R.bm25_topk(queries.select("qid", "text"), chunks.select("chunk_id", "text"), depth)
    columns = lambda df, i, s: df.select("qid", F.lit(i).alias("list_no"), F.lit(s).alias("source"), "rank", "chunk_id")
    return stored(columns(dense, 0, "dense").unionByName(columns(sparse, 1, "sparse")), "lists")


HYBRID = f"""{bm25_ctes(HYBRID_CORPUS, HYBRID_QUERIES)},
rankings AS (
  SELECT qid, 0 AS list_no, 'dense' AS source, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank
  FROM (SELECT qid, chunk_id, list_dot_product(q::DOUBLE[], embedding::DOUBLE[]) AS score FROM queries, corpus)
  UNION ALL
  SELECT qid, 1, 'sparse', chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) FROM bm25),
cut AS (SELECT * FROM rankings WHERE rank <= {CANDIDATES * MULTIPLIER}),
sums AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_no, rank)) AS seen, bool_or(source = 'dense') AS d, bool_or(source = 'sparse') AS s FROM cut GROUP BY ALL),
fused AS (
  SELECT qid, chunk_id, score, CASE WHEN d AND s THEN 'both' WHEN s THEN 'sparse' ELSE 'dense' END AS provenance,
         row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank FROM sums)"""


def elbow_ctes(ranked: str, min_k: int = 2, max_k: int = 10, mad: float = 3.0, prominence: float = 0.15) -> str:
    """CTEs up to ``elbow(qid, cutoff, reason)`` for a relation with qid, rank and score."""
    return f"""sized AS (SELECT qid, count(*) AS n FROM {ranked} GROUP BY qid),
win AS (SELECT r.qid, r.rank, r.score, lead(r.score) OVER (PARTITION BY r.qid ORDER BY r.rank) AS nxt FROM {ranked} r WHERE r.rank <= {max_k}),
gaps AS (SELECT qid, rank, score - nxt AS gap FROM win WHERE nxt IS NOT NULL),
big AS (SELECT qid, arg_min(rank, (-gap, rank)) AS j, max(gap) AS gap FROM gaps GROUP BY qid),
oth AS (SELECT g.qid, g.gap FROM gaps g JOIN big b ON g.qid = b.qid AND g.rank <> b.j),
med AS (SELECT qid, median(gap) AS m FROM oth GROUP BY qid),
dev AS (SELECT o.qid, any_value(m) AS m, median(abs(gap - m)) AS mad FROM oth o JOIN med USING (qid) GROUP BY o.qid),
ext AS (SELECT qid, max(score) - min(score) AS r, count(*) AS w FROM win GROUP BY qid),
elbow AS (
  SELECT s.qid,
    CASE WHEN n <= {min_k} THEN n WHEN w <= 1 THEN w WHEN steep THEN greatest({min_k}, least(j, {max_k})) ELSE least({max_k}, n) END::INTEGER AS cutoff,
    CASE WHEN n <= {min_k} THEN 'pool_exhausted' WHEN w <= 1 THEN 'no_elbow' WHEN steep THEN 'elbow' ELSE 'no_elbow' END AS reason
  FROM (SELECT sized.qid, n, w, j, coalesce(r > 0 AND big.gap > dev.m + {mad} * greatest(dev.mad, 1e-3 * r) AND big.gap > {prominence} * r, false) AS steep
        FROM sized JOIN ext USING (qid) LEFT JOIN big USING (qid) LEFT JOIN dev USING (qid)) s)"""


@query(f"""WITH {HYBRID}, pool AS (SELECT * FROM fused WHERE rank <= {CANDIDATES}), {elbow_ctes("pool")}
SELECT p.qid, p.chunk_id, p.rank, round(p.score, 9) AS score, p.provenance, c.source, e.cutoff, e.reason
FROM pool p JOIN corpus c USING (chunk_id) JOIN elbow e USING (qid) WHERE p.rank <= e.cutoff""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: dense and lexical recall, fusion, hydration, and the adaptive cutoff, for all queries in one plan."""
    pool = R.materialise(_rankings(spark, sf_dir), CANDIDATES, MULTIPLIER)
    cuts = R.score_lists(pool).select("qid", R.cutoff(F.col("scores")).alias("c")).select("qid", "c.cutoff", "c.reason")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source")
    kept = pool.join(cuts, "qid").filter(F.col("rank") <= F.col("cutoff")).join(chunks, "chunk_id")
    return kept.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"), R.provenance().alias("provenance"), "source", "cutoff", "reason")


@query(f"WITH {HYBRID} SELECT qid, chunk_id, rank, round(score, 9) AS score FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = R.rrf(_rankings(spark, sf_dir))
    return fused.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(f"WITH {HYBRID} SELECT qid, provenance, count(*) AS n FROM fused WHERE rank <= {CANDIDATES} GROUP BY ALL")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.materialise(_rankings(spark, sf_dir), CANDIDATES, MULTIPLIER)
    return pool.groupBy("qid", R.provenance().alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HYBRID}, pool AS (SELECT * FROM fused WHERE rank <= {CANDIDATES}), {elbow_ctes("pool")} SELECT qid, cutoff, reason FROM elbow""")
def elbow_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = R.materialise(_rankings(spark, sf_dir), CANDIDATES, MULTIPLIER)
    return R.score_lists(pool).select("qid", R.cutoff(F.col("scores")).alias("c")).select("qid", "c.cutoff", "c.reason")


VARIANTS = f"""WITH a AS (
  SELECT q.vec_id AS qid, v.vec_id AS variant, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, v.vec_id) - 1 AS list_no
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
l AS (
  SELECT qid, list_no, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY qid, list_no ORDER BY round(list_dot_product(v.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS rank
  FROM a JOIN embeddings v ON v.vec_id = a.variant, embeddings b WHERE list_no < 3),
s AS (SELECT qid, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min((list_no, rank)) AS seen FROM l WHERE rank <= 60 GROUP BY ALL)
SELECT * FROM (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, seen) AS rank, round(score, 9) AS score FROM s) WHERE rank <= 20"""


@query(VARIANTS)
def multi_variant_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query and its variants (here its two nearest neighbours) each rank the corpus; all lists are fused flat."""
    queries, chunks = _vectors(spark, sf_dir)
    near = R.dense_topk(queries, chunks.drop("label"), 3).select("qid", (F.col("rank") - 1).alias("list_no"), "chunk_id")
    variants = near.join(chunks.select("chunk_id", F.col("embedding").alias("q")), "chunk_id").select(F.struct("qid", "list_no").alias("qid"), "q")
    lists = R.dense_topk(variants, chunks.drop("label"), 60).select("qid.qid", "qid.list_no", "chunk_id", "rank")
    return R.rrf(lists).filter("rank <= 20").select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


@query(f"""WITH {HYBRID}, o AS (
  SELECT f.qid, f.chunk_id, f.rank AS prior, len(list_intersect(list_distinct(regexp_extract_all(lower(q.text), '{WORDS}')), regexp_extract_all(lower(c.text), '{WORDS}')))::DOUBLE AS score
  FROM fused f JOIN queries q USING (qid) JOIN corpus c USING (chunk_id) WHERE f.rank <= {CANDIDATES})
SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, prior) AS rank, score FROM o""")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lexical stand-in for a scorer: shared distinct words; ties keep the fused order."""
    from tessera.functions.text import tokens

    queries, chunks = _hybrid(spark, sf_dir)
    pool = R.materialise(_rankings(spark, sf_dir, (queries, chunks)), CANDIDATES, MULTIPLIER).select("qid", "chunk_id", "rank", "score")
    q = queries.select("qid", tokens(F.col("text")).alias("a"))
    full = pool.join(q, "qid").join(chunks.select("chunk_id", tokens(F.col("text")).alias("b")), "chunk_id")
    ranked = R.rerank(full, F.size(F.array_intersect("a", "b")).cast("double"))
    return ranked.select("qid", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")
