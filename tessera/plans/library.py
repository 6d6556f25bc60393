"""Named library queries: ``documents`` as papers (tags from language, source group and a flag), ``events`` as citations and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import library as L
from tessera.plans.catalogue import query, table

MANIFEST = """m AS (SELECT doc_id AS paper_id, [lang, 'group-' || doc_id % 7] || CASE WHEN doc_id % 3 = 0 THEN ['third'] ELSE [] END || ['corpus'] AS tags, n_chars FROM documents)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    extra = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("third"))).otherwise(F.array().cast("array<string>"))
    return d.select(F.col("doc_id").alias("paper_id"), F.concat(F.array("lang", F.concat(F.lit("group-"), F.col("doc_id") % 7)), extra, F.array(F.lit("corpus"))).alias("tags"), "n_chars")


@query(f"WITH {MANIFEST} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM m) GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tag_counts(manifest(spark, sf_dir))


@query(f"WITH {MANIFEST} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM m) GROUP BY tag HAVING count(*) < (SELECT count(*) FROM m) OR (SELECT count(*) FROM m) <= 1")
def discriminating_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.discriminating_tags(manifest(spark, sf_dir))


@query(f"WITH {MANIFEST} SELECT paper_id FROM m WHERE list_has_any(tags, ['fr', 'third']) AND paper_id IN (SELECT doc_id FROM documents WHERE source IN ('src1', 'src2', 'src3'))")
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "documents").filter(F.col("source").isin("src1", "src2", "src3")).select(F.col("doc_id").alias("paper_id"))
    return L.scope(manifest(spark, sf_dir), ["fr", "third"], papers)


@query(f"""WITH {MANIFEST}, e AS (SELECT paper_id, u.i - 1 AS pos, tags[u.i] AS tag FROM m, unnest(range(1, len(tags) + 1)) AS u(i)), c AS (SELECT tag, count(*) AS n FROM e GROUP BY tag)
SELECT paper_id, tag, rank FROM (SELECT paper_id, tag, row_number() OVER (PARTITION BY paper_id ORDER BY n, pos)::INTEGER AS rank FROM e JOIN c USING (tag)) WHERE rank <= 3""")
def rarest_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rarest_tags(manifest(spark, sf_dir))


@query(f"""WITH {MANIFEST}, e AS (SELECT paper_id, u.i AS pos, tags[u.i] AS tag FROM m, unnest(range(1, len(tags) + 1)) AS u(i)),
r AS (SELECT paper_id, CASE tag WHEN 'fr' THEN 'romance' WHEN 'es' THEN 'romance' WHEN 'third' THEN 'corpus' ELSE tag END AS tag, min(pos) AS pos FROM e GROUP BY ALL)
SELECT paper_id, array_to_string(list(tag ORDER BY pos), ',') AS tags FROM r GROUP BY paper_id""")
def tag_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    proposed = spark.createDataFrame([("fr", "Romance"), ("es", "romance!"), ("third", "corpus"), ("ghost", "x"), ("de", "de")], "src string, dst string")
    mapping = L.valid_mapping(proposed, m.select(F.explode("tags").alias("tag")))
    return L.remap_tags(m, F.broadcast(mapping)).select("paper_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT o_orderkey AS paper_id, o_totalprice AS price FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_totalprice").alias("price"))
    done = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("paper_id"))
    return L.pending(config, done)


@query("""SELECT doc_id AS paper_id, 'new' AS state, length(text)::BIGINT AS n FROM documents WHERE doc_id % 4 = 0
UNION ALL SELECT doc_id, 'old', n_chars FROM documents WHERE doc_id % 4 <> 0""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.select(F.col("doc_id").alias("paper_id"), F.lit("old").alias("state"), F.col("n_chars").alias("n"))
    new = d.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("paper_id"), F.lit("new").alias("state"), F.char_length("text").cast("long").alias("n"))
    return L.upsert(old, new, "paper_id")


@query("""WITH o AS (SELECT source AS paper_id, doc_id AS chunk_id FROM documents), n AS (SELECT * FROM o WHERE paper_id IN ('src1', 'src2') AND chunk_id % 3 = 0)
SELECT paper_id, chunk_id FROM o WHERE paper_id IN (SELECT paper_id FROM n) EXCEPT SELECT paper_id, chunk_id FROM n""")
def stale_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_id"))
    new = old.filter(F.col("paper_id").isin("src1", "src2") & (F.col("chunk_id") % 3 == 0))
    return L.replace_groups(old, new, "paper_id", "chunk_id")[1]


EDGES = "edges AS (SELECT user_id AS paper_id, printf('%04d.%05d', event_id % 97, event_id % 89) AS arxiv_id, event_type AS label, event_id AS pos FROM events)"


@query(f"""WITH {EDGES}, v AS (SELECT * FROM edges WHERE arxiv_id NOT IN (SELECT printf('%04d.%05d', i, i) FROM range(50) t(i)))
SELECT arxiv_id, count(DISTINCT paper_id) AS cited_by, arg_min(label, (paper_id, pos)) AS label FROM v GROUP BY arxiv_id""")
def cited_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda a, b: F.concat(F.lpad(a.cast("string"), 4, "0"), F.lit("."), F.lpad(b.cast("string"), 5, "0"))
    e = table(spark, sf_dir, "events")
    edges = e.select(F.col("user_id").alias("paper_id"), number(F.col("event_id") % 97, F.col("event_id") % 89).alias("arxiv_id"), F.col("event_type").alias("label"), F.col("event_id").alias("pos"))
    pooled = spark.range(50).select(number(F.col("id"), F.col("id")).alias("arxiv_id"))
    return L.cited_by(edges, pooled)


@query("""SELECT conv_id AS chat_id, turn, n_refs, coalesce(sum(n_refs) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
FROM (SELECT conv_id, turn, length(text) % 5 AS n_refs FROM conversations)""")
def ref_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ref_offsets(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", (F.char_length("text") % 5).cast("long").alias("n_refs")))


@query("""WITH r AS (SELECT user_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 1000 END AS i, event_id % 77 AS o FROM events)
SELECT user_id, CASE WHEN count(i) = count(*) THEN sum(i)::BIGINT END AS input_tokens, sum(o)::BIGINT AS output_tokens FROM r GROUP BY user_id""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    r = e.select("user_id", F.when(F.col("event_id") % 50 != 0, F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    return L.usage(r, "user_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn < 3")
def truncate_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.truncate_before(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("""SELECT conv_id, count(*) AS n_turns, first(text ORDER BY turn)[1:60] AS title, max(turn) AS last_turn, count(*) FILTER (WHERE role = 'assistant') AS answers FROM conversations GROUP BY conv_id""")
def chat_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with the title that their first turn gives them."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.substring(F.min_by("text", "turn"), 1, 60).alias("title"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "assistant").alias("answers")
    )


@query("SELECT sha256(text) AS digest, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return d.filter("n > 1")


@query("SELECT count(*) AS n_papers, coalesce(sum(n_chars), 0)::BIGINT AS n_chars, count(*) FILTER (WHERE n_chars < 100) AS pending FROM documents")
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_papers"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"), F.count_if(F.col("n_chars") < 100).alias("pending"))


@query(r"""WITH c AS (SELECT s_suppkey AS pos, s_nationkey::VARCHAR AS paper_id, n_name || ' & {co} 50% \x_#' AS title,
  CASE s_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '2401.' || printf('%05d', s_nationkey) ELSE 'hep-th/990100' || s_nationkey END AS arxiv_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT paper_id, any_value(arxiv_id) AS a, min(pos) AS pos, any_value(replace(replace(replace(replace(replace(title, '\', '\textbackslash '), '{', '\{'), '}', '\}'), '&', '\&'), '%', '\%')) AS t FROM c GROUP BY paper_id)
SELECT paper_id, pos, '@misc{' || paper_id || ',' || chr(10) || '  title = {' || t || '}' || CASE WHEN a IS NULL THEN '' ELSE ',' || chr(10) || '  eprint = {' || a || '},' || chr(10) || '  archivePrefix = {arXiv}' END
  || CASE WHEN regexp_matches(a, '^\d{4}\.\d{4,5}$') THEN ',' || chr(10) || '  year = {20' || a[1:2] || '}' ELSE '' END || ',' || chr(10) || '}' AS entry FROM f""")
def bibtex_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited papers, once each, though many suppliers name their nation; some have no id, some an old one."""
    j = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_nationkey").cast("string")
    known = F.when(F.col("s_nationkey") % 3 == 1, F.concat(F.lit("2401."), F.lpad(key, 5, "0"))).when(F.col("s_nationkey") % 3 == 2, F.concat(F.lit("hep-th/990100"), key))
    cited = j.select(key.alias("paper_id"), F.concat("n_name", F.lit(" & {co} 50% \\x_#")).alias("title"), known.alias("arxiv_id"), F.col("s_suppkey").alias("pos"))
    return L.bibtex(cited)
