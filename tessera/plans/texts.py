"""Named text and faithfulness queries: ``conversations`` are cited answers, ``documents`` passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import library as L
from tessera.operators.retrieval import sized_broadcast
from tessera.plans.catalogue import query, table
from tessera.plans.chunks import STRIP, WHITE

#: {{t}} stands for the text; white space is the operators'.
SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_replace({{t}}, {STRIP}), '([.!?]){WHITE}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, {STRIP})), lambda s: s <> '')".replace("{", "{{").replace("}", "}}").replace("{{t}}", "{t}")


@query(f"SELECT doc_id, len(s)::INTEGER AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM (SELECT doc_id, {SENTENCES.format(t='text')} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences_md5"))


PAIRS = f"""a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, turn + 1 AS turn, text FROM conversations WHERE role = 'user'),
pairs AS (SELECT conv_id * 1000 + turn AS ref, sentence, passage FROM (SELECT a.conv_id, a.turn, unnest({SENTENCES.format(t="a.text")}) AS sentence, {SENTENCES.format(t="u.text")} AS ps FROM a JOIN u USING (conv_id, turn)), unnest(ps) AS x(passage)),
scored AS (
  SELECT ref, sentence, passage, CASE WHEN len(p) = 0 OR len(h) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(p, h)) / (len(p) + len(h)) END::DOUBLE AS score
  FROM (SELECT DISTINCT *, list_filter(list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')), lambda w: w NOT IN ('a', 'an', 'the')) AS p,
               list_filter(list_distinct(regexp_extract_all(lower(passage), '[a-z0-9]+')), lambda w: w NOT IN ('a', 'an', 'the')) AS h FROM pairs))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of an answer with each sentence of the turn before it, and how they overlap."""
    c = table(spark, sf_dir, "conversations")
    a = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = c.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("said"))
    j = a.join(u, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("ref"), F.explode(T.sentences(F.col("answer"))).alias("sentence"), "said")
    p = j.select("ref", "sentence", F.explode(T.sentences(F.col("said"))).alias("passage")).distinct()
    return p.withColumn("score", T.answer_f1(F.col("sentence"), F.col("passage")))


@query(f"WITH {PAIRS} SELECT ref, sentence, passage, round(score, 9) AS score FROM scored")
def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumn("score", F.round("score", 9))


@query(f"""WITH {PAIRS} SELECT ref, sentence, round(max(score), 9) AS score, CASE WHEN max(score) <= 0.05 THEN 'contradiction' WHEN max(score) >= 0.3 THEN 'entailment' ELSE 'neutral' END AS label FROM scored GROUP BY ref, sentence""")
def max_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir).withColumn("label", T.label_of(F.col("score")))
    return L.support(s).withColumn("score", F.round("score", 9))


@query(f"""WITH {PAIRS}, v AS (SELECT ref, sentence, max(score) AS score FROM scored GROUP BY ref, sentence)
SELECT ref, count(*) AS total, count(*) FILTER (WHERE score <= 0.05) AS contradictions, count(*) FILTER (WHERE score >= 0.3) AS entailments,
  max(CASE WHEN score <= 0.05 THEN 2 WHEN score >= 0.3 THEN 0 ELSE 1 END)::INTEGER AS worst FROM v GROUP BY ref""")
def faithfulness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = L.support(_scored(spark, sf_dir).withColumn("label", T.label_of(F.col("score"))))
    return v.groupBy("ref").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("label") == "contradiction").alias("contradictions"), F.count_if(F.col("label") == "entailment").alias("entailments"),
        F.max(L.severity(F.col("label"))).alias("worst"),
    )


F1 = """list_filter(list_distinct(regexp_extract_all(lower({t}), '[a-z0-9]+')), lambda w: w NOT IN ('a', 'an', 'the'))"""


@query(f"""WITH t AS (SELECT d.doc_id, b.item_id, {F1.format(t='d.text')} AS p, {F1.format(t='b.text')} AS g FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
f AS (SELECT doc_id, item_id, CASE WHEN len(list_intersect(p, g)) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END::DOUBLE AS f1 FROM t)
SELECT doc_id, item_id, round(f1, 9) AS f1, f1 >= 0.5 AS leaked FROM f""")
def token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leak filter's score: texts as predicted answers against gold ones, dealt to all items in turn."""
    items = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    d = table(spark, sf_dir, "documents").join(F.broadcast(items)).select("doc_id", F.col("text").alias("predicted"), (F.col("doc_id") % F.col("n")).alias("item_id"))
    b = sized_broadcast(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold")))
    s = d.join(b, "item_id").withColumn("f1", T.answer_f1(F.col("predicted"), F.col("gold")))
    return s.select("doc_id", "item_id", F.round("f1", 9).alias("f1"), (F.col("f1") >= 0.5).alias("leaked"))


@query(r"""WITH c AS (SELECT conv_id, turn, role || ' [r' || turn || ', r' || (turn + 1) || '] and 【r' || (turn % 2) || '】' || CASE WHEN turn % 3 = 0 THEN ' [r' || turn || ']' ELSE ' [ r77 ]' END AS t FROM conversations),
e AS (SELECT conv_id, turn, list_transform(regexp_extract_all(t, '[\[【](r\d+(?:\s*,\s*r\d+)*)[\]】]', 1), lambda m: string_split_regex(m, '\s*,\s*')) AS l FROM c),
x AS (SELECT conv_id, turn, flatten(l) AS rs FROM e)
SELECT conv_id, turn, array_to_string(list_filter(rs, lambda r, i: list_position(rs, r) = i), ',') AS refs FROM x""")
def citation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    n = lambda x: x.cast("string")
    marked = F.concat("role", F.lit(" [r"), n(F.col("turn")), F.lit(", r"), n(F.col("turn") + 1), F.lit("] and 【r"), n(F.col("turn") % 2), F.lit("】"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" [r"), n(F.col("turn")), F.lit("]"))).otherwise(" [ r77 ]"))
    return c.select("conv_id", "turn", F.array_join(T.citation_refs(marked), ",").alias("refs"))


@query(r"""SELECT DISTINCT p_type, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM part""")
def kebab_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_type").distinct().withColumn("tag", T.kebab(F.col("p_type")))


@query(r"""WITH p AS (SELECT o_orderkey, ['https://arxiv.org/abs/2401.', 'arxiv.org/pdf/2402.', '2403.', 'x2404.'][o_orderkey % 4 + 1] || printf('%05d', o_orderkey % 90000) || ['', 'v2', '.pdf', 'v3.pdf'][o_custkey % 4 + 1] AS raw FROM orders),
b AS (SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(raw, '^https?://arxiv\.org/(abs|pdf)/', ''), '\.pdf$', ''), 'v\d+$', '') AS id FROM p)
SELECT o_orderkey, CASE WHEN regexp_matches(id, '^\d{4}\.\d{4,5}$') THEN id END AS arxiv_id FROM b""")
def arxiv_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    raw = F.concat(pick(["https://arxiv.org/abs/2401.", "arxiv.org/pdf/2402.", "2403.", "x2404."], F.col("o_orderkey")), F.lpad((F.col("o_orderkey") % 90000).cast("string"), 5, "0"), pick(["", "v2", ".pdf", "v3.pdf"], F.col("o_custkey")))
    return o.select("o_orderkey", T.arxiv_id(raw).alias("arxiv_id"))


PREFIXES = ("http://", "HTTPS://", "ftp://", "https://u:p@", "https://@", " https://", "javascript:")
SUFFIXES = ("", ":80", ":99999", ":65535/x?y#z", ":8a", "/\x01", ":")


@query(f"""WITH u AS (SELECT page_id, {list(PREFIXES)}[page_id % 7 + 1] || CASE WHEN page_id % 11 = 0 THEN '' ELSE split_part(url, '/', 3) END || replace({[x.replace(chr(1), "~") for x in SUFFIXES]}[page_id // 7 % 7 + 1], '~', chr(1)) AS url FROM pages),
p AS (SELECT *, regexp_extract(url, '^ *(?i:https?)://([^/?#]*)', 1) AS place FROM u), q AS (SELECT *, string_split(place, ':') AS hp FROM p)
SELECT page_id, url, place <> '' AND NOT contains(place, '@') AND NOT contains(url, chr(1)) AND hp[1] <> '' AND len(hp) <= 2
  AND (len(hp) = 1 OR hp[2] = '' OR (regexp_matches(hp[2], '^[0-9]+$') AND TRY_CAST(hp[2] AS BIGINT) <= 65535)) AS safe FROM q""")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' hosts in addresses of many kinds, good and bad."""
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % 7 + 1).cast("int"))
    host = F.when(F.col("page_id") % 11 == 0, "").otherwise(F.split_part("url", F.lit("/"), F.lit(3)))
    url = F.concat(pick(PREFIXES, F.col("page_id")), host, pick(SUFFIXES, F.floor(F.col("page_id") / 7)))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), T.is_safe_url(url).alias("safe"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows only: a tree walk; unit tests hold it against written cases."""
    from tessera.sources.html import render

    return render(table(spark, sf_dir, "pages"))
