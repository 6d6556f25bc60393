"""Driver queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, exact_dedup, filter_audit, mixing, near_dedup, pii, quality_rules, secret_scan, suffix_dedup, token_counts, warc, whitening
from tessera.llm.common import table

#: The pseudonym key of the driver's queries; jobs set tessera.pii.key to one of their own.
KEY = "tessera-demo-key"
TOKENIZER = "byte_bpe_50k.json"
QUERIES = {}
ORACLES = {}


def tokenizer_path(spark: SparkSession) -> str:
    """tessera.tokenizer names the vocabulary file; it must be at the same place on every executor."""
    import public_tokenizers

    return spark.conf.get("tessera.tokenizer", public_tokenizers.path(TOKENIZER))


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = F.lit(quality_rules.mask("base")).cast("long")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"),
        quality_rules.kept_by("v1").alias("kept"),
        "fail_bits",
    )


ORACLES["op6_quality_ledger"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, t,
         list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
n AS (SELECT rid, u.i AS i, array_to_string(ws[u.i:u.i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM n) WHERE c > 1),
g AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS s FROM d),
cov AS (SELECT rid, sum(s) AS n_repeat_words FROM g GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: ends_with(x, '!!')))::BIGINT AS n_shouted
  FROM w LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_words >= 20 AND 2 * n_shouted > n_words THEN 8 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars > 30 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""


@query
def op2_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in secret_scan.STRONG],
        F.sha2(secret_scan.described(tuple(secret_scan.STRONG)), 256).alias("base_sha256"),
        secret_scan.described(secret_scan.KINDS).alias("spans"),
    )


def _secret_sql() -> str:
    kinds = secret_scan.STRONG | secret_scan.WEAK
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT rid, {i} AS k, string_split_regex(t, {quoted(p)}) AS s, regexp_extract_all(t, {quoted(p)}, 0) AS m, "
        f"regexp_extract_all(t, {quoted(p)}, {group}) AS g, {least} AS least FROM docs WHERE regexp_matches(t, {quoted(p)})"
        for i, (p, group, least) in enumerate(kinds.values())
    )
    names = ", ".join(f"'{k}'" for k in kinds)
    near = f"x.a < y.b + {secret_scan.SCOPE} AND y.a < x.b + {secret_scan.SCOPE}"
    some = lambda roles: f"EXISTS (SELECT 1 FROM apart y WHERE y.rid = x.rid AND y.k IN ({roles}) AND {near})"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({parts}),
placed AS (
  SELECT rid, k, list_sum(list_transform(s[1:u.i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:u.i - 1], lambda x: length(x))), 0) AS a, length(m[u.i]) AS n
  FROM parts, unnest(range(1, len(m) + 1)) AS u(i) WHERE length(g[u.i]) >= least),
found AS (SELECT rid, k, a::BIGINT AS a, (a + n)::BIGINT AS b FROM placed),
apart AS (SELECT * FROM found x WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM found y WHERE y.rid = x.rid AND y.k < 3 AND x.a < y.b AND y.a < x.b)),
kept AS (SELECT * FROM apart x WHERE k < 3 OR (k = 3 AND {some("0, 2, 4")}) OR (k = 4 AND {some("1, 3")}) OR (k = 5 AND {some("1, 3")} AND {some("0, 2, 4")})),
said AS (
  SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
         string_agg([{names}][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (WHERE k < 3) AS base,
         string_agg([{names}][k + 1] || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans
  FROM kept GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN said USING (rid)"""


ORACLES["op2_secret_links"] = _secret_sql()


@query
def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("tessera.pii.key", KEY)
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key, ("doc_id", "text"), counts=True)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(spark), limit=1024)


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    formatted = chat_format.format_chats(rows.unionByName(extra), tokenizer_path(spark))
    read = chat_format.read_back(formatted)
    return read.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLES["op7_chat_format"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'none') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT *, len(regexp_extract_all(role || chr(10) || text, '␛|<\||\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS n_escapes FROM said)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + n_escapes + length('<|turn|><|text|><|end|>'))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


@query
def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op4_warc_round_trip"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""


@query
def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


ORACLES["op8_repeated_strings"] = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT rid, o, u.i AS i, substr(h, 2 * u.i + 1, 100) AS k FROM n, unnest(range(0, n_bytes - 49)) AS u(i)),
g AS (SELECT k, min(o) AS m FROM w GROUP BY k),
c AS (SELECT w.rid, w.i FROM w JOIN g USING (k) WHERE m < o),
f AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM c),
s AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM f),
r AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY rid, run),
p AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM r),
k AS (
  SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM p JOIN n USING (rid) GROUP BY rid)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN k USING (rid)
"""


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query
def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query
def op12_exact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents")).drop("row")


ORACLES["op12_exact_classes"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query
def op13_filter_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_lattice"] = r"""
WITH RECURSIVE orders AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || l FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(l) WHERE NOT contains(filter_order, l)),
steps AS (SELECT filter_order, s.step, filter_order[s.step] AS f, filter_order[1:s.step - 1] AS before FROM orders, unnest(range(1, 6)) AS s(step) WHERE length(filter_order) = 5),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
docs AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(doc_id, 9223372036854775807) AS o, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(o) OVER (PARTITION BY t) AS first_id FROM docs),
judged AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN o > first_id THEN 'E' ELSE '' END AS failed
  FROM words LEFT JOIN lab USING (doc_id)),
seen AS (
  SELECT part, filter_order, step, f, good, toxic, contains(failed, f) AS fails, failed = f AS alone,
         len(list_intersect(string_split(before, ''), string_split(failed, ''))) > 0 AND before <> '' AND failed <> '' AS gone
  FROM judged, steps),
told AS (
  SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT fails) AS kept, count(*) FILTER (NOT gone AND fails) AS removed,
         count(*) FILTER (gone AND fails) AS redundant, count(*) FILTER (alone) AS unique_fails,
         count(*) FILTER (NOT gone AND fails AND good) AS good_lost, count(*) FILTER (NOT gone AND fails AND toxic) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
