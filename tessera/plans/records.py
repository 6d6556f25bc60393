"""Named queries over records: chats, notes, citations, match groups and small text rules, on tables that stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking as C
from tessera.operators import exports as X
from tessera.operators import library as L
from tessera.plans.catalogue import query, table
from tessera.sources import records as V
from tessera.plans.chunks import SECTIONS, pool
from tessera.plans.texts import SENTENCES


@query("""SELECT conv_id AS chat_id, arg_min(text, turn)[1:60] AS title, min(turn)::VARCHAR AS scope, count(*) AS n_turns, max(conv_id * 10 + turn) AS updated_at FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats by when they last changed, titled and scoped by their first turn."""
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    turns = c.select(F.col("conv_id").alias("chat_id"), "turn", F.col("text").alias("question"), F.col("turn").cast("string").alias("scope"), (F.col("conv_id") * 10 + F.col("turn")).alias("created_at"))
    return L.sessions(turns)


@query("""WITH n AS (SELECT conv_id AS chat_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE turn >= 2), l AS (SELECT conv_id AS chat_id, max(turn) AS last FROM conversations WHERE turn < 2 GROUP BY 1)
SELECT conv_id AS chat_id, turn, text FROM conversations WHERE turn < 2 UNION ALL SELECT chat_id, coalesce(last, -1) + k, text FROM n LEFT JOIN l USING (chat_id)""")
def append_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    old = c.filter("turn < 2").select(F.col("conv_id").alias("chat_id"), F.col("turn").cast("long").alias("turn"), "text")
    new = c.filter("turn >= 2").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "text")
    return L.append_turns(old, new)


@query("""SELECT conv_id AS chat_id, turn, CASE WHEN conv_id = 3 AND turn = 1 THEN 'down' ELSE CASE WHEN turn % 2 = 0 THEN 'up' END END AS vote, CASE WHEN conv_id = 3 AND turn = 1 THEN 'wrong' ELSE role END AS note FROM conversations""")
def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), "turn", F.when(F.col("turn") % 2 == 0, "up").alias("vote"), F.col("role").alias("note"))
    return L.feedback(c, F.lit(3), F.lit(1), "down", "wrong")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'changed' ELSE event_type END AS note, ts AS created_at, event_type AS snippet FROM events""")
def annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth note is written anew: when it was made and what it stands at stay."""
    e = table(spark, sf_dir, "events")
    old = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("note"), F.col("ts").alias("created_at"), F.col("event_type").alias("snippet"))
    new = e.filter("event_id % 5 = 0").select(F.col("event_id").alias("id"), F.lit("changed").alias("note"), F.lit("2030-01-01").cast("timestamp_ntz").alias("created_at"), F.lit("").alias("snippet"))
    return L.annotate(old, new).withColumnRenamed("id", "event_id")


@query("""SELECT e.event_id, 'p' || e.user_id AS paper_id, coalesce(c.c_name, 'p' || e.user_id) AS title, 'a' || c.c_custkey AS arxiv_id FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_custkey % 2 = 0""")
def citation_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with their papers' titles; every other paper is missing from the manifest."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    manifest = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(name("c_custkey").alias("paper_id"), F.col("c_name").alias("title"), F.concat(F.lit("a"), F.col("c_custkey").cast("string")).alias("arxiv_id"))
    return L.with_titles(table(spark, sf_dir, "events").select("event_id", name("user_id").alias("paper_id")), manifest).select("event_id", "paper_id", "title", "arxiv_id")


@query("""WITH g AS (SELECT o_custkey AS group_id, 'p' || (o_orderkey % 40) AS paper_id, (o_orderkey % 3)::VARCHAR AS number, 's' || (o_orderkey % 11) AS title FROM orders),
s AS (SELECT DISTINCT 'p' || (l_orderkey % 40) AS paper_id, (l_linenumber % 3)::VARCHAR AS number, 's' || (l_partkey % 11) AS title FROM lineitem WHERE l_partkey % 11 < 9)
SELECT group_id FROM g LEFT JOIN (SELECT *, 1 AS k FROM s) USING (paper_id, number, title) GROUP BY group_id HAVING count(*) >= 2 AND count(DISTINCT paper_id) = count(*) AND count(k) = count(*)""")
def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of sections that can be compared: different papers, and sections that exist."""
    o = table(spark, sf_dir, "orders")
    word = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    groups = o.select(F.col("o_custkey").alias("group_id"), word("p", F.col("o_orderkey") % 40).alias("paper_id"), (F.col("o_orderkey") % 3).cast("string").alias("section_number"), word("s", F.col("o_orderkey") % 11).alias("section_title"))
    li = table(spark, sf_dir, "lineitem").filter("l_partkey % 11 < 9")
    sections = li.select(word("p", F.col("l_orderkey") % 40).alias("paper_id"), (F.col("l_linenumber") % 3).cast("string").alias("number"), word("s", F.col("l_partkey") % 11).alias("title"))
    return L.valid_groups(groups, sections)


@query("""WITH c AS (SELECT event_id AS pos, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'p' || event_id % 30 END AS paper_id, 'https://x/' || event_id % 13 AS url, 'r' || event_id AS ref FROM events)
SELECT CASE WHEN paper_id IS NULL THEN 'web' ELSE 'paper' END AS kind, coalesce(paper_id, url) AS source, min(pos) AS pos, string_agg(ref, ',' ORDER BY pos) AS refs FROM c GROUP BY ALL""")
def grouped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("p"), F.col("event_id") % 30)).alias("paper_id"), F.concat(F.lit("https://x/"), F.col("event_id") % 13).alias("url"), F.concat(F.lit("r"), F.col("event_id")).alias("ref"))
    return L.grouped_sources(c)


@query(r"""WITH a AS (SELECT o_orderkey AS pos, CASE o_orderkey % 3 WHEN 0 THEN 'https://arxiv.org/abs/' ELSE '' END || printf('%04d.%05d', o_orderkey % 50, o_custkey % 20) || CASE WHEN o_orderkey % 7 = 0 THEN '/x' ELSE '' END AS raw FROM orders),
n AS (SELECT *, CASE WHEN regexp_matches(raw, '/x$') THEN NULL ELSE right(raw, 10) END AS id FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS k FROM n)
SELECT pos, id AS arxiv_id, CASE WHEN id < '0010' THEN 'old-' || id ELSE id END AS name, CASE WHEN id IS NULL THEN 'invalid' WHEN id < '0010' OR k > 1 THEN 'duplicate' ELSE 'queued' END AS status FROM f""")
def added_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers asked for: queued, duplicates of what is there or was asked for before, and no papers at all."""
    o = table(spark, sf_dir, "orders")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    bare = F.concat(digits(F.col("o_orderkey") % 50, 4), F.lit("."), digits(F.col("o_custkey") % 20, 5))
    raw = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "https://arxiv.org/abs/").otherwise(""), bare, F.when(F.col("o_orderkey") % 7 == 0, "/x").otherwise(""))
    config = o.select(bare.alias("arxiv_id")).filter("arxiv_id < '0010'").distinct().select("arxiv_id", F.concat(F.lit("old-"), "arxiv_id").alias("name"))
    return L.merged_config(config, o.select(F.col("o_orderkey").alias("pos"), raw.alias("raw"))).select("pos", "arxiv_id", "name", "status")


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'h' || page_id END AS h, CASE WHEN page_id % 2 = 0 THEN 'p' || page_id END AS p FROM pages)
SELECT page_id AS paper_id, coalesce(h, p) AS markdown, CASE WHEN h IS NOT NULL THEN 'html' WHEN p IS NOT NULL THEN 'pdf' END AS source, CASE WHEN h IS NULL THEN 'html: no title' ELSE '' END AS warnings FROM p""")
def backend_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("paper_id"))
    html = p.select("paper_id", F.when(F.col("paper_id") % 3 != 0, F.concat(F.lit("h"), "paper_id")).alias("markdown"), F.when(F.col("paper_id") % 3 == 0, "no title").alias("error"))
    pdf = p.filter("paper_id % 2 = 0").select("paper_id", F.concat(F.lit("p"), "paper_id").alias("markdown"))
    return L.fallback(html, pdf).withColumn("warnings", F.array_join("warnings", ","))


@query("""WITH m AS (SELECT DISTINCT 'r' || user_id AS ref, event_type AS sentence, event_id // 3 AS start FROM events), v AS (SELECT 'r' || user_id AS ref, event_type AS sentence, event_id AS pos, CASE event_id % 3 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS label FROM events WHERE event_id % 2 = 0),
mn AS (SELECT *, row_number() OVER (PARTITION BY ref, sentence ORDER BY start) AS n FROM m), vn AS (SELECT *, row_number() OVER (PARTITION BY ref, sentence ORDER BY pos) AS n FROM v)
SELECT ref, sentence, start, label FROM mn LEFT JOIN vn USING (ref, sentence, n)""")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which verdict each mark of an answer shows."""
    e = table(spark, sf_dir, "events").withColumn("ref", F.concat(F.lit("r"), "user_id"))
    marks = e.select("ref", F.col("event_type").alias("sentence"), F.floor(F.col("event_id") / 3).alias("start"))
    label = F.element_at(F.array(F.lit("entailment"), F.lit("neutral"), F.lit("contradiction")), (F.col("event_id") % 3 + 1).cast("int"))
    return L.claims(marks, e.filter("event_id % 2 = 0").select("ref", F.col("event_type").alias("sentence"), F.col("event_id").alias("pos"), label.alias("label")))


@query("""WITH t AS (SELECT event_id, ts AS a, TIMESTAMP '2031-06-01 00:00:00' AS now, floor((epoch(TIMESTAMP '2031-06-01 00:00:00') - epoch(CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN TIMESTAMP '2031-05-31 23:59:30' - to_minutes((event_id % 70)::INTEGER) WHEN 2 THEN TIMESTAMP '2031-05-30 00:00:00' + to_hours((event_id % 40)::INTEGER) ELSE TIMESTAMP '2031-05-31 00:00:00' - to_days((event_id % 900)::INTEGER) END)) / 60)::BIGINT AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m // 60 < 24 THEN (m // 60)::BIGINT || 'h ago' WHEN m // 1440 < 30 THEN (m // 1440)::BIGINT || 'd ago' WHEN m // 1440 // 30 < 12 THEN (m // 1440 // 30)::BIGINT || 'mo ago' ELSE (m // 1440 // 30 // 12)::BIGINT || 'y ago' END AS said FROM t""")
def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda s: F.lit(s).cast("timestamp")
    i = F.col("event_id")
    then = (
        F.when(i % 4 == 0, F.col("ts")).when(i % 4 == 1, F.timestamp_add("MINUTE", -(i % 70).cast("int"), at("2031-05-31 23:59:30")))
        .when(i % 4 == 2, F.timestamp_add("HOUR", (i % 40).cast("int"), at("2031-05-30 00:00:00"))).otherwise(F.timestamp_add("DAY", -(i % 900).cast("int"), at("2031-05-31 00:00:00")))
    )
    return e.select("event_id", T.relative_time(then, at("2031-06-01 00:00:00")).alias("said"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '_' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE format('{:,}', o_custkey * 1000 + o_orderkey % 2) || ' token' || CASE WHEN o_custkey * 1000 + o_orderkey % 2 = 1 THEN '' ELSE 's' END || ' · ' END || printf('%.1f', ((o_orderkey * 125 % 90000 + 50) // 100) / 10.0) || 's_' END AS line FROM orders""")
def usage_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = T.usage_line(F.when(k % 5 != 0, F.col("o_custkey") * 1000), k % 2, F.when(k % 9 != 0, k * 125 % 90000))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


@query(f"""WITH s AS (SELECT doc_id, text, {SENTENCES.format(t="text")} AS ss FROM documents), x AS (SELECT doc_id, text, u.i AS i, ss[u.i] AS sentence FROM s, unnest(range(1, len(ss) + 1)) AS u(i))
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE contains(text, sentence)) AS found, sum(length(sentence))::BIGINT AS chars FROM x GROUP BY doc_id""")
def sentence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences by their offsets: each is cut out of the text anew and compared."""
    # Judged inside the row, from one array of spans: a row for each sentence would carry the whole text.
    again = lambda x: F.col("text").substr(x["start"] + 1, x["end"] - x["start"])
    told = lambda s: F.struct(F.size(s).alias("n"), F.size(F.filter(s, lambda x: again(x) == x["sentence"])).alias("found"), F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("chars"))
    each = table(spark, sf_dir, "documents").select("doc_id", F.inline(F.transform(F.array(T.sentence_spans(F.col("text"))), told)))
    return each.groupBy("doc_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "found", "chars")]).filter("n > 0")


@query(f"""WITH {SECTIONS}, u AS (SELECT paper_id, section_index, trim(coalesce(number, '') || ' ' || title) AS unit, title FROM sections)
SELECT paper_id, 'Paper ' || paper_id || ': ' || (SELECT heading FROM sections h WHERE h.paper_id = u.paper_id AND h.section_index = 0) || chr(10) || string_agg('  ' || unit, chr(10) ORDER BY section_index) AS outline FROM u GROUP BY paper_id""")
def outline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.outline_text(C.split_sections(pool(spark, sf_dir)))


@query("""SELECT sha256(string_agg(text, chr(0) ORDER BY text))[1:16] AS fingerprint FROM benchmark""")
def items_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.items_fingerprint(table(spark, sf_dir, "benchmark").select(F.col("text").alias("query")))


@query(r"""SELECT page_id, '2401.00001' || CASE page_id % 3 WHEN 0 THEN 'v' || (page_id % 9) ELSE '' END AS version, CASE page_id % 5 WHEN 0 THEN '.jpeg' WHEN 1 THEN '.png' WHEN 2 THEN '.svg' WHEN 3 THEN '.img' ELSE '.webp' END AS extension FROM pages""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a page names for its paper, and what its image is stored as."""
    i = F.col("page_id")
    html = F.concat(F.lit("x arXiv:2401.00001"), F.when(i % 3 == 0, F.concat(F.lit("v"), i % 9)).when(i % 3 == 1, " none").otherwise(" arXiv:2402.00002v3"))
    url = F.element_at(F.array(*[F.lit(x) for x in ("https://h/a.JPEG?x=1", "https://h/a", "https://h/a.pdf", "https://h/.png", "https://h/b.webp#f")]), (i % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("image/png", "image/png;q=1", "Image/SVG+XML", "text/html", "image/png")]), (i % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.page_version(html, F.lit("2401.00001")).alias("version"), T.extension(url, kind).alias("extension"))


@query(r"""WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, text || ' [^2][^10] and [r7]' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '[^2]: **Page** — https://h.example/x' || chr(10) || '[^10]: **Paper** — Method, https://arxiv.org/abs/2401.00001' AS markdown FROM c""")
def answer_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite a paper and a page in one bracket, and a ref that nothing stands behind."""
    none = F.lit(None).cast("string")
    cite = lambda ref, paper, title, section, arxiv, url: F.struct(F.lit(ref).alias("ref"), paper.alias("paper_id"), F.lit(title).alias("title"), section.alias("section_title"), arxiv.alias("arxiv_id"), url.alias("url"), F.lit("s").alias("snippet"), none.alias("label")).cast(X.CITATION)
    known = F.array(cite("r10", F.lit("p"), "Paper", F.lit("Method"), F.lit("2401.00001"), none), cite("r2", none, "Page", none, none, F.lit("https://h.example/x")), cite("r5", F.lit("q"), "Unused", F.lit("x"), none, none))
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", X.answer_markdown(F.concat("text", F.lit(" [r2, r10] and [r7]")), known).alias("markdown"))


@query(r"""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, q.text AS question, a.text AS answer FROM q LEFT JOIN a USING (conv_id, turn)),
i AS (SELECT *, regexp_replace(regexp_replace(replace(replace(question, '<', '&lt;'), '>', '&gt;'), '(?m)^(\s{0,3})([#>`~*+\-=_])', '\1\\\2', 'g'), '(?m)^(\s{0,3}\d+)([.)])(\s)', '\1\\\2\3', 'g') AS said FROM t),
b AS (SELECT conv_id, n, concat_ws(chr(10) || chr(10), '## Turn ' || n, '**Q:** ' || said, nullif(answer, ''), '_1.5s_') AS text FROM i)
SELECT conv_id AS chat_id, '# Conversation' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS markdown FROM b GROUP BY conv_id""")
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as documents: questions escaped, answers as they are."""
    c = table(spark, sf_dir, "conversations")
    q = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    turns = q.join(a, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("chat_id"), "turn", "question", "answer", F.array().cast(f"array<{X.CITATION}>").alias("citations"), F.array().cast("array<struct<kind:string,text:string,paper:string>>").alias("trace"),
        F.lit(None).cast("long").alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"), F.lit(1500).cast("long").alias("latency_ms"), F.lit(None).cast("string").alias("vote"), F.lit(None).cast("string").alias("note"),
    )
    return X.conversations(turns)


@query("""WITH n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE turn % 3 = 2) AS odd, max(text) FILTER (WHERE turn = 0) AS name FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS chat_id, CASE WHEN conv_id % 7 <> 3 THEN n END AS n_turns, CASE WHEN conv_id % 7 <> 3 THEN n - odd END AS n_answers,
  CASE WHEN conv_id % 7 <> 3 THEN coalesce(nullif(left(name, 40), ''), 'New chat') END AS name, CASE WHEN conv_id % 7 = 3 THEN 'no record' END AS error FROM n""")
def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as JSON records, some of them cut off, read by paths: answers of another type in every third turn, and bad records beside good ones."""
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 3 == 2, F.to_json(F.struct(F.array(F.lit(1)).alias("answer"), "turn"))).otherwise(F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("answer"), "turn")))
    chats = c.select("conv_id", "turn", "text", said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "said"))).alias("x"), F.max(F.when(F.col("turn") == 0, F.substring("text", 1, 40))).alias("name"))
    head = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.coalesce("name", F.lit("")).alias("name")))
    whole = F.concat(F.rtrim(head, F.lit("}")), F.lit(', "turns": ['), F.array_join(F.transform("x", lambda e: e["said"]), ","), F.lit("]}"))
    texts = chats.select(F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("pos"), F.when(F.col("conv_id") % 7 == 3, F.substring(whole, F.lit(1), F.char_length(whole) - 1)).otherwise(whole).alias("text"))
    rows = V.parsed(texts)
    turns = V.turns(rows).groupBy("chat_id").agg(F.count_if(~V.field(F.col("record"), "$.answer", "array<variant>").isNotNull()).alias("n_answers"))
    good = V.sessions(rows).select(F.col("id").alias("chat_id"), F.col("n_turns").cast("long").alias("n_turns"), "name").join(turns, "chat_id").withColumn("error", F.lit(None).cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = V.refused(rows).select(F.col("file").alias("chat_id"), none("long").alias("n_turns"), none("string").alias("name"), none("long").alias("n_answers"), "error")
    return good.unionByName(bad).select("chat_id", "n_turns", "n_answers", "name", "error")
