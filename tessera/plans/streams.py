"""Named stream queries: batch twins of the streaming plans, over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalogue import query, table
from tessera.streaming import streams as S


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tumbling(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT w AS window_start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY w""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding(table(spark, sf_dir, "events"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(table(spark, sf_dir, "events"))


DELTAS = """d AS (SELECT conv_id AS stream_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || text || '</think>' WHEN 3 THEN text || '<think>' || role ELSE text END AS delta FROM conversations),
w AS (SELECT stream_id, string_agg(delta, '' ORDER BY turn, delta) AS t FROM d GROUP BY stream_id)"""


@query(rf"""WITH {DELTAS} SELECT stream_id, regexp_replace(regexp_replace(t, '<think>.*?</think>', 'THINK_TAG', 'gs'), '<think>.*\z', '', 's') AS text,
  array_to_string(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|\z)', 1), '') AS thoughts FROM w""")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without the thoughts between tags, a placeholder for each whole span, and the thoughts beside them."""
    c = table(spark, sf_dir, "conversations")
    thought = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>"), "text", F.lit("</think>"))).when(F.col("turn") % 4 == 3, F.concat("text", F.lit("<think>"), "role")).otherwise(F.col("text"))
    return S.visible_text_batch(c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), thought.alias("delta")))


@query("""SELECT user_id AS stream_id, event_id % 3 AS index, string_agg(event_type, '' ORDER BY event_id) AS arguments FROM events GROUP BY ALL""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of calls that come interleaved, put together by index."""
    e = table(spark, sf_dir, "events")
    return S.tool_calls(e.select(F.col("user_id").alias("stream_id"), (F.col("event_id") % 3).alias("index"), F.col("event_id").alias("seq"), F.col("event_type").alias("fragment")))


@query("""WITH e AS (SELECT user_id AS stream_id, event_id AS seq, ['token', 'trace', 'noise', 'usage', 'done', 'token', 'token'][event_id % 7 + 1] AS kind, event_type AS data FROM events),
f AS (SELECT *, coalesce(max((kind = 'done')::INTEGER) OVER (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e)
SELECT stream_id, seq, 'event: ' || kind || chr(10) || 'data: ' || data || chr(10) || chr(10) AS line FROM f WHERE ended = 0 AND kind <> 'noise'""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn sends, up to its end; late events and unknown kinds are not sent."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("token", "trace", "noise", "usage", "done", "token", "token")]), (F.col("event_id") % 7 + 1).cast("int"))
    return S.event_lines(table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("data")))
