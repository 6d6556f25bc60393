"""Stores of JSON records as VARIANT: what is known is read by paths and types, what isn't stays, and a bad record is a row of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a chat and of its turns that are read by name; others stay in the record.
CHAT = {"id": "string", "name": "string", "created_at": "string", "updated_at": "string"}
TURN = {"question": "string", "answer": "string", "feedback": "string", "created_at": "string"}
NOTE = {"id": "string", "paper_id": "string", "section": "string", "snippet": "string", "note": "string", "created_at": "string"}


def parsed(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``record``, a VARIANT, and ``error`` where the text is no JSON; a JSON null is an error too."""
    record = F.try_parse_json(F.col(text))
    return texts.withColumn("record", record).withColumn("error", F.when(record.isNull() | F.is_variant_null(record), F.lit("no record"))).drop(text)


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, pos, record, error: a record for each file, or for each line that isn't blank (pos counts within a task's part of a file)."""
    rows = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"))
    return parsed(rows.filter(F.trim("text") != "") if lines else rows)


def field(record: Column, path: str, kind: str) -> Column:
    """The value at a path where it has the type, or can be cast to it; null otherwise."""
    return F.try_variant_get(record, path, kind)


def fields(record: Column, known: dict[str, str]) -> list[Column]:
    return [field(record, f"$.{name}", kind).alias(name) for name, kind in known.items()]


def elements(rows: DataFrame, path: str, *keep: str | Column) -> DataFrame:
    """``keep``, pos and record of each element of the array at a path; without an array there are none."""
    return rows.select(*keep, F.posexplode(field(F.col("record"), path, "array<variant>")).alias("pos", "record"))


def sessions(records: DataFrame) -> DataFrame:
    """id, name, created_at, updated_at, n_turns of chats, the latest first; what is no chat (no id) is left out, and kept by ``refused``."""
    good = records.filter("error IS NULL").select(*fields(F.col("record"), CHAT), F.coalesce(F.size(field(F.col("record"), "$.turns", "array<variant>")), F.lit(0)).alias("n_turns"))
    return good.filter("id IS NOT NULL").withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("New chat"))).orderBy(F.desc_nulls_last("updated_at"), "id")


def turns(records: DataFrame) -> DataFrame:
    """chat_id, turn, the known fields, and the turn as it is; an element that is no object has nulls, and its neighbours theirs."""
    each = elements(records.filter("error IS NULL"), "$.turns", field(F.col("record"), "$.id", "string").alias("chat_id"))
    return each.filter("chat_id IS NOT NULL").select("chat_id", F.col("pos").cast("long").alias("turn"), *fields(F.col("record"), TURN), "record")


def annotations(records: DataFrame) -> DataFrame:
    """The known fields of notes, from files that hold an array of them; an element without an id is left out, its neighbours stay."""
    return elements(records.filter("error IS NULL"), "$").select(*fields(F.col("record"), NOTE), "record").filter("id IS NOT NULL")


def refused(records: DataFrame, key: str = "$.id") -> DataFrame:
    """file, pos, error of records that can't be read, and of those without what they are told by."""
    named = F.coalesce(F.col("error"), F.when(field(F.col("record"), key, "string").isNull(), F.lit(f"without {key}")))
    return records.select("file", "pos", named.alias("error")).filter("error IS NOT NULL")
