"""WARC archives: writing with deduplicated payloads, and reading by boundary-chain verification (operator 4).

Writing: a record is a line of Spark's text writer whose line separator is the archive's record separator, so
files appear by the commit protocol, on any file system that Spark writes to. Payloads of at least
``MIN_REVISIT`` bytes that are equal (by SHA-256) are stored once, under the smallest page id; the others
become revisit records that name it.

Reading: the record magic may also stand inside a payload. Tasks emit, for every place in a file where the
magic is found, the offset of the record that would follow; from the start of each file pointer jumping
(doubling the jumps each round) marks the records on the chain, and only those are kept.

Defined results: a null html is an empty payload; a null page_id is written as an empty field and read as
null; where page ids repeat, rows with the smallest id of a payload are all responses; tables without rows
give archives without records; other columns of the input are not read. A broken file keeps the records up
to the break, as the chain ends there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, scratch, stored, tidy

MAGIC = b"WARC/1.1\r\n"
SEPARATOR = "\r\n\r\n"
MIN_REVISIT = 100
#: Fixed value: what says that a revisit's payload is the same as one that is there.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file, which a task reads whole, and of pages that are written together whatever their size.
FILE_BYTES, SMALL = 128 << 20, 64 << 10
#: Rows of the table of repeated payloads up to which it is broadcast (about 100 bytes a row); beyond, it is joined by shuffle.
BROADCAST_ROWS = 100_000
HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)\r\n")
FOUND = "file string, at long, next long, page_id string, record_type string, refers_to string, named_digest string, payload_digest string, payload_bytes long, right boolean"


def _repeated(pages: DataFrame) -> DataFrame:
    """digest -> smallest page id, of payloads that occur more than once: partial sums before the one small shuffle."""
    sums = pages.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy(F.sha2("payload", 256).alias("digest"))
    return sums.agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def with_types(pages: DataFrame) -> DataFrame:
    """Adds ``digest`` and, for revisits, ``first_id``. The payloads themselves are shuffled only if the repeated ones are too many to broadcast."""
    again = stored(_repeated(pages), "warc-repeated")
    small = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    p = pages.withColumn("digest", F.sha2("payload", 256))
    j = p.join(F.broadcast(again) if small else again, (F.octet_length("payload") >= MIN_REVISIT) & (p["digest"] == again["digest"]), "left").drop(again["digest"])
    return j.withColumn("first_id", F.when(F.col("page_id") == F.col("first_id"), None).otherwise(F.col("first_id")))


def _record(date: str) -> Column:
    """One record. Its id is its own, whatever pages repeat; pages are told by fields of our own, which readers may skip."""
    revisit = F.col("first_id").isNotNull()
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest", F.monotonically_increasing_id().cast("string")))
    uuid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To-Page: "), F.col("first_id").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, F.lit(0)).otherwise(F.octet_length("payload")).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str | None = None) -> None:
    """One record for each row, in files of about ``file_bytes`` at most, or of one record, under ``path``.

    Pages are written by classes of their size, each twice the one before, with as many records in a file as a class
    allows. Nearly always there is one class.
    """
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    size = F.greatest(F.lit(0), F.ceil(F.log2(F.octet_length("payload") / F.lit(float(SMALL))))).cast("int")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    typed = with_types(p).withColumn("class", F.when(F.octet_length("payload") > SMALL, size).otherwise(0))
    classes = sorted(r["class"] for r in p.select(F.when(F.octet_length("payload") > SMALL, size).otherwise(0).alias("class")).distinct().collect()) or [0]
    for c in classes:
        records = typed.filter(F.col("class") == c) if len(classes) > 1 else typed
        out = records.select(_record(date).alias("value")).write.mode("append").option("lineSep", SEPARATOR)
        out.option("maxRecordsPerFile", max(1, file_bytes // (SMALL << c))).text(path)


def candidates(data: bytes) -> Iterator[tuple]:
    """Every place with the magic and a complete header: (offset, offset of what would follow, fields...).

    The digest is that of the payload's bytes as they are read (null for revisits, which have none), and ``right`` says
    whether it is the one that the header names; chains don't use it.
    """
    at = data.find(MAGIC)
    while at >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end >= 0:
            fields = {k.lower(): v for k, v in HEADER.findall(data[at + len(MAGIC) : end + 2])}
            length = fields.get(b"content-length", b"")
            if length.isdigit():
                start = end + 4
                stop = start + int(length)
                if data[stop : stop + 4] == b"\r\n\r\n":
                    page = lambda k: fields.get(k, b"").decode("ascii", "replace") or None
                    named = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
                    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
                    read = None if kind == "revisit" else hashlib.sha256(data[start:stop]).hexdigest()
                    yield at, stop + 4, page(b"warc-page-id"), kind, page(b"warc-refers-to-page"), named, read, int(length), read in (None, named)
        at = data.find(MAGIC, at + 1)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All candidates of all files under ``path``: a task holds one file of bounded length at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in FOUND.split(", ")][1:]
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                found = pd.DataFrame(list(candidates(bytes(data))), columns=columns)
                found.insert(0, "file", file)
                yield found

    return files.mapInPandas(run, FOUND)


def reachable(found: DataFrame) -> DataFrame:
    """file, at: the records on the chain from each file's start.

    Round r knows the records within 2**r steps and the jumps over 2**r records; both are written each round,
    so a lost executor costs one round. The number of rounds is the logarithm of the longest chain.
    """
    jumps = stored(found.select("file", "at", F.col("next").alias("to")), "warc-jumps")
    reach = found.filter("at = 0").select("file", "at")
    known = reach.count()
    while True:
        ahead = reach.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        ahead = ahead.join(found.select("file", "at"), ["file", "at"], "left_semi")
        reach = stored(reach.unionByName(ahead).distinct(), "warc-reach")
        now = reach.count()
        if now == known:
            return reach
        known = now
        far = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
        jumps = stored(jumps.join(far, ["file", "to"]).select("file", "at", F.col("end").alias("to")), "warc-jumps")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records on the chains: page_id, record_type, refers_to, named_digest, and of responses payload_digest, payload_bytes and right, from the bytes read."""
    found = stored(scan(spark, path), "warc-found")
    return found.join(reachable(found), ["file", "at"], "left_semi").drop("next")


def resolved(records: DataFrame) -> DataFrame:
    """Revisits with length and digest of the payload they refer to, as read at the response that names the same digest.

    ``right`` is false where the bytes don't have the digest that headers name, and for a revisit whose response isn't there.
    """
    again = records.filter("record_type = 'revisit'").select("page_id", "refers_to", "named_digest")
    first = records.filter("record_type = 'response' AND payload_bytes >= 100").groupBy(F.col("page_id").alias("refers_to"), "named_digest").agg(
        F.max("payload_bytes").alias("payload_bytes"), F.min("payload_digest").alias("payload_digest"), F.bool_and("right").alias("right")
    )
    columns = ("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "right")
    looked_up = again.join(first, ["refers_to", "named_digest"], "left").withColumns({"record_type": F.lit("revisit"), "right": F.coalesce("right", F.lit(False))})
    return records.filter("record_type = 'response'").select(*columns).unionByName(looked_up.select(*columns))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder, read them back, and say what they hold for each page."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    try:
        with tidy(spark) as keep:
            write_archives(pages, path)
            records = read_archives(spark, path)
            return keep(stored(resolved(records).withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long")), "warc-out"))
    finally:
        drop_path(spark, path)
