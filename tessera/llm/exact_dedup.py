"""Exact duplicates by deterministic block naming (operator 12).

A text is cut into fixed-size blocks of its UTF-8 bytes. Blocks are sorted and take integer names, equal blocks the same
one; then adjacent names of a document are taken as pairs, and the pairs are sorted and named in the same way, until each
document has one name. Names are given after comparing whole blocks and whole pairs, so no two texts share an identity by
chance. What occurs once in the corpus needs no name: the document that holds it equals no other and leaves. So later
rounds only see documents made of what others have too, and each round has half as many names.

Blocks are grouped before and after the one shuffle that carries text, so a group of copies sends each block once for a
task. A document finds the names of its blocks by two 64-bit hashes; that these tell all blocks apart is proven by counting
(as many blocks found a name as were grouped under one), and where they don't, other hashes are taken. Pairs of names
need no hash. Joins on a hot name are split by the adaptive skew join, over rows of a few bytes.

Defined results: a null text is an empty one, and all empty texts are equal; ids may be null or repeated, every row is a
document of its own, and a null id is the smallest; of equal texts the row with the largest id stays, of repeated such
rows one; an empty table gives no rows; texts are compared whole, whatever their length (a document's own names, 8 bytes
for each block, are one row); columns beside id and text have no influence, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, stored, tidy

#: Bytes of a block.
BLOCK = 1024
#: Stands in a pair for the name that an odd number of names lacks.
NONE = -1


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The text's UTF-8 bytes in blocks of ``size``, the last as long as what is left; an empty text is one empty block."""
    last = lambda b: F.greatest(F.floor((F.octet_length(b) - 1) / size), F.lit(0)).cast("int")
    return let(F.coalesce(text, F.lit("")).cast("binary"), lambda b: F.transform(F.sequence(F.lit(0), last(b)), lambda i: F.substring(b, i * size + 1, F.lit(size))))


def keys(block: Column, attempt: int) -> Column:
    """What blocks are looked up by; another attempt has other hashes."""
    return F.struct(F.xxhash64(F.lit(2 * attempt), block).alias("a"), F.xxhash64(F.lit(2 * attempt + 1), block).alias("b"))


def named(things: DataFrame, *by: str) -> DataFrame:
    """``by``, n, name: what occurs twice or more has its place in sorted order as name, and the partition in the upper bits.

    Rows are grouped in their tasks first. The names hold for the table that is written from this, not for a second run.
    """
    repeated = things.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def renamed(parts: DataFrame, names: DataFrame, on: list[str]) -> DataFrame:
    """rid, n_blocks, found, names: each document's new names in order; ``found`` is the number of its parts that have one."""
    found = parts.join(names.select(*on, "name"), on, "left")
    listed = found.groupBy("rid", "n_blocks").agg(
        F.count(F.lit(1)).alias("n"), F.count("name").alias("found"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("pos", "name"))).alias("x")
    )
    ordered = F.transform(F.array_sort("x"), lambda e: e["name"])
    return listed.select("rid", "n_blocks", "found", F.when(F.col("found") == F.col("n"), ordered).alias("names"))


def _first_names(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The documents by row id, and the first names of those that only have repeated blocks."""
    for attempt in count():
        told = F.transform(blocks(F.col("text"), size), lambda b: keys(b, attempt))
        ids = stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), told.alias("keys"), "row"), "exact-docs")
        each = docs.select(F.explode(blocks(F.col("text"), size)).alias("block"))
        names = stored(named(each.select(keys(F.col("block"), attempt).alias("key"), "block"), "key", "block").drop("block"), "exact-blocks")
        parts = ids.select("rid", F.size("keys").alias("n_blocks"), F.posexplode("keys").alias("pos", "key"))
        level = stored(renamed(parts, names, ["key"]), "exact-names")
        if names.agg(F.sum("n")).first()[0] == level.agg(F.sum("found")).first()[0]:
            return ids, level.filter("names IS NOT NULL")


def _identities(level: DataFrame) -> DataFrame:
    """rid, n_blocks, name: of documents whose parts are repeated up to the whole; others equal none."""
    done = []
    while True:
        done.append(level.filter(F.size("names") == 1).select("rid", "n_blocks", F.col("names")[0].alias("name")))
        going = level.filter(F.size("names") > 1)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        second = lambda i: F.coalesce(F.get("names", 2 * i + 1), F.lit(NONE).cast("long"))
        pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")), lambda i: F.struct(F.get("names", 2 * i).alias("left"), second(i).alias("right")))
        parts = going.select("rid", "n_blocks", F.posexplode(pairs).alias("pos", "pair"))
        names = stored(named(parts, "n_blocks", "pair"), "exact-pairs")
        level = stored(renamed(parts, names, ["n_blocks", "pair"]), "exact-names").filter("names IS NOT NULL")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, row: one row for each document; ``row`` is a struct of the columns to carry."""
    spark = docs.sparkSession
    row = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("string")
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), row.alias("row"))
    with tidy(spark) as keep:
        ids, level = _first_names(d, block)
        same = keep(stored(_identities(level).join(ids.select("rid", "doc_id"), "rid"), "exact-same"))
        ids = keep(ids)
    identity = ["n_blocks", "name"]
    sizes = same.groupBy(*identity).agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size"))
    grouped = same.select("rid", *identity).join(sizes, identity).select("rid", "best", "group_size")
    own = F.struct("doc_id", "rid")
    return (
        ids.drop("keys").join(grouped, "rid", "left")
        .withColumn("best", F.coalesce("best", own))
        .select("doc_id", F.col("best.doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (F.col("best.rid") == F.col("rid")).alias("kept"), "text_sha256", "row")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return classes(docs, id_col, text_col, tuple(docs.columns)).filter("kept").select("row.*")
