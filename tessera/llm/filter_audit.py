"""Filter interaction audit by lattice edges (operator 13).

A document's outcome under any order of the filters follows from which of them it fails. Documents are counted by part,
failures and labels in their tasks; each of these few counts contributes to the 80 edges (already-applied subset, next
filter) of the subset lattice, and the edges are joined to the 600 steps of the 120 orders, which are paths through it.
So no document is looked at more than once, and none 600 times.

Filters, by what fails: A under 200 words; B fewer distinct words than half the words; C more than 2 % capitals A to Z;
D any of ``#$%&*|``; E a text that a smaller doc_id has too, table-wide.

Defined results: a null text is an empty one (no words: fails A alone, or A and E), a null source the empty string; a null
doc_id has no labels and counts as larger than all others; of repeated rows with the smallest doc_id of a text none fails E;
of repeated labels of a doc_id any 1 counts, null labels count as 0; an empty table gives no rows; texts are taken whole;
equal texts are told by their SHA-256; other columns, whatever their names, have no influence.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let

FILTERS = "ABCDE"
#: Filter E, which needs other documents; the others are the text's own.
REPEATED = FILTERS.index("E")
SPACE = r"[\x20\x09-\x0D]+"
CAPITAL = r"[A-Z]"
MARK = r"[#$%&*|]"
#: What null ids count as.
LAST = 2**63 - 1
#: Rows with a null id are spread over so many keys.
SPREAD = 256


def failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that the text fails. Words are split once."""
    t = F.coalesce(text, F.lit(""))
    bit = lambda i, fails: F.when(fails, F.lit(1 << i)).otherwise(F.lit(0))
    words = let(F.filter(F.split(t, SPACE), lambda w: w != ""), lambda w: bit(0, F.size(w) < 200) + bit(1, F.lit(100).cast("long") * F.size(F.array_distinct(w)) < F.lit(50).cast("long") * F.size(w)))
    capitals = F.when(t.rlike(CAPITAL), F.regexp_count(t, F.lit(CAPITAL)).cast("long")).otherwise(F.lit(0).cast("long"))
    return words + bit(2, 100 * capitals > 2 * F.char_length(t)) + bit(3, t.rlike(MARK))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, good, toxic, n: how many documents fail the same filters and are labelled alike. At most 128 rows for each part.

    One row of a few dozen bytes for each document is shuffled, by doc_id, which no group of copies makes hot. Then texts
    are counted by digest before they are shuffled by it.
    """
    d = docs.select(
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), docs["doc_id"].alias("doc_id"),
        failures(docs["text"]).alias("bits"), F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)).alias("digest"),
    )
    d = d.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long")))
    flags = labels.filter(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].alias("doc_id")).agg(
        F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic")
    )
    flagged = d.join(flags.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left").fillna(False, ["good", "toxic"])
    rows = flagged.groupBy("doc_id", "spread", "digest", "part", "bits", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    same = rows.withColumn("o", F.coalesce("doc_id", F.lit(LAST))).groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.struct("o", "n")).alias("first")
    )
    # The smallest id of all that have the text passes E. A text has a row for each part and label, so none is hot here.
    each = same.withColumn("o", F.min("first.o").over(Window.partitionBy("digest")))
    passes = F.when(F.col("first.o") == F.col("o"), F.col("first.n")).otherwise(F.lit(0).cast("long"))
    split = F.array(
        F.struct(F.col("bits"), passes.alias("n")),
        F.struct(F.col("bits").bitwiseOR(F.lit(1 << REPEATED)).alias("bits"), (F.col("n") - passes).alias("n")),
    )
    told = each.select("part", "good", "toxic", F.explode(split).alias("s")).filter("s.n > 0")
    return told.groupBy("part", F.col("s.bits").alias("bits"), "good", "toxic").agg(F.sum("s.n").alias("n"))


def edges(counted: DataFrame) -> DataFrame:
    """part, applied, next and counts: the 80 edges of every part, from counts by failure pattern."""
    pairs = [(applied, i) for applied in range(1 << len(FILTERS)) for i in range(len(FILTERS)) if not applied >> i & 1]
    lattice = F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(i).alias("next")) for a, i in pairs])
    x = counted.select("part", "bits", "good", "toxic", "n", F.explode(lattice).alias("e")).select("*", "e.applied", "e.next")
    gone = F.col("bits").bitwiseAND(F.col("applied")) != 0
    own = F.expr("shiftleft(1, next)")
    fails = F.col("bits").bitwiseAND(own) != 0
    total = lambda when, name: F.sum(F.when(when, F.col("n")).otherwise(F.lit(0).cast("long"))).alias(name)
    return x.groupBy("part", "applied", "next").agg(
        total(~gone & ~fails, "kept"), total(~gone & fails, "removed"), total(gone & fails, "redundant"), total(F.col("bits") == own, "unique_fails"),
        total(~gone & fails & F.col("good"), "good_lost"), total(~gone & fails & F.col("toxic"), "toxic_lost"),
    )


def steps(df: DataFrame) -> DataFrame:
    """filter_order, step, applied, next: 600 rows."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        applied = 0
        for k, i in enumerate(order):
            rows.append(("".join(FILTERS[j] for j in order), k + 1, applied, i))
            applied |= 1 << i
    return df.sparkSession.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    lattice, paths = edges(patterns(docs, labels)), steps(docs)
    # An edge lies on as many orders as the steps say: sums over edges stand for sums over all orders.
    uses = F.broadcast(paths.groupBy("applied", "next").agg(F.count(F.lit(1)).alias("uses")))
    removed = F.sum(F.col("removed") * F.col("uses")).over(Window.partitionBy("part", "next"))
    weighed = lattice.join(uses, ["applied", "next"]).withColumn("shapley", removed)
    return weighed.join(F.broadcast(paths), ["applied", "next"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
