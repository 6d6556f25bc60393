"""BM25's best rows from postings in blocks: what can't reach the n-th score is not read.

Rows are dealt to shards by a hash of their id and numbered in each, in the order of their ids. A block holds one term's
postings of a run of numbers, with its greatest frequency and its least length; from these two the most that the block can
add to a score follows for any statistics, so blocks outlive changes of the corpus. A query takes a shard's runs in the
order of what its terms could add there at most, and stops at the pivot: the first run whose bound the n-th score so far
beats. Inside a run only rows with a term that is needed to beat it are scored. What leaves a shard are n rows for each query, never all (query, row) scores.

Scores, statistics and ties are those of ``retrieval.bm25_topk``. Shards are bounded by rows and by bytes of text, so a task
holds the asked terms' postings of one shard; queries go to the shards in blocks of a bounded number of terms. Texts are
shuffled once, to their shards, and are split into words and grouped there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import retrieval as R
from tessera.scratch import stored

#: Rows of a shard about, numbers of a block's run, and distinct (query, term) pairs that are sent to the shards at once.
SHARD, RUN, TERMS = 65_536, 256, 200_000
#: Bytes of a shard's texts about: in Python its postings take several times as much.
SHARD_BYTES = 4 << 20
PLACES = 9


@dataclass
class Blocks:
    """rows (shard, no, chunk_id), blocks (shard, term, run, most_tf, least_dl, nos, tfs, dls), and the corpus' statistics."""

    rows: DataFrame
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame


def build(chunks: DataFrame, path: str | None = None, shard: int = SHARD, run: int = RUN) -> Blocks:
    """Blocks of (chunk_id, text), stored (under ``path``): texts are split into words once, and words are counted inside the row."""
    at = (lambda name: f"{path}/{name}") if path else (lambda name: None)
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    shards = max(1, -(-size["n"] // shard), -(-(size["bytes"] or 0) // SHARD_BYTES))
    told = chunks.select("chunk_id", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int").alias("shard"), "text")
    # A partition for each shard about; all that follows is within a shard, and needs no other shuffle.
    number = (F.row_number().over(Window.partitionBy("shard").orderBy("chunk_id")) - 1).alias("no")
    rows = stored(told.select("shard", "chunk_id").repartition(shards, "shard").select("shard", number, "chunk_id"), "rows", at("rows"))
    numbered = told.repartition(shards, "shard").select("shard", number, "text")
    entries = numbered.select("shard", "no", F.explode(R.counted_terms(F.array_sort(R.words(F.col("text"))))).alias("e")).select("shard", "no", "e.dl", "e.term", "e.tf")
    grouped = entries.groupBy("shard", "term", F.floor(F.col("no") / run).cast("int").alias("run")).agg(
        F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.sort_array(F.collect_list(F.struct(F.col("no"), F.col("tf").cast("int").alias("tf"), F.col("dl")))).alias("p")
    )
    blocks = grouped.select("shard", "term", "run", "most_tf", "least_dl", *[F.col(f"p.{f}").cast("array<int>").alias(f"{f}s") for f in ("no", "tf", "dl")])
    blocks = stored(blocks.sortWithinPartitions("shard", "term", "run"), "blocks", at("blocks"))
    tokens = blocks.agg(F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)).alias("tokens"))
    about = rows.agg(F.lit(None).cast("string").alias("term"), F.count(F.lit(1)).alias("df")).join(F.broadcast(tokens))
    vocab = stored(blocks.groupBy("term").agg(F.sum(F.size("nos")).alias("df"), F.lit(None).cast("long").alias("tokens")).unionByName(about), "vocabulary", at("vocabulary"))
    return Blocks(rows, blocks, R.term_stats(vocab), R.corpus_stats(vocab))


def load(spark: SparkSession, path: str) -> Blocks:
    """What ``build`` stored under ``path``."""
    rows, blocks, vocab = (spark.read.parquet(f"{path}/{name}") for name in ("rows", "blocks", "vocabulary"))
    return Blocks(rows, blocks, R.term_stats(vocab), R.corpus_stats(vocab))


def _scan(asked: dict[int, list[tuple[str, float]]], avgdl: float, n: int, k1: float, b: float):
    """A shard's best: rows (q, shard, no, score), and a row for each query without a number that has the postings read, and all of its terms'."""

    def part(tf, dl):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

    def run(t: pa.Table) -> pa.Table:
        shard, terms = t["shard"][0].as_py(), {}
        for i, term in enumerate(t["term"].to_pylist()):
            terms.setdefault(term, []).append(i)
        bound = part(t["most_tf"].to_numpy().astype(float), t["least_dl"].to_numpy().astype(float))
        runs = t["run"].to_numpy()
        lists = {c: t[c].combine_chunks() for c in ("nos", "tfs", "dls")}
        cut = lists["nos"].offsets.to_numpy()
        flat = {c: x.values.to_numpy() for c, x in lists.items()}
        sizes = np.diff(cut)
        out = []
        for q, weights in asked.items():
            mine = [(i, w) for term, w in weights for i in terms.get(term, ())]
            if not mine:
                continue
            at = np.array([i for i, _ in mine])
            weight = np.array([w for _, w in mine])
            where, code = np.unique(runs[at], return_inverse=True)
            most = np.bincount(code, np.maximum(weight * bound[at], 0), len(where))
            best_no, best = np.zeros(0, np.int64), np.zeros(0)
            read = 0
            by_run = np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code, minlength=len(where)))[:-1])
            for r in np.argsort(-most, kind="stable"):
                # The pivot: neither this run nor a later one can reach the n-th score, not even as a tie.
                if most[r] <= 0 or (len(best) >= n and round(float(most[r]), PLACES) < round(float(best[-1]), PLACES)):
                    break
                # Rows that only have terms which together can't reach the n-th score aren't looked for; theirs are looked up for the others.
                blocks, own = at[by_run[r]], weight[by_run[r]]
                most_of = np.maximum(own * bound[blocks], 0)
                order = np.argsort(most_of, kind="stable")
                low = np.round(np.cumsum(most_of[order]), PLACES) < round(float(best[-1]), PLACES) if len(best) >= n else np.zeros(len(order), bool)
                span = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in blocks[order[~low]]])
                read += len(span)
                each = np.repeat(own[order[~low]], sizes[blocks[order[~low]]]) * part(flat["tfs"][span].astype(float), flat["dls"][span].astype(float))
                nos, inverse = np.unique(flat["nos"][span], return_inverse=True)
                score = np.bincount(inverse, each, len(nos))
                for i, w in zip(blocks[order[low]].tolist(), own[order[low]].tolist()):
                    there = flat["nos"][cut[i] : cut[i + 1]]
                    place = np.minimum(np.searchsorted(there, nos), len(there) - 1)
                    hit = np.flatnonzero(there[place] == nos)
                    read += min(len(nos), len(there))
                    if len(hit):
                        x = cut[i] + place[hit]
                        score[hit] += w * part(flat["tfs"][x].astype(float), flat["dls"][x].astype(float))
                keep = np.round(score, PLACES) > 0
                nos, score = np.concatenate([best_no, nos[keep]]), np.concatenate([best, score[keep]])
                top = np.lexsort((nos, -np.round(score, PLACES)))[:n]
                best_no, best = nos[top], score[top]
            out += [(q, shard, int(x), float(s)) for x, s in zip(best_no, best)]
            out.append((q, shard, None, float(read)))
            out.append((q, None, None, float(sizes[at].sum())))
        columns = [list(c) for c in zip(*out)] or [[]] * 4
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64()))], ["q", "shard", "no", "score"])

    return run


def topk(queries: DataFrame, index: Blocks, n: int, k1: float = R.K1, b: float = R.B) -> tuple[DataFrame, DataFrame]:
    """(qid, chunk_id, score, rank) of the best ``n`` rows of each query (qid, text), and (qid, n_read, n_postings): the postings read, and all of its terms'."""
    spark = queries.sparkSession
    terms = queries.select("qid", F.explode(R.words(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    numbered = stored(terms.groupBy("qid").agg(F.collect_list(F.struct("term", "qtf")).alias("x")).withColumn("q", F.monotonically_increasing_id()), "asked")
    each = numbered.select("q", F.explode("x").alias("e")).select("q", "e.term", "e.qtf").join(index.terms.select("term", "idf"), "term")
    known = stored(each.select("q", "term", (F.col("qtf") * F.col("idf")).alias("weight")), "weights")
    shape = "q long, shard int, no int, score double"
    parts = max(1, -(-known.count() * 10 // (9 * TERMS)))
    average = index.corpus.first()
    found = []
    for i in range(parts if average is not None and average["avgdl"] else 0):
        some = known.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == i) if parts > 1 else known
        asked: dict[int, list[tuple[str, float]]] = {}
        for r in sorted(some.collect()):
            asked.setdefault(r["q"], []).append((r["term"], r["weight"]))
        wanted = spark.createDataFrame([(t,) for t in {t for x in asked.values() for t, _ in x}], "term string")
        mine = index.blocks.join(F.broadcast(wanted), "term", "left_semi").select("shard", "term", "run", "most_tf", "least_dl", "nos", "tfs", "dls")
        found.append(mine.groupBy("shard").applyInArrow(_scan(asked, average["avgdl"], n, k1, b), shape))
    best = stored(reduce(DataFrame.unionByName, found), "found") if found else spark.createDataFrame([], shape)
    named = best.filter("no IS NOT NULL").join(index.rows.select("shard", "no", "chunk_id"), ["shard", "no"]).join(numbered.select("q", "qid"), "q")
    said = best.filter("no IS NULL").groupBy("q").agg(F.sum(F.when(F.col("shard").isNotNull(), F.col("score"))).cast("long").alias("n_read"), F.sum(F.when(F.col("shard").isNull(), F.col("score"))).cast("long").alias("n_postings"))
    return R.top(named.select("qid", "chunk_id", "score"), n), said.join(numbered.select("q", "qid"), "q").select("qid", "n_read", "n_postings")
