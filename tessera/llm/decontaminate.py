"""Benchmark decontamination by latent semantic retrieval (operator 3).

Texts are split into words once for each block of items, and kept as the numbers of the block's terms. The passages
of all documents make a TF-IDF matrix over these terms. A randomised SVD of it is found in one pass: each task
multiplies its passages' part of A'A with the same random test matrix, the small products are summed, and the right
singular vectors follow from the sum (Nystroem's form). Candidates are all passages that hold enough of an item's
words in any order, without which they can't hold them in order: a text is asked for items by each item's rarest
words, of which it must have one, then as a whole, then passage by passage. Candidates are
then read word by word: the longest common subsequence with the item, and its rarest terms (its answer, where the
benchmark has such a column), must be there, so reworded copies are found and shared topics are not. Of passages that
share as much with an item, the one with the best cosine of the projections stands for the leak; no passage is
dropped for its cosine. Latent search adds to these: a passage that is as near to an item as ``COSINE`` and has its rarest
terms (or its answer) is read too, whatever words it lacks, and leaks with a smaller share in order, so that an item with
its clauses moved or half of its words changed is found.

A block has at most ``TERMS`` different terms, or a single item; its vocabulary and vectors are what is broadcast.
Statistics, singular vectors and search cover all passages of all documents, whole.

Defined results: words are runs of letters, digits and underscores, lower-cased; a null text is an empty one;
items of under ``LEAST`` words leak where they stand word for word, side by side; items without words never do; a
null item_id is an id of its own; repeated items and documents give their own rows; empty tables give no pairs;
other columns are not read, but an ``answer`` of the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, stored, tidy

#: Words in a passage of the matrix, in a block of the search, and in a part of a long item.
PASSAGE, BLOCK, PART = 64, 16, 64
RANK, OVERSAMPLE, SEED = 64, 16, 7
#: Bytes of text or of term numbers that are worked on at a time; rows of digests up to which they are broadcast.
SLICE, LONG, BROADCAST_ROWS = 256 << 10, 4 << 20, 300_000
TERMS, LEAST = 200_000, 5
#: Leaks: share of the item's words in order, and share of its rarest terms or of its answer.
COMMON, RAREST, ANSWER = 0.6, 8, 0.5
#: Latent candidates: the least cosine of a passage, and the least share in order of one that is so near.
COSINE, REWORDED = 0.35, 0.4
WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@dataclass
class Index:
    """One block of items; everything a task needs to search."""

    vocabulary: dict[str, int]
    vectors: np.ndarray  # terms x rank
    parts: list[tuple]  # (item number, word ids, unit projection, distinct ids of words and answer, how often the words have each, 1 for those of the answer)

    asked: tuple[np.ndarray, np.ndarray]  # for each term, where its parts begin and the parts that are asked for by it
    telling: tuple[np.ndarray, np.ndarray]  # the same of the terms that a part is told by

    def possible(self, ids: np.ndarray) -> np.ndarray:
        """Parts that a text may leak: it has enough of their words, in any order, to have them in order, or enough of the terms they are told by.

        These are bounds that lose nothing.
        """
        there = np.zeros(len(self.vocabulary) + 1, bool)
        there[ids] = True
        there[-1] = False
        terms = np.flatnonzero(there)

        def met(lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
            begin, parts = lists
            n = begin[terms + 1] - begin[terms]
            return parts[np.repeat(begin[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())]

        good = set()
        for k in np.unique(met(self.asked)).tolist():
            _, item, _, own, often, told = self.parts[k]
            have = there[own]
            if often @ have >= (COMMON if len(item) >= LEAST else 1.0) * len(item) - 1e-9 and told @ have >= ANSWER * told.sum():
                good.add(k)
        for k, n in zip(*np.unique(met(self.telling), return_counts=True)):
            if len(self.parts[k][1]) >= LEAST and n >= ANSWER * self.parts[k][5].sum():
                good.add(int(k))
        return np.array(sorted(good), np.int64)


def _asked(parts: list[tuple], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest terms of each part, as many as leave fewer of its words than a leak has."""
    pairs = []
    for k, (_, item, _, own, often, _) in enumerate(parts):
        mine = own[often > 0]
        rare = np.argsort(-idf[mine], kind="stable")
        left = len(item) - np.cumsum(often[often > 0][rare])
        least = COMMON if len(item) >= LEAST else 1.0
        pairs += [(int(t), k) for t in mine[rare[: 1 + int(np.argmax(left < least * len(item) - 1e-9))]]]
    return _by_term(pairs, len(idf))


def _telling(parts: list[tuple], terms: int) -> tuple[np.ndarray, np.ndarray]:
    return _by_term([(int(t), k) for k, (_, _, _, own, _, told) in enumerate(parts) for t in own[told > 0]], terms)


def _by_term(pairs: list[tuple[int, int]], terms: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(pairs[:, 0], np.arange(terms + 1)), pairs[:, 1]


def _ids(text: str, vocabulary: dict[str, int]) -> np.ndarray:
    """Numbers of the text's words; a long text's words are never held all at once."""
    get, lower = vocabulary.get, text.lower()
    if len(lower) > LONG:
        return np.fromiter((get(m[0], -1) for m in WORD.finditer(lower)), np.int32)
    return np.array([get(w, -1) for w in WORD.findall(lower)], np.int32)


def _entries(texts: list[np.ndarray], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sparse passages: passage number, term and count, sorted by passage; and the number of passages."""
    n = [-(-len(ids) // PASSAGE) for ids in texts]
    first = np.cumsum([0, *n])
    out = [np.empty(0, np.int64)]
    for ids, begin in zip(texts, first.tolist()):
        at = np.flatnonzero(ids >= 0)
        out.append((begin + at // PASSAGE) * terms + ids[at])
    key, count = np.unique(np.concatenate(out), return_counts=True)
    return key // max(1, terms), key % max(1, terms), count, int(first[-1])


def _slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[slice]:
    """Neighbouring rows of about ``most`` bytes, so that arrays over their words stay in a processor's cache."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    yield from (slice(a, b) for a, b in zip(np.r_[0, cut].tolist(), np.r_[cut, len(sizes)].tolist()) if b > a)


def _numbered(shared):
    """The texts as numbers of terms (int32, -1 for other words); a task's last row has its document frequencies."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value
        df, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for rows in _slices(batch["text"].str.len().to_numpy()):
                part = batch[rows]
                ids = [_ids(text, vocabulary) for text in part["text"]]
                _, term, _, n = _entries(ids, len(vocabulary))
                df += np.bincount(term, minlength=len(df))
                total += n
                yield pd.DataFrame({"name": part["name"].array, "ids": [x.tobytes() for x in ids], "df": None})
        at = np.flatnonzero(df)
        yield pd.DataFrame({"name": [None], "ids": [None], "df": [np.stack([np.r_[-1, at], np.r_[total, df[at]]]).tobytes()]})

    return run


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data in batch["df"]:
            term, df = np.frombuffer(data, np.int64).reshape(2, -1)
            yield pd.DataFrame({"term": term, "df": df})


def _random(terms: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((terms, RANK + OVERSAMPLE)).astype(np.float32)


def _products(shared):
    """Rows of A'(A Omega), summed over a task's passages; a passage's weights are counts * idf, of length 1."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf = shared.value
        omega = _random(len(idf))
        z = np.zeros(omega.shape, np.float64)
        for batch in batches:
            for rows in _slices(batch["ids"].str.len().to_numpy()):
                passage, term, count, n = _entries([np.frombuffer(x, np.int32) for x in batch["ids"][rows]], len(idf))
                if not len(term):
                    continue
                weight = (count * idf[term]).astype(np.float32)
                weight /= np.sqrt(np.bincount(passage, weight.astype(float) ** 2, n) + 1e-12)[passage].astype(np.float32)
                cut = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
                y = np.add.reduceat(omega[term] * weight[:, None], cut, axis=0)
                row = np.cumsum(np.r_[0, passage[1:] != passage[:-1]])
                order = np.argsort(term, kind="stable")
                new = np.flatnonzero(np.r_[True, np.diff(term[order]) > 0])
                z[term[order][new]] += np.add.reduceat(y[row[order]] * weight[order][:, None], new, axis=0)
        at = np.flatnonzero(np.abs(z).sum(1))
        if len(at):
            yield pd.DataFrame({"term": at, "z": pd.Series(list(z[at]), dtype=object)})

    return run


def singular_vectors(z: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """The leading eigenvectors of the matrix whose product with ``omega`` is ``z``, for a positive semi-definite matrix."""
    shift = np.sqrt(len(z)) * 1e-9 * max(np.linalg.norm(z), 1e-30)
    z = z + shift * omega
    core = omega.T @ z
    values, left = np.linalg.eigh((core + core.T) / 2)
    ok = values > values.max() * 1e-10
    u, _, _ = np.linalg.svd(z @ (left[:, ok] / np.sqrt(values[ok])), full_matrices=False)
    return u[:, :RANK]


def _split(items: list[tuple]) -> list[tuple]:
    """(number, words, words of the answer) of the parts of all items with words."""
    split = []
    for number, text, answer in items:
        if w := words(text or ""):
            n = max(1, round(len(w) / PART))
            split += [(number, list(x), words(answer or "")) for x in np.array_split(np.array(w, object), n)]
    return split


def numbered(docs: DataFrame, name: str, vocabulary: dict[str, int]) -> DataFrame:
    """``name`` as a string and the texts' term numbers, written once for statistics, products and search."""
    d = docs.select(F.col(name).cast("string").alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(d.mapInPandas(_numbered(docs.sparkSession.sparkContext.broadcast(vocabulary)), "name string, ids binary, df binary"), "leak-terms")


def _index(tokens: DataFrame, split: list[tuple], vocabulary: dict[str, int]) -> Index:
    spark = tokens.sparkSession
    counts = tokens.filter("df IS NOT NULL").select("df").mapInPandas(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 0.05
    rows = tokens.filter("ids IS NOT NULL").select("ids").mapInPandas(_products(spark.sparkContext.broadcast(idf)), "term long, z array<double>")
    summed = rows.select("term", F.posexplode("z")).groupBy("term", "pos").agg(F.sum("col").alias("z")).toArrow()
    z = np.zeros((len(vocabulary), RANK + OVERSAMPLE))
    z[summed["term"].to_numpy(), summed["pos"].to_numpy()] = summed["z"].to_numpy()
    vectors = singular_vectors(z, _random(len(vocabulary)).astype(float)) if np.abs(z).sum() else np.eye(len(vocabulary), min(RANK, len(vocabulary)))
    vectors = (idf[:, None] * vectors).astype(np.float32)

    parts = []
    for number, w, answer in split:
        ids = np.array([vocabulary[x] for x in w], np.int32)
        own, often = np.unique(ids, return_counts=True)
        told = np.unique([vocabulary[x] for x in answer]) if answer else own[np.argsort(-idf[own], kind="stable")[:RAREST]]
        terms = np.union1d(own, told)
        counts = np.zeros(len(terms), np.int64)
        counts[np.searchsorted(terms, own)] = often
        q = vectors[ids].sum(0)
        parts.append((number, ids, q / max(np.linalg.norm(q), 1e-12), terms, counts, np.isin(terms, told).astype(np.int64)))
    return Index(vocabulary, vectors, parts, _asked(parts, idf), _telling(parts, len(idf)))


def _vocabulary(split: list[tuple]) -> dict[str, int]:
    return {w: i for i, w in enumerate(sorted({w for _, x, a in split for w in (*x, *a)}))}


def build(docs: DataFrame, items: list[tuple]) -> Index | None:
    """Statistics and vectors for one block of (number, text, answer)."""
    if not (split := _split(items)):
        return None
    vocabulary = _vocabulary(split)
    return _index(numbered(docs, "text", vocabulary), split, vocabulary)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; ``a`` is a bit vector, each word of ``b`` one addition."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := where.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _side_by_side(item: np.ndarray, ids: np.ndarray) -> bool:
    last = len(ids) - len(item) + 1
    return last > 0 and bool(np.all([ids[k : k + last] == x for k, x in enumerate(item.tolist())], axis=0).any())


def _running_vectors(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Sums of the words' vectors up to each block's end, from none: a window's is a difference. Blocks are taken some at a time."""
    blocks = -(-len(ids) // BLOCK)
    sums = np.zeros((blocks + 1, vectors.shape[1]))
    for begin in range(0, blocks, 1024):
        part = ids[begin * BLOCK : (begin + 1024) * BLOCK]
        at = np.flatnonzero(part >= 0)
        if len(at):
            block = at // BLOCK
            cut = np.flatnonzero(np.r_[True, np.diff(block) > 0])
            sums[begin + block[cut] + 1] = np.add.reduceat(vectors[part[at]].astype(float), cut, axis=0)
    return np.cumsum(sums, axis=0)


def search(text: str, index: Index) -> list[tuple]:
    """(item number, share of common words, cosine) of the leaks in one text, the best of each item."""
    return search_ids(_ids(text, index.vocabulary), index)


def search_ids(ids: np.ndarray, index: Index) -> list[tuple]:
    blocks = -(-len(ids) // BLOCK)
    slot = sums = None
    best: dict[int, tuple[float, float]] = {}
    for part in index.possible(ids).tolist():
        number, item, unit, terms, counts, told = index.parts[part]
        if len(item) < LEAST:
            if _side_by_side(item, ids):
                best[number] = max((1.0, 1.0), best.get(number, (1.0, 1.0)))
            continue
        if slot is None:
            slot = np.full(len(index.vocabulary) + 1, -1, np.int32)
        n = -(-len(item) // BLOCK) + 1
        first = np.arange(max(1, blocks - n + 1))
        last = np.minimum(first + n, blocks)
        slot[terms] = np.arange(len(terms))
        place = slot[ids]
        slot[terms] = -1
        at = np.flatnonzero(place >= 0)
        there = np.zeros((len(terms), blocks + 1), np.int32)
        there[place[at], at // BLOCK + 1] = 1
        there = np.cumsum(there, axis=1)
        present = there[:, last] > there[:, first]
        if sums is None:
            sums = _running_vectors(ids, index.vectors)
        near = sums[last] - sums[first]
        cosine = near @ unit / np.maximum(np.linalg.norm(near, axis=1), 1e-12)
        latent = cosine >= COSINE
        for i in np.flatnonzero(((counts @ present / len(item) >= COMMON) | latent) & (told @ present / told.sum() >= ANSWER)).tolist():
            window = ids[first[i] * BLOCK : last[i] * BLOCK]
            share = common_subsequence(item, window) / len(item)
            if share >= (REWORDED if latent[i] else COMMON) and share >= best.get(number, (0.0, 0.0))[0]:
                found = (share, float(cosine[i]))
                best[number] = max(found, best.get(number, found))
    return [(number, *x) for number, x in best.items()]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[tuple], dict[str, int]]]:
    """Item ids, parts and vocabulary of each block of items; iterated, not collected."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    ids, parts, terms = [], [], set()
    for item_id, text, told in benchmark.select("item_id", F.col("text"), answer.alias("answer")).toLocalIterator():
        more = _split([(len(ids), text, told)])
        new = {w for _, x, a in more for w in (*x, *a)}
        if parts and len(terms | new) > TERMS:
            yield ids, parts, _vocabulary(parts)
            ids, parts, terms = [], [], set()
            more = [(0, x, a) for _, x, a in more]
        ids.append(item_id)
        parts += more
        terms |= new
    if parts:
        yield ids, parts, _vocabulary(parts)


def _found(docs: DataFrame, name: str, benchmark: DataFrame) -> Iterator[DataFrame]:
    """name, item_id, common and cosine, written, for each block of items."""
    spark = docs.sparkSession
    for names, split, vocabulary in _blocks(benchmark):
        with tidy(spark) as keep:
            tokens = numbered(docs, name, vocabulary)
            shared = spark.sparkContext.broadcast(_index(tokens, split, vocabulary))

            @lean
            def run(batches: Iterator[pd.DataFrame], names=names, shared=shared) -> Iterator[pd.DataFrame]:
                index = shared.value
                for batch in batches:
                    hits = [(who, names[n], round(share, 6), round(cosine, 4)) for who, x in zip(batch["name"], batch["ids"]) for n, share, cosine in search_ids(np.frombuffer(x, np.int32), index)]
                    out = pd.DataFrame(hits, columns=["name", "item_id", "common", "cosine"])
                    yield out.astype({"name": object, "item_id": "Int64", "common": float, "cosine": float})

            texts = tokens.filter("ids IS NOT NULL").select("name", "ids")
            found = keep(stored(texts.mapInPandas(run, "name string, item_id long, common double, cosine double"), "leaks"))
        yield found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``common`` and ``cosine``: a row for each document and item it leaks."""
    d = docs.select(F.col(id_col).cast("long").alias("name"), F.col(text_col).alias("text"))
    found = [docs.sparkSession.createDataFrame([], "name string, item_id long, common double, cosine double"), *_found(d, "name", benchmark)]
    out = reduce(DataFrame.unionByName, found[1:] or found)
    return out.select(F.col("name").cast("long").alias("doc_id"), "item_id", "common", "cosine")


def clean(docs: DataFrame, benchmark: DataFrame, columns: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak, with ``columns``: what leaks is told by the text's digest."""
    d = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("name"), F.col(text_col).alias("text"))
    kept = docs.select(*columns)
    for found in _found(d, "name", benchmark):
        gone = stored(found.select(F.col("name").alias("__name")).distinct(), "leaking")
        small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        kept = kept.join(F.broadcast(gone) if small else gone, F.md5(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__name"), "left_anti")
    return kept
