"""Near-duplicates by ProbMinHash, banding and verification (operator 1).

Texts are sets of five-word shingles, weighted by 1 + ln(count). Each shingle's arrivals form a Poisson process
whose rate is its weight; a register keeps the shingle that arrives in it first, and a shingle stops as soon as
it is later than all registers. Two texts agree in a register with the probability Jaccard of their weights.
Bands of registers give buckets; links are verified by the exact Jaccard of the shingle sets, at 0.8 or more,
and the classes are the components of the verified links. A text that repeats shingles also gets the bands of
weights of 1, as its links are judged by the sets: so no link is missed for a line that one side repeats.

A bucket is never expanded into pairs. Its members are compared with a hub first, and what that connects is done
with. Members of one hub that are still in different components are described by their differences to the hub.
Two members' distance is that of their differences, so a link needs a number of differences in common, and two
linked members share one of their rarest differences, at places that leave room for the rest (prefix filter).
Where a difference is shared by many, its holders are first compared with one of them, as long as that connects
some. What is compared last are holders of the same rare difference in different components. Every pair of a
bucket is so verified, connected, or proven to be too far apart. Hot hubs and buckets are salted.

Defined results: words are split at white space and lower-cased; a text of one to four words is one shingle;
texts without words are copies of each other; a null text is an empty one; a class is named by its smallest
doc_id (null counts as largest); repeated rows are copies; an empty table gives an empty result; other columns
of the input are not read. Copies are settled by a digest and take no part in the above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lean, stored, tidy

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of 16-byte digests up to which a table is broadcast.
BROADCAST_ROWS = 300_000
#: Rows of a key beyond which a join deals them to SALTS tasks.
HOT, SALTS = 512, 32
#: Members of a hub up to which all their pairs are compared: at most FEW / 2 for each member.
FEW = 16
#: Pairs for each holder of a difference beyond which its holders are compared with one of them first.
CROWDED = 4
#: Bytes and rows that Python works on at a time.
SLICE, SLICE_ROWS = 512 << 10, 1024
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if len(_POWERS[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[k] = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])
    return _POWERS


def shingles(texts) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit shingle hash of every shingle; the texts' words are split by single blanks."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(x + b" " for x in raw), np.uint8)
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    power, inverse = (p[: len(data) + 1] for p in _powers(len(data) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * power[:-1])])
    stop = np.flatnonzero(data == 32)
    start = np.r_[0, stop[:-1] + 1]
    word = _mixed((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum([len(x) + 1 for x in raw])
    text = np.searchsorted(ends, stop, "right")
    real = stop > start
    word, text = word[real], text[real]
    n = np.bincount(text, minlength=len(raw))
    factors = [_mixed(np.array([i + 1], np.uint64))[0] | _U(1) for i in range(SHINGLE)]
    padded = np.concatenate([word, np.zeros(SHINGLE, np.uint64)])
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = np.arange(len(word)) - first[text]
    size = np.minimum(n[text], SHINGLE)
    take = place + size <= n[text]
    take &= (n[text] >= SHINGLE) | (place == 0)
    at, size = np.flatnonzero(take), size[take]
    h = np.zeros(len(at), np.uint64)
    for i in range(SHINGLE):
        h += np.where(i < size, padded[at + i] * factors[i], _U(0))
    return text[at], _mixed(h)


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of about SLICE characters that share SHINGLE - 1 words, so that each shingle is in one part."""
    at = 0
    while len(text) - at > 2 * SLICE and (cut := text.find(" ", at + SLICE)) >= 0:
        back = cut
        for _ in range(SHINGLE - 1):
            back = text.rfind(" ", at, back)
            if back < 0:
                break
        yield text[at:cut]
        at = max(at, back + 1)
    yield text[at:]


def _counted(text: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, text))
    text, h, n = text[order], h[order], n[order]
    at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.empty(0, np.int64)
    return text[at], h[at], np.add.reduceat(n, at) if len(at) else n


def weighted(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and count, by text and then shingle."""
    found, texts = [], list(texts)
    for k, t in enumerate(texts):
        if len(t) > 2 * SLICE:
            many = (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
            for part in _parts(t):
                _, h = shingles([part])
                many = _counted(*(np.concatenate(x) for x in zip(many, (np.zeros(len(h), np.int64), h, np.ones(len(h), np.int64)))))
            found.append((many[0] + k, *many[1:]))
            texts[k] = ""
    text, h = shingles(texts)
    found.append((text, h, np.ones(len(h), np.int64)))
    return _counted(*(np.concatenate(x) for x in zip(*found)))


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x REGISTERS winners; rows without shingles are zero."""
    first = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    time, step = np.zeros(len(h)), 0
    while len(h):
        step += 1
        u = _mixed(h + _U(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        time = time - np.log1p(-((u >> _U(11)).astype(np.float64) * 2.0**-53)) / weight
        register = text * REGISTERS + (_mixed(u + _U(1)) % _U(REGISTERS)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        winner[register[won]] = h[won]
        goes_on = time < first.reshape(n, REGISTERS).max(1)[text]
        text, h, weight, time = text[goes_on], h[goes_on], weight[goes_on], time[goes_on]
    return winner.reshape(n, REGISTERS)


def band_hashes(winner: np.ndarray) -> np.ndarray:
    parts = winner.reshape(len(winner), BANDS, ROWS)
    h = np.zeros(parts.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        h = _mixed(h * _U(31) + parts[:, :, i])
    return h.view(np.int64)


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in groups of about SLICE characters and at most SLICE_ROWS rows."""
    rows = np.arange(len(batch)) // SLICE_ROWS
    size = (batch["words"].str.len().cumsum() // SLICE).to_numpy()
    yield from (g for _, g in batch.groupby([rows, size], sort=False))


@lean
def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in _slices(batch):
            text, h, count = weighted(part["words"])
            n = np.bincount(text, minlength=len(part))
            bands = list(band_hashes(signatures(text, h, 1 + np.log(count), len(part))))
            again = np.bincount(text, count > 1, len(part)) > 0
            if again.any():
                number, some = np.cumsum(again) - 1, again[text]
                sets = band_hashes(signatures(number[text[some]], h[some], np.ones(int(some.sum())), int(again.sum())))
                for i, more in zip(np.flatnonzero(again), sets):
                    bands[i] = np.concatenate([bands[i], more])
            yield pd.DataFrame({"key": part["key"].array, "n": n, "bands": bands})[n > 0]


@lean
def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in _slices(batch):
            text, h, _ = weighted(part["words"])
            cut = np.searchsorted(text, np.arange(1, len(part)))
            yield pd.DataFrame({"key": part["key"].array, "shingles": np.split(h.view(np.int64), cut)})


def normal(text: Column) -> Column:
    """Lower-cased words with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast where the counted size allows, else left to a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hot(rows: DataFrame, key: str) -> DataFrame | None:
    hot = stored(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT).select(key, F.lit(True).alias("__hot")), "near-hot")
    return None if hot.isEmpty() else hot


def _spread(many: DataFrame, one: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one`` by ``key``; the rows of a hot key in ``many`` are dealt to SALTS tasks by ``by``."""
    if hot is None:
        return many.join(one, key, how)
    zero = F.lit(0).cast("long")
    left = many.join(_few(hot), key, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(zero)).drop("__hot")
    salts = F.when(F.col("__hot"), F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero))
    right = one.join(_few(hot), key, "left").withColumn("__salt", F.explode(salts)).drop("__hot")
    return left.join(right, [key, "__salt"], how).drop("__salt")


def _looked_up(many: DataFrame, one: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """A join with a narrow table that has a row for each key: broadcast where its counted size allows, else salted."""
    if one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(one), key, how)
    return _spread(many, one, key, by, _hot(many, key), how)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sets x and y; ``a`` may be the hub of many."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    return _spread(pairs.join(two, "b"), one, "a", "b", _hot(pairs, "a"))


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``n`` (size of b's set), ``d`` (size of the symmetric difference) and whether they are ``alike``."""
    shared, n, m = F.size(F.array_intersect("x", "y")), F.size("y"), F.size("x")
    p = _with_sets(pairs, sets).select(*pairs.columns, n.alias("n"), (n + m).alias("t"), shared.alias("s"))
    return p.select(*pairs.columns, "n", (F.col("t") - 2 * F.col("s")).alias("d"), (F.col("s") >= SIMILAR * (F.col("t") - F.col("s")) - 1e-9).alias("alike"))


def components(links: DataFrame) -> DataFrame:
    """key, comp: the smallest key that is reachable, for every key that has a link.

    Each round takes the least label of the neighbours, then the label of that label, and is written out.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    label = stored(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("comp")), "near-label")
    while True:
        seen = _looked_up(both, label.select(F.col("key").alias("b"), F.col("comp").alias("c")), "b", "a").groupBy(F.col("a").alias("key")).agg(F.min("c").alias("c"))
        near = label.join(seen, "key").select("key", "comp", F.least("comp", "c").alias("new"))
        jump = _looked_up(near, label.select(F.col("key").alias("new"), F.col("comp").alias("far")), "new", "key").select("key", "comp", F.least("new", "far").alias("next"))
        step = stored(jump, "near-step")
        label = step.select("key", F.col("next").alias("comp"))
        if step.filter("next != comp").isEmpty():
            return label


def _named(rows: DataFrame, comps: DataFrame, key: str, comp: str) -> DataFrame:
    """The rows with the component of ``key``, which is its own where it has no link."""
    c = comps.select(F.col("key").alias(key), F.col("comp").alias("__c"))
    return rows.join(_few(c), key, "left").withColumn(comp, F.coalesce("__c", key)).drop("__c")


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only their labels are connected, and every key follows its label."""
    ends = _named(_named(links, comps, "a", "p"), comps, "b", "q").filter("p != q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    ends = stored(ends.distinct(), "near-ends")
    if ends.isEmpty():
        return comps
    label = components(ends)
    moved = _looked_up(comps, label.select(F.col("key").alias("comp"), F.col("comp").alias("to")), "comp", "key", "left").select("key", F.coalesce("to", "comp").alias("comp"))
    return stored(moved.unionByName(label.join(comps, "key", "left_anti")), "near-comps")


def _limit(n: Column, m: Column) -> Column:
    """The largest symmetric difference that alike sets of n and m shingles have."""
    return F.floor((n + m) * (1 - SIMILAR) / (1 + SIMILAR) + 1e-9)


def _open_to(x: str, y: str) -> Column:
    """Whether two members of a hub, aliased x and y, may be alike and are not connected: by sizes, and by the triangle inequality."""
    c = lambda side, name: F.col(f"{side}.{name}")
    return (c(x, "comp") != c(y, "comp")) & (F.abs(c(x, "n") - c(y, "n")) <= _limit(c(x, "n"), c(y, "n"))) & (F.abs(c(x, "d") - c(y, "d")) <= _limit(c(x, "n"), c(y, "n")))


def _room() -> Column:
    """Whether the differences from here on, to the hub of x and y, are enough for the number that alike members share."""
    shared = (F.col("x.d") + F.col("y.d") - _limit(F.col("x.n"), F.col("y.n"))) / 2
    return (F.col("x.d") - F.col("x.i") >= shared) & (F.col("y.d") - F.col("y.i") >= shared)


def _prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, elem, key, comp, n, d, i): the i-th rarest of the d differences of a member to its hub, up to its prefix.

    A difference that members of a single component have can't be part of a link between two; it counts as rarest.
    """
    two = _with_sets(members.select(F.col("hub").alias("a"), F.col("key").alias("b"), "comp"), sets)
    diff = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    d = two.select(F.col("a").alias("hub"), F.col("b").alias("key"), "comp", F.size("y").alias("n"), F.transform(diff, lambda e: F.xxhash64("a", e)).alias("diff"))
    d = stored(d.withColumn("member", F.xxhash64("hub", "key")), "near-diffs")
    each = d.select("member", F.xxhash64("comp").alias("c"), F.explode("diff").alias("elem"))
    often = each.groupBy("elem").agg(F.count(F.lit(1)).alias("often"), F.min("c").alias("p"), F.max("c").alias("q")).filter("p != q").select("elem", "often")
    often = stored(often, "near-often")
    hot = stored(often.filter(F.col("often") > HOT).select("elem", F.lit(True).alias("__hot")), "near-hot")
    ranked = _spread(each.select("member", "elem"), often, "elem", "member", None if hot.isEmpty() else hot)
    shared = ranked.groupBy("member").agg(F.sort_array(F.collect_list(F.struct("often", "elem"))).alias("e"))
    told = d.select("hub", "key", "comp", "n", F.size("diff").alias("d"), "member").join(shared, "member")
    # Those that one component has come first, so the shared ones start at d - size(e). No alike member is larger than n / SIMILAR.
    told = told.withColumn("first", F.col("d") - F.size("e")).withColumn("e", F.slice("e", 1, F.greatest(F.lit(0), _limit(F.col("n"), F.col("n") / SIMILAR) + 1 - F.col("first")).cast("int")))
    told = told.select("hub", "key", "comp", "n", "d", "first", F.posexplode("e").alias("k", "z"))
    return stored(told.select("hub", F.col("z.elem").alias("elem"), "key", "comp", "n", "d", (F.col("first") + F.col("k")).alias("i")), "near-prefixes")


def _still_open(rows: DataFrame, by: str) -> DataFrame:
    """The rows of groups that have members in several components."""
    opened = rows.groupBy(by).agg(F.min("comp").alias("__p"), F.max("comp").alias("__q"), F.count(F.lit(1)).alias("size")).filter("__p != __q").select(by, "size")
    return _looked_up(rows, stored(opened, "near-opened"), by, "key")


def _pairs(rows: DataFrame, by: str, room: Column, hot: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of a group that may be alike and are not connected."""
    x, y = rows.alias("x"), rows.alias("y")
    ok = (F.col("x.key") < F.col("y.key")) & _open_to("x", "y") & room
    if hot is None:
        return x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & ok).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    zero = F.lit(0).cast("long")
    known = rows.join(_few(hot), by, "left")
    x = known.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(zero)).alias("x")
    y = known.withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(zero, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(zero)))).alias("y")
    return x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col("x.__salt") == F.col("y.__salt")) & ok).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()


def _crowds(hubs: DataFrame, sets: DataFrame, comps: DataFrame) -> DataFrame:
    """The components when all pairs of members of hubs with more than ``FEW`` members are settled."""
    posted = _prefixes(hubs, sets)
    turn, pays = 0, True
    while True:
        posted = stored(_still_open(_named(posted.drop("comp", "size"), comps, "key", "comp"), "elem"), "near-posted")
        work = posted.select(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("pairs")).first()
        if not work["rows"]:
            return comps
        if not pays or work["pairs"] <= CROWDED * work["rows"]:
            break
        # Each holder of a difference with one of them, another one in each turn, as long as a tenth is found alike.
        turn += 1
        head = posted.groupBy("elem").agg(F.min_by(F.struct("key", "comp", "n", "d", "i"), F.xxhash64("key", F.lit(turn))).alias("x"))
        y = _looked_up(posted.drop("size"), head, "elem", "key").alias("y")
        to_head = y.select(F.struct(*[F.col(f"y.{c}") for c in ("key", "comp", "n", "d", "i")]).alias("y"), F.col("x")).filter(_open_to("x", "y") & _room())
        to_head = stored(to_head.select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct(), "near-heads")
        links = stored(_measured(to_head, sets).filter("alike").select("a", "b"), "near-links")
        pays = 10 * links.count() >= max(1, to_head.count())
        comps = merged(comps, links)
    hot = stored(posted.filter(F.col("size") > HOT).select("elem", F.lit(True).alias("__hot")).distinct(), "near-hot")
    rest = stored(_pairs(posted, "elem", _room(), None if hot.isEmpty() else hot), "near-more")
    return comps if rest.isEmpty() else merged(comps, stored(_measured(rest, sets).filter("alike").select("a", "b"), "near-links"))


def _grouped(words: DataFrame) -> DataFrame:
    """key, class_id, lead, first, n of every text that has a copy or shared a bucket: ``words`` has doc_id, key and words.

    ``first`` is the smallest doc_id of the text, ``n`` how many rows have it; ``lead`` is the class's text with the
    smallest first.
    """
    ids = stored(words.select("doc_id", "key"), "near-ids")
    copied = ids.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = stored(copied.select("key", "first"), "near-copies")
    own = words.join(_few(copied), "key", "left").filter("first IS NULL OR first = doc_id").select("key", "words")
    signed = stored(own.mapInPandas(_sign, "key binary, n long, bands array<bigint>"), "near-bands")

    members = signed.select("key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter("hub != last").select("bucket", "hub")
    shared = stored(shared, "near-buckets")
    pairs = stored(_looked_up(members, shared, "bucket", "key").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "near-pairs")
    wanted = stored(pairs.select(F.col("b").alias("key")).distinct(), "near-wanted")
    sets = stored(own.join(_few(wanted), "key", "left_semi").mapInPandas(_sets, "key binary, shingles array<bigint>").dropDuplicates(["key"]), "near-sets")

    # Each member with the hub of each of its buckets.
    hubs = stored(_measured(pairs.filter("a != b"), sets), "near-hubs")
    comps = stored(components(hubs.filter("alike")), "near-comps")
    # The other pairs of a hub's members, where they are not in one component yet.
    opened = _still_open(_named(hubs.select(F.col("a").alias("hub"), F.col("b").alias("key"), "n", "d"), comps, "key", "comp"), "hub")
    opened = stored(opened, "near-open")
    few = stored(_pairs(opened.filter(F.col("size") <= FEW).drop("size"), "hub", F.lit(True), None), "near-few")
    if not few.isEmpty():
        comps = merged(comps, stored(_measured(few, sets).filter("alike").select("a", "b"), "near-links"))
    crowded = opened.filter(F.col("size") > FEW)
    if not crowded.isEmpty():
        comps = _crowds(stored(_still_open(_named(crowded.drop("comp", "size"), comps, "key", "comp"), "hub").select("hub", "key", "comp"), "near-crowded"), sets, comps)

    # Class names: the smallest doc_id of all copies of all members.
    some = ids.join(_few(wanted.unionByName(copied.select("key")).distinct()), "key", "left_semi").groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    firsts = some.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("f"))
    firsts = _named(firsts.select("key", F.col("f.none").alias("none"), F.col("f.doc_id").alias("first"), F.col("f.n").alias("n")), comps, "key", "comp")
    firsts = stored(firsts, "near-firsts")
    name = firsts.groupBy("comp").agg(F.min(F.struct("none", "first", "key")).alias("f")).select("comp", F.col("f.first").alias("class_id"), F.col("f.key").alias("lead"))
    return stored(_looked_up(firsts, stored(name, "near-names"), "comp", "key").select("key", "class_id", "lead", "first", "n"), "near-named")


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), normal(F.col(text_col)).alias("words")).withColumn("key", F.unhex(F.md5("words")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``class_id`` of every row of ``docs``; the plan's steps are written to the shared folder."""
    words = _words(docs, id_col, text_col)
    with tidy(docs.sparkSession) as keep:
        named = keep(_grouped(words)).select("key", "class_id", F.lit(True).alias("found"))
    return words.select("doc_id", "key").join(_few(named), "key", "left").select("doc_id", F.when(F.col("found"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def one_of_each(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class one row, with ``columns``: the smallest doc_id (null counts as largest), of repeated rows any.

    What goes is told by id and text, so a row with another text under the same id is judged by its own class.
    """
    with tidy(docs.sparkSession) as keep:
        named = keep(_grouped(_words(docs, id_col, text_col)))
    named = named.select(F.col("key").alias("__key"), (F.col("key") == F.col("lead")).alias("__lead"), F.col("first").alias("__first"), F.col("n").alias("__n"))
    rows = docs.select(*columns).withColumn("__key", F.unhex(F.md5(normal(F.col(text_col))))).join(_few(named), "__key", "left")
    kept = rows.filter(F.col("__lead").isNull() | (F.col("__lead") & F.col(id_col).cast("long").eqNullSafe(F.col("__first"))))
    once, again = kept.filter(F.coalesce("__n", F.lit(1)) == 1), kept.filter(F.col("__n") > 1)
    if not named.filter("__lead AND __n > 1").isEmpty():
        once = once.unionByName(again.dropDuplicates(["__key"]))
    return once.select(*columns)
