"""Repeated 50-byte strings by bucket-pointer refinement (operator 8).

Sorting every suffix of a corpus costs many times its size in shuffles, so the suffixes are thinned first by a
rule that loses nothing: of the ``GRAM``-grams in any ``LENGTH``-byte string the one with the least hash is an
anchor, and equal strings have equal anchors at equal places. Then

1. anchors are counted by hash, in buckets; hashes found in one document only are done with; an anchor is sent as 4 bytes
   and its document's number in its slice of text, so what is sent doesn't grow with the number of buckets;
2. documents with other anchors emit the bytes around each, once for each task and context, with the smallest document
   that has it: all strings whose first least gram it is lie in there, so each string goes to one anchor only; around
   hot anchors, found in very many slices of text, contexts differ at a passage's ends for every document, so there
   each string goes to a bucket of its own;
3. around each anchor, 8-gram buckets are refined by sorting on pairs of bucket identifiers, a position's own and
   that of a later offset, to 16, 32 and 50 bytes, each time with the identifiers of the time before; the
   smallest document of each final bucket tells every other one what to remove.

Whole copies are settled before, by a digest. Hot passages reach a bucket once for each task, not once for each
document. Nothing is sampled or capped; hashes only ever add work, as all is compared by its bytes in step 3.

Defined results: a null text is an empty one; a null doc_id counts as larger than any other; rows with one
doc_id are never each other's original; texts under 50 bytes keep all; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_path, lean, release, stored

LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM
CONTEXT = GRAM + 2 * SIDE
#: Text bytes for each bucket: bounds what a task of steps 1 and 3 holds.
BUCKET_BYTES = 48 << 20
#: Bytes of text whose grams are hashed at a time (40 bytes of arrays for each), and characters whose anchors are held at a time.
LOT, SLICE = 1 << 20, 4 << 20
#: Rows of the table of copied texts up to which it is broadcast (30 bytes a row).
BROADCAST_ROWS = 200_000
LAST = (1 << 63) - 1
#: Kinds of rows: entries to be looked at, what is settled and goes back, single strings of hot anchors, and their hashes.
OPEN, SETTLED, STRINGS, HOT = range(4)
#: Kinds whose entries are bytes of texts, which are sent compressed.
TEXTS = OPEN, STRINGS
ROWS = "bucket int, kind int, ids binary, tids binary, counts binary, data binary"
#: Rows of step 1, of one slice of text: its name, its documents (only in the row of what is settled), and each entry's number among them.
SLICES = "bucket int, kind int, slice binary, ids binary, tids binary, docs binary, data binary"
#: Slices of text in which an anchor is found, beyond which it is hot; and the most that are treated so, as they are sent to all tasks.
HOT_SLICES, HOT_MOST = 256, 1 << 20
FOUND = "ord long, tid long, data binary"
#: The same of step 1; a row with ``hot`` has no document but hot anchors. A mark, as a filter of ord would also be put on one side of a join of texts.
ANCHORS = FOUND + ", hot boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _running(best, x: np.ndarray, width: int) -> np.ndarray:
    """best (minimum or maximum) of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and 64-bit hashes of the anchors in ``data``, which holds documents back to back, and the order of all grams."""
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32)
    eight = _mixed(np.ndarray(n - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).copy())
    grams = n - GRAM + 1
    h = _mixed(eight[:grams] + eight[8 : grams + 8] * np.uint64(3) + eight[16 : grams + 16] * np.uint64(5))
    order = (h >> np.uint64(33)).astype(np.int32)
    least = _running(np.minimum, order, SIDE + 1)
    # A string that would cross a document's end is none.
    inside = np.zeros(len(least) + 1, np.int32)
    whole = ends - starts >= LENGTH
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, ends[whole] - LENGTH + 1, -1)
    least = np.where(np.cumsum(inside[:-1]) > 0, least, np.int32(-1))
    padded = np.full(grams + SIDE, -1, np.int32)
    padded[SIDE : SIDE + len(least)] = least
    at = np.flatnonzero(_running(np.maximum, padded, SIDE + 1)[:grams] == order)
    return at, h[at], order


def _reach(at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes before and after each anchor the strings go whose first least gram it is; SIDE at most."""
    edge = np.full(SIDE, np.iinfo(np.int32).max, np.int32)
    near = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, order, edge]), 2 * SIDE + 1)
    left, right = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for k in range(0, len(at), 1 << 16):
        some = near[at[k : k + (1 << 16)]]
        own = some[:, SIDE : SIDE + 1]
        for out, ends in ((left, some[:, SIDE - 1 :: -1] <= own), (right, some[:, SIDE + 1 :] < own)):
            out[k : k + (1 << 16)] = np.where(ends.any(axis=1), ends.argmax(axis=1), SIDE)
    return left, right


def _lots(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' bytes in lots of about LOT bytes: data, where each piece starts and ends, its row, its offset there.

    A long row is cut into pieces that overlap by LENGTH - 1 bytes, so that each string of LENGTH bytes is in one piece.
    """
    pieces, size = [], 0

    def lot():
        ends = np.cumsum([len(p) for _, _, p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        return data, np.r_[0, ends[:-1]].astype(np.int64), ends, np.array([r for r, _, _ in pieces], np.int64), np.array([a for _, a, _ in pieces], np.int64)

    for row, text in enumerate(texts):
        raw = text.encode()
        for a in range(0, max(1, len(raw) - LENGTH + 1), LOT):
            pieces.append((row, a, raw[a : a + LOT + LENGTH - 1]))
            size += len(pieces[-1][2])
            if size >= LOT:
                yield lot()
                pieces, size = [], 0
    if pieces:
        yield lot()


def _slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of a batch in groups of about SLICE characters, so that what is held of them stays small."""
    group = batch["text"].str.len().cumsum() // SLICE
    yield from (g for _, g in batch.groupby(group.to_numpy(), sort=False))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _packed(bucket: int, kind: int, doc: np.ndarray, ids: np.ndarray, tids: np.ndarray, data: np.ndarray) -> tuple:
    """A row: the documents, how many entries each has, and the entries; ``doc`` is sorted."""
    own, counts = np.unique(doc, return_counts=True)
    sent = pa.compress(data.tobytes(), "zstd", asbytes=True) if kind in TEXTS else data.tobytes()
    return bucket, kind, ids[own].tobytes(), tids[own].tobytes(), counts.astype(np.int32).tobytes(), sent


def _unpacked(rows: pd.DataFrame, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number of each entry, entries, and (ord, tid) by document number."""
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, dtype), np.empty((0, 2), np.int64)
    ids, tids = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("ids", "tids"))
    counts = np.frombuffer(b"".join(rows["counts"]), np.int32)
    size = [int(np.frombuffer(c, np.int32).sum()) * np.dtype(dtype).itemsize for c in rows["counts"]]
    data = (pa.decompress(d, n, "zstd", asbytes=True) if kind in TEXTS else d for d, n, kind in zip(rows["data"], size, rows["kind"]))
    return np.repeat(np.arange(len(ids)), counts), np.frombuffer(b"".join(data), dtype), np.stack([ids, tids], 1)


def _columns(shape: str) -> list[str]:
    return [c.split()[0] for c in shape.split(", ")]


def _numbers(doc: np.ndarray) -> bytes:
    """Ascending document numbers as the steps between them, in as few bytes each as the largest needs."""
    steps = np.diff(doc, prepend=0)
    return steps.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if steps.max(initial=0) <= np.iinfo(t).max)).tobytes()


def _numbered(docs: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(docs, f"u{len(docs) // n}" if n else np.uint8), dtype=np.int64)


def _emit_anchors(buckets: int):
    """Step 1, map side: anchor hashes by bucket; those in several documents of a slice go once, their documents are settled."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch):
                ids, tids = part["ord"].to_numpy(np.int64), part["tid"].to_numpy(np.int64)
                # Slices of one name have the same documents, so their entries may meet.
                name = hashlib.blake2b(ids.tobytes() + tids.tobytes(), digest_size=16).digest()
                found = []
                for data, starts, ends, row, _ in _lots(part["text"]):
                    at, h, _ = anchors(data, starts, ends)
                    found.append((row[np.searchsorted(ends, at, "right")], h))
                doc, h = (np.concatenate(x) for x in zip(*found))
                bucket, short = _bucket(h, buckets), h.astype(np.uint32)
                order = np.lexsort((doc, h))
                hs, ds = h[order], doc[order]
                new = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.empty(0, bool)
                group = np.cumsum(new) - 1
                first = ds[np.flatnonzero(new)]
                shared = np.zeros(len(first), bool)
                np.logical_or.at(shared, group, ds != first[group])
                rows = []
                keep = order[~shared[group] | new]
                keep = keep[np.lexsort((doc[keep], bucket[keep]))]
                for b, piece in _runs(bucket[keep], keep):
                    rows.append((b, OPEN, name, b"", b"", _numbers(doc[piece]), short[piece].tobytes()))
                known = np.sort(order[shared[group]])
                rows.append((_home(name, buckets), SETTLED, name, ids.tobytes(), tids.tobytes(), _numbers(doc[known]), short[known].tobytes()))
                yield pd.DataFrame(rows, columns=_columns(SLICES))

    return run


def _home(name: bytes, groups: int) -> int:
    """Where all that is known of a slice's documents meets."""
    return int.from_bytes(name[:8], "little") % groups


def _runs(sorted_keys: np.ndarray, values: np.ndarray):
    if len(sorted_keys):
        cut = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1], True])
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(sorted_keys[a]), values[a:b]


def _to_owners(doc: np.ndarray, data: np.ndarray, who: np.ndarray, groups: int) -> pd.DataFrame:
    """Entries on their way back to their documents: a row for each group of documents, not for each document."""
    group = who[doc, 1] % groups
    order = np.lexsort((doc, group))
    rows = [_packed(g, SETTLED, doc[piece], who[:, 0], who[:, 1], data[piece]) for g, piece in _runs(group[order], order)]
    return pd.DataFrame(rows, columns=_columns(ROWS))


def _by_document(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 3, one group of documents: for each, all spans that came back."""
    doc, data, who = _unpacked(rows, SPAN)
    keys, own = np.unique(who, axis=0, return_inverse=True)
    doc = own.ravel()[doc]
    order = np.argsort(doc, kind="stable")
    out = [(keys[d, 0], keys[d, 1], data[piece].tobytes()) for d, piece in _runs(doc[order], order)]
    return pd.DataFrame(out, columns=["ord", "tid", "data"]).astype({"ord": "int64", "tid": "int64"})


def _repeated_anchors(rows: pd.DataFrame, buckets: int, hot_slices: int) -> pd.DataFrame:
    """Step 1, one bucket: for each slice, its anchor hashes that another document has, and whose; and which of them are hot."""
    open_rows = rows[rows["kind"] == OPEN]
    sizes = [len(x) // 4 for x in open_rows["data"]]
    h = np.frombuffer(b"".join(open_rows["data"]), np.uint32)
    slices = np.repeat(np.arange(len(open_rows)), sizes)
    doc = np.concatenate([*[_numbered(d, n) for d, n in zip(open_rows["docs"], sizes)], np.empty(0, np.int64)])
    order = np.argsort(h, kind="stable")
    hs, ds = h[order], (slices << 32 | doc)[order]
    new = np.r_[True, hs[1:] != hs[:-1]] if len(hs) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    shared = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    np.logical_or.at(shared, group, ds != ds[np.flatnonzero(new)][group])
    # Entries lie by slice, and by document in each.
    open_ = np.sort(order[shared[group]])
    # An anchor that is shared within a slice came once from it, and else once from each of its documents there.
    both = np.unique(h[open_].astype(np.uint64) << np.uint64(32) | slices[open_].astype(np.uint64)) >> np.uint64(32)
    known, often = np.unique(both, return_counts=True)
    hot = np.stack([known[often > hot_slices], often[often > hot_slices].astype(np.uint64)], axis=1).astype(np.uint32)
    names = open_rows["slice"].to_list()
    told = [(_home(names[i], buckets), OPEN, names[i], b"", b"", _numbers(doc[piece]), h[piece].tobytes()) for i, piece in _runs(slices[open_], open_)]
    told.append((0, HOT, b"", b"", b"", b"", hot.tobytes()))
    return pd.concat([pd.DataFrame(told, columns=_columns(SLICES)), rows[rows["kind"] == SETTLED]], ignore_index=True)


def _of_slices(rows: pd.DataFrame) -> pd.DataFrame:
    """Step 1, the slices of one group: for each document, its anchor hashes that another document has."""
    hot = b"".join(rows["data"][rows["kind"] == HOT])
    out = [(0, 0, hot, True)] * bool(hot)
    for _, mine in rows[rows["kind"] != HOT].groupby("slice", sort=False):
        who = mine[mine["kind"] == SETTLED].iloc[0]
        ids, tids = np.frombuffer(who["ids"], np.int64), np.frombuffer(who["tids"], np.int64)
        doc = np.concatenate([_numbered(d, len(x) // 4) for d, x in zip(mine["docs"], mine["data"])])
        h = np.frombuffer(b"".join(mine["data"]), np.uint32)
        # Once each and in order, so that rows with the same text and doc_id have the same bytes.
        both = np.unique(doc.astype(np.uint64) << np.uint64(32) | h.astype(np.uint64))
        doc, h = (both >> np.uint64(32)).astype(np.int64), both.astype(np.uint32)
        out += [(ids[d], tids[d], piece.tobytes(), False) for d, piece in _runs(doc, h)]
    return pd.DataFrame(out, columns=_columns(ANCHORS)).astype({"ord": "int64", "tid": "int64", "hot": "bool"})


ENTRY = np.dtype([("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (CONTEXT,))])
SPAN = np.dtype([("start", "<i4"), ("stop", "<i4")])
STRING = np.dtype([("pos", "<i4"), ("bytes", "u1", (LENGTH,))])


def _around(lot: tuple, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and context of the anchors of one lot that are among ``mine`` (row, short hash)."""
    data, starts, ends, row, base = lot
    at, h, order = anchors(data, starts, ends)
    piece = np.searchsorted(ends, at, "right")
    hit = np.isin(row[piece].astype(np.uint64) << np.uint64(32) | h.astype(np.uint32).astype(np.uint64), mine)
    at, h, piece = at[hit], h[hit], piece[hit]
    left, right = _reach(at, order)
    left, right = np.minimum(left, at - starts[piece]), np.minimum(right, ends[piece] - at - GRAM)
    # An anchor that is the first in none of its strings (the same gram stands before it) has nothing to send.
    some = left + right >= SIDE
    at, h, piece, left, right = at[some], h[some], piece[some], left[some], right[some]
    entry = np.zeros(len(at), ENTRY)
    entry["pos"], entry["left"], entry["right"] = at - starts[piece] + base[piece], left, right
    if len(at):
        padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(SIDE, np.uint8)])
        place = np.arange(CONTEXT) - SIDE
        inside = (place >= -entry["left"][:, None].astype(np.int8)) & (place < GRAM + entry["right"][:, None].astype(np.int8))
        entry["bytes"] = np.where(inside, np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[at], 0)
    return row[piece], h, entry


def _strings(entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of each context at each offset, as void items, and which of them lie within the document."""
    place = np.arange(SIDE + 1)
    valid = (place >= SIDE - entry["left"][:, None].astype(int)) & (place <= entry["right"][:, None].astype(int))
    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(entry["bytes"], LENGTH, axis=1))
    return wide.view(np.dtype((np.void, LENGTH)))[..., 0], valid


def _spans_of(gone: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For contexts whose strings at some offsets go: the entry and the span of each run of neighbouring strings."""
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    spans = np.zeros(len(i), SPAN)
    spans["start"], spans["stop"] = entry["pos"][i] - SIDE + a, entry["pos"][i] - SIDE + b - 1 + LENGTH
    return i, spans


def _hot_strings(doc: np.ndarray, entry: np.ndarray, ids: np.ndarray, tids: np.ndarray, buckets: int) -> list[tuple]:
    """Contexts of hot anchors: each string goes to a bucket of its own hash, once from a slice, so that no bucket has all
    that differ around one anchor. What a smaller document of the slice has is settled."""
    rows: list[tuple] = []
    for lot in np.array_split(np.arange(len(entry)), 1 + len(entry) // 20_000):
        strings, valid = _strings(entry[lot])
        i, k = np.nonzero(valid)
        same, own = np.unique(strings[i, k], return_inverse=True)
        own = own.ravel()
        who = ids[doc[lot]][i]
        first = np.full(len(same), LAST)
        np.minimum.at(first, own, who)
        gone = np.zeros(valid.shape, bool)
        gone[i, k] = first[own] < who
        at, spans = _spans_of(gone, entry[lot])
        back = tids[doc[lot[at]]] % buckets
        order = np.lexsort((doc[lot[at]], back))
        rows += [_packed(b, SETTLED, doc[lot[at[p]]], ids, tids, spans[p]) for b, p in _runs(back[order], order)]
        left = np.flatnonzero(first[own] == who)
        out = np.zeros(len(left), STRING)
        out["pos"] = entry["pos"][lot[i[left]]] - SIDE + k[left]
        out["bytes"] = np.frombuffer(same[own[left]].tobytes(), np.uint8).reshape(-1, LENGTH)
        eight = np.ascontiguousarray(out["bytes"][:, : LENGTH - LENGTH % 8]).view("<u8")
        hashed = np.zeros(len(left), np.uint64)
        for c in range(eight.shape[1]):
            hashed = _mixed(hashed ^ eight[:, c])
        bucket, d = _bucket(hashed, buckets), doc[lot[i[left]]]
        order = np.lexsort((d, bucket))
        rows += [_packed(b, STRINGS, d[p], ids, tids, out[p]) for b, p in _runs(bucket[order], order)]
    return rows


def _emit_contexts(buckets: int, hot: np.ndarray):
    """Step 2: the bytes around each repeated anchor, once for each context and slice, and what that settles already."""

    @lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch):
                ids, tids = part["ord"].to_numpy(np.int64), part["tid"].to_numpy(np.int64)
                wanted = [np.unique(np.frombuffer(b"".join(x), np.uint32)) for x in part["data"]]
                mine = np.repeat(np.arange(len(wanted), dtype=np.uint64), [len(x) for x in wanted]) << np.uint64(32) | np.concatenate([*wanted, np.empty(0, np.uint32)]).astype(np.uint64)
                found = [_around(lot, mine) for lot in _lots(part["text"])]
                doc, h, entry = (np.concatenate(x) for x in zip(*found))
                del found
                warm = np.isin(h.astype(np.uint32), hot)
                rows = _hot_strings(doc[warm], entry[warm], ids, tids, buckets)
                doc, h, entry = doc[~warm], h[~warm], entry[~warm]
                same = _classes(entry)
                order = np.lexsort((ids[doc], same))
                ss = same[order]
                new = np.r_[True, ss[1:] != ss[:-1]] if len(ss) else np.empty(0, bool)
                first = ids[doc[order[np.flatnonzero(new)]]][np.cumsum(new) - 1] if len(ss) else np.empty(0, np.int64)
                later = order[ids[doc[order]] > first]
                bucket = _bucket(h, buckets)
                keep = order[new]
                keep = keep[np.lexsort((doc[keep], bucket[keep]))]
                for b, piece in _runs(bucket[keep], keep):
                    rows.append(_packed(b, OPEN, doc[piece], ids, tids, entry[piece]))
                # Of one document, or of rows with one doc_id, every place of a context has to be told.
                alike = order[~new & (ids[doc[order]] == first)]
                alike = alike[np.lexsort((doc[alike], bucket[alike]))]
                for b, piece in _runs(bucket[alike], alike):
                    rows.append(_packed(b, OPEN, doc[piece], ids, tids, entry[piece]))
                later = np.sort(later)
                spans = np.zeros(len(later), SPAN)
                spans["start"], spans["stop"] = entry["pos"][later] - entry["left"][later].astype(np.int32), entry["pos"][later] + GRAM + entry["right"][later]
                spread = tids[doc[later]] % buckets
                go = np.argsort(spread, kind="stable")
                for b, piece in _runs(spread[go], go):
                    rows.append(_packed(b, SETTLED, doc[later[piece]], ids, tids, spans[piece]))
                yield pd.DataFrame(rows, columns=_columns(ROWS))

    return run


def _classes(entry: np.ndarray) -> np.ndarray:
    """A number for each different context (its bytes and how far they reach), by exact comparison."""
    flat = np.ascontiguousarray(np.concatenate([entry["bytes"], entry["left"][:, None], entry["right"][:, None]], axis=1))
    return np.unique(flat.view(np.dtype((np.void, flat.shape[1]))).ravel(), return_inverse=True)[1].ravel()


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """New bucket identifiers: equal where both old ones are."""
    if a.dtype != np.uint64:
        return np.unique(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64), return_inverse=True)[1].reshape(a.shape).astype(np.uint32)
    ids = np.unique(np.concatenate([a.ravel(), b.ravel()]), return_inverse=True)[1].astype(np.uint32)
    return _ranks(ids[: a.size].reshape(a.shape), ids[a.size :].reshape(a.shape))


def refined(bytes_: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the ``LENGTH``-byte strings at offsets 0 to 2 * SIDE - ... of each context.

    8-gram buckets are refined to 16, 32 and 50 bytes by the identifiers at later offsets.
    """
    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(bytes_, 8, axis=1))
    b8 = wide.view("<u8")[..., 0]
    b16 = _ranks(b8[:, :-8], b8[:, 8:])
    b32 = _ranks(b16[:, :-16], b16[:, 16:])
    return _ranks(b32[:, : -(LENGTH - 32)], b32[:, LENGTH - 32 :])


def _smaller_elsewhere(rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Step 3, one bucket: for each document, the spans that a smaller one has too."""
    doc, entry, who = _unpacked(rows[rows["kind"] == OPEN], ENTRY)
    found = [_to_owners(*_unpacked(rows[rows["kind"] == SETTLED], SPAN), buckets)]
    own, string, holder = _unpacked(rows[rows["kind"] == STRINGS], STRING)
    if len(own):
        same = np.unique(np.ascontiguousarray(string["bytes"]).view(np.dtype((np.void, LENGTH))).ravel(), return_inverse=True)[1].ravel()
        first = np.full(int(same.max()) + 1, LAST)
        np.minimum.at(first, same, holder[own, 0])
        late = np.flatnonzero(first[same] < holder[own, 0])
        spans = np.zeros(len(late), SPAN)
        spans["start"], spans["stop"] = string["pos"][late], string["pos"][late] + LENGTH
        found.append(_to_owners(own[late], spans, holder, buckets))
    if len(doc):
        ids = who[doc, 0]
        same = _classes(entry)
        first = np.full(same.max() + 1, LAST)
        np.minimum.at(first, same, ids)
        one = np.zeros(len(first), np.int64)
        one[same] = np.arange(len(same))
        contexts = entry[one]
        # Buckets of the anchor itself; one with a single context has the same answer for all its strings.
        middle = np.ascontiguousarray(contexts["bytes"][:, SIDE : SIDE + GRAM])
        gram = np.unique(middle.view(np.dtype((np.void, GRAM))).ravel(), return_inverse=True)[1].ravel()
        many = np.flatnonzero(np.bincount(gram)[gram] > 1)
        least = np.repeat(first[:, None], SIDE + 1, axis=1)
        place = np.arange(SIDE + 1)
        valid = (place >= SIDE - contexts["left"][:, None].astype(int)) & (place <= contexts["right"][:, None].astype(int))
        for lot in np.array_split(many[np.argsort(gram[many], kind="stable")], 1 + len(many) // 25_000) if len(many) else ():
            # Lots are cut between anchors only in that both neighbours get the anchor at the cut.
            lot = many[np.isin(gram[many], np.unique(gram[lot]))]
            key = refined(contexts["bytes"][lot])
            m = np.full(int(key.max()) + 1, LAST)
            ok = valid[lot]
            np.minimum.at(m, key[ok], np.broadcast_to(first[lot][:, None], ok.shape)[ok])
            least[lot] = np.where(ok, np.minimum(least[lot], m[key]), least[lot])
        gone = (least[same] < ids[:, None]) & valid[same]
        i, spans = _spans_of(gone, entry)
        found.append(_to_owners(doc[i], spans, who, buckets))
    out = pd.concat(found, ignore_index=True)
    del doc, found, own, string
    release()
    return out


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, data in zip(batch["text"], batch["data"]):
            raw = text.encode()
            spans = np.sort(np.frombuffer(data, SPAN), order="start")
            stop = np.maximum.accumulate(spans["stop"])
            new = np.r_[True, spans["start"][1:] > stop[:-1]] if len(spans) else np.empty(0, bool)
            starts, stops = spans["start"][new], stop[np.r_[new[1:], True]] if len(spans) else stop
            at, kept = 0, []
            for a, b in zip(starts.tolist(), stops.tolist()):
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            out.append((int((stops - starts).sum()), len(starts), hashlib.sha256(b"".join(kept)).hexdigest()))
        got = pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])
        yield pd.concat([batch[["ord", "n_bytes"]].reset_index(drop=True), got], axis=1)


def _hottest(repeated: DataFrame) -> np.ndarray:
    """Hashes of the hot anchors, the hottest of them if they are too many to be sent to all tasks."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = np.frombuffer(b"".join(batch["data"]), np.uint32).reshape(-1, 2)
            yield pd.DataFrame({"h": pairs[:, 0].astype(np.int64), "n": pairs[:, 1].astype(np.int64)})

    told = repeated.filter("hot").select("data").mapInPandas(each, "h long, n long")
    return told.orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").toArrow()["h"].to_numpy().astype(np.uint32)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return t.select("ord", "text", F.xxhash64("text").alias("tid"), F.octet_length("text").cast("long").alias("n_bytes"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_slices: int = HOT_SLICES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of each document.

    Anchors found in more than ``hot_slices`` slices are dealt string by string; the result is the same for any number.
    """
    texts = _texts(docs, id_col, text_col)
    digest = F.sha2("text", 256)
    copied = texts.groupBy(digest.alias("digest")).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copied = stored(copied.select("digest", "first"), "suffix-copies")
    small = copied.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    t = texts.withColumn("digest", digest).join(F.broadcast(copied) if small else copied, "digest", "left").drop("digest")
    copy = F.coalesce(F.col("first") < F.col("ord"), F.lit(False))
    own = t.filter(~copy).select("ord", "tid", "n_bytes", "text")

    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))
    # The same columns in both joins of texts, so that Spark shuffles the texts once for both.
    long_enough = own.filter(F.col("n_bytes") >= LENGTH).select("ord", "tid", "text")
    hashes = long_enough.mapInPandas(_emit_anchors(buckets), SLICES)
    repeated = hashes.groupBy("bucket").applyInPandas(lambda rows: _repeated_anchors(rows, buckets, hot_slices), SLICES)
    repeated = stored(repeated.groupBy("bucket").applyInPandas(_of_slices, ANCHORS), "suffix-anchors")

    hot = _hottest(repeated)
    # Rows with the same text and doc_id have an entry each.
    each = repeated.filter("NOT hot").groupBy("ord", "tid").agg(F.collect_set("data").alias("data"))
    contexts = long_enough.join(each, ["ord", "tid"]).select("ord", "tid", "text", "data").mapInPandas(_emit_contexts(buckets, hot), ROWS)
    spans = contexts.groupBy("bucket").applyInPandas(lambda rows: _smaller_elsewhere(rows, buckets), ROWS)
    spans = spans.groupBy("bucket").applyInPandas(_by_document, FOUND)

    touched = long_enough.join(spans, ["ord", "tid"])
    touched = touched.select("ord", F.octet_length("text").cast("long").alias("n_bytes"), "text", "data")
    cut = touched.mapInPandas(_applied, "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    whole = own.select("ord", "tid", "n_bytes", F.sha2("text", 256).alias("kept_sha256")).join(spans.select("ord", "tid"), ["ord", "tid"], "left_anti")
    whole = whole.select("ord", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256")
    gone = F.col("n_bytes") >= LENGTH
    copies = t.filter(copy).select(
        "ord", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.sha2(F.when(gone, "").otherwise(F.col("text")), 256).alias("kept_sha256"),
    )
    every = cut.unionByName(whole).unionByName(copies)
    every = every.select(F.when(F.col("ord") != LAST, F.col("ord")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    done = stored(every, "suffix-repeats")
    for before in (copied, repeated):
        drop_path(docs.sparkSession, before.stored_at)
    return done
