"""Exact token counts at every prefix (operator 10).

A text's tokens are the tokens of its pieces, cut off by the tokenizer's own pattern; inside a piece a
dynamic programme over its bytes gives the count at every prefix: the last token of a prefix is the one
suffix whose left neighbour stays apart from it, and the count is one more than at that token's start.
Pieces repeat, so each worker keeps the counts of those it has met (a bounded cache of pure values).

What is stored for a text is the count of each of its prefixes, every code point's, as a text of its own: the
differences from one prefix to the next, a byte for each code point (four where a difference needs it). Token
counts, truncation and budgets are sums and look-ups in it; nothing is encoded again.

Defined results: a null text is an empty one (0 bytes, 0 tokens); a special string inside a text is one
token, as the library has it by default; a prefix that ends inside one is plain text; ids may be null or repeated;
an empty table gives an empty result; of the input only the two named columns are read. Texts are never cut,
whatever their length.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the split pattern of the byte-level vocabulary, as its documentation states it.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: the characters of Unicode's property White_Space, which are the pattern's \\s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The last code point of the short classes, and a search for any beyond them.
LATIN = 0x24F
BEYOND = re.compile(f"[^\\x00-{chr(LATIN)}]").search
#: Runs of white space that are two pieces, but in a prefix that ends behind them.
RUNS = re.compile(f"[{WHITE}]{{2,}}")
#: Of the pattern's contractions, those that are no piece without their last letter.
LONG = ("'re", "'ve", "'ll")
#: Entries of a worker's caches, and their bytes, roughly; a full one is emptied. Longer pieces, in code points, aren't kept.
CACHE, CACHE_BYTES, LONGEST = 600_000, 128 << 20, 64
#: What an entry takes besides its piece and a step for each of the piece's characters.
ENTRY = 200


class _Pieces(dict):
    """What is known of pieces, found when it is first asked for; emptied when full. Pieces of unspaced text may be as long as it: they are found anew."""

    def __init__(self, find):
        self.find, self.held = find, 0

    def __missing__(self, piece: str):
        n = self.find(piece)
        if len(piece) <= LONGEST:
            if len(self) >= CACHE or self.held >= CACHE_BYTES:
                self.clear()
                self.held = 0
            self[piece] = n
            self.held += ENTRY + 5 * len(piece)
        return n


def classes_spelt_out(pattern: str, last: int) -> str:
    """The pattern for the standard library's matcher, which has no classes of letters and numbers, up to code point ``last``."""

    def spans(kind: str) -> str:
        inside = [unicodedata.category(chr(c))[0] == kind for c in range(last + 1)]
        inside.append(False)
        starts = [c for c, x in enumerate(inside) if x and not (c and inside[c - 1])]
        ends = [c - 1 for c, x in enumerate(inside) if not x and c and inside[c - 1]]
        return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))

    letters, numbers = spans("L"), spans("N")
    for name, inside in ((r"[^\s\p{L}\p{N}]", f"[^{WHITE}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{WHITE}]"), (r"\s", f"[{WHITE}]")):
        pattern = pattern.replace(name, inside)
    return pattern


class PrefixCounter:
    """Counts for one byte-level BPE vocabulary, given as its library's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without a normalizer or prefix space is needed")
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(back[c] for c in token)
        self.tokens = {i: raw(token) for token, i in spec["model"]["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        #: Which two tokens make a third, by which rule, and the two that a token is made of.
        self.rule, self.made_of, self.born = {}, {}, dict.fromkeys(self.tokens, -1)
        for n, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.rule[a << 20 | b] = n
            if c not in self.made_of:
                self.made_of[c], self.born[c] = (a, b), n
        #: Every beginning of a token, with the token's id where it is one itself, else -1.
        self.begins = dict.fromkeys((t[:n] for t in self.tokens.values() for n in range(1, len(t))), -1) | {t: i for i, t in self.tokens.items()}
        self.latin, self.any = (re.compile(classes_spelt_out(PIECE, last)) for last in (LATIN, sys.maxunicode))
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.whole = _Pieces(lambda piece: self.prefixes(piece.encode())[-1])
        self.steps = _Pieces(self._steps)
        self.apart: dict[int, bool] = {}
        #: Ids by token and the longest one's bytes; for beginnings of pieces, lists of which they are a part: tokens up to each place, and the last of them.
        self.ids = {t: i for i, t in self.tokens.items()}
        self.most = max(map(len, self.ids))
        self.known: dict[bytes, tuple[list[int], list[int]]] = {}

    def stays(self, left: int, right: int) -> bool:
        """Whether two tokens, side by side, are encoded as themselves; ``left`` is -1 at a piece's start.

        The encoder's steps are undone from the end, the later born of the two tokens at the border first. If at
        any time a rule joins what stands at the border before the next step that was really taken, they merge.
        """
        if len(self.apart) >= CACHE:
            self.apart.clear()
        key = (left + 1 << 20) + right
        if left < 0:
            self.apart[key] = True
            return True
        rule, born, made_of, limit = self.rule.get, self.born, self.made_of, 1 << 60
        known = None
        while known is None:
            if rule(left << 20 | right, limit) < limit:
                known = False
            elif born[left] > born[right]:
                limit, left = born[left], made_of[left][1]
            elif born[right] >= 0:  # of equal rules the left one is applied first
                limit, right = born[right] + 1, made_of[right][0]
            else:
                known = True
        self.apart[key] = known
        return known

    def prefixes(self, piece: bytes) -> list[int]:
        """Tokens of every prefix of a piece, from the empty one to the whole.

        From each offset on, the tokens that begin there are tried behind the last token of the prefix before it;
        of all tokens that end at an offset, just one stays apart from what is before it.
        """
        n = len(piece)
        if n <= self.most * 4:
            return self._short(piece)
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        begins, apart = self.begins.get, self.apart.get
        for start in range(n):
            left, more = last[start], counts[start] + 1
            key = left + 1 << 20
            for end in range(start + 1, n + 1):
                token = begins(piece[start:end])
                if token is None:
                    break
                if token >= 0 and not counts[end]:
                    known = apart(key + token)
                    if known or known is None and self.stays(left, token):
                        counts[end], last[end] = more, token
        return counts

    def _short(self, piece: bytes) -> list[int]:
        """The same for a piece of usual length: what is known of its beginnings from other pieces is taken over."""
        n, token_of, known, apart = len(piece), self.ids.get, self.known, self.apart.get
        if len(known) >= CACHE:
            known.clear()
        met = n
        while met and (state := known.get(piece[:met])) is None:
            met -= 1
        counts, last = (state[0][: met + 1], state[1][: met + 1]) if met else ([0], [-1])
        state = counts, last
        for end in range(met + 1, n + 1):
            for start in range(max(0, end - self.most), end):
                token = token_of(piece[start:end])
                if token is not None:
                    stays = apart(last[start] + 1 << 20 | token)
                    if stays or stays is None and self.stays(last[start], token):
                        counts.append(counts[start] + 1)
                        last.append(token)
                        break
            known[piece[:end]] = state
        return counts

    def pieces(self, text: str) -> list[str]:
        """The same for either pattern; the one with the short classes is several times as fast."""
        return (self.any if BEYOND(text) else self.latin).findall(text)

    def _segments(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        """The last entry of ``table``, without the table."""
        return sum(1 if special else sum(map(self.whole.__getitem__, self.pieces(part))) for part, special in self._segments(text))

    def _steps(self, piece: str) -> bytes:
        """From each prefix of a piece to the next, how many tokens more or less; empty where a byte can't hold one."""
        counts = self.prefixes(piece.encode())
        if len(piece) <= LONGEST and piece not in LONG:
            if not piece.isascii():
                counts = [counts[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]
            return bytes([b - a & 255 for a, b in zip(counts, counts[1:])])
        if not piece.isascii():
            at = np.cumsum([0, *(len(c.encode()) for c in piece)])
            counts = [counts[i] for i in at.tolist()]
        if piece in LONG:
            counts = [*counts]
            counts[2] = self.whole["'"] + self.whole[piece[1]]
        steps = np.diff(counts)
        return steps.astype(np.int8).tobytes() if len(steps) and np.abs(steps).max() < 128 else b""

    def _wide(self, piece: str) -> np.ndarray:
        counts = self.prefixes(piece.encode())
        return np.diff([counts[i] for i in np.cumsum([0, *(len(c.encode()) for c in piece)]).tolist()])

    def table(self, text: str) -> bytes:
        """The steps from each prefix of the text to the next: int8, or int32 where there are four bytes for each code point."""
        out, fixes, at, plain = [], [], 0, True
        last = ""  # the last piece before a special string
        for part, special in self._segments(text):
            if special:
                # Up to its last character it is plain text, which may join the piece before.
                base = self.whole[last] if last else 0
                counts = [0, *(self.count(last + part[:k]) - base for k in range(1, len(part))), 1]
                out.append(np.diff(counts))
                last, plain = "", False
            else:
                found = self.pieces(part)
                steps = list(map(self.steps.__getitem__, found))
                if not all(steps):
                    steps, plain = [s or self._wide(p) for s, p in zip(steps, found)], False
                out += steps
                last = found[-1] if found else last
                for m in RUNS.finditer(part):
                    if m.end() < len(part):
                        # All but the last are a piece of their own; the prefix that ends behind the last has all in one.
                        run = m[0]
                        fixes.append((at + m.end() - 1, self.whole[run] - self.whole[run[:-1]] - self.whole[run[-1]]))
            at += len(part)
        if plain and not fixes:
            return b"".join(out)
        if plain:
            steps = np.frombuffer(b"".join(out), np.int8).astype(np.int64)
        else:
            steps = np.concatenate([np.frombuffer(x, np.int8).astype(np.int64) if type(x) is bytes else x for x in out]) if out else np.empty(0, np.int64)
        for place, more in fixes:
            steps[place] += more
            if place + 1 < len(steps):
                steps[place + 1] -= more
        return steps.astype(np.int8 if np.abs(steps).max(initial=0) < 128 else np.int32).tobytes()


def counts(table: bytes, length: int) -> np.ndarray:
    """Tokens of every prefix of a text of ``length`` code points, from the empty one on, by its table."""
    steps = np.frombuffer(table, np.int8 if len(table) == length else np.int32)
    return np.concatenate([[0], np.cumsum(steps, dtype=np.int64)])


def at_prefix(table: bytes, length: int, n: int) -> int:
    """Tokens of the first ``n`` code points as a text of their own."""
    return int(counts(table, length)[n])


def fits(table: bytes, length: int, limit: int) -> int:
    """The longest prefix, in code points, of at most ``limit`` tokens."""
    return int(np.flatnonzero(counts(table, length) <= limit)[-1])


def byte_letters() -> dict[int, str]:
    """The vocabulary file's letters for bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One for each Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``, ``fits_chars`` and ``prefixes``, the table that the others are read from.

    ``fits_chars`` is the longest prefix within ``limit``. A narrow pass: batches of texts go to Python, tables come back.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fields = [d.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "fits_chars")], T.StructField("prefixes", T.BinaryType())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(tokenizer)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                table, n = c.table(text), len(text)
                total = int(np.frombuffer(table, np.int8 if len(table) == n else np.int32).sum(dtype=np.int64))
                rows.append((len(text.encode()), total, n if total <= limit else fits(table, n, limit), table))
            out = pd.DataFrame(rows, columns=[f.name for f in fields[1:]])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    counted = d.mapInPandas(run, T.StructType(fields))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars", "prefixes")
