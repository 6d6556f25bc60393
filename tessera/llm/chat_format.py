"""Chat formatting with offset-aligned loss masks (operator 7).

A conversation is rendered whole, encoded once with offsets, and the turns' text spans are intersected with
the token spans by binary search. The template's marks are added tokens, so the tokenizer cuts at every mark
and no token lies half in a text. Strings that could be taken for marks are escaped inside texts, one to one.

Defined results: a null text is an empty one, a null role the role ``none``; turns are ordered by turn, then
role, then text, nulls first, and repeated rows are turns of their own; rows with a null conv_id form one
conversation; a conversation without assistant turns has an empty mask; an empty table gives an empty
result; other columns of the input are not read. A conversation is one row in one task, as it is one
sequence of tokens, whose length no template can divide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPE = "␛"
#: Control strings of common chat templates, and the opening of any <|...|> mark.
CONTROL = re.compile(ESCAPE + r"|<\||\|>|</?s>|\[/?INST\]|<</?SYS>>")
UNESCAPE = re.compile(ESCAPE + "(" + ESCAPE + "?)")
LEARNT = ("assistant",)


def escape(text: str) -> str:
    """An escape sign is doubled; a control string gets one after its first character."""
    return CONTROL.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the texts that are learnt."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        at += len(head)
        if role in LEARNT:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += (head, body, END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: no mark occurs but those of the template."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.partition(TEXT)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def masked(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token, whether it overlaps a span; all are sorted, and each span finds its tokens by binary search."""
    mask = np.zeros(len(starts), bool)
    if spans:
        begin, stop = np.array(spans).T
        for a, b in zip(np.searchsorted(ends, begin, "right").tolist(), np.searchsorted(starts, stop, "left").tolist()):
            mask[a:b] = True
    return mask


def learnt_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask, read from the tokens' offsets: several tokens may share a character, and neighbours make one run."""
    a, b = starts[mask], ends[mask]
    if not len(a):
        return ""
    far = np.maximum.accumulate(b)
    new = np.flatnonzero(np.r_[True, a[1:] > far[:-1]])
    return unescape("".join(formatted[x:y] for x, y in zip(a[new].tolist(), far[np.r_[new[1:] - 1, len(a) - 1]].tolist())))


_LOADED: dict = {}


def loaded(path: str):
    """The tokenizer with the template's marks as added tokens; one for each Python worker."""
    if path not in _LOADED:
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
        _LOADED[path] = tokenizer
    return _LOADED[path]


def _slices(batches: Iterator[pd.DataFrame], rows: int = 64) -> Iterator[pd.DataFrame]:
    """Batches in parts of a few conversations, as tokens take many times their texts' memory."""
    for batch in batches:
        for a in range(0, len(batch), rows):
            yield batch.iloc[a : a + rows]


def conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation: its turns in order."""
    r = rows.select("conv_id", "turn", F.coalesce("role", F.lit("none")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return r.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def format_chats(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``conv_id``, ``formatted``, and aligned arrays ``ids``, ``starts``, ``ends`` and ``loss_mask``."""
    chats = conversations(rows)
    longs = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [chats.schema["conv_id"], T.StructField("formatted", T.StringType()), *[T.StructField(n, longs) for n in ("ids", "starts", "ends")], T.StructField("loss_mask", T.ArrayType(T.BooleanType()))]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = loaded(tokenizer)
        for batch in _slices(batches):
            texts, spans = zip(*(render([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"])) if len(batch) else ((), ())
            encoded = tok.encode_batch(list(texts), add_special_tokens=False)
            ends = [np.array(e.offsets, np.int32).reshape(-1, 2) for e in encoded]
            yield pd.DataFrame(
                {
                    "conv_id": batch["conv_id"].array,
                    "formatted": texts,
                    "ids": [np.array(e.ids, np.int32) for e in encoded],
                    "starts": [x[:, 0].copy() for x in ends],
                    "ends": [x[:, 1].copy() for x in ends],
                    "loss_mask": [masked(x[:, 0], x[:, 1], s) for x, s in zip(ends, spans)],
                }
            )

    return chats.mapInPandas(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output says: turns parsed from the text, and the learnt text from the tokens under the mask."""
    schema = T.StructType(
        [formatted.schema["conv_id"]]
        + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("n_tokens", T.LongType()), ("n_loss_tokens", T.LongType()))]
    )
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            rows = []
            for text, starts, ends, mask in zip(batch["formatted"], batch["starts"], batch["ends"], batch["loss_mask"]):
                turns, learnt = parse(text), learnt_text(text, starts, ends, mask)
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), digest(told), len(learnt), digest(learnt), len(text), len(mask), int(mask.sum())))
            out = pd.DataFrame(rows, columns=[f.name for f in schema.fields[1:]])
            out.insert(0, "conv_id", batch["conv_id"].array)
            yield out

    return formatted.mapInPandas(run, schema)
