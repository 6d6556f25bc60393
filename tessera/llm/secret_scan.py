"""Secret scans with multipart credential linking (operator 2).

Strong kinds are reported wherever they stand. Weak candidates (a user name, a pass phrase, an endpoint)
mean little alone; they are joined by interval with their complements in the same document, and reported
only where the other part of a credential lies within ``SCOPE`` code points.

Everything happens inside a row: no shuffle, no Python. Spans are in code points, end exclusive.

Defined results: a null text is an empty one (no spans); ids may be null or repeated, rows are independent;
spans that start together are ordered by kind as listed; an empty table gives an empty result; other columns
of the input are not read. A text's cost is its length, plus the logarithm of a kind's spans for each weak candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, running

#: kind -> (pattern, group whose length is checked, least length of it); matches are leftmost, not overlapping.
STRONG = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # A maximal run of at least so many characters: the same spans as a run of any length that is then checked.
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
WEAK = {
    "ident": (r"""((?i:access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3),
    "weak": (r"""((?i:passphrase|pass|pwd|private_?key|access_?key|credential|auth))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "endpoint": (r"""((?i:https?|s3|jdbc:[a-z]+|postgresql|postgres|mysql|mongodb|redis|amqp))://([^\x20\x09-\x0D"'<>]+)""", 2, 3),
}
KINDS = (*STRONG, *WEAK)
SCOPE = 200
SPANS = "array<struct<start:int,stop:int>>"


#: Plain strings of which a text has one wherever a kind matches; looking for them is much cheaper than matching.
HINTS = {kind: (":", "=") for kind in ("assign", "ident", "weak")} | {"access": ("AKIA",), "endpoint": ("://",)}


def find(text: Column, pattern: str, group: int, least: int, hints: tuple[str, ...] = ()) -> Column:
    """Spans of the matches whose group is long enough, from the pieces between matches and the matches; texts without any hint have none."""

    def placed(p: Column) -> Column:
        # A match ends where all pieces and matches up to it end.
        ends = running(F.transform(p["m"], lambda m, k: (F.char_length(p["s"][k]) + F.char_length(m)).cast("long")))
        span = lambda e, k: F.struct((e - F.char_length(p["m"][k])).cast("int").alias("start"), e.cast("int").alias("stop"))
        return F.filter(F.transform(ends, span), lambda x, k: F.char_length(p["g"][k]) >= least)

    parts = F.struct(
        F.split(text, pattern, -1).alias("s"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
    )
    hinted = reduce(Column.__or__, [text.contains(h) for h in hints], F.lit(not hints))
    return F.when(hinted & text.rlike(pattern), let(parts, placed)).otherwise(F.array().cast(SPANS))


def _meets(x: Column, spans: Column, scope: int) -> Column:
    """Whether any of the spans of one kind lies within ``scope`` of x (0: overlaps it).

    They are sorted and don't overlap, so the first that ends late enough decides; it is found by halving.
    """
    halve = lambda s, _: let(
        F.floor((s["lo"] + s["hi"]) / 2).cast("int"),
        lambda mid: F.when(s["lo"] >= s["hi"], s)
        .when(F.get(spans, mid)["stop"] + scope > x["start"], F.struct(s["lo"].alias("lo"), mid.alias("hi")))
        .otherwise(F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))),
    )
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1.0))).cast("int"))
    first = F.aggregate(turns, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda s: s["lo"])
    return F.when(F.size(spans) > 0, F.coalesce(F.get(spans, first)["start"] < x["stop"] + scope, F.lit(False))).otherwise(F.lit(False))


def _linked(kind: str, *complements: tuple[str, ...]) -> Column:
    """The spans with a part of each complement within SCOPE."""
    z = F.struct(F.col(kind).alias("a"), *[F.col(k).alias(k) for k in dict.fromkeys(k for c in complements for k in c)])
    near = lambda s, x: reduce(Column.__and__, [reduce(Column.__or__, [_meets(x, s[k], SCOPE) for k in c]) for c in complements])
    return F.when(F.size(kind) > 0, let(z, lambda s: F.filter(s["a"], lambda x: near(s, x)))).otherwise(F.col(kind))


def _apart(kind: str) -> Column:
    """The spans that no strong one overlaps."""
    z = F.struct(F.col(kind).alias("a"), *[F.col(k).alias(k) for k in STRONG])
    clear = lambda s, x: ~reduce(Column.__or__, [_meets(x, s[k], 0) for k in STRONG])
    return F.when(F.size(kind) > 0, let(z, lambda s: F.filter(s["a"], lambda x: clear(s, x)))).otherwise(F.col(kind))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and, for each kind, the array of its reported spans."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.select("doc_id", *[find(F.col("t"), *rule, HINTS.get(kind, ())).alias(kind) for kind, rule in (STRONG | WEAK).items()])
    d = d.select("doc_id", *STRONG, *[_apart(k).alias(k) for k in WEAK])
    idents, secrets = ("access", "ident"), ("assign", "hex", "weak")
    return d.select("doc_id", *STRONG, _linked("ident", secrets).alias("ident"), _linked("weak", idents).alias("weak"), _linked("endpoint", idents, secrets).alias("endpoint"))


def described(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""
    ranked = lambda i, k: F.transform(F.col(k), lambda x: F.struct(x["start"].alias("a"), F.lit(i).alias("k"), x["stop"].alias("b")))
    every = F.concat(*[ranked(i, k) for i, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(every), lambda x: F.concat_ws(":", names[x["k"]], x["a"].cast("string"), x["b"].cast("string"))), ",")

