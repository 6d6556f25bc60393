"""Rule bitmask ledger (operator 6).

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per
rule; policies are masks over those bits, so a new policy version or an ablation never reads text again.

Defined results: a null text is an empty one (no words, every measurement 0); ids may be null or repeated,
rows are independent of each other; an empty table gives an empty ledger; of the input only the two named
columns are read, so other columns, whatever their names, have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
SHOUT = r"!!(?=[\x20\x09-\x0D]|\z)"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measurements; ``bit`` never changes once a ledger has been written."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "too_few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbol_noise", "5 * n_symbols > n_words"),
    Rule(3, "shouting", "n_words >= 20 AND 2 * n_shouted > n_words"),
    Rule(4, "duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule(5, "word_length", "n_words > 0 AND word_chars > 30 * n_words"),
)
#: Policy versions: the rules that reject.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_noise", "shouting", "duplicate_lines", "word_length"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted")


def mask(policy: str) -> int:
    names = POLICIES[policy]
    return sum(1 << r.bit for r in RULES if r.name in names)


def _repeat_words(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, from the array of word hashes.

    Windows are compared by 64-bit hashes of their words within one text; equal neighbours after a sort
    are repeats, and the union of the repeated windows is a sum over gaps, so the cost is n log n, and
    linear for the many texts whose windows are all different.
    """

    def covered(s: Column) -> Column:
        n = F.size(s)
        at = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.when((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"]), True).otherwise(
                (k < n - 1) & (s[F.least(k + 1, n - 1)]["h"] == s[k]["h"])
            ),
        )
        return let(
            F.array_sort(F.transform(at, lambda k: s[k]["i"])),
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.when(k == F.size(p) - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), p[F.least(k + 1, F.size(p) - 1)] - x))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    def repeated(w: Column) -> Column:
        ranked = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(ranked, covered)).otherwise(F.lit(0))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)]))

    return let(hashes, lambda h: F.when(F.size(h) >= WINDOW, let(windows(h), repeated)).otherwise(F.lit(0))).cast("long")


def measure(docs: DataFrame, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, unchanged, and the measurements of ``text_col``: one narrow pass, no shuffle."""
    d = docs.select(*keep, F.coalesce(docs[text_col], F.lit("")).alias("__t"))
    t = F.col("__t")
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    d = d.select(
        *keep,
        F.when(t.rlike(SYMBOL), count(SYMBOL)).otherwise(0).alias("n_symbols"),
        F.when(t.contains("!!"), count(SHOUT)).otherwise(0).alias("n_shouted"),
        let(
            F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
            lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
        ).alias("__l"),
        let(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
                _repeat_words(F.transform(w, lambda x: F.xxhash64(x))).alias("n_repeat_words"),
            ),
        ).alias("__w"),
    )
    return d.select(*keep, "__w.n_words", "__w.word_chars", "n_symbols", "__l.n_dup_lines", "__w.n_repeat_words", "__l.n_lines", "n_shouted")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``fail_bits``: bit b is set where the rule with that bit fails."""
    return with_bits(measure(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ("doc_id",)))


def with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def kept_by(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents it rejects, and documents that only it rejects.

    The ledger is first reduced to one count per bit pattern (map-side partial sums), which is all that
    any ablation needs.
    """
    m = mask(policy)
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if m >> r.bit & 1])
    x = patterns.select("bits", "n", F.explode(rules).alias("r"))
    hit = x["bits"].bitwiseAND(F.col("r.bit")) != 0
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_only_here"),
    )


def apply_policy(docs: DataFrame, policy: str = "v1", columns: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with ``columns`` only; the filter is one narrow pass."""
    columns = tuple(columns or docs.columns)
    names = [f"__c{i}" for i in range(len(columns))]
    d = docs.select(*[docs[c].alias(n) for c, n in zip(columns, names)], docs["text"].alias("__text"))
    kept = with_bits(measure(d, tuple(names), "__text")).filter(kept_by(policy))
    return kept.select(*[F.col(n).alias(c) for c, n in zip(columns, names)])
