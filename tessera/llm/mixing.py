"""Soft-membership mixing (operator 9).

A classifier fitted on the labelled table gives every document a posterior over domains; document rates, at
least 0, are then fitted so that the expected tokens of each domain, the sum of rate * tokens * posterior,
meet its target. The fit is least squares by projected gradient: a step needs only the domains' residuals, one
small sum over all documents, and moves each rate by the residuals weighted with its own posterior.

All is DataFrame expressions. Texts are read once: their tokens (words between white space) and posteriors are
written with the columns that are wanted. A rate is a function of a document's posterior and of the steps so far, so
no rates are stored between steps.

The classifier is a naive Bayes model of the presence of word and punctuation buckets. It is fitted on at most
``SAMPLE`` labelled rows (those with the least hashes of doc_id) and keeps the ``FEATURES`` buckets that tell
the domains apart best; everything else covers all documents.

Defined results: a null text is an empty one; documents without words have 0 tokens and the rate that their
posterior gives; labels with a null are not used; of repeated labels of one document each counts; without
labels the posterior is even; tables without rows give an empty result; other columns are not read.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, stored, tidy

DOMAINS = ("good", "poor", "toxic")
#: Shares of all tokens; the mix has as many expected tokens as the corpus.
TARGETS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}
SAMPLE, BUCKETS, FEATURES = 20_000, 1 << 18, 256
STEPS, MOMENTUM, TOLERANCE = 60, 0.9, 3e-5
#: Steps after which rates are written, so that no expression nests more of them.
WRITTEN = 10
#: Times by which a bucket must be more frequent in a domain than elsewhere; the best ``FEATURES`` of those are taken, at any number of labels.
RATIO = 4.0


@dataclass(frozen=True)
class Model:
    buckets: tuple[int, ...]
    present: tuple[tuple[float, ...], ...]  # by bucket, by domain: what its presence adds, against its absence and the first domain
    base: tuple[float, ...]  # by domain: the prior, and the absence of every bucket


def features(text: Column) -> Column:
    """Distinct buckets of a text's words (letters only, lower case) and of its runs of other signs."""
    t = F.coalesce(text, F.lit(""))
    parts = F.concat(F.split(F.lower(t), r"[^\p{L}]+"), F.split(t, r"[\p{L}\p{N}\s]+"))
    return F.array_distinct(F.transform(parts, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")))


def tokens(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, 2).when(quality == 1, 0).otherwise(1)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The sample of labels is bounded, so it is broadcast, and no text is shuffled."""
    known = labels.select("doc_id", "quality", "toxic").dropna()
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(SAMPLE)
    sample = sample.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain"))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("domain", features(F.col("text")).alias("f"))
    rows = stored(rows, "mixing-labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([float(sizes.get(k, 0)) for k in range(len(DOMAINS))])
    count = [F.count(F.when(F.col("domain") == k, 1)).alias(f"c{k}") for k in range(len(DOMAINS))]
    table = rows.select("domain", F.explode("f").alias("bucket")).groupBy("bucket").agg(*count)
    # Buckets that speak for a domain other than the first: how much more frequent they are there, in standard errors.
    score = F.lit(0.0)
    total = sum((F.col(f"c{k}") for k in range(1, len(DOMAINS))), F.col("c0"))
    for k in range(1, len(DOMAINS)):
        inside, outside = n[k], n.sum() - n[k]
        if inside and outside:
            mean = total / float(n.sum())
            gap = F.col(f"c{k}") / float(inside) - (total - F.col(f"c{k}")) / float(outside)
            often = F.col(f"c{k}") / float(inside) >= RATIO * (total - F.col(f"c{k}")) / float(outside)
            score = F.greatest(score, often.cast("int") * gap / F.sqrt(mean * (1 - mean) * float(1 / inside + 1 / outside) + 1e-12))
    best = table.withColumn("score", score).filter(F.col("score") > 0).orderBy(F.desc("score"), "bucket").limit(FEATURES).collect()
    prior = np.log((n + 1) / (n.sum() + len(n)))
    p = np.array([[r[f"c{k}"] for k in range(len(DOMAINS))] for r in best], float).reshape(len(best), len(DOMAINS))
    p = (p + 0.5) / (n + 1)
    there, gone = np.log(p) - np.log(p[:, :1]), np.log1p(-p) - np.log1p(-p[:, :1])
    return Model(tuple(int(r["bucket"]) for r in best), tuple(map(tuple, (there - gone).tolist())), tuple((prior + gone.sum(0)).tolist()))


def posterior(text: Column, model: Model) -> Column:
    """A struct with a field for each domain; they sum to 1."""
    k = len(DOMAINS)
    if model.buckets:
        names = F.array(*[F.lit(b) for b in model.buckets])
        rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in model.present])
        hits = F.array_intersect(features(text), names)

        def added(h: Column) -> Column:
            places = F.transform(h, lambda x: F.array_position(names, x).cast("int") - 1)
            return let(F.transform(places, lambda i: rows[i]), lambda r: F.array(*[F.aggregate(r, F.lit(base), _adder(d)) for d, base in enumerate(model.base)]))

        scores = added(hits)
    else:
        scores = F.array(*[F.lit(x) for x in model.base])

    def softmax(s: Column) -> Column:
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return let(e, lambda w: F.struct(*[(w[d] / sum((w[i] for i in range(1, k)), w[0])).alias(name) for d, name in enumerate(DOMAINS)]))

    return let(scores, softmax)


def _adder(d: int):
    return lambda acc, row: acc + row[d]


def rate(steps: list[tuple[float, ...]], start: Column | None = None) -> Column:
    """From columns p_<domain>: rates start at 1, and each step subtracts its weights times the posterior, not below 0."""
    r = F.lit(1.0) if start is None else start
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.col(f"p_{d}") * w for d, w in zip(DOMAINS[1:], step[1:])), F.col(f"p_{DOMAINS[0]}") * step[0]))
    return r


def fit_rates(members: DataFrame, targets: dict[str, float]) -> list[tuple[float, ...]]:
    """Steps of projected gradient for ``members`` (n_tokens, p_<domain>).

    What is made least is the sum of squares of the domains' residuals, weighted once and for all by the inverse of
    sum(tokens * posterior * posterior'). The gradient of a document's rate is its posterior times the weighted
    residuals; with these weights its steepest curvature is 1, so a step of size 1 never makes the sum larger. A step
    ends where rates are at least 0. Steps carry ``MOMENTUM`` of the one before along, and where that makes the sum
    larger, the step is taken anew without it. What is gathered are a few sums over domains for each step. The fit has
    converged when a step takes off less than ``TOLERANCE`` of what the sum was at first, which it does in the end, as
    the sum is never below 0; there is no other end to it. After ``STEPS`` it says once that it goes on.
    """
    k, names = len(DOMAINS), [f"p_{d}" for d in DOMAINS]
    curves = [F.sum(F.col("n_tokens") * F.col(a) * F.col(b)).alias(f"h{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    now = members.agg(F.sum("n_tokens").alias("total"), *curves).first()
    total = float(now["total"] or 0)
    if not total:
        return []
    goal = total * np.array([targets[d] for d in DOMAINS]) / sum(targets.values())
    curve = np.array([[now[f"h{i}_{j}"] for j in range(k)] for i in range(k)], float)
    # Domains that no document tells apart have no inverse; what they can't change is left out.
    weights = np.linalg.pinv(curve, rcond=1e-7, hermitian=True)
    steps: list[tuple[float, ...]] = []
    losses: list[float] = []
    gradient = carried = np.zeros(k)
    plain = True
    sums = [F.sum(F.col("n_tokens") * F.col(p) * F.col("r")).alias(p) for p in names]
    with tidy(members.sparkSession):
        at, done = members.select(*names, "n_tokens", F.lit(1.0).alias("start")), 0
        while True:
            now = at.select(*names, "n_tokens", rate(steps[done:], F.col("start")).alias("r")).agg(*sums).first()
            gap = np.array([now[p] for p in names]) - goal
            loss = float(gap @ weights @ gap)
            if losses and loss > losses[-1] and not plain:
                steps.pop()
                step, plain = gradient, True
            else:
                if losses and losses[-1] - loss <= TOLERANCE * losses[0] + 1e-12 * total:
                    return steps
                losses.append(loss)
                gradient = weights @ gap
                step, plain = gradient + MOMENTUM * carried, not carried.any()
            carried = step
            # Rounded, so that sums in another order give the same steps.
            steps.append(tuple(float(f"{x:.9g}") for x in step))
            if len(steps) - done > WRITTEN:
                # The last step may still be taken back; those before it stand.
                at = stored(rated(at, steps[done:-1], names), "mixing-rates")
                done = len(steps) - 1
            if len(losses) == STEPS:
                warnings.warn(f"mixing rates have not converged in {STEPS} steps; the fit goes on", stacklevel=2)


def rated(members: DataFrame, steps: list[tuple[float, ...]], names: list[str]) -> DataFrame:
    """``members`` with the rates that the steps lead to as where the next ones start."""
    return members.select(*names, "n_tokens", rate(steps, F.col("start")).alias("start"))


def with_members(docs: DataFrame, columns: tuple[str, ...], model: Model) -> DataFrame:
    d = docs.select(*columns, tokens(F.col("text")).alias("n_tokens"), posterior(F.col("text"), model).alias("__p"))
    return d.select(*columns, "n_tokens", *[F.col("__p")[d].alias(f"p_{d}") for d in DOMAINS])


def mix(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...] = ("doc_id",), targets: dict[str, float] = TARGETS) -> DataFrame:
    """``columns`` of ``docs``, ``n_tokens``, ``p_<domain>`` and ``rate``: expected copies of the document in the mix."""
    docs = docs.select(*dict.fromkeys(("doc_id", "text", *columns)))
    with tidy(docs.sparkSession):
        model = fit(docs, labels)
    members = stored(with_members(docs, columns, model), "mixing-members")
    steps = fit_rates(members, targets)
    # A rate's steps are one expression as long as there are few; more are written in between.
    start = None
    while len(steps) > STEPS:
        members = stored(members.withColumn("__start", rate(steps[:STEPS], start)), "mixing-started")
        steps, start = steps[STEPS:], F.col("__start")
    return members.select(*columns, "n_tokens", *[f"p_{d}" for d in DOMAINS], F.round(rate(steps, start), 6).alias("rate"))


def expected_totals(mixed: DataFrame) -> DataFrame:
    """Expected tokens of each domain under the rates."""
    return mixed.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("rate")).alias(d) for d in DOMAINS])
