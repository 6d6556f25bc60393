"""The corpus pipeline: quality rules, near-duplicates, decontamination, pseudonyms, mixing rates.

Every stage takes documents and returns documents: what it rejects is gone, what it rewrites is rewritten. The
last one adds the mixing columns and keeps every document; a rate of 0 says that the mix has no use for it.

Defined results: a null text is an empty one, which the quality rules reject; null or repeated ids are kept apart by
their texts, so a row is judged by what it says; of repeated rows one stays; nulls in other columns stay as they are;
texts are taken whole, whatever their length; columns beside those of documents are left out, whatever their names;
labels with nulls are not used, and items without words leak nowhere; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_dedup, pii, quality_rules
from tessera.llm.common import DOC_COLUMNS, stored, table
from tessera.llm.queries import KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality_rules.apply_policy(docs, "v1", DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id."""
    return near_dedup.one_of_each(docs, DOC_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), DOC_COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by keyed pseudonyms."""
    hidden = pii.pseudonymise(docs, spark.conf.get("tessera.pii.key", KEY), DOC_COLUMNS)
    return hidden.withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with tokens, posteriors and rates."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), DOC_COLUMNS)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("mixing", mixture),
]
#: Random matrices and components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each but the last written to the shared folder, as the next ones read it many times."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
