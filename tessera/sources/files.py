"""Sources and sinks over files: markdown pools, JSON records, split writes, resumable units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA_SCHEMA = "query string, paper_id string, gold_span array<int>, source_unit string, section_number string, section_title string, stratum string, answer string"
COMPARATIVE_SCHEMA = "query string, answer string, sections array<struct<paper_id:string,number:string,title:string,body:string,start:int,end:int>>"
LABELS = ("entailment", "neutral", "contradiction")


def load_pool(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """paper_id, markdown: one row for each .md file, but for display copies; the first ``most`` papers by name, or all."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    named = files.select(F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.md$", 1).alias("paper_id"), F.col("value").alias("markdown"))
    papers = named.filter(~F.col("paper_id").endswith("_display"))
    return papers.orderBy("paper_id").limit(most) if most else papers


def shown(spark: SparkSession, path: str, papers: DataFrame) -> DataFrame:
    """paper_id, markdown of (paper_id): the copy that is made for display, where there is one, else the text; null without either."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True)
    stem = F.regexp_extract(F.url_decode(F.input_file_name()), r"([^/]+)\.md$", 1)
    both = files.select(stem.alias("stem"), F.col("value").alias("markdown"))
    each = both.select(F.regexp_replace("stem", "_display$", "").alias("paper_id"), F.col("stem").endswith("_display").alias("display"), "markdown")
    best = each.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").groupBy("paper_id").agg(F.max_by("markdown", "display").alias("markdown"))
    return papers.select("paper_id").join(best, "paper_id", "left")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items; malformed lines fail, and so does a file without section titles."""
    items = spark.read.schema(QA_SCHEMA).option("mode", "FAILFAST").json(path)
    if not items.filter("section_title IS NULL").isEmpty():
        raise ValueError("items without section_title: they were made for another kind of gold and must be made anew")
    return items


def read_comparative(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMPARATIVE_SCHEMA).option("mode", "FAILFAST").json(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled premise and hypothesis pairs; unknown labels and empty files are errors."""
    pairs = spark.read.schema("premise string, hypothesis string, label string").json(path)
    seen = pairs.groupBy("label").count().collect()
    unknown = sorted(str(r["label"]) for r in seen if r["label"] not in LABELS)
    if unknown or not seen:
        raise ValueError(f"unknown labels: {unknown}" if unknown else "no pairs")
    return pairs


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records, a file each or a line each; corrupt ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def write_splits(items: DataFrame, path: str, leaked: str | None = None) -> None:
    """By split; leaked items are left out of both, and written for audit."""
    if leaked is None:
        items.write.mode("overwrite").partitionBy("split").json(path)
        return
    gone = F.coalesce(F.col(leaked), F.lit(False))
    items.withColumn("split", F.when(gone, "leaked").otherwise(F.col("split"))).write.mode("overwrite").partitionBy("split").json(path)


def finished_units(spark: SparkSession, path: str, header: str) -> DataFrame:
    """unit, record of an earlier run with the same header; another header discards them."""
    empty = spark.createDataFrame([], "unit string, record string")
    try:
        found = spark.read.schema("header string, unit string, record string").parquet(path)
        return found.filter(F.col("header") == header).select("unit", "record")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise


def record_units(units: DataFrame, path: str, header: str) -> None:
    """Append finished units; the commit protocol leaves no half-written ones."""
    units.select(F.lit(header).alias("header"), "unit", "record").write.mode("append").parquet(path)


CONFIRMATIONS = "items string, arm string, confirmed boolean, at timestamp"


def confirmations(spark: SparkSession, path: str) -> DataFrame:
    """What was confirmed before, and on which items."""
    try:
        return spark.read.schema(CONFIRMATIONS).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], CONFIRMATIONS)
        raise


def confirm(spark: SparkSession, path: str, items: str, arm: str, confirmed: bool) -> None:
    row = spark.createDataFrame([(items, arm, confirmed)], "items string, arm string, confirmed boolean")
    row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(path)
