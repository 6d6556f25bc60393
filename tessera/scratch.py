"""Tables between the jobs of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The setting that bounds batches to Python by their bytes, and what it is while tables are written: rows may be large.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a local folder where it is unset and the master is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/tessera-scratch"


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """``df`` written and read back: its lineage is cut, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    usual = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(BATCH, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def path_of(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = path_of(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = path_of(spark, path)
    fs.delete(at, True)
