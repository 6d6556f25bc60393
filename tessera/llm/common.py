"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose running sums are taken at a time.
RUN = 256
#: The setting that bounds batches to Python by their bytes, and what it is while tables are written.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that it is evaluated once in ``body``."""
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset.

    A local folder is only ever chosen for local masters, as in tests.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/tessera-checkpoints"


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def lean(run: Callable) -> Callable:
    """A function over batches that gives freed memory back to the system at its end: workers live on, idle, beside others."""

    @wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def release() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every system's library can
        ctypes.CDLL(None).malloc_trim(0)


#: The paths that are written inside each open ``tidy``, the innermost last.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    if _OPEN:
        _OPEN[-1].append(path)
    # Python holds a batch several times over: small ones, whatever the length of texts.
    usual = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is stored inside at its end, after an error too, but for the tables given to the function it yields.

    Those are the caller's, and belong to the ``tidy`` around it, if there is one.
    """
    paths: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    _OPEN.append(paths)
    done = False
    try:
        yield keep
        done = True
    finally:
        _OPEN.pop()
        for path in paths:
            if done and path in kept:
                if _OPEN:
                    _OPEN[-1].append(path)
            else:
                drop_path(spark, path)


def running(xs: Column) -> Column:
    """Sums of an array's numbers up to and with each of them; in blocks, so that no long array is copied for each element."""
    n = F.size(xs)
    empty = F.array().cast("array<long>")
    add = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + x))

    def joined(blocks: Column) -> Column:
        totals = F.aggregate(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)), empty, add)
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.get(t, i - 1)).otherwise(F.lit(0).cast("long"))))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), lambda i: F.aggregate(F.slice(xs, i * RUN + 1, RUN), empty, add))
    return F.when(n > 0, let(blocks, joined)).otherwise(empty)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
