"""Ingestion in stages as one stream: files arrive, are extracted, tagged and indexed, each stage once for each paper's content.

A stage's rows (paper_id, stage, digest, done, error) are written under the number of their micro-batch, so a batch that is
run again after a crash replaces what it had written, and does only what is missing. What a stage makes is kept with its
rows: a paper that could not be indexed is tried again without being extracted anew. The index remembers the names of the
writes that it has published, so a crash between that and the stage's rows adds nothing twice.

A paper that fails is kept apart inside its batch: extraction and tags fail by the row, and where the index refuses a
batch, halves of it are tried until the papers are found that it refuses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import models as M
from tessera.index import Index
from tessera.progress import Counted, Hook
from tessera.scratch import exists

STAGES = "paper_id string, stage string, digest string, done boolean, error string"
EXTRACTED = "paper_id string, digest string, markdown string"
LANDED = "path string, modificationTime timestamp, length long, content binary"


class Ingestion:
    """``extract`` takes (paper_id, content) and gives (paper_id, markdown, error) with one of the two null, a row for each paper.

    ``hook`` hears of each stage of each batch how many papers have been through it.
    """

    def __init__(self, index: Index, path: str, extract: Callable[[DataFrame], DataFrame], tagger: M.LanguageModel | None = None, name: str = "ingestion", hook: Hook | None = None):
        self.index, self.path, self.extract, self.tagger, self.name, self.hook = index, path.rstrip("/"), extract, tagger, name, hook
        self.spark: SparkSession = index.spark

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(f"{schema}, batch string, part string").parquet(at).drop("batch", "part") if exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, batch: str, part: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}/part={part}")

    def stages(self) -> DataFrame:
        return self._table("stages", STAGES)

    def _missing(self, rows: DataFrame, stage: str) -> DataFrame:
        """Papers whose content has not been through the stage."""
        return rows.join(self.stages().filter((F.col("stage") == stage) & F.col("done")).select("paper_id", "digest"), ["paper_id", "digest"], "left_anti")

    def pending(self) -> DataFrame:
        """(paper_id, digest, markdown) of what is extracted and not indexed: the latest content of each paper, older ones are past."""
        at = f"{self.path}/extracted"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], EXTRACTED)
        rows = self.spark.read.schema(f"{EXTRACTED}, batch string, part string").parquet(at)
        last = rows.groupBy("paper_id").agg(F.max_by("digest", F.col("batch").cast("long")).alias("digest"))
        return self._missing(rows.select("paper_id", "digest", "markdown").join(last, ["paper_id", "digest"], "left_semi"), "index").dropDuplicates(["paper_id", "digest"])

    def _commit(self, rows: DataFrame, stage: str, batch: str, part: str | None = None) -> None:
        told = rows.select("paper_id", F.lit(stage).alias("stage"), "digest", F.col("error").isNull().alias("done"), "error")
        Counted(stage, self.hook).write(told, lambda df: self._write(df, "stages", batch, part or stage))

    def batch(self, landed: DataFrame, number: int | str) -> None:
        """One micro-batch of (paper_id, content): extraction of what is new, then tags and index of what was extracted in it."""
        key = str(number)
        digested = landed.select("paper_id", "content", F.sha2("content", 256).alias("digest")).dropDuplicates(["paper_id", "digest"])
        new = self._missing(digested, "extract")
        if not new.isEmpty():
            made = self.extract(new.select("paper_id", "content")).join(new.select("paper_id", "digest"), "paper_id")
            self._write(made.select("paper_id", "digest", "markdown", "error"), "made", key, "all")
            made = self.spark.read.schema("paper_id string, digest string, markdown string, error string").parquet(f"{self.path}/made/batch={key}/part=all")
            self._write(made.filter("error IS NULL").select("paper_id", "digest", "markdown"), "extracted", key, "all")
            self._commit(made, "extract", key)
        here = f"{self.path}/extracted/batch={key}/part=all"
        if exists(self.spark, here):
            self.index_papers(self.spark.read.schema(EXTRACTED).parquet(here), key)

    def index_papers(self, papers: DataFrame, key: str) -> None:
        """Tags, each asked for once, and the index."""
        due = self._missing(papers, "index")
        if due.isEmpty():
            return
        if self.tagger is not None:
            asked = self._missing(due, "tag")
            if not asked.isEmpty():
                self._write(M.tagged(asked, self.tagger).join(asked.select("paper_id", "digest"), "paper_id"), "tags", key, "all")
                self._commit(asked.withColumn("error", F.lit(None).cast("string")), "tag", key)
        tags = self._table("tags", "paper_id string, tags array<string>, digest string")
        self._index(due, tags, key, "")

    def _index(self, due: DataFrame, tags: DataFrame, key: str, place: str) -> None:
        """All of ``due`` at once, or its halves, down to the papers that the index refuses. ``place`` names a half, so no write is published twice."""
        known = due.join(tags, ["paper_id", "digest"], "left_semi").select("paper_id", "digest").join(tags, ["paper_id", "digest"]).select("paper_id", "tags")
        try:
            self.index.add(due.select("paper_id", "markdown"), known, once=f"{self.name}:{key}:{place}")
            failed = None
        except Exception as e:
            failed = str(e).strip().splitlines()[0][:300] or type(e).__name__
        if failed is None or due.count() <= 1:
            self._commit(due.withColumn("error", F.lit(failed).cast("string")), "index", key, f"index{place}")
            return
        half = F.pmod(F.shiftright(F.xxhash64("paper_id"), len(place)), F.lit(2))
        for i in range(2):
            part = due.filter(half == i)
            if not part.isEmpty():
                self._index(part, tags, key, f"{place}{i}")

    def stream(self, source: str, files_per_batch: int | None = None):
        """All files that have arrived in ``source`` and weren't taken before; a paper is called by its file's name without the suffix."""
        read = self.spark.readStream.format("binaryFile").schema(LANDED).option("recursiveFileLookup", True)
        if files_per_batch:
            read = read.option("maxFilesPerTrigger", files_per_batch)
        name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
        landed = read.load(source).select(name.alias("paper_id"), "content")
        return landed.writeStream.queryName(self.name).foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def run(self, source: str, files_per_batch: int | None = None, timeout: int = 3600) -> DataFrame:
        """Takes what has arrived, polls again until nothing more has, and tries what is pending from before once more.

        Returns (paper_id, stage, error) of what still fails.
        """
        before = self.pending().select("paper_id", "digest")
        waiting = before.collect() if before.limit(1).count() else []
        while True:
            known = self.stages().filter("stage = 'extract'").count()
            query = self.stream(source, files_per_batch)
            if not query.awaitTermination(timeout):
                query.stop()
                raise TimeoutError(f"{self.name}: not ready after {timeout} s")
            if self.stages().filter("stage = 'extract'").count() == known:
                break
        if waiting:
            again = self.pending().join(self.spark.createDataFrame(waiting, "paper_id string, digest string"), ["paper_id", "digest"], "left_semi")
            self.index_papers(again, f"again-{self.index.version()}")
        done = self.stages().filter("done").select("paper_id", "stage", "digest")
        return self.stages().filter("NOT done").join(done, ["paper_id", "stage", "digest"], "left_anti").groupBy("paper_id", "stage").agg(F.max("error").alias("error"))
