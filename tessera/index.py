"""The life of an index, as a log: immutable segments, and snapshots that say which of them count.

An add or a removal writes one segment of its own (chunks with vectors, postings, document frequencies, and the papers that
it touches) and reads nothing that was there before. It appears when the next snapshot is published, a small file that is
created under its number or not at all; what crashes before that is never seen, and ``vacuum`` deletes it. A reader keeps the
snapshot that it has read. The latest segment that names a paper holds it; rows of the paper in older ones are left out by an
anti-join, until ``compact`` writes a run of segments anew without them.

Lexical statistics need no rebuild: sizes are sums over the papers that count, and document frequencies the sums of the
segments' own, less those of the papers that no longer count, which alone are looked up.
"""

from __future__ import annotations

import json
import uuid
from contextlib import suppress
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.models import Embedder, embedded
from tessera.operators import documents as D
from tessera.operators import retrieval as R
from tessera.scratch import delete, path_of

MANIFEST = "paper_id string, title string, n_chunks long, tags array<string>"
PAPERS = f"{MANIFEST}, n_tokens long, removed boolean, segment string"
CHUNKS = (
    "chunk_id string, text string, body string, paper_id string, paper_title string, section_number string, section_title string, "
    "section_index int, breadcrumb string, part int, n_parts int, approx_tokens int, embedding array<float>"
)
POSTINGS = "chunk_id string, dl int, term string, tf long, paper_id string, segment string"
TERMS = "term string, df long, segment string"
SCHEMAS = {"chunks": f"{CHUNKS}, segment string", "papers": PAPERS, "postings": POSTINGS, "terms": TERMS}


#: Names of writes that a snapshot remembers, so that none is published twice.
REMEMBERED = 256


class Conflict(RuntimeError):
    """Another writer has changed what this one builds on."""


@dataclass(frozen=True)
class Snapshot:
    version: int
    segments: tuple[str, ...]
    properties: dict


class Index:
    """Papers in, chunks out; ``path`` is a folder that driver and executors share. ``buckets`` is the number of files that a compaction deals papers to."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, buckets: int = 64, reset: bool = False, **chunking):
        self.spark, self.path, self.embedder, self.buckets, self.chunking = spark, path.rstrip("/"), embedder, buckets, chunking
        self._known: dict[int, DataFrame] = {}
        if reset:
            self.drop()
        if self.version() is None:
            # Where another writer opens it at the same time, theirs counts.
            with suppress(Conflict):
                self._write(Snapshot(0, (), {"embedder": embedder.name, "space": "cosine", "buckets": buckets}))
        said = self.snapshot().properties
        if said["embedder"] != embedder.name:
            raise ValueError(f"the index has vectors of {said['embedder']}, not of {embedder.name}: reset it, or use that one")
        self.buckets = said["buckets"]

    # Snapshots.

    def versions(self) -> list[int]:
        fs, at = path_of(self.spark, f"{self.path}/snapshots")
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The one of a version, else the latest."""
        version = self.version() if version is None else version
        fs, at = path_of(self.spark, f"{self.path}/snapshots/{version:012d}.json")
        stream = fs.open(at)
        try:
            said = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(version, tuple(said["segments"]), said["properties"])

    def _write(self, snapshot: Snapshot) -> None:
        """Creates the snapshot under its number, whole, unless there is one: then it is a Conflict."""
        sc = self.spark.sparkContext
        jvm = sc._jvm
        fs, draft = path_of(self.spark, f"{self.path}/snapshots/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(json.dumps({"segments": snapshot.segments, "properties": snapshot.properties}).encode())
        out.close()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots/{snapshot.version:012d}.json")
        try:
            # A rename that never replaces what is there.
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
            files.rename(fs.makeQualified(draft), fs.makeQualified(at), sc._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if fs.exists(at):
                raise Conflict(f"snapshot {snapshot.version} is another's") from e
            raise

    def _publish(self, segment: str, once: str | None = None) -> None:
        """Appends the segment to whatever is the latest snapshot: what was published in between stays, before it.

        A write that is named by ``once`` is published together with its name, and not where the name is there already.
        """
        while True:
            last = self.snapshot()
            done = last.properties.get("done", [])
            if once in done:
                return
            named = last.properties if once is None else last.properties | {"done": [*done, once][-REMEMBERED:]}
            try:
                return self._write(Snapshot(last.version + 1, (*last.segments, segment), named))
            except Conflict:
                continue

    # Reading.

    def _read(self, table: str, segments: tuple[str, ...]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.path}/segments/{s}/{table}" for s in segments])

    def _log(self, segments: tuple[str, ...]) -> DataFrame:
        """The segments' papers, each with the place of its segment and that of the latest one that names the paper."""
        order = self.spark.createDataFrame(list(zip(segments, range(len(segments)))), "segment string, at int")
        log = self._read("papers", segments).join(F.broadcast(order), "segment")
        return log.join(log.groupBy("paper_id").agg(F.max("at").alias("latest")), "paper_id")

    def _dead(self, at: Snapshot) -> DataFrame | None:
        """(paper_id, segment) whose rows no longer count; None where all do."""
        if at.version not in self._known:
            dead = self._log(at.segments).filter("at < latest AND n_chunks > 0").select("paper_id", "segment").distinct()
            self._known = {at.version: None if len(at.segments) < 2 or dead.isEmpty() else dead}
        return self._known[at.version]

    def _live(self, table: str, at: Snapshot) -> DataFrame:
        rows, dead = self._read(table, at.segments), self._dead(at)
        return rows if dead is None else rows.join(R.sized_broadcast(dead), ["paper_id", "segment"], "left_anti")

    def _columns(self, schema: str) -> list[str]:
        return [c.split()[0] for c in schema.split(", ")]

    def chunks(self, version: int | None = None) -> DataFrame:
        return self._live("chunks", self.snapshot(version)).select(*self._columns(CHUNKS))

    def _papers(self, at: Snapshot) -> DataFrame:
        return self._log(at.segments).filter("at = latest AND NOT removed")

    def manifest(self, version: int | None = None) -> DataFrame:
        return self._papers(self.snapshot(version)).select(*self._columns(MANIFEST))

    def count(self) -> int:
        return self._papers(self.snapshot()).agg(F.sum("n_chunks")).first()[0] or 0

    def where(self, **equal) -> DataFrame:
        """Chunks of which all the columns have the given values; the conditions reach the scan."""
        out = self.chunks()
        for column, value in equal.items():
            out = out.filter(F.col(column) == value)
        return out

    def ids_of(self, paper_id: str) -> DataFrame:
        return self.where(paper_id=paper_id).select("chunk_id")

    def by_ids(self, ids: DataFrame) -> DataFrame:
        return self.chunks().join(R.sized_broadcast(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")

    def lexical(self, k1: float = R.K1, b: float = R.B) -> R.LexicalIndex:
        """The lexical tables of the latest snapshot, from the segments' own: no text is read."""
        at = self.snapshot()
        terms, dead = self._read("terms", at.segments).select("term", "df"), self._dead(at)
        if dead is not None:
            gone = self._read("postings", at.segments).join(R.sized_broadcast(dead), ["paper_id", "segment"], "left_semi")
            terms = terms.unionByName(gone.groupBy("term").agg((-F.count(F.lit(1))).alias("df")))
        known = terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").withColumn("tokens", F.lit(None).cast("long"))
        sizes = self._papers(at).agg(F.sum("n_chunks").alias("df"), F.sum("n_tokens").alias("tokens")).filter("df > 0")
        vocab = known.unionByName(sizes.select(F.lit(None).cast("string").alias("term"), "df", "tokens"))
        return R.LexicalIndex(self._live("postings", at).select("chunk_id", "dl", "term", "tf"), R.term_stats(vocab), R.corpus_stats(vocab))

    # Writing.

    def _segment(self, chunks: DataFrame, papers: DataFrame, sorted_by_paper: bool = False) -> str:
        """Writes a segment, unseen until it is published: chunks once, and the other tables from what was written."""
        name = uuid.uuid4().hex
        at = f"{self.path}/segments/{name}"
        marked = chunks.select(*self._columns(CHUNKS)).withColumn("segment", F.lit(name))
        if sorted_by_paper:
            marked = marked.repartition(self.buckets, "paper_id").sortWithinPartitions("paper_id", "section_index", "part")
        marked.write.parquet(f"{at}/chunks")
        own = self._read("chunks", (name,))
        R.postings(own.select("chunk_id", "text")).join(own.select("chunk_id", "paper_id").distinct(), "chunk_id").withColumn("segment", F.lit(name)).select(*self._columns(POSTINGS)).write.parquet(f"{at}/postings")
        posted = self._read("postings", (name,))
        posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("segment", F.lit(name)).write.parquet(f"{at}/terms")
        sizes = own.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.size(R.words(F.col("text")))).alias("n_tokens"))
        full = papers.join(sizes, "paper_id", "left").withColumn("segment", F.lit(name))
        none = F.lit(0).cast("long")
        full.select("paper_id", "title", F.coalesce("n_chunks", none).alias("n_chunks"), "tags", F.coalesce("n_tokens", none).alias("n_tokens"), "removed", "segment").write.parquet(f"{at}/papers")
        return name

    def add(self, pool: DataFrame, tags: DataFrame | None = None, once: str | None = None) -> DataFrame:
        """Chunk, embed and store the papers of (paper_id, markdown); what their older chunking left behind no longer counts.

        Returns their manifest rows (paper_id, title, n_chunks, tags). With ``once``, the name of this write, a second call
        of the same name (after a crash, say) does nothing.
        """
        if once is not None and once in self.snapshot().properties.get("done", []):
            return self.manifest().join(pool.select(F.col("paper_id").cast("string").alias("paper_id")), "paper_id", "left_semi")
        pool = pool.select(F.col("paper_id").cast("string").alias("paper_id"), F.coalesce("markdown", F.lit("")).alias("markdown"))
        papers = pool.select("paper_id", T.title(F.col("markdown")).alias("title"), F.lit(False).alias("removed"))
        papers = papers.join(tags, "paper_id", "left") if tags is not None else papers.withColumn("tags", F.lit(None).cast("array<string>"))
        papers = papers.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
        segment = self._segment(embedded(D.chunks(pool, **self.chunking), self.embedder), papers)
        self._publish(segment, once)
        return self._read("papers", (segment,)).select(*self._columns(MANIFEST))

    def remove(self, papers: DataFrame) -> None:
        """All that the index has of the papers: a segment that only says so."""
        gone = papers.select(F.col("paper_id").cast("string").alias("paper_id")).distinct()
        told = gone.select("paper_id", F.lit("").alias("title"), F.lit(True).alias("removed"), F.array().cast("array<string>").alias("tags"))
        self._publish(self._segment(self.spark.createDataFrame([], CHUNKS), told))

    def compact(self, last: int | None = None) -> None:
        """Writes the last so many segments, all by default, as one, without what no longer counts.

        Segments that are published meanwhile stay, after it. A removal is kept where an older segment may hold the paper.
        """
        before = self.snapshot()
        run = before.segments[-last:] if last else before.segments
        if len(run) < 2:
            return
        chunks = self._live("chunks", before).filter(F.col("segment").isin(*run)) if set(run) != set(before.segments) else self._live("chunks", before)
        log = self._log(before.segments).filter("at = latest").filter(F.col("segment").isin(*run))
        if run == before.segments:
            log = log.filter("NOT removed")
        segment = self._segment(chunks, log.select("paper_id", "title", "removed", "tags"), sorted_by_paper=True)
        while True:
            now = self.snapshot()
            start = next((i for i in range(len(now.segments)) if now.segments[i : i + len(run)] == run), None)
            if start is None:
                delete(self.spark, f"{self.path}/segments/{segment}")
                raise Conflict("another compaction has replaced these segments")
            merged = (*now.segments[:start], segment, *now.segments[start + len(run) :])
            with suppress(Conflict):
                return self._write(Snapshot(now.version + 1, merged, now.properties))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes all snapshots but the last ``keep``, and the segments that none of these has. Run it while nothing writes."""
        versions = self.versions()
        kept = {s for v in versions[-keep:] for s in self.snapshot(v).segments}
        for v in versions[:-keep]:
            delete(self.spark, f"{self.path}/snapshots/{v:012d}.json")
        fs, at = path_of(self.spark, f"{self.path}/segments")
        gone = [f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName() not in kept] if fs.exists(at) else []
        for name in gone:
            delete(self.spark, f"{self.path}/segments/{name}")
        return gone

    def drop(self) -> None:
        self._known = {}
        for table in ("snapshots", "segments"):
            delete(self.spark, f"{self.path}/{table}")


def ingest(index: Index, pool: DataFrame, fail_fast: bool = False) -> DataFrame:
    """Papers that the manifest hasn't got, in one batch: (paper_id, error) of those that could not be taken in.

    A paper without text is an error. With ``fail_fast`` the first error stops it, before anything is stored.
    """
    pending = pool.join(index.manifest().select("paper_id"), "paper_id", "left_anti")
    empty = F.trim(F.coalesce("markdown", F.lit(""))) == ""
    bad = pending.filter(empty).select("paper_id", F.lit("no text").alias("error"))
    if fail_fast and not bad.isEmpty():
        raise ValueError(f"no text: {bad.first()['paper_id']}")
    index.add(pending.filter(~empty))
    return bad
