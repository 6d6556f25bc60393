"""The index as a log: crashes, readers in between, concurrent writers, compaction, and statistics without a rebuild."""

import pytest
from pyspark.sql import functions as F

from tessera import models as M
from tessera.index import Conflict, Index, Snapshot, ingest
from tessera.operators import retrieval as R
from tests.test_engine import paper, pool


@pytest.fixture
def index(spark, tmp_path):
    return Index(spark, str(tmp_path / "i"), M.HashingEmbedder(), buckets=2)


def held(index, version=None):
    return sorted((r["paper_id"], r["chunk_id"]) for r in index.chunks(version).collect())


def same_as_rebuilt(index):
    """Statistics and postings equal those made anew from the chunks that count."""
    kept, made = index.lexical(), R.lexical_index(index.chunks())
    rows = lambda df, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    assert rows(kept.terms, "term", "df", "idf") == rows(made.terms, "term", "df", "idf")
    assert rows(kept.corpus, "n_docs", "avgdl") == rows(made.corpus, "n_docs", "avgdl")
    assert rows(kept.postings, "chunk_id", "dl", "term", "tf") == rows(made.postings, "chunk_id", "dl", "term", "tf")
    assert index.count() == index.chunks().count()


def test_statistics_follow_changes_without_a_rebuild(spark, index):
    index.add(pool(spark, a=paper("tide"), b=paper("kiln")))
    same_as_rebuilt(index)
    index.add(pool(spark, c=paper("moss", 5), a=paper("tide", 1)))
    same_as_rebuilt(index)
    index.remove(pool(spark, b=""))
    same_as_rebuilt(index)
    assert {r["paper_id"]: r["n_chunks"] for r in index.manifest().collect()} == {p: index.where(paper_id=p).count() for p in "ac"}
    index.add(pool(spark, b=paper("kiln", 2)))
    index.compact(2)
    same_as_rebuilt(index)
    assert {p for p, _ in held(index)} == {"a", "b", "c"} and len(index.snapshot().segments) == 3
    index.compact()
    same_as_rebuilt(index)
    assert len(index.snapshot().segments) == 1


def test_an_add_reads_nothing_old(spark, index, tmp_path):
    """The first segment's files are gone; an add doesn't miss them."""
    index.add(pool(spark, a=paper("tide")))
    first = index.snapshot().segments[0]
    (tmp_path / "i" / "segments" / first).rename(tmp_path / "away")
    rows = index.add(pool(spark, b=paper("kiln"))).collect()
    assert [r["paper_id"] for r in rows] == ["b"] and rows[0]["n_chunks"] > 0
    (tmp_path / "away").rename(tmp_path / "i" / "segments" / first)
    assert {p for p, _ in held(index)} == {"a", "b"}


def test_a_crash_before_publishing_is_never_seen(spark, index, monkeypatch):
    index.add(pool(spark, a=paper("tide")))
    before = held(index)
    with monkeypatch.context() as m:
        m.setattr(Index, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            index.add(pool(spark, a=paper("tide", 1), b=paper("kiln")))
    assert held(index) == before and held(Index(spark, index.path, M.HashingEmbedder())) == before
    assert len(index.vacuum()) == 1 and held(index) == before
    index.add(pool(spark, b=paper("kiln")))
    assert {p for p, _ in held(index)} == {"a", "b"}


def test_a_reader_keeps_its_snapshot(spark, index):
    index.add(pool(spark, a=paper("tide")))
    version, reading = index.version(), index.chunks()
    before = held(index)
    index.add(pool(spark, a=paper("tide", 1)))
    index.remove(pool(spark, a=""))
    index.compact()
    assert sorted((r["paper_id"], r["chunk_id"]) for r in reading.collect()) == before == held(index, version)
    assert held(index) == [] and index.count() == 0
    assert len(index.vacuum(1)) == 3 and index.versions() == [index.version()]


def test_writers_at_the_same_time(spark, index, monkeypatch):
    """Another add is published while this one is about to: both are there, and the later wins."""
    other = Index(spark, index.path, M.HashingEmbedder())
    true, done = Index._write, []

    def late(self, snapshot):
        if self is index and not done:
            done.append(1)
            other.add(pool(spark, a=paper("moss", 1), b=paper("kiln")))
        return true(self, snapshot)

    monkeypatch.setattr(Index, "_write", late)
    index.add(pool(spark, a=paper("tide")))
    assert {p for p, _ in held(index)} == {"a", "b"} and index.where(paper_id="a").filter(F.col("text").contains("On tide")).count() > 0
    with pytest.raises(Conflict):
        other._write(Snapshot(index.version(), (), {}))
    # A compaction keeps what is added meanwhile, and gives way to another compaction.
    done.append(2)
    monkeypatch.setattr(Index, "_segment", lambda self, *a, s=Index._segment, **k: (s(self, *a, **k), other.add(pool(spark, c=paper("moss"))) if k and self is index else None)[0])
    index.compact()
    assert {p for p, _ in held(index)} == {"a", "b", "c"} and len(index.snapshot().segments) == 2
    monkeypatch.setattr(Index, "_segment", lambda self, *a, s=Index._segment, **k: (s(self, *a, **k), other.compact() if k and self is index else None)[0])
    with pytest.raises(Conflict):
        index.compact()
    assert {p for p, _ in held(index)} == {"a", "b", "c"}


def test_ingestion_of_what_was_removed(spark, index):
    ingest(index, pool(spark, a=paper("tide")))
    index.remove(pool(spark, a=""))
    ingest(index, pool(spark, a=paper("tide")))
    assert {p for p, _ in held(index)} == {"a"}
