"""Staged ingestion: one bad paper among good ones, a crash at each point, and that no stage is run twice."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import models as M
from tessera.index import Index
from tessera.streaming.ingestion import Ingestion
from tests.test_engine import paper


class Reading:
    """Extraction that notes each paper it is given, and fails on some."""

    def __init__(self, log):
        self.log = str(log)

    def __call__(self, rows):
        log = self.log

        def run(batches):
            for b in batches:
                out = []
                for name, content in zip(b["paper_id"], b["content"]):
                    with open(log, "a") as f:
                        f.write(f"{name}\n")
                    text = bytes(content).decode()
                    out.append((name, None, "unreadable") if text == "broken" else (name, text, None))
                yield pd.DataFrame(out, columns=["paper_id", "markdown", "error"])

        return rows.mapInPandas(run, "paper_id string, markdown string, error string")

    def seen(self):
        try:
            return sorted(open(self.log).read().split())
        except FileNotFoundError:
            return []


class Refusing(M.HashingEmbedder):
    """An embedder that fails on some texts as long as a file is there."""

    def __init__(self, marker):
        super().__init__()
        self.marker = str(marker)

    def documents(self, texts):
        import os

        if os.path.exists(self.marker) and any("poison" in t for t in texts):
            raise RuntimeError("refused")
        return super().documents(texts)


class Tagger:
    def complete(self, system, user, max_tokens=0):
        if "kiln" in user:
            raise RuntimeError("no answer")
        return 'Here: ["Sea Water", "sea-water", "Moon!", ""]'


@pytest.fixture
def made(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "marker").touch()
    read = Reading(tmp_path / "log")
    index = Index(spark, str(tmp_path / "index"), Refusing(tmp_path / "marker"), buckets=2)
    return tmp_path, read, index, lambda **more: Ingestion(index, str(tmp_path / "state"), read, Tagger(), **more)


def put(tmp_path, **papers):
    for name, text in papers.items():
        (tmp_path / "in" / f"{name}.md").write_text(text)


def test_one_bad_paper_does_not_fail_its_batch(spark, made):
    tmp_path, read, index, ingestion = made
    put(tmp_path, a=paper("tide"), b=paper("kiln"), c="broken", d=paper("moss") + "\n## 9 Last\n" + "poison " * 40)
    left = {tuple(r) for r in ingestion().run(str(tmp_path / "in")).collect()}
    assert {(p, s) for p, s, _ in left} == {("c", "extract"), ("d", "index")}
    rows = {r["paper_id"]: r["tags"] for r in index.manifest().collect()}
    assert rows == {"a": ["sea-water", "moon"], "b": []}
    # What failed is tried again by the next run; what was extracted isn't extracted anew.
    (tmp_path / "marker").unlink()
    put(tmp_path, e=paper("tide", 2, 5))
    assert {tuple(r)[:2] for r in ingestion().run(str(tmp_path / "in")).collect()} == {("c", "extract")}
    assert {r["paper_id"] for r in index.manifest().collect()} == {"a", "b", "d", "e"}
    assert read.seen() == ["a", "b", "c", "d", "e"]


@pytest.mark.parametrize("lost", ["extract", "tag", "index"])
def test_a_crash_before_a_stage_is_noted(spark, made, monkeypatch, lost):
    """The stage's work is done, its rows aren't written: the batch runs again, and the index has every paper once."""
    tmp_path, read, index, ingestion = made
    put(tmp_path, a=paper("tide"), b=paper("moss"))
    true = Ingestion._commit

    def crash(self, rows, stage, *more):
        if stage == lost:
            raise RuntimeError("lost")
        true(self, rows, stage, *more)

    with monkeypatch.context() as m:
        m.setattr(Ingestion, "_commit", crash)
        with pytest.raises(Exception, match="lost"):
            ingestion().run(str(tmp_path / "in"))
    segments = len(index.snapshot().segments)
    assert segments == (1 if lost == "index" else 0)
    assert ingestion().run(str(tmp_path / "in")).count() == 0
    assert len(index.snapshot().segments) == 1 and index.count() == index.chunks().select("chunk_id").distinct().count() > 0
    assert ingestion().stages().filter("done").groupBy("paper_id", "stage", "digest").count().filter(F.col("count") > 1).count() == 0
    if lost != "extract":
        assert read.seen() == ["a", "b"]


def test_changed_content_replaces_a_paper(spark, made):
    tmp_path, read, index, ingestion = made
    put(tmp_path, a=paper("tide"))
    said = []
    ingestion(hook=lambda *x: said.append(x[:2])).run(str(tmp_path / "in"))
    assert said == [("extract", 1), ("tag", 1), ("index", 1)]
    (tmp_path / "in" / "sub").mkdir()
    (tmp_path / "in" / "sub" / "a.md").write_text(paper("tide", 1))
    before = index.count()
    assert ingestion().run(str(tmp_path / "in")).count() == 0
    assert index.count() < before and index.manifest().count() == 1
