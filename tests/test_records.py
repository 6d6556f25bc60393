"""VARIANT stores: drifting records, bad ones beside good ones."""

import json

from pyspark.sql import functions as F

from tessera.sources import records as V


def store(tmp_path, **files):
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(value if isinstance(value, str) else json.dumps(value, indent=1))
    return str(tmp_path)


def test_chats_with_drift_and_bad_records(spark, tmp_path):
    chat = {"id": "a", "name": "", "updated_at": "2", "turns": [{"question": "q1", "answer": "x"}, 7, {"question": ["no text"], "answer": 5, "later": {"x": 1}}]}
    at = store(tmp_path, a=chat, b="{broken", c={"id": "c", "name": "C", "updated_at": "3"}, d=["no chat"], e="null")
    rows = V.read(spark, at)
    assert [(r["id"], r["name"], r["n_turns"]) for r in V.sessions(rows).collect()] == [("c", "C", 0), ("a", "New chat", 3)]
    got = V.turns(rows).orderBy("turn").select("turn", "question", "answer", F.try_variant_get("record", "$.later.x", "int").alias("later")).collect()
    assert [(r["turn"], r["answer"], r["later"]) for r in got] == [(0, "x", None), (1, None, None), (2, "5", 1)] and got[0]["question"] == "q1"
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in V.refused(rows).collect()} == {"b.json": "no record", "d.json": "without $.id", "e.json": "no record"}


def test_notes_and_lines(spark, tmp_path):
    at = store(tmp_path / "n" if (tmp_path / "n").mkdir() is None else tmp_path, p=[{"id": "1", "paper_id": "p", "note": "x"}, {"paper_id": "p"}, "?"], q="[")
    assert [(r["id"], r["note"]) for r in V.annotations(V.read(spark, at)).collect()] == [("1", "x")]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\n\n{oops\n{"id": "2"}\n')
    rows = V.read(spark, str(tmp_path / "l.jsonl"), lines=True)
    assert sorted(r["id"] for r in rows.select(V.field(F.col("record"), "$.id", "string").alias("id")).collect() if r["id"]) == ["1", "2"] and rows.filter("error IS NOT NULL").count() == 1


def test_records_are_kept_as_they_are(spark, tmp_path):
    at = store(tmp_path, a={"id": "a", "odd": [1, {"z": None}]})
    V.read(spark, at).write.parquet(str(tmp_path / "kept"))
    kept = spark.read.parquet(str(tmp_path / "kept"))
    assert json.loads(kept.select(F.to_json("record").alias("j")).first()["j"]) == {"id": "a", "odd": [1, {"z": None}]}
