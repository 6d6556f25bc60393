import datetime

import pytest

from tessera.streaming import streams as S


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_think_filter_is_the_same_for_any_cut(size):
    text = "a<think>hidden < stuff</think>b<thi>c</think><think></think><think>x</thin"
    f = S.ThinkFilter()
    got = "".join(f.feed(text[i : i + size]) for i in range(0, len(text), size)) + f.finish()
    assert got == "aTHINK_TAGb<thi>c</think>THINK_TAG"
    assert f.thoughts == "hidden < stuffx</thin"


def test_visible_text_as_a_stream(spark, tmp_path):
    """Pieces over several micro-batches, as the batch twin sees them at once; ended streams keep no state."""
    text = {1: "one <think>no\n</think>two", 2: "<think>all", 3: "pl<ain"}
    schema = "stream_id long, seq long, delta string, last boolean, ts timestamp"
    rows = [(k, i, t[i], i == len(t) - 1, datetime.datetime(2030, 1, 1, 0, i)) for k, t in text.items() for i in range(len(t))]
    ordered = sorted(rows, key=lambda r: r[1])
    for n, part in enumerate((ordered[: len(rows) // 2], ordered[len(rows) // 2 :])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = S.visible_text(stream).writeStream.format("memory").queryName("shown").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    out = spark.sql("SELECT stream_id, concat_ws('', transform(sort_array(collect_list(struct(seq, text))), x -> x.text)) AS text, max(thoughts) AS thoughts FROM shown GROUP BY stream_id").collect()
    twin = S.visible_text_batch(spark.createDataFrame(rows, schema)).collect()
    assert {tuple(r) for r in out} == {tuple(r) for r in twin} and len(out) == 3


def test_ingestion_isolates_what_fails(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n,)], "n int").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = lambda: spark.readStream.schema("n int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    taken, failed = [], []

    def index(batch):
        n = batch.first()["n"]
        if n == 1:
            raise ValueError("bad")
        taken.append(n)

    assert S.ingest(stream(), str(tmp_path / "a"), index, lambda b, e: failed.append((b.first()["n"], str(e)))).awaitTermination(120)
    assert sorted(taken) == [0, 2] and failed == [(1, "bad")]
    again = len(taken)
    assert S.ingest(stream(), str(tmp_path / "a"), index).awaitTermination(120) and len(taken) == again


def test_stream_equals_its_batch_twin(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    q = S.tumbling(stream, late="10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    assert q.awaitTermination(90)
    got = {(r[0], r[1]): r[2] for r in spark.sql("SELECT cast(window_start AS string), event_type, n FROM tumbled").collect()}
    want = {(r[0], r[1]): r[2] for r in S.tumbling(events).selectExpr("cast(window_start AS string)", "event_type", "n").collect()}
    assert got == want


SCHEMA = "stream_id long, seq long, delta string, last boolean, ts timestamp"


def batches(spark, tmp_path, *parts):
    """A file for each micro-batch, by the order of its time."""
    import os

    for n, rows in enumerate(parts):
        at = tmp_path / "in" / str(n)
        if not at.exists():
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(at))
            for f in at.glob("part-*"):
                os.utime(f, (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run(stream, tmp_path, **more):
    q = S.visible_text(stream, **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(180)
    return q


def shown(spark, tmp_path):
    rows = spark.read.schema(S.VISIBLE).parquet(str(tmp_path / "out")).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        text, thoughts = texts.get(r["stream_id"], ("", None))
        texts[r["stream_id"]] = text + r["text"], r["thoughts"] if r["thoughts"] is not None else thoughts
    return texts


def at(minute):
    return datetime.datetime(2030, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def test_text_filter_survives_a_restart(spark, tmp_path):
    """Cut inside tags and thoughts, stopped in between, and begun elsewhere: as the batch twin sees them at once."""
    text = {1: "one <think>no\n</think>two <thi", 2: "<think>all of it", 3: "pl<ain</think>"}
    pieces = {k: [t[i : i + 3] for i in range(0, len(t), 3)] for k, t in text.items()}
    rows = [(k, i, p, i == len(x) - 1, at(i)) for k, x in pieces.items() for i, p in enumerate(x)]
    thirds = [[r for r in rows if r[1] % 100 in span] for span in (range(2), range(2, 5), range(5, 100))]
    begun = spark.createDataFrame([(9, "</th", True, "before ")], "stream_id long, held string, inside boolean, thoughts string")
    more = [[], [(9, 50, "ink>seen", True, at(3))], []]
    first = [a + b for a, b in zip(thirds, more)]
    run(batches(spark, tmp_path, *first[:1]), tmp_path, initial=begun)
    run(batches(spark, tmp_path, *first), tmp_path, initial=begun)
    twin = {r["stream_id"]: (r["text"], r["thoughts"]) for r in S.visible_text_batch(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert shown(spark, tmp_path) == twin | {9: ("THINK_TAGseen", "before ")}


def test_idle_streams_leave_no_state(spark, tmp_path):
    """A stream without a last piece is forgotten when others have gone on for longer than it may be idle; what ended is gone at once."""
    late = 10 * 60
    q = run(batches(spark, tmp_path, [(1, 0, "a<think>b", False, at(0)), (2, 0, "x", True, at(0))], [(3, 0, "y", False, at(late))], [(3, 1, "z", True, at(late + 1))], [(1, 1, "c</think>", True, at(late + 2))]), tmp_path)
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    assert shown(spark, tmp_path)[1] == ("ac</think>", "")
