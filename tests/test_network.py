"""Data sources with a client that notes what it is asked: nothing twice, and no more than conditions name."""

import json

import pytest

from tessera.sources import network


@pytest.fixture
def asked(spark, tmp_path):
    """What the clients were asked so far; ``asked.settings`` tells them where to note it."""
    network.register(spark)
    log = tmp_path / "log" / "asked"
    log.parent.mkdir()
    log.write_text("")

    def seen():
        return sorted(log.read_text().split())

    seen.settings = json.dumps({"log": str(log)})
    return seen


def fetch(spark, tmp_path, asked, **options):
    return spark.read.format("tessera_fetch").options(client="tests.network_client:pages", settings=asked.settings, cache=str(tmp_path / "cache"), **options)


def test_pages_are_fetched_once(spark, tmp_path, asked):
    (tmp_path / "list").write_text("https://h/a\nhttps://h/b.pdf\nhttps://h/down\nftp://h/x\nhttps://h/a\n\n")
    read = fetch(spark, tmp_path, asked, list=str(tmp_path / "list"))
    rows = {r["url"]: (r["body"] and bytes(r["body"]), r["content_type"], r["error"]) for r in read.load().collect()}
    assert rows["https://h/a"] == (b"<p>page</p>", "text/html; charset=utf-8", None) and rows["https://h/b.pdf"][0] == b"%PDF"
    assert "down" in rows["https://h/down"][2] and rows["ftp://h/x"][2] == "address not allowed" and len(rows) == 4
    assert asked() == ["https://h/a", "https://h/b.pdf", "https://h/down"]
    # Again: what came is known, what failed is asked again. Other types than those named are errors.
    kinds = {r["url"]: r["error"] for r in fetch(spark, tmp_path, asked, list=str(tmp_path / "list"), types="application/pdf", hosts="h").load().collect()}
    assert kinds["https://h/b.pdf"] is None and kinds["https://h/a"] == "not application/pdf"
    assert asked().count("https://h/a") == 1 and asked().count("https://h/down") == 2


def test_conditions_reach_the_source(spark, tmp_path, asked):
    rows = fetch(spark, tmp_path, asked).load().filter("url IN ('https://h/1', 'https://h/2') AND error IS NULL").collect()
    assert {r["url"] for r in rows} == {"https://h/1", "https://h/2"} == set(asked())
    assert fetch(spark, tmp_path, asked).load().count() == 0
    (tmp_path / "list").write_text("\n".join(f"https://h/{i}" for i in range(50)))
    assert fetch(spark, tmp_path, asked, list=str(tmp_path / "list")).load().filter("url = 'https://h/7'").count() == 1
    assert asked() == ["https://h/1", "https://h/2", "https://h/7"]
    assert fetch(spark, tmp_path, asked, list=str(tmp_path / "list")).load().rdd.getNumPartitions() == 4


def test_searches(spark, tmp_path, asked):
    search = spark.read.format("tessera_search").options(client="tests.network_client:results", settings=asked.settings, cache=str(tmp_path / "c"), k="3").load()
    for _ in range(2):
        assert [(r["pos"], r["url"]) for r in search.filter("query = 'tides'").orderBy("pos").collect()] == [(0, "https://h/1"), (2, "https://h/2")]
    assert search.filter("query = 'fail'").count() == 0
    assert asked() == ["fail", "tides"]


def test_a_stream_takes_what_is_appended_once(spark, tmp_path, asked):
    at = tmp_path / "list"

    def run():
        stream = spark.readStream.format("tessera_fetch").options(client="tests.network_client:pages", settings=asked.settings, cache=str(tmp_path / "cache"), list=str(at)).load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(r["url"] for r in spark.read.schema(network.FETCHED).parquet(str(tmp_path / "out")).collect())

    at.write_text("https://h/1\nhttps://h/2\n")
    assert run() == ["https://h/1", "https://h/2"]
    with at.open("a") as f:
        f.write("https://h/3\n")
    assert run() == ["https://h/1", "https://h/2", "https://h/3"] == asked()


def test_annotations_by_paper(spark, tmp_path):
    network.register(spark)
    (tmp_path / "a.json").write_text('[{"note": "x"}, {"note": "y"}]')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("{}")
    notes = spark.read.format("tessera_annotations").option("path", str(tmp_path)).load()
    got = sorted((r["paper_id"], r["annotation"], r["error"] is not None) for r in notes.collect())
    assert got == [("a", '{"note": "x"}', False), ("a", '{"note": "y"}', False), ("b", None, True), ("c", None, True)]
    assert [r["pos"] for r in notes.filter("paper_id = 'a'").collect()] == [0, 1]
    assert spark.read.format("tessera_annotations").option("path", str(tmp_path / "none")).load().count() == 0
