"""Progress that grows, and that costs no job of its own."""

import pytest
from pyspark.sql import functions as F

from tessera import progress as P
from tessera.operators import arms as A


def test_writes_report_without_a_job_of_their_own(spark, tmp_path):
    said, tracker = [], spark.sparkContext.statusTracker()
    counted = P.Counted("rows", lambda *x: said.append(x), 30)
    for n in (10, 20):
        spark.sparkContext.setJobGroup(f"write-{n}", "")
        assert counted.write(spark.range(n).repartition(3), lambda df, n=n: df.write.parquet(str(tmp_path / str(n)))) == n
        with_hook = len(tracker.getJobIdsForGroup(f"write-{n}"))
        spark.sparkContext.setJobGroup(f"bare-{n}", "")
        spark.range(n).repartition(3).write.parquet(str(tmp_path / f"bare-{n}"))
        assert with_hook == len(tracker.getJobIdsForGroup(f"bare-{n}"))
    spark.sparkContext._jsc.clearJobGroup()
    assert [x[:3] for x in said] == [("rows", 10, 30), ("rows", 30, 30)] and said[0][3] > 0 and said[1][3] == 0


def test_streams_report_each_batch(spark, tmp_path):
    for n in range(3):
        spark.range(5).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    said = []
    listener = P.StreamProgress(lambda *x: said.append(x), 15)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = P.counted(stream).writeStream.queryName("numbers").format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert [x[:3] for x in said] == [("numbers", n, 15) for n in (5, 10, 15)] and said[-1][3] == 0


@pytest.mark.parametrize("elapsed, done, total", [(10.0, 2, 6), (10.0, 6, 6), (3.0, 0, 4)])
def test_time_left(spark, elapsed, done, total):
    column = spark.range(1).select(A.remaining(F.lit(elapsed), F.lit(done), F.lit(total)).alias("r")).first()["r"]
    assert column == P.seconds_left(elapsed, done, total)
