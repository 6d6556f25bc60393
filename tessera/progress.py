"""Progress of writes and streams, from metrics that their own jobs gather: nothing is counted twice, and no job is run for it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

#: what, rows done, rows in all (None where that isn't known), seconds left (None where they can't be told).
Hook = Callable[[str, int, int | None, float | None], None]
METRIC = "tessera_rows"


def seconds_left(elapsed: float, done: int, total: int | None) -> float | None:
    """At the pace so far; as ``arms.remaining`` says it of columns."""
    return elapsed / done * max(0, total - done) if done and total is not None else None


class Counted:
    """Rows of several writes towards one total: each write reports to the hook once, when it is done."""

    def __init__(self, what: str, hook: Hook | None, total: int | None = None):
        self.what, self.hook, self.total, self.done, self.began = what, hook, total, 0, time.monotonic()

    def write(self, df: DataFrame, save: Callable[[DataFrame], None]) -> int:
        """``save`` writes the rows that it is given; returns how many they were."""
        seen = Observation()
        save(df.observe(seen, F.count(F.lit(1)).alias("rows")))
        n = seen.get["rows"]
        self.done += n
        if self.hook is not None:
            self.hook(self.what, self.done, self.total, seconds_left(time.monotonic() - self.began, self.done, self.total))
        return n


def counted(stream: DataFrame) -> DataFrame:
    """A stream whose rows a ``StreamProgress`` hears of."""
    return stream.observe(METRIC, F.count(F.lit(1)).alias("rows"))


class StreamProgress(StreamingQueryListener):
    """Reports to the hook after every micro-batch of ``counted`` streams; what is done never falls. Add it by ``spark.streams.addListener``."""

    def __init__(self, hook: Hook, total: int | None = None):
        self.hook, self.total, self.done, self.began = hook, total, {}, {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.began[str(event.runId)] = time.monotonic()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        metrics = p.observedMetrics.get(METRIC)
        if metrics is None or not metrics["rows"]:
            return
        run = str(p.runId)
        self.done[run] = self.done.get(run, 0) + metrics["rows"]
        elapsed = time.monotonic() - self.began.get(run, time.monotonic())
        self.hook(p.name or run, self.done[run], self.total, seconds_left(elapsed, self.done[run], self.total))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.done.pop(str(event.runId), None)
        self.began.pop(str(event.runId), None)
