"""Structured Streaming: windows over events, ingestion in micro-batches, and a stateful text filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The tags that hide a model's thoughts, and what stands in their place.
OPEN, CLOSE, PLACEHOLDER = "<think>", "</think>", "THINK_TAG"
#: How long after its last piece a stream's state is kept.
IDLE_MS = 3_600_000


def event_time(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; files hold none."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their values by window and type; ``late`` sets the watermark, for streams."""
    e = event_time(events).withWatermark("ts", late) if late else events
    w = e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    e = event_time(events).withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    e = event_time(events).withWatermark("ts", late) if late else events
    s = e.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, within the watermark."""
    return event_time(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def ingest(source: DataFrame, checkpoint: str, index: Callable[[DataFrame], None], failed: Callable[[DataFrame, Exception], None] | None = None):
    """Everything that has arrived, in micro-batches; a batch that fails goes to ``failed`` and the rest goes on.

    The checkpoint makes each batch count once over restarts. Without ``failed`` the first error stops the stream, and
    its batch is tried again by the next start.
    """

    def one(batch: DataFrame, number: int) -> None:
        try:
            index(batch)
        except Exception as e:
            if failed is None:
                raise
            failed(batch, e)

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: The order in which a turn's events are sent, those of one kind by seq.
EVENTS = ("token", "trace", "citations", "usage", "meta", "compare_row", "error", "done")


def event_lines(events: DataFrame) -> DataFrame:
    """(stream_id, seq, line): server-sent events, an ``event:`` and a ``data:`` line each; nothing follows a stream's first done."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max((F.col("kind") == "done").cast("int")).over(w), F.lit(0))
    live = events.withColumn("__ended", ended).filter((F.col("__ended") == 0) & F.col("kind").isin(*EVENTS))
    return live.select("stream_id", "seq", F.concat(F.lit("event: "), "kind", F.lit("\ndata: "), F.coalesce("data", F.lit("{}")), F.lit("\n\n")).alias("line"))


@dataclass
class ThinkFilter:
    """Takes what stands between think tags out of a stream of text pieces, and keeps it as ``thoughts``.

    What is shown has ``PLACEHOLDER`` where a whole span was. The end of a piece that may be the beginning of the awaited
    tag is held back until the next piece decides. A span that never ends leaves no placeholder.
    """

    held: str = ""
    inside: bool = False
    thoughts: str = ""

    def feed(self, piece: str) -> str:
        shown, rest = "", self.held + piece
        while True:
            awaited = CLOSE if self.inside else OPEN
            text, tag, after = rest.partition(awaited)
            if not tag:
                break
            shown += PLACEHOLDER if self.inside else text
            self.thoughts += text * self.inside
            self.inside, rest = not self.inside, after
        undecided = max(n for n in range(len(awaited)) if rest.endswith(awaited[:n]))
        decided, self.held = rest[: len(rest) - undecided], rest[len(rest) - undecided :]
        self.thoughts += decided * self.inside
        return shown + decided * (not self.inside)

    def finish(self) -> str:
        """At the end, what was held back belongs where it stands."""
        rest, self.held = self.held, ""
        self.thoughts += rest * self.inside
        return rest * (not self.inside)


VISIBLE = "stream_id long, seq long, text string, thoughts string"
#: State of a stream: what its filter holds back, and its thoughts, a row for each piece that had any. New fields may only be added at the end.
HELD, THOUGHT = "held string, inside boolean", "piece string"
#: The state store that typed state needs.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class VisibleText(StatefulProcessor):
    """A filter for each stream. Thoughts are appended piece by piece, so a piece costs its own length, however long they get.

    Without ``ttl_ms`` a timer in event time ends a stream that has been idle; with it, state expires so long after it was
    last written, by the clock.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {} if self.ttl_ms is None else {"ttlDurationMs": self.ttl_ms}
        self.filter = handle.getValueState("filter", HELD, **ttl)
        self.thoughts = handle.getListState("thoughts", THOUGHT, **ttl)

    def _known(self) -> ThinkFilter:
        return ThinkFilter(*self.filter.get()) if self.filter.exists() else ThinkFilter()

    def _end(self) -> None:
        self.filter.clear()
        self.thoughts.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        f, latest = self._known(), 0
        for r in sorted(rows, key=lambda r: r["seq"]):
            text = f.feed(r["delta"] or "")
            latest = max(latest, int(r["ts"].timestamp() * 1000))
            if not r["last"]:
                yield Row(stream_id=key[0], seq=r["seq"], text=text, thoughts=None)
                continue
            text += f.finish()
            before = "".join(x[0] for x in self.thoughts.get())
            yield Row(stream_id=key[0], seq=r["seq"], text=text, thoughts=before + f.thoughts)
            self._end()
            return
        self.filter.update((f.held, f.inside))
        if f.thoughts:
            self.thoughts.appendValue((f.thoughts,))
        if self.ttl_ms is None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(latest + IDLE_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self._end()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802, N803
        """A stream that began elsewhere: (stream_id, held, inside, thoughts) of its filter."""
        self.filter.update((initialState["held"] or "", bool(initialState["inside"])))
        if initialState["thoughts"]:
            self.thoughts.appendValue((initialState["thoughts"],))

    def close(self) -> None:
        pass


def visible_text(deltas: DataFrame, idle: str = "1 hour", initial: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """Streaming: (stream_id, seq, delta, last, ts) to (stream_id, seq, text, thoughts), with a filter's state for each stream.

    Pieces of a stream within a micro-batch are taken by seq. ``thoughts`` are those of the whole stream, on its last piece;
    what comes after that begins a stream anew. State goes with the last piece, or when the watermark says that a stream
    has been idle (with ``ttl_ms``: when it has expired). ``initial`` is the state of streams that began elsewhere:
    (stream_id, held, inside, thoughts). Sets the session's state store to one that holds typed state.
    """
    deltas.sparkSession.conf.set(*PROVIDER)
    timed = deltas.withColumn("ts", F.col("ts").cast("timestamp"))
    if ttl_ms is None:
        timed = timed.withWatermark("ts", idle)
    known = None if initial is None else initial.select("stream_id", "held", "inside", "thoughts").groupBy("stream_id")
    return timed.groupBy("stream_id").transformWithState(VisibleText(ttl_ms), VISIBLE, "Append", "EventTime" if ttl_ms is None else "ProcessingTime", known)


def visible_text_batch(deltas: DataFrame) -> DataFrame:
    """The same over finished streams: a stream's pieces are one answer, so one row (stream_id, text, thoughts)."""
    rows = deltas.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("x"))
    whole = rows.select("stream_id", F.array_join(F.transform("x", lambda r: r["delta"]), "").alias("t"))
    shown = F.regexp_replace(F.regexp_replace("t", f"(?s){OPEN}.*?{CLOSE}", PLACEHOLDER), rf"(?s){OPEN}.*\z", "")
    spans = F.regexp_extract_all("t", F.lit(rf"(?s){OPEN}(.*?)(?:{CLOSE}|\z)"), F.lit(1))
    return whole.select("stream_id", shown.alias("text"), F.array_join(spans, "").alias("thoughts"))


def tool_calls(deltas: DataFrame) -> DataFrame:
    """Fragments of tool calls, put together by stream and index."""
    rows = deltas.groupBy("stream_id", "index").agg(F.sort_array(F.collect_list(F.struct("seq", "fragment"))).alias("x"))
    return rows.select("stream_id", "index", F.array_join(F.transform("x", lambda r: r["fragment"]), "").alias("arguments"))
