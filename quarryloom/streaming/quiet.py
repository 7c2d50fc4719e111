"""Re-indexing after silence, by timers.

Each project with events has a burst in the stream's state and a timer that its
next event puts off; the burst fires when the clock reaches it, whether or not
another event ever comes. What fires joins a queue of bounded length, also in
the state, of which each micro-batch gives a few to the one worker. A project
that finds the queue full is dropped and counted. All of it survives a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quarryloom.streaming.watch import project_of_stream, relevant

QUIET_MS = 500
#: Projects that may wait for the worker, and how many it takes in a micro-batch.
QUEUE, TAKE = 100, 1

#: Times of events are microseconds, those of timers milliseconds, both since the epoch.
BURST = "first long, last long, events long, due long"
FIRED = "project string, first long, last long, events long, fired_at long"
#: project is null in a row that only tells of the queue; dropped counts from the stream's beginning.
ASKED = "project string, events long, fired_at long, waiting int, dropped long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Burst(StatefulProcessor):
    """(ts, project) to FIRED: one row for each burst, quiet_ms after its last event reached the stream."""

    def __init__(self, quiet_ms: int = QUIET_MS):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self._handle = handle
        self._burst = handle.getValueState("burst", BURST)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, first, last = 0, None, None
        if self._burst.exists():
            first, last, n, due = self._burst.get()
            self._handle.deleteTimer(due)
        for r in rows:
            n += 1
            if r["ts"] is not None:
                first, last = r["ts"] if first is None else min(first, r["ts"]), r["ts"] if last is None else max(last, r["ts"])
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self._handle.registerTimer(due)
        self._burst.update((first, last, n, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._burst.exists():
            first, last, n, due = self._burst.get()
            self._burst.clear()
            yield Row(project=key[0], first=first, last=last, events=n, fired_at=due)

    def close(self) -> None:
        pass


class Queue(StatefulProcessor):
    """FIRED to ASKED: most projects wait at a time, each once, and take of them go to the worker in a micro-batch.

    A project that waits already keeps its place, and its events are added to
    those that wait; the re-index that is to come sees them all.
    """

    def __init__(self, most: int = QUEUE, take: int = TAKE):
        self.most, self.take = most, take

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "project string, events long, fired_at long")
        self._dropped = handle.getValueState("dropped", "n long")

    def _given(self, waiting: list[tuple], dropped: int, timerValues) -> Iterator[Row]:
        given, rest = waiting[: self.take], waiting[self.take :]
        self._waiting.clear()
        if rest:
            self._waiting.put(rest)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1)
        self._dropped.update((dropped,))
        for project, events, fired_at in given:
            yield Row(project=project, events=events, fired_at=fired_at, waiting=len(rest), dropped=dropped)
        if not given:
            yield Row(project=None, events=0, fired_at=None, waiting=0, dropped=dropped)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = [tuple(r) for r in self._waiting.get()]
        dropped = self._dropped.get()[0] if self._dropped.exists() else 0
        place = {w[0]: i for i, w in enumerate(waiting)}
        for t in list(self._handle.listTimers()):
            self._handle.deleteTimer(t)
        for r in sorted(rows, key=lambda r: (r["fired_at"], r["project"])):  # one for each project at most
            if (i := place.get(r["project"])) is not None:
                waiting[i] = (r["project"], waiting[i][1] + r["events"], waiting[i][2])
            elif len(waiting) < self.most:
                place[r["project"]] = len(waiting)
                waiting.append((r["project"], r["events"], r["fired_at"]))
            else:
                dropped += 1
        return self._given(waiting, dropped, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        dropped = self._dropped.get()[0] if self._dropped.exists() else 0
        return self._given([tuple(r) for r in self._waiting.get()], dropped, timerValues)

    def close(self) -> None:
        pass


def bursts(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """FIRED rows of a stream of (ts, project)."""
    own = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "project")
    return own.groupBy("project").transformWithState(Burst(quiet_ms), FIRED, "append", "processingTime")


def queued(fired: DataFrame, most: int = QUEUE, take: int = TAKE) -> DataFrame:
    """ASKED rows of a stream of FIRED ones. There is one queue, of few rows, hence one key."""
    return fired.withColumn("queue", F.lit(0)).groupBy("queue").transformWithState(Queue(most, take), ASKED, "append", "processingTime")


def watch_quiet(
    events: DataFrame, projects: DataFrame, reindex: Callable[[str], None], checkpoint: str, quiet_ms: int = QUIET_MS, most: int = QUEUE, take: int = TAKE,
    done: Callable[[str], None] | None = None, seen: Callable[[Row], None] | None = None, **trigger,
) -> StreamingQuery:
    """Starts the stream (ts, path, op): reindex(project) after each burst, one project after the other.

    done(project) follows a re-index that worked; seen gets each ASKED row, of
    which waiting and dropped tell of the queue. A re-index that raises ends the
    stream, and a restart from the checkpoint asks for it again. Timers are looked
    at in each micro-batch, so a burst fires at the first trigger after its quiet time.
    """
    spark = events.sparkSession

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("fired_at", "project").collect():  # take rows, or one
            if seen is not None:
                seen(row)
            if row["project"] is not None:
                reindex(row["project"])
                if done is not None:
                    done(row["project"])

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # timers need it; a query keeps what was set at its start
    try:
        asked = queued(bursts(project_of_stream(relevant(events), projects), quiet_ms), most, take)
        return asked.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**(trigger or {"processingTime": "200 milliseconds"})).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
