"""Re-indexing as files change.

Events arrive as a stream of (ts, path, op). They are filtered, given their
project and gathered into sessions: one re-index for each project after a
quiet gap. Gaps are measured in event time; events later than the watermark
are dropped, which a timer would not do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryloom.functions import text as X
from quarryloom.sources.files import owner

QUIET = "500 milliseconds"


def relevant(events: DataFrame, path: str = "path", op: str = "op") -> DataFrame:
    """Events of code files, and everything that was created (it may be a directory)."""
    return events.filter(X.is_code_file(path, "watch") | (F.lower(op) == "create"))


def debounced(events: DataFrame, key: Column, ts: str = "ts", quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """(key, first, last, fires_at, events): sessions of events with less than quiet between them.

    In a stream late is the watermark's delay; in a batch it isn't needed.
    """
    rows = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if late else rows
    out = rows.groupBy(key.alias("key"), F.session_window("_ts", quiet).alias("w")).agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.count("*").alias("events"))
    return out.select("key", "first", "last", F.col("w.end").alias("fires_at"), "events")


EVENT = "ts timestamp, path string, op string"
#: A micro-batch takes so many files of events at most.
MOST_FILES = 1000


def event_source(spark: SparkSession, folder: str, most_files: int = MOST_FILES) -> DataFrame:
    """A stream of the events that a watcher drops into folder as JSON lines, in the order of their files; what one batch can't take waits for the next."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", most_files).json(folder)


def watch(events: DataFrame, projects: DataFrame, reindex: Callable[[str], None], checkpoint: str, quiet: str = QUIET, late: str = "10 seconds", done: Callable[[str], None] | None = None, **trigger) -> StreamingQuery:
    """Starts the stream: reindex(project) once for each project of a micro-batch, one after the other. Nothing queues up or is dropped between batches.

    done(project) follows a re-index that worked, as to set last_indexed in the registry.
    """
    sessions = debounced(project_of_stream(relevant(events), projects), F.col("project"), quiet=quiet, late=late)

    def run(batch: DataFrame, _: int) -> None:
        for row in batch.select("key").distinct().collect():  # projects, which the registry limits
            if row["key"] is not None:
                reindex(row["key"])
                if done is not None:
                    done(row["key"])

    return sessions.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**(trigger or {"processingTime": "1 second"})).start()


def project_of_stream(events: DataFrame, projects: DataFrame) -> DataFrame:
    """Events with the first project, as they were added, that contains their path. Others are dropped."""
    return events.withColumn("project", owner(F.col("path"), projects)).filter("project is not null")


def status(query: StreamingQuery, projects: DataFrame | None = None) -> dict:
    """Whether the stream runs, what it waits for and the last micro-batch's figures; with projects how many there are and how many are watched."""
    last = query.lastProgress
    counts = projects.agg(F.count("*").alias("projects"), F.count_if("watch_enabled").alias("watched")).first().asDict() if projects is not None else {}
    return counts | {"running": query.isActive, "message": query.status.get("message"), "batch": last["batchId"] if last else None, "rows": last["numInputRows"] if last else 0}
