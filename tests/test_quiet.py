"""Debounce by silence: bursts fire without further events, the queue is bounded, state survives."""

import time

from quarryloom.streaming import watch as W
from quarryloom.streaming.quiet import watch_quiet


def drop(folder, name, *paths):
    lines = "".join(f'{{"ts": "2024-01-01T00:00:0{i % 10}", "path": "{p}", "op": "write"}}\n' for i, p in enumerate(paths))
    (folder / f".{name}").write_text(lines)
    (folder / f".{name}").rename(folder / f"{name}.json")


def until(what, query, seconds=60):
    end = time.time() + seconds
    while not what() and time.time() < end and query.isActive:
        time.sleep(0.1)
    assert query.exception() is None and what(), (query.exception(), query.status)


def test_a_lone_burst_fires_and_a_restart_goes_on(spark, tmp_path):
    folder, asked, rows = tmp_path / "events", [], []
    folder.mkdir()
    projects = spark.createDataFrame([("/p",), ("/q",)], "path string")
    start = lambda quiet, reindex=asked.append: watch_quiet(W.event_source(spark, f"file://{folder}"), projects, reindex, f"file://{tmp_path}/check", quiet, seen=rows.append)
    query = start(1_500)
    drop(folder, "a", "/p/x.go", "/p/y.go", "/p/notes.bin", "/else/z.go")
    until(lambda: asked == ["/p"], query)
    assert [(r["project"], r["events"], r["waiting"], r["dropped"]) for r in rows] == [("/p", 2, 0, 0)]
    query.stop()
    # A burst that is open when the stream stops fires after the restart, its events of both runs counted.
    rows.clear()
    query = start(3_600_000)
    drop(folder, "b", "/q/x.go")
    until(lambda: any(p["numInputRows"] for p in query.recentProgress), query)
    time.sleep(1)
    query.stop()
    assert asked == ["/p"]
    query = start(500)
    drop(folder, "c", "/q/x.go", "/q/y.go")
    until(lambda: asked == ["/p", "/q"], query)
    assert [(r["project"], r["events"]) for r in rows] == [("/q", 3)]
    query.stop()


def test_a_full_queue_drops_and_counts(spark, tmp_path):
    folder, asked, rows = tmp_path / "events", [], []
    folder.mkdir()
    projects = spark.createDataFrame([(f"/p{i}",) for i in range(6)], "path string")
    drop(folder, "a", *[f"/p{i}/x.go" for i in range(6)])
    query = watch_quiet(W.event_source(spark, f"file://{folder}"), projects, asked.append, f"file://{tmp_path}/check", 200, most=4, take=1, seen=rows.append)
    until(lambda: len(asked) == 4, query)
    time.sleep(1)
    query.stop()
    assert len(asked) == len(set(asked)) == 4 and set(asked) <= {f"/p{i}" for i in range(6)}
    assert [(r["waiting"], r["dropped"]) for r in rows] == [(3, 2), (2, 2), (1, 2), (0, 2)]


def test_a_failed_reindex_is_asked_again(spark, tmp_path):
    folder, asked = tmp_path / "events", []
    folder.mkdir()
    projects = spark.createDataFrame([("/p",)], "path string")

    def fails(project):
        raise RuntimeError("no disk")

    drop(folder, "a", "/p/x.go")
    start = lambda reindex: watch_quiet(W.event_source(spark, f"file://{folder}"), projects, reindex, f"file://{tmp_path}/check", 200)
    query = start(fails)
    end = time.time() + 60
    while query.isActive and time.time() < end:
        time.sleep(0.1)
    assert "no disk" in str(query.exception())
    query = start(asked.append)
    until(lambda: asked == ["/p"], query)
    query.stop()
