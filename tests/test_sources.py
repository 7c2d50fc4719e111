import json

import pytest
from pyspark.sql import functions as F

from quarryloom.config import SearchConfig, parse_bool
from quarryloom.functions import formats
from quarryloom.functions import text as X
from quarryloom.operators import embed
from quarryloom.operators import evals as V
from quarryloom.operators import search as S
from quarryloom.sources import files as R
from quarryloom.sources import sinks
from quarryloom.streaming import watch as W


def test_read_tree(spark, tmp_path):
    for p, t in {"a.py": "x = 1\n", "sub/b.go": "package b\n", "node_modules/c.js": "no", ".git/d.py": "no", "e.txt": "no", "gen/f.py": "gen", "bin.py": "a\x00b"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / p).write_text(t)
    files = R.read_tree(spark, f"file://{tmp_path}", ignore=["gen/"])
    assert sorted((r["path"], r["text"]) for r in files.collect()) == [("a.py", "x = 1\n"), ("sub/b.go", "package b\n")]
    known = files.filter("path = 'a.py'").unionByName(files.limit(1).withColumn("path", F.lit("gone.py")))
    assert [r["path"] for r in R.changed_files(files, known).collect()] == ["sub/b.go"]
    assert [r["path"] for r in R.deleted_files(files, known).collect()] == ["gone.py"]


@pytest.mark.parametrize(("pattern", "path", "out"), [
    ("*.log", "a/b.log", True), ("*.log", "a/b.logs", False), ("/top", "top/x", True), ("/top", "a/top", False), ("build/", "a/build/x", True), ("build/", "build", False),
    ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("?.c", "x.c", True), ("[ab].c", "b.c", True), ("[!ab].c", "b.c", False), ("# x", "# x", False), ("", "x", False), ("doc", "x/doc/y", True),
])
def test_gitignore(spark, pattern, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(R.gitignored(F.col("p"), [pattern])).first()[0] is out


def test_gitignore_brings_back(spark):
    df = spark.createDataFrame([("a.log",), ("keep.log",)], "p string")
    assert [r[0] for r in df.select(R.gitignored(F.col("p"), ["*.log", "!keep.log"])).collect()] == [True, False]


def test_imports(spark):
    lines = spark.createDataFrame([("/r/a.py:3:x: y",), ("nothing",)], "value string")
    assert [tuple(r) for r in R.parse_match_lines(lines, "/r").collect()] == [("a.py", 3, "x: y")]
    event = lambda d: (json.dumps(d),)
    events = spark.createDataFrame([event({"type": "begin"}), event({"type": "match", "data": {"path": {"text": "/r/b"}, "lines": {"text": "hit\n"}, "line_number": 7}}), event({"type": "match", "data": {"path": {"text": "/r/c"}, "lines": {"bytes": "aGk="}, "line_number": 1}})], "value string")
    assert sorted(tuple(r) for r in R.parse_match_events(events, "/r").collect()) == [("b", 7, "hit"), ("c", 1, "hi")]


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"projects": [{"path": "/a", "name": "a", "watch_enabled": True, "symbols": 3}, {"path": "/b", "name": "b", "watch_enabled": False, "symbols": 4}]}))
    projects = R.read_registry(spark, f"file://{tmp_path}/r.json")
    assert R.watched(projects).count() == 1
    more = R.add_project(R.add_project(projects, "/c"), "/a")
    assert more.count() == 3
    with pytest.raises(ValueError):
        R.add_project(more, "/d", most=3)
    assert R.set_project(more, "/b", symbols=9).filter("path = '/b'").first()["symbols"] == 9
    paths = spark.createDataFrame([("/a/x.go",), ("/a/.git/x",), ("/ab/x",), ("/b/y",)], "path string")
    assert {r["path"]: r["project"] for r in R.project_of(paths, projects).collect()} == {"/a/x.go": "/a", "/a/.git/x": None, "/ab/x": None, "/b/y": "/b"}


CASES = [{"id": "1", "category": "search", "description": "d", "prompt": "p", "ground_truth": {"files": ["src/A.go", "b.py"], "symbols": ["Run"]}, "difficulty": "easy"}, {"id": "2", "category": "navigate", "description": "", "prompt": "", "ground_truth": {"symbols": ["X", "Y"]}, "difficulty": "hard"}]


def test_evaluation(spark, tmp_path):
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    (tmp_path / "c.jsonl").write_text("// note\n\n" + json.dumps(CASES[0]) + "\n")
    (tmp_path / "sub" / "d.jsonl").write_text(json.dumps(CASES[1]) + "\n")
    (tmp_path / "sub" / "deep" / "e.jsonl").write_text(json.dumps(CASES[1] | {"id": "3"}) + "\n")
    cases = R.read_cases(spark, f"file://{tmp_path}")
    assert sorted(r["id"] for r in cases.collect()) == ["1", "2"]
    assert [r["id"] for r in R.read_cases(spark, f"file://{tmp_path}", ["search"]).collect()] == ["1"]
    (tmp_path / "runs.json").write_text("\n".join(json.dumps(r) for r in (
        {"test_case_id": "1", "mode": V.WITH, "success": True, "output": "see lib/src/a.go: func run()", "tokens_used": 10, "duration_ns": 5},
        {"test_case_id": "1", "mode": V.WITHOUT, "success": False, "output": "src/A.go b.py Run", "tokens_used": 20, "duration_ns": 10},
        {"test_case_id": "2", "mode": V.WITHOUT, "success": True, "output": "x", "tokens_used": 20, "duration_ns": 10},
        {"test_case_id": "9", "mode": V.WITH, "success": True, "output": ""},
    )))
    runs = R.read_runs(spark, f"file://{tmp_path}/runs.json")
    checked = V.validate(cases, runs)
    got = {(r["test_case_id"], r["mode"]): (r["files_found"], r["symbols_found"], round(r["f1"], 6)) for r in checked.collect()}
    assert got == {("1", V.WITH): (["src/A.go"], ["Run"], 0.666667), ("1", V.WITHOUT): ([], [], 0.0), ("2", V.WITHOUT): ([], ["X"], 0.5)}
    compared = V.compare(cases, checked)
    assert {r["test_case_id"]: r["winner"] for r in compared.collect()} == {"1": V.WITH, "2": V.WITHOUT}
    summary = {r["mode"]: r for r in V.summarize(runs, compared).collect()}
    assert summary[V.WITHOUT]["success_rate"] == 0.5 and summary[V.WITHOUT]["ref_accuracy"] == 0.5 and summary[V.WITHOUT]["accuracy"] == 0.25
    assert V.reductions(V.summarize(runs, compared)).first()["tokens_used_reduction"] == 75.0
    name = spark.createDataFrame([("/l/2026-01-14-101112-case-1-with_mcp.log",), ("x.log",)], "p string").select(V.parse_log_name(F.col("p")).alias("n")).collect()
    assert (name[0]["n"]["test_case"], name[0]["n"]["mode"], str(name[0]["n"]["timestamp"])) == ("case-1", V.WITH, "2026-01-14 10:11:12") and name[1]["n"] is None


def test_run_results(spark):
    lines = spark.createDataFrame([(json.dumps({"type": "result", "result": "ok", "duration_ms": 3, "usage": {"input_tokens": 4}}),), (json.dumps({"type": "system"}),)], "value string")
    (r,) = R.run_results(lines).collect()
    assert (r["output"], r["success"], r["duration_ns"], r["input_tokens"]) == ("ok", True, 3_000_000, 4)


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.soft_truncated(F.lit("aaaa\nbbbb\ncccc"), 10)) == "aaaa\nbbbb\n..."
    assert one(X.soft_truncated(F.lit("a" * 20), 10)) == "a" * 10 + "..."
    assert one(X.name_in(F.lit("func Foo(x int) {"))) == "Foo" and one(X.name_in(F.lit("((")) ) == "unknown"
    assert one(X.line_slice(F.lit("a\nb\nc\n"), 2, 0)) == "b\nc"
    with pytest.raises(Exception, match="beyond"):
        one(X.line_slice(F.lit("a\nb\n"), 3, 0))
    assert one(X.version_at_least(F.lit("0.7.10"), "0.7.2")) and not one(X.version_at_least(F.lit("0.x"), "0.1"))
    assert one(formats.byte_size(F.lit(1536))) == "1.5 KiB" and one(formats.byte_size(F.lit(5))) == "5 B" and one(formats.byte_size(F.lit(3 << 40))) == "3.0 TiB"
    assert one(formats.duration(F.lit(1_500_000_000))) == "1.5s" and one(formats.duration(F.lit(2_000_000))) == "2ms"


def test_patterns(spark):
    assert S.java_pattern(spark, "(?P<x>a)") == "(?<x>a)"
    with pytest.raises(ValueError):
        S.java_pattern(spark, "(")
    files = spark.createDataFrame([("r", "b", "one\ntwo\n"), ("r", "a", "two\ntwo\nx"), ("r", "n", None)], "repo_root string, path string, text string")
    got = [(r["path"], r["line_start"], r["score"]) for r in S.keyword_search(files, "^two$", 3).orderBy("rank").collect()]
    assert got == [("a", 1, 100.0), ("a", 2, 99.0), ("b", 2, 98.0)]
    assert S.get_file(files, "r", "b", 2, 2).first()["content"] == "two" and S.get_file(files, "r", "zz").count() == 0


def test_two_repos_sharing_a_hash(spark):
    cache = spark.createDataFrame([("h", [1.0, 0.0])], "content_hash string, embedding array<float>")
    loc = spark.createDataFrame([("/r1", "f1", 1, 9, "h"), ("/r2", "f2", 1, 9, "h")], "repo_root string, path string, start_line int, end_line int, content_hash string")
    assert [r["path"] for r in S.semantic_search_by_hash(cache, loc, [1.0, 0.0], 5, ["/r1"]).collect()] == ["f1"]
    assert S.semantic_search_by_hash(cache, loc, [1.0, 0.0], 5).count() == 2


def test_overlapping_ids(spark):
    hits = spark.createDataFrame([("p:5", "p", 5), ("q:1", "q", 1)], "id string, path string, line int")
    chunks = spark.createDataFrame([("p", 1, 10), ("p", 5, 200)], "path string, start_line int, end_line int")
    assert sorted(r["id"] for r in S.into_chunks(hits, chunks).collect()) == ["p:1:10", "q:1"]


def test_settings(monkeypatch):
    monkeypatch.setenv("QUARRYLOOM_KEYWORD_LIMIT", "7")
    monkeypatch.setenv("QUARRYLOOM_RERANK", "yes")
    c = SearchConfig.from_env()
    assert (c.keyword_limit, c.rerank, c.semantic_limit) == (7, True, 20)
    assert parse_bool("Enabled", False) and not parse_bool("off", True) and parse_bool("?", True)
    assert formats.hnsw_memory_bytes(10, 4) == 160 + 2560 and formats.hnsw_build_seconds(100, 768) == 1.0


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, "/p/a.go" if i % 3 else "/q/b.py", "write", t) for i, t in enumerate([0, 100, 300, 2000, 2100, 9000, 9100, 20000])]
    events = spark.createDataFrame(rows, "n int, path string, op string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    projects = spark.createDataFrame([("/p",), ("/q",)], "path string")
    batch = {(r["key"], r["events"]) for r in W.debounced(W.project_of_stream(W.relevant(events), projects), F.col("project")).collect()}
    events.repartition(1).sortWithinPartitions("ms").write.parquet(str(tmp_path / "in"))
    asked = []
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = W.watch(stream, projects, asked.append, str(tmp_path / "cp"), late="0 seconds", availableNow=True)
    q.awaitTermination(60)
    assert set(asked) == {"/p", "/q"} and W.status(q)["running"] is False
    out = W.debounced(W.project_of_stream(W.relevant(stream), projects), F.col("project"), late="0 seconds").writeStream.outputMode("append").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    out.awaitTermination(60)
    got = {(r["key"], r["events"]) for r in spark.table("sessions").collect()}
    assert got <= batch and len(batch) - len(got) <= 2


def test_ignore_files_are_loaded(spark, tmp_path):
    tree = tmp_path / "repo"
    for name in ("a.py", "gen/b.py", "tmp_c.py", "keep/tmp_d.py"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text("x = 1\n")
    (tree / ".gitignore").write_text("# made\ngen/\n!keep/tmp_d.py\n")
    (tmp_path / "global").write_text("tmp_*\n")
    paths = lambda **o: sorted(r["path"] for r in R.read_tree(spark, f"file://{tree}", **o).collect())
    assert paths() == ["a.py", "keep/tmp_d.py", "tmp_c.py"]
    assert paths(everywhere=f"file://{tmp_path}/global") == ["a.py", "keep/tmp_d.py"]
    assert paths(ignore=["a.py"], everywhere="file:///no/such/file") == ["keep/tmp_d.py", "tmp_c.py"]
    assert R.ignore_patterns(spark, f"file://{tmp_path}/nothing") == []


def test_registry_entries_come_and_go(spark):
    rows = spark.createDataFrame([("/a", "a", True), ("/b", "b", False)], "path string, name string, watch_enabled boolean")
    assert R.get_project(rows, "/b").first()["name"] == "b" and [r["path"] for r in R.remove_project(rows, "/a").collect()] == ["/b"]
    with pytest.raises(ValueError, match="no such"):
        R.remove_project(rows, "/c")


def test_watching_a_folder_of_events(spark, tmp_path):
    """Files of events are taken a few at a time; a quiet project is indexed and then noted."""
    (tmp_path / "events").mkdir()
    lines = [f'{{"ts": "2024-01-01T00:0{i}:00", "path": "/{p}/x{i}.py", "op": "write"}}' for i, p in enumerate(("p", "q", "p", "z", "z", "z"))]
    for i, line in enumerate(lines):
        (tmp_path / "events" / f"{i}.json").write_text(line + "\n")
    projects = spark.createDataFrame([("/p", True), ("/q", False)], "path string, watch_enabled boolean")
    seen, noted = [], []
    events = W.event_source(spark, f"file://{tmp_path}/events", most_files=2)
    query = W.watch(events, projects, seen.append, f"file://{tmp_path}/check", quiet="10 seconds", late="1 second", done=noted.append, availableNow=True)
    query.awaitTermination(90)
    state = W.status(query, projects)
    assert set(seen) == {"/p", "/q"} and noted == seen and len(query.recentProgress) >= 3
    assert (state["projects"], state["watched"], state["running"]) == (2, 1, False)
    query.stop()


def test_logs_of_runs(spark, tmp_path):
    (tmp_path / "2024-03-01-101500-case-7-with_mcp.log").write_text("what was said")
    (tmp_path / "notes.log").write_text("no")
    r = R.read_logs(spark, f"file://{tmp_path}").collect()
    assert [(x["test_case"], x["mode"], x["text"], str(x["timestamp"])) for x in r] == [("case-7", "with_mcp", "what was said", "2024-03-01 10:15:00")]


def test_a_database_is_read_in_parts(spark):
    """Through JDBC, from the database that comes with Spark."""
    at, driver = "jdbc:derby:memory:quarry", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("cast(id as int) id", "concat('n', id) name").write.format("jdbc").option("url", at + ";create=true").option("driver", driver).option("dbtable", "things").save()
    rows = sinks.read_database(spark, at, "things", "id", (0, 100), parts=4, driver=driver)
    assert rows.rdd.getNumPartitions() == 4 and rows.filter("id >= 90").count() == 10
    assert sinks.read_database(spark, at, '(select "id" from things where "id" < 5) t', driver=driver).count() == 5


def test_an_embedder_is_asked_again_and_asked_whether_it_works(spark):
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) % 3:
            raise OSError("busy")
        return [[1.0, 2.0] for _ in texts]

    e = embed.http_embedder("t", "m", flaky, dimensions=2, wait=0.01)
    assert e.embed_text("a") == [1.0, 2.0] and len(calls) == 3
    assert not e.available() and not embed.no_embedder().available() and embed.hashing_embedder().available()
    assert embed.http_embedder("t", "m", lambda ts: [[0.0, 0.0] for _ in ts], dimensions=2).available()
    assert not embed.http_embedder("t", "m", lambda ts: [[0.0] for _ in ts], dimensions=2).available()
