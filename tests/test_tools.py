import json

from pyspark.sql import functions as F

from quarryloom.operators import chunking, embed, evals, lookup, symbols
from quarryloom.plans.tools import Workspace
from quarryloom.sources import files as R
from quarryloom.sources import sinks

TEXTS = {"a.py": "def alpha():\n    return 'license text'\n", "b.py": "def beta():\n    return 2\n\ndef alphabet():\n    return 3\n"}


def workspace(spark, vectors=True):
    files = spark.createDataFrame([("r", p, t) for p, t in TEXTS.items()], "repo_root string, path string, text string")
    by = embed.hashing_embedder(32)
    chunks = chunking.structural_chunks(files)
    cache, loc = embed.embed_with_cache(chunks, spark.createDataFrame([], "content_hash string"), by)
    return Workspace(files, symbols.extract_symbols(files), cache if vectors else None, loc if vectors else None, by if vectors else None)


def answer(df):
    (row,) = df.collect()
    return json.loads(row["json"])


def test_calls(spark):
    w = workspace(spark)
    assert [r["path"] for r in answer(w.search_keyword("return"))["results"]] == ["a.py", "b.py", "b.py"]
    assert answer(w.get_file("a.py", 1, 1)) == {"path": "a.py", "content": "def alpha():"} and w.get_file("zz").count() == 0
    assert [s["name"] for s in answer(w.find_symbol("alpha"))["symbols"]] == ["alpha", "alphabet"]
    assert [s["name"] for s in answer(w.list_defs_in_file("b.py"))["symbols"]] == ["beta", "alphabet"]
    found = answer(w.search_semantic("license text", 3))
    assert found["available"] and found["results"][0]["path"] == "a.py" and "license" in found["results"][0]["snippet"]
    assert answer(w.hybrid_search("license"))["results"][0]["path"] == "a.py"
    assert answer(w.hybrid_search_v2("license", 5))["results"][0]["path"] == "a.py"
    again = answer(w.hybrid_search_v2("license", 5, rerank_results=True))
    assert again["results"][0]["path"] == "a.py" and again["results"][0]["reranked"]


def test_calls_without_vectors(spark):
    w = workspace(spark, vectors=False)
    assert answer(w.search_semantic("x")) == {"results": [], "available": False}
    assert answer(w.hybrid_search_v2("license"))["semantic_available"] is False


def test_reports(spark, tmp_path):
    compared = spark.createDataFrame([("1", 0.5, 0.25, evals.WITH)], "test_case_id string, with_f1 double, without_f1 double, winner string").withColumn("with_recall", F.col("with_f1")).withColumn("without_recall", F.col("without_f1"))
    runs = spark.createDataFrame([("1", evals.WITH, True, "o", "s", 2_000_000_000, 5)], "test_case_id string, mode string, success boolean, output string, session_id string, duration_ns long, tokens_used long")
    for c, k in (("input_tokens", "long"), ("output_tokens", "long"), ("cache_read_tokens", "long"), ("cache_create_tokens", "long"), ("cost_usd", "double"), ("num_turns", "long"), ("tool_call_count", "long")):
        runs = runs.withColumn(c, F.lit(None).cast(k))
    summary = evals.summarize(runs, compared)
    text = sinks.text_report(compared, summary)
    assert "2.0s" in text and "100.0%" in text and evals.WITH in text.splitlines()[-1]
    sinks.write_report(compared, summary, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report/results").count() == 1


def test_registry_round_trip(spark, tmp_path):
    projects = R.add_project(spark.createDataFrame([("/a", "a", True)], "path string, name string, watch_enabled boolean"), "/b")
    sinks.write_registry(projects, f"file://{tmp_path}/reg")
    assert sorted(r["path"] for r in R.read_registry(spark, f"file://{tmp_path}/reg").collect()) == ["/a", "/b"]


def test_lookups(spark):
    rows = spark.createDataFrame([("r", "p", 2, "h1"), ("r", "p", 1, "h2"), ("s", "q", 1, "h1")], "repo_root string, path string, start_line int, content_hash string")
    assert [r["start_line"] for r in lookup.by_path(rows, "r", "p").collect()] == [1, 2]
    assert lookup.by_hash(rows, "h1").count() == 2 and lookup.by_hashes(rows, ["h1"], ["s"]).count() == 1
    assert lookup.by_hashes(rows, ["h1", *map(str, range(2000))]).count() == 2
    assert lookup.count_rows(rows).first()["n"] == 3 and lookup.config_of(rows, "s").count() == 1
