"""Figures that runs keep, against those of the whole tables."""

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import chunking, stats, symbols
from quarryloom.operators import embed as E
from quarryloom.plans.indexer import Index


def figures(rows):
    return {(r["metric"], r["value"]): r["n"] for r in rows.collect()}


def test_they_follow_runs_and_equal_the_whole(spark, tmp_path):
    def files(texts, repo="r"):
        return spark.createDataFrame([(repo, p, t, "en") for p, t in texts.items()], "repo_root string, path string, text string, language string")

    index = Index(spark, f"file://{tmp_path}/ix", E.hashing_embedder(8), chunking.fixed_chunks, lambda f: symbols.extract_symbols(f, "en", {"en": ()}), buckets=4)
    texts = {f"f{i}.py": "\n".join(f"line {j} of {i % 5}" for j in range(i * 9)) for i in range(12)}
    index.run(files(texts), "r")
    index.run(files({p: t for p, t in texts.items() if p != "f11.py"} | {"f3.py": "new", "more.go": "x"}), "r")
    assert figures(index.kept_stats()) == figures(index.stats())  # so few hashes are counted exactly
    index.run(files({"a.c": "1\n2", "b.c": "1\n2"}, "other"), "other")
    assert figures(index.kept_stats()) == figures(index.stats())
    of = figures(index.kept_stats("other"))
    assert (of["total", "chunks"], of["total", "files"], of["total", "hashes"]) == (2, 2, 1)
    index.compact(0)
    assert figures(index.kept_stats()) == figures(index.stats())


def test_only_rows_of_changed_files_are_written(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/ix", E.hashing_embedder(8), chunking.fixed_chunks, lambda f: symbols.extract_symbols(f, "en", {"en": ()}), buckets=4)
    rows = spark.range(40).select(F.lit("r").alias("repo_root"), F.concat("id", F.lit(".py")).alias("path"), F.concat(F.lit("t"), "id").alias("text"), F.lit("en").alias("language"))
    index.run(rows, "r")
    index.run(rows.withColumn("text", F.when(F.col("path") == "7.py", "other").otherwise(F.col("text"))), "r")
    held = [sum(e["rows"].values()) for e in index.tables.manifest()["tables"]["file_stats"] if e["kind"] == "rows"]
    assert held == [40, 1] and index.read("file_stats").count() == 40


def test_estimate_of_many_hashes_and_no_rows(spark):
    rows = spark.range(200_000).select(F.lit("r").alias("repo_root"), (F.col("id") % 1000).cast("string").alias("path"), F.sha2((F.col("id") % 60_000).cast("string"), 256).alias("content_hash"), F.when(F.col("id") % 3 > 0, "block").alias("node_type"), (F.col("id") % 7).cast("string").alias("language"))
    got, want = figures(stats.merged_stats(stats.file_stats(rows), rows)), figures(stats.index_stats(rows, rows))
    assert got.pop(("total", "hashes")) == pytest.approx(want.pop(("total", "hashes")), rel=0.025)
    assert got == want
    empty = rows.limit(0)
    assert figures(stats.merged_stats(stats.file_stats(empty), empty)) == {("total", v): 0 for v in ("chunks", "hashes", "files", "cached")}
