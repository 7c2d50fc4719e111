"""Places in a total order, the scratch tables they are written to, and what is built on them."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quarryloom import scratch
from quarryloom.operators import embed, fusion, rerank, store
from quarryloom.operators.ordering import numbered, row_at
from quarryloom.plans import hybrid


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([None, 1.0, 2.0, 3.0, rng.random()])) for i in range(3000)]
    return data, spark.createDataFrame(data, "id int, score double").repartition(7)


def ordered(data):
    return sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))


def order():
    return [F.col("score").desc_nulls_last(), F.col("id")]


@pytest.mark.parametrize("most", [None, 5000, 40])
def test_places(rows, most):
    data, df = rows
    got = {r["rank"]: r["id"] for r in numbered(df, order(), most=most).collect()}
    want = [i for i, _ in ordered(data)][: most or 5000]
    assert [got[i + 1] for i in range(len(got))] == want


def test_no_rows(rows):
    _, df = rows
    assert numbered(df.limit(0), order()).count() == 0 and row_at(df.limit(0), order(), 1) is None
    assert row_at(df, order(), 0) is None and row_at(df, order(), 3001) is None


@pytest.mark.parametrize("keep", [0, 1, 700, 2999, 3000, 9000])
def test_eviction_keeps_the_latest(rows, keep):
    data, df = rows
    got = store.evict(df, keep, key="id", used="score")
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i, _ in ordered(data)[:keep])


def test_whole_lists_are_ranked(rows):
    data, df = rows
    some = df.filter("score is not null").withColumn("id", F.format_string("%05d", "id"))
    got = fusion.ranked(some, "s")
    want = sorted((-s, f"{i:05d}") for i, s in data if s is not None)
    assert [r["id"] for r in got.orderBy("rank").collect()] == [i for _, i in want]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") == 1 and "HashAggregate" in plan.split("SinglePartition")[1]  # one row for each range, no rows of the list


def test_scratch_needs_a_shared_folder():
    def fake(master, folder=None):
        conf = SimpleNamespace(get=lambda name, default=None: folder if name == "spark.checkpoint.dir" else default)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            scratch.shared_dir(fake(master))
        assert scratch.shared_dir(fake(master, "hdfs:///s/")) == "hdfs:///s"


# Reranking and retrieval that go on when something fails


@pytest.fixture(scope="module")
def fused(spark):
    data = [(f"d{i:02d}", 1.0 / (i + 1), 1.0, ["a"]) for i in range(30)]
    return spark.createDataFrame(data, "id string, rrf_score double, score double, sources array<string>")


def contents(spark, n=30):
    return spark.createDataFrame([(f"d{i:02d}", f"word{i} license" if i % 2 else f"word{i}") for i in range(n)], "id string, content string")


@pytest.mark.parametrize("most", [None, 30])
def test_rerank_by_vectors(spark, fused, most):
    out = rerank.rerank(fused, contents(spark, 8), rerank.embedder_scores("license", embed.hashing_embedder(256)), top_k=10, threshold=0.1, most=most).orderBy("position").collect()
    # Those with the word first, then two without content, then the tail; four without the word are gone.
    assert [r["id"] for r in out[:6]] == ["d01", "d03", "d05", "d07", "d08", "d09"] and [r["position"] for r in out] == list(range(1, 27))
    assert [r["reranked"] for r in out] == [True] * 4 + [False] * 22


def test_contents_without_vectors_get_the_middle(spark, fused):
    partly = embed.Embedder("partly", 4, lambda df, i, c: df.filter(F.col(c).contains("license")).select(i, F.array(*[F.lit(0.0).cast("float")] * 4).alias("embedding")), lambda t: [1.0, 0.0, 0.0, 0.0])
    out = {r["id"]: r["rerank_score"] for r in rerank.rerank(fused, contents(spark, 4), rerank.embedder_scores("q", partly), top_k=4, most=30).collect()}
    assert [out[f"d{i:02d}"] for i in range(4)] == [0.5, 0.0, 0.5, 0.0]


def test_a_failing_provider_leaves_the_order(spark, fused):
    broken = rerank.Scorer(lambda df: df.select("id", F.raise_error(F.lit("down")).cast("double").alias("rerank_score")))
    kept = rerank.rerank(fused, contents(spark), broken, most=30, on_failure="keep").orderBy("position").collect()
    assert [r["id"] for r in kept] == [f"d{i:02d}" for i in range(30)] and not any(r["reranked"] for r in kept)
    with pytest.raises(Exception, match="down"):
        rerank.rerank(fused, contents(spark), broken, most=30)


def test_failing_and_slow_signals_are_left_out(spark):
    good = spark.createDataFrame([("a", 1.0, "x", 1)], "id string, score double, source string, rank int")

    def fails():
        raise OSError("no server")

    def waits():
        time.sleep(20)

    begun = time.monotonic()
    found, missing = hybrid.gathered({"good": lambda: good, "fails": fails, "late": waits, "lazy": lambda: good.withColumn("score", F.raise_error(F.lit("broken")))}, timeout=8)
    assert time.monotonic() - begun < 15 and len(found) == 1 and found[0].collect() == good.collect()
    assert set(missing) == {"fails", "late", "lazy"} and missing["fails"] == "OSError: no server" and "8" in missing["late"]
    with pytest.raises(RuntimeError):
        hybrid.retrieve_tolerant(good.select(F.lit(1).alias("wrong")), None, None, "x", None, None)
