import pytest
from pyspark.sql import functions as F

from quarryloom.operators import fusion as R
from quarryloom.operators import rerank as K


def ranked(spark, source, *pairs):
    return spark.createDataFrame([(i, float(s), source, n + 1) for n, (i, s) in enumerate(pairs)], "id string, score double, source string, rank int")


@pytest.fixture
def two(spark):
    return ranked(spark, "keyword", ("a", 1.0), ("b", 0.8), ("c", 0.6)), ranked(spark, "semantic", ("b", 1.0), ("d", 0.9), ("a", 0.5))


def test_both_lists_count(two):
    rows = R.top_n(R.rrf(*two), 0).collect()
    assert [r["id"] for r in rows][0] == "b" and len(rows) == 4
    assert set(rows[0]["sources"]) == {"keyword", "semantic"}
    assert rows[0]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61)


def test_order_of_lists_does_not_matter(two):
    a = {(r["id"], round(r["rrf_score"], 12)) for r in R.rrf(*two).collect()}
    assert a == {(r["id"], round(r["rrf_score"], 12)) for r in R.rrf(*reversed(two)).collect()}


def test_arithmetic(spark):
    one, two = ranked(spark, "x", ("a", 1), ("b", 1)), ranked(spark, "y", ("a", 1))
    got = {r["id"]: r["rrf_score"] for r in R.rrf(one, two).collect()}
    assert got == pytest.approx({"a": 2 / 61, "b": 1 / 62})


def test_weights(spark):
    kw, sem, other = ranked(spark, "kw", ("a", 1)), ranked(spark, "sem", ("b", 1)), ranked(spark, "other", ("c", 1))
    got = {r["id"]: r["rrf_score"] for r in R.weighted_rrf({"kw": 0.3, "sem": 0.7, "other": 0.0}, kw, sem, other).collect()}
    assert got == pytest.approx({"a": 0.3 / 61, "b": 0.7 / 61, "c": 1 / 61})


def test_filters(two):
    fused = R.rrf(*two)
    assert {r["id"] for r in R.min_sources(fused, 2).collect()} == {"a", "b"}
    assert R.min_sources(fused, 1).count() == 4
    assert R.top_n(fused, 2).count() == 2 and R.top_n(fused, -1).count() == 4
    assert R.at_least(fused, 1 / 61).count() == 2


def test_weighted_sum(spark):
    schema = "key string, path string, start_line int, end_line int, snippet string"
    kw = spark.createDataFrame([("p:1-1", "p", 1, 1, "k"), ("p:2-2", "p", 2, 2, "k2")], schema)
    sem = spark.createDataFrame([("p:1-1", "p", 1, 1, "s", 0.5)], schema + ", score double")
    got = {r["key"]: (round(r["score"], 9), r["source"], r["snippet"]) for r in R.weighted_sum(kw, sem).collect()}
    assert got == {"p:1-1": (0.8, "both", "k"), "p:2-2": (0.6, "keyword", "k2")}


@pytest.fixture
def candidates(spark):
    return spark.createDataFrame([(i, s, s, ["x"]) for i, s in (("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6))], "id string, rrf_score double, score double, sources array<string>")


def contents(spark, **by_id):
    return spark.createDataFrame(list(by_id.items()) or [("", "")], "id string, content string")


def order(df):
    return [r["id"] for r in df.orderBy("position").collect()]


def test_rerank(spark, candidates):
    c = contents(spark, a="0.1", b="0.9", c="0.5", d="0.99")
    by = lambda x: x.cast("double")
    assert order(K.rerank(candidates, c, by, 3)) == ["b", "c", "a", "d"]
    assert order(K.rerank(candidates, c, by, 3, 0.4)) == ["b", "c", "d"]
    assert order(K.rerank(candidates, contents(spark, b="0.2", c="0.5"), by, 3)) == ["c", "b", "a", "d"]
    fallen = K.rerank(candidates, c, None)
    assert order(fallen) == ["a", "b", "c", "d"] and not any(r["reranked"] for r in fallen.collect())


def test_providers(spark):
    df = spark.createDataFrame([("The Cat sat",), ("dog",)], "content string")
    assert [r[0] for r in df.select(K.overlap_scores("cat sat down up")(F.col("content"))).collect()] == [0.5, 0.0]
    assert [r[0] for r in df.select(K.fixed_scores(0.25)(F.col("content"))).collect()] == [0.25, 0.25]
