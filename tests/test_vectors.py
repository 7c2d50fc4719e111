import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.functions import vectors as V
from quarryloom.operators import ann as A
from quarryloom.operators import vector_search as S


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [1.0, 1.0, 0.0]), (5, None)], "id int, embedding array<float>")


def test_nearest(few):
    rows = S.top_k(few, [1.0, 0, 0], 3).collect()
    assert [r["id"] for r in rows] == [1, 4, 2]
    assert rows[0]["distance"] == pytest.approx(0, abs=1e-9) and rows[1]["distance"] == pytest.approx(1 - 1 / math.sqrt(2))


def one(spark, f, a, b):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(f(F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(("a", "b"), [([1.0], [1.0, 2.0]), ([], []), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])])
def test_neutral_values(spark, a, b):
    assert one(spark, V.cosine, a, b) == 0.0
    assert one(spark, V.cosine_distance, a, b) == 1.0
    assert one(spark, V.dot, a, b) == 0.0


def test_scores(spark):
    row = spark.range(1).select(
        V.score(F.lit(3.0), "euclidean"), V.score(F.lit(-3.0), "dot_product"), V.score(F.lit(0.25), "cosine"), V.score(F.lit(1.5), "cosine", "complement"), V.score(F.lit(1.0), "cosine", "inverse"), V.score(F.lit(-1.0), "cosine", "inverse")
    ).first()
    assert row[:5] == pytest.approx((0.25, 3.0, 0.75, 0.4, 0.5)) and row[5] is None


def test_batch_equals_single(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)], "id int, embedding array<float>")
    asked = rows.filter("id < 5").withColumnRenamed("id", "query_id")
    for metric in V.METRICS:
        got = S.batch_knn(rows, asked, 7, metric).collect()
        for q in asked.collect():
            want = [r["id"] for r in S.top_k(rows, list(q["embedding"]), 7, metric).collect()]
            assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q["query_id"]), key=lambda r: r["rank"])] == want
    assert S.batch_knn(rows, asked.limit(0), 3).count() == 0


@pytest.fixture(scope="module")
def many(spark):
    x = np.random.default_rng(3).normal(size=(900, 32))
    return x, spark.createDataFrame([(i, v.tolist(), f"r{i % 3}") for i, v in enumerate(x)], "id int, embedding array<float>, repo_root string").repartition(3)


@pytest.mark.parametrize(("kind", "probes"), [("ivf", 10), ("lsh", 13)])
def test_approximate_finds_most(spark, many, tmp_path, kind, probes):
    """All ids divisible by 20 as queries, against the exact search."""
    _, rows = many
    index = A.AnnIndex(spark, f"file://{tmp_path}/{kind}").build(rows, kind, 16)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = S.batch_knn(rows, asked, 10)
    found = index.search_many(asked, 10, probes)
    assert A.recall(found, exact) >= 0.9 and found.groupBy("query_id").count().filter("count <> 10").count() == 0
    # Probing all cells is exact.
    assert A.recall(index.search_many(asked, 10, index.cells().n), exact) == 1.0


def test_blocks_of_a_cell_give_the_same(spark, many, tmp_path, monkeypatch):
    _, rows = many
    index = A.AnnIndex(spark, f"file://{tmp_path}/i").build(rows, "ivf", 8)
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")

    def plain(df):  # products of blocks of other shapes differ in the last digits
        return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())

    whole = plain(index.search_many(asked, 5, 4))
    monkeypatch.setattr(A, "BLOCK_ROWS", 20)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 7)
    assert plain(index.search_many(asked, 5, 4)) == whole
    monkeypatch.setattr(S, "BLOCK_BYTES", 32 * 4 * 10)
    few = plain(S.batch_knn(rows, asked, 5))
    monkeypatch.setattr(S, "BLOCK_BYTES", 32 << 20)
    assert plain(S.batch_knn(rows, asked, 5)) == few


def test_a_search_reads_the_probed_cells(spark, many, tmp_path):
    x, rows = many
    index = A.AnnIndex(spark, f"file://{tmp_path}/i").build(rows, "ivf", 16)
    found = index.search(x[0].tolist(), 5, probes=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and found.first()["id"] == 0
    only = index.search(x[0].tolist(), 5, probes=16, where=F.col("repo_root") == "r2").collect()
    assert len(only) == 5 and all(r["repo_root"] == "r2" for r in only)


def test_index_changes(spark, many, tmp_path):
    x, rows = many
    index = A.AnnIndex(spark, f"file://{tmp_path}/i")
    index.drop()
    with pytest.raises(LookupError):
        index.count()
    index.build(rows.filter("id < 600"), "ivf", 8)
    index.delete(rows.filter("id < 10"))
    assert index.count() == 590 and index.search(x[3].tolist(), 1, 8).first()["id"] != 3
    index.insert(rows.filter("id between 3 and 12"))  # comes back, or is put over what is there
    assert index.count() == 597 and index.search(x[3].tolist(), 1, 8).first()["id"] == 3
    index.sync(rows.filter("id % 2 = 0"))
    assert index.count() == 450 and sorted(r[0] for r in index.rows().select("id").collect()) == list(range(0, 900, 2))
    index.rebuild(4)
    assert index.count() == 450 and index.cells().n == 4 and not (tmp_path / "i" / "gone").exists()
    again = A.AnnIndex(spark, f"file://{tmp_path}/i")
    assert again.search(x[4].tolist(), 1, 4).first()["id"] == 4
    index.build(rows.limit(0), "ivf")
    assert index.count() == 0 and index.search_many(rows.select(F.col("id").alias("query_id"), "embedding"), 3).count() == 0
    index.drop()
    assert not (tmp_path / "i").exists()


def test_cached_search(many):
    x, rows = many
    search = A.cached(rows)
    assert [r["id"] for r in search(x[5].tolist(), 3).collect()][0] == 5
    assert all(r["repo_root"] == "r1" for r in search(x[5].tolist(), 3, ["r1"]).collect())


def test_repos_are_filtered_first(spark):
    rows = spark.createDataFrame([(i, f"r{i % 3}", [1.0, float(i)]) for i in range(30)], "id int, repo_root string, embedding array<float>")
    got = S.filtered_top_k(rows, [1.0, 0.0], 5, ["r2"]).collect()
    assert [r["id"] for r in got] == [2, 5, 8, 11, 14]


def test_sync(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "id int, embedding array<float>")
    b = spark.createDataFrame([(2, [2.0]), (3, [3.0]), (4, None)], "id int, embedding array<float>")
    assert sorted(r["id"] for r in S.sync_index(a, b).collect()) == [2, 3]


def test_rounded_as_sql_does(spark):
    import duckdb

    rng = random.Random(2)
    given = [-3e-7, 3e-7, -0.0, 0.0, 0.0000005, -0.0000005, 1.0000005, -2.5e-6, 1e300, float("nan"), None] + [(rng.randrange(-(10**9), 10**9) + 0.5) / 1e6 for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").orderBy("i").select(V.rounded(F.col("x"), 6)).collect()]
    want = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest($1::DOUBLE[]) AS x, generate_subscripts($1::DOUBLE[], 1) AS i) ORDER BY i", [given]).fetchall()]
    assert list(map(repr, got)) == list(map(repr, want))  # repr tells -0.0 from 0.0


@pytest.mark.parametrize("metric", ["cosine", "manhattan"])
def test_batch_keeps_k_of_each_query_at_any_time(spark, monkeypatch, metric):
    """Vectors come in many pieces, with copies among them: the best by distance, then id, as of all at once."""
    monkeypatch.setattr(S, "ROWS", 7)
    monkeypatch.setattr(S, "PIECE", 4)
    rng = np.random.default_rng(5)
    few = rng.normal(size=(9, 4))
    v = np.concatenate([rng.normal(size=(60, 4)), few[rng.integers(0, 9, 140)]])[rng.permutation(200)].astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>").coalesce(2)
    got = S.batch_knn(rows, rows.filter("id % 9 = 0").withColumnRenamed("id", "query_id"), 12, metric).orderBy("query_id", "rank").collect()
    d = np.round(S.distances(v[::9].astype(float), v.astype(float), metric), 12)
    assert [r["id"] for r in got] == np.argsort(d, axis=1, kind="stable")[:, :12].ravel().tolist()


def test_nearest_gives_no_more_than_k(monkeypatch):
    d = np.random.default_rng(6).normal(size=(5, 3000))
    i, near, ids = S.nearest(d, np.arange(3000)[::-1], np.full(5, np.inf), 10)
    assert i.tolist() == np.repeat(np.arange(5), 10).tolist() and near.tolist() == np.sort(d, axis=1)[:, :10].ravel().tolist() and ids.tolist() == (2999 - np.argsort(d, axis=1)[:, :10]).ravel().tolist()
