"""Neighbour lists against brute force, and searches along them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.operators import ann, vector_search
from quarryloom.operators import graph_index as G
from quarryloom.operators.graph_index import GraphIndex, beam_for, neighbour_lists, walk_for

VEC = "id long, embedding array<float>, v int, node string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, "n") for i, v in vectors], VEC).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    return rng.normal(size=(600, 24))


def test_lists_are_those_of_brute_force(spark, vectors):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "node long, v array<double>").repartition(3).cache()
    got = {r["node"]: [(x["id"], x["d"]) for x in r["near"]] for r in neighbour_lists(nodes, 16).collect()}
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, 9)
    true = np.argsort(d, axis=1)[:, :16]
    assert got.keys() == set(range(600)) and all(len(x) == 16 and len({i for i, _ in x}) == 16 and i not in {j for j, _ in x} for i, x in got.items())
    assert np.mean([len({j for j, _ in got[i]} & set(true[i].tolist())) / 16 for i in range(600)]) > 0.9
    assert all(abs(e - d[i, j]) < 1e-9 for i in range(0, 600, 50) for j, e in got[i])


def test_search(spark, tmp_path, vectors):
    rows = table(spark, list(enumerate(vectors)) + [(5000 + i, vectors[3]) for i in range(40)] + [(900, None), (901, np.zeros(24))])
    index = GraphIndex(spark, f"file://{tmp_path}/g").build(rows)
    assert index.tables.read("graph").count() == 601
    asked = rows.filter("id % 20 = 0 AND embedding IS NOT NULL").select(F.col("id").alias("query_id"), "embedding").cache()
    found = index.search_many(asked, 10).cache()
    exact = vector_search.batch_knn(rows.filter("embedding IS NOT NULL"), asked, 10)
    assert ann.recall(found, exact) >= 0.9
    near = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    # Copies come by id, as many as fit.
    assert [near[5000, k] for k in range(1, 11)] == [3, *range(5000, 5009)]
    seen = {r["query_id"]: r["visited"] for r in found.collect()}
    assert max(seen.values()) < 601 and found.groupBy("query_id").count().filter("count <> 10").count() == 0
    # A wider beam finds no less.
    assert ann.recall(index.search_many(asked, 10, beam=60), exact) >= 0.98


def test_rebuild_and_little(spark, tmp_path, vectors):
    index = GraphIndex(spark, f"file://{tmp_path}/g")
    ask = table(spark, [(1, vectors[0]), (2, None)]).select(F.col("id").alias("query_id"), "embedding")
    assert index.search_many(ask, 3).count() == 0
    index.build(table(spark, [(7, vectors[0])]))
    assert [(r["query_id"], r["id"], r["rank"]) for r in index.search_many(ask, 3).collect()] == [(1, 7, 1)]
    index.build(table(spark, [(8, vectors[1]), (9, vectors[0]), (10, vectors[2])]))
    assert [r["id"] for r in index.search_many(ask, 1).collect()] == [9]
    index.build(table(spark, []))
    assert index.search_many(ask, 3).count() == 0


def test_comparisons_around_a_center_cross_batches(vectors):
    """Rows of one center in several batches are compared as in one."""
    import pyarrow as pa

    v = vectors[:40] / np.linalg.norm(vectors[:40], axis=1, keepdims=True)
    center = np.sort(np.arange(40) % 3)
    whole = pa.RecordBatch.from_arrays([pa.array(center), pa.array(np.arange(40)), pa.array(v.tolist()), pa.array(np.full(40, 1.1))], ["center", "node", "v", "worst"])
    pairs = lambda batches: sorted((a, b) for x in G.compared(iter(batches)) for a, b in zip(x["node"].to_pylist(), x["id"].to_pylist(), strict=True))
    want = sorted((a, b) for a in range(40) for b in range(40) if a != b and center[a] == center[b] and 1 - v[a] @ v[b] < 1.1 - 1e-12)
    assert pairs([whole]) == want == pairs([whole.slice(0, 5), whole.slice(5, 9), whole.slice(14)])


def test_beams_grow_slower_than_tables():
    assert beam_for(500, 10) == 10 and beam_for(2000, 10) == 11 and beam_for(51_282, 10) == 80
    assert walk_for(1) == walk_for(500) == 6 and walk_for(2000) == 10 and walk_for(10**9) == 24


def test_segments(spark, tmp_path, vectors, monkeypatch):
    """Several graphs, each in one task: lists of the own segment, hits and visits of all."""
    monkeypatch.setattr(G, "SEGMENT", 128)
    rows = table(spark, list(enumerate(vectors)) + [(5000 + i, vectors[3]) for i in range(3)])
    index = GraphIndex(spark, f"file://{tmp_path}/g").build(rows)
    graph = index.tables.read("graph").collect()
    own = {r["node"]: r["segment"] for r in graph}
    assert set(own.values()) == set(range(5)) and all(own[j] == r["segment"] and j != r["node"] for r in graph for j in r["near"])
    asked = rows.filter("id % 20 = 0").select(F.col("id").cast("string").alias("query_id"), "embedding").cache()
    found = index.search_many(asked, 10).cache()
    assert ann.recall(found, vector_search.batch_knn(rows, asked, 10)) >= 0.9
    seen = {r["query_id"]: r["visited"] for r in found.collect()}
    assert len(seen) == 31 and 5 * G.ENTRIES < min(seen.values()) and max(seen.values()) < 600
    # No vector moves for a comparison: neither a join nor an exchange of pairs.
    plan = G.lists_in_segments(spark.createDataFrame([(0, 1, [1.0])], "segment int, node long, v array<double>"), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
