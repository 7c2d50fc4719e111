"""Byte codes against their definition, searches against brute force, rows that come and go."""

import numpy as np
from pyspark.sql import functions as F

from quarryloom.operators import ann, vector_search
from quarryloom.operators import quantized as Q

VEC = "id long, embedding array<float>, d int, v string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, "n") for i, v in vectors], VEC).repartition(3)


def test_search(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=(900, 22))
    rows = table(spark, [*enumerate(x), *((5000 + i, x[3]) for i in range(80)), (903, None), (901, np.zeros(22))]).cache()
    index = Q.QuantizedIndex(spark, f"file://{tmp_path}/q").build(rows)
    codes = {r["id"]: np.frombuffer(r["code"], np.uint8) for r in index.tables.read("codes").collect()}
    books = index._books(index.tables.version())
    assert len(codes) == 981 and {len(c) for c in codes.values()} == {8}
    # Each part has the nearest centre.
    unit = Q.parted(x / np.linalg.norm(x, axis=1, keepdims=True))
    for i in range(0, 900, 90):
        far = ((unit[i][:, None] - books) ** 2).sum(2)
        assert np.allclose(far[np.arange(8), codes[i]], far.min(1))
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding").cache()
    # The first pass by its definition: all products of decoded vectors.
    ids = np.array(sorted(codes))
    decoded = np.array([[books[j, c] for j, c in enumerate(codes[i])] for i in ids]).reshape(len(ids), -1)
    got = {}
    for r in index.candidates(asked, 30).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    for q in (0, 60, 880):
        d = np.round(1 - decoded[:, :22] @ (x[q] / np.linalg.norm(x[q])), 12)
        edge = np.sort(d)[29]
        assert len(got[q]) == 30 and {int(i) for i in ids[d < edge - 1e-9]} <= got[q] <= {int(i) for i in ids[d <= edge + 1e-9]}
    found = index.search_many(rows, asked, 10).cache()
    exact = vector_search.batch_knn(rows.filter("embedding IS NOT NULL"), asked.filter("embedding IS NOT NULL"), 10)
    assert ann.recall(found, exact) >= 0.9 and found.groupBy("query_id").count().filter("count <> 10").isEmpty()
    near = {(r["query_id"], r["rank"]): r["id"] for r in found.collect()}
    assert [near[5000, k] for k in range(1, 11)] == [3, *range(5000, 5009)]  # copies by id, however many
    # Rows that go are not found, those that come are, by the same centres.
    index.delete(rows.filter("id < 450").select("id"))
    index.put(table(spark, [(7, x[8]), (9000, x[0])]))
    more = rows.filter("id >= 450").unionByName(table(spark, [(7, x[8]), (9000, x[0])]))
    one = index.search_many(more, table(spark, [(0, x[0]), (8, x[8])]).select(F.col("id").alias("query_id"), "embedding"), 1)
    assert {(r["query_id"], r["id"]) for r in one.collect()} == {(0, 9000), (8, 7)}


def test_few_rows_and_none(spark, tmp_path):
    rows = table(spark, [(1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0])])
    index = Q.QuantizedIndex(spark, f"file://{tmp_path}/a").build(rows)
    asked = rows.select(F.col("id").alias("query_id"), "embedding")
    assert [(r["query_id"], r["id"], round(r["distance"], 9)) for r in index.search_many(rows, asked, 5).orderBy("query_id", "rank").collect()] == [(1, 1, 0), (1, 2, 1), (2, 2, 0), (2, 1, 1)]
    assert index.search_many(rows, asked.limit(0), 5).count() == 0
    assert Q.QuantizedIndex(spark, f"file://{tmp_path}/b").build(rows.limit(0)).search_many(rows, asked, 5).count() == 0
