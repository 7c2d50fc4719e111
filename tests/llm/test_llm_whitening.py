"""Whitening against numpy, and on awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.llm.whitening import Whitening, covariance, quantised, usable, whiten

EMB = "vec_id long, embedding array<float>, component int, n string, x_ string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "n", "x") for i, v in vectors], EMB).repartition(3)


def brute(vectors, k=8):
    """By the definition, in whole numbers as far as they go and in numpy after that."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = (n * x - s).astype(np.float64) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    deviation = [int(((n * r - s) ** 2).sum()) for r in x]
    return deviation, centred @ directions[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12))
    return [[float(np.float32(x)) for x in rng.normal(size=12) @ mix * 0.3] for _ in range(150)]


def test_by_the_definition(spark, vectors):
    rows = list(enumerate(vectors)) + [(7, vectors[7]), (None, vectors[9])]
    bad = [(900, None), (901, [None] + vectors[0][1:]), (902, [float("nan")] + vectors[0][1:]), (903, [float("inf")] + vectors[0][1:]), (904, []), (905, vectors[0][:5])]
    got = [r.asDict() for r in whiten(table(spark, rows + bad)).collect()]
    deviation, white, explained = brute([v for _, v in rows])
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {len(rows)} and {r["component"] for r in got} == set(range(1, 9))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r)
    sign = np.sign([by[0, k][0]["whitened"] * white[0][k - 1] for k in range(1, 9)])
    for at, (i, _) in enumerate(rows):
        for k in range(1, 9):
            r = by[i, k][0]
            assert r["deviation"] == deviation[at]
            assert r["whitened"] == pytest.approx(white[at][k - 1] * sign[k - 1], abs=1e-9) and r["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
    assert len(by[7, 1]) == 2 and len(by[None, 1]) == 1


@pytest.mark.parametrize("vectors", [[], [[0.5, 0.25]], [[0.5, 0.25]] * 3, [[]]])
def test_nothing_to_whiten(spark, vectors):
    out = whiten(table(spark, list(enumerate(vectors))))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_directions_without_variance_give_no_rows(spark):
    rng = np.random.default_rng(5)
    flat = [[float(a), 0.5, float(a) * 2, float(b)] for a, b in rng.integers(-4, 5, size=(40, 2))]
    got = whiten(table(spark, list(enumerate(flat)))).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def test_deviation_is_exact_beyond_doubles_and_null_beyond_longs(spark):
    rows = [(0, [9e5, 0.0]), (1, [-9e5, 1.0]), (2, [3.0, 2.0])]
    deviation, _, _ = brute([v for _, v in rows])
    got = {r["vec_id"]: r["deviation"] for r in whiten(table(spark, rows)).collect()}
    assert got == dict(enumerate(deviation)) and max(deviation) > 1 << 53
    got = whiten(table(spark, [(0, [3e30, 0.0]), (1, [-3e30, 1.0]), (2, [3.0, 2.0])])).collect()
    assert got and {r["deviation"] for r in got if r["vec_id"] < 2} == {None}


def test_both_ways_to_the_deviation_agree(spark, vectors):
    rows = usable(table(spark, list(enumerate(vectors))).select("vec_id", "embedding"), "embedding", "x")
    fit = Whitening.fit(rows, "x")
    wide = Whitening(fit.n, fit.sums, 1 << 50, fit.values, fit.vectors, fit.total)
    assert rows.select(fit.deviation("x").alias("a"), wide.deviation("x").alias("b")).filter("a IS DISTINCT FROM b OR a IS NULL").count() == 0


def test_covariance_in_several_aggregations(spark, vectors, monkeypatch):
    from quarryloom.llm import whitening as W

    rows = table(spark, list(enumerate(vectors))).select(quantised(F.col("embedding")).alias("x")).cache()
    mean = np.array([r["x"] for r in rows.collect()]).mean(axis=0).tolist()
    whole = covariance(rows, "x", mean, len(vectors))
    monkeypatch.setattr(W, "PAIRS", 7)
    assert np.allclose(whole, covariance(rows, "x", mean, len(vectors)), rtol=1e-12)
    assert np.allclose(whole, np.cov(np.array([r["x"] for r in rows.collect()]).T, bias=True), rtol=1e-9)
