"""The best of fused lists from their beginnings, against ranking them as a whole."""

import random

import pytest

from quarryloom.operators import fusion
from quarryloom.operators import threshold as T

HIT = "id string, score double, path string"


def lists(spark, seed, sizes, ids=3_000, ties=False):
    rng = random.Random(seed)
    out = {}
    for s, n in sizes.items():
        rows = [(f"i{i}", None if rng.random() < 0.01 else float(rng.randint(0, 5)) if ties else rng.random(), f"{s}/{i}") for i in rng.sample(range(ids), n)]
        out[s] = spark.createDataFrame(rows, HIT).repartition(3)
    return out


def whole(ls, n, weights=None):
    ranked = [fusion.ranked(h, s) for s, h in ls.items()]
    return fusion.top_n(fusion.weighted_rrf(weights or {}, *ranked), n)


def plain(frame):
    return [(r["id"], round(r["rrf_score"], 12), r["score"], r["sources"], r["path"]) for r in frame.collect()]


@pytest.mark.parametrize("ties", [False, True])
def test_equals_ranking_the_whole(spark, ties):
    ls = lists(spark, 5 + ties, {"a": 2_500, "b": 1_500, "c": 40}, ties=ties)
    for n, depth, weights in ((5, None, None), (5, 3, {"a": 0.2, "c": 3.0}), (40, 8, None)):
        got = T.top_n_by_threshold(ls, n, weights=weights, depth=depth)
        assert plain(got) == plain(whole(ls, n, weights))
        assert all(r["depth"] is not None and r["depth"] < 2_500 for r in got.collect())


def test_places(spark):
    hits = lists(spark, 3, {"a": 400}, ties=True)["a"]
    at = {r["id"]: (r["score"], r["rank"]) for r in fusion.ranked(hits, "a").collect()}
    assert T.places(hits, [(s, i) for i, (s, _) in at.items()]) == [rank for _, rank in at.values()]


def test_short_empty_and_undecided_lists(spark, monkeypatch):
    ls = lists(spark, 9, {"a": 6, "b": 0})
    assert plain(T.top_n_by_threshold(ls, 10)) == plain(whole(ls, 10)) and len(plain(T.top_n_by_threshold(ls, 10))) == 6
    assert plain(T.top_n_by_threshold({"b": ls["b"]}, 10)) == []
    monkeypatch.setattr(T, "DEEPEST", 16)
    ls = lists(spark, 10, {"a": 900, "b": 900})
    got = T.top_n_by_threshold(ls, 20, depth=8)
    assert plain(got) == plain(whole(ls, 20)) and got.first()["depth"] is None
