"""Places found by counting, against sorted lists."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import ordering, store


@pytest.mark.parametrize("descending", [False, True])
def test_whole_numbers(spark, descending):
    rng = random.Random(1)
    values = [rng.choice([rng.randrange(-(10**15), 10**15), 5, -7]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x long").repartition(3)
    for place in (1, 2, 150, 299, 300):
        v, at, n = ordering.whole_at(df, F.col("x"), place, descending)
        want = sorted(values, reverse=descending)
        assert v == want[place - 1] and at == place - want.index(v) and n == values.count(v)
    assert ordering.whole_at(df.limit(0), F.col("x"), 1) is None
    assert ordering.whole_at(spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "x long"), F.col("x"), 1) is None


def test_texts(spark):
    rng = random.Random(2)
    values = ["", "a", "a\x00", "ab", "abc", "é", "\U0001f600", "abcdefgh" * 20] + ["abcdefgh" * 20 + rng.choice("xyz") * rng.randrange(4) for _ in range(30)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x string").repartition(3)
    want = sorted(values, key=str.encode)
    for place in (1, 2, 3, 4, 6, 9, 20, len(values)):
        assert ordering.text_at(df, "x", place) == want[place - 1]


KINDS = {"timestamp": lambda n: datetime(2024, 1, 1, 0, 0, n), "date": lambda n: date(2024, 1, 1 + n), "int": int, "double": float}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("key", ["string", "long"])
def test_eviction(spark, kind, key):
    rng = random.Random(3)
    rows = [(f"k{i:02}" if key == "string" else i, rng.choice([None, 0, 1, 2, 9])) for i in range(40)]
    want = [k for k, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    df = spark.createDataFrame([(k, None if n is None else KINDS[kind](n)) for k, n in rows], f"content_hash {key}, last_accessed {kind}").repartition(3)
    for keep in (1, 17, 36, 40, 99):
        assert sorted(r["content_hash"] for r in store.evict(df, keep).collect()) == sorted(want[:keep])


def test_eviction_leaves_no_scratch_and_no_sort(spark, monkeypatch):
    df = spark.range(50).select(F.col("id").alias("content_hash"), F.timestamp_seconds(F.col("id") % 7).alias("last_accessed"))
    monkeypatch.setattr(ordering, "settle", lambda *a: pytest.fail("a scratch table"))
    plan = store.evict(df, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and store.evict(df, 20).count() == 20
