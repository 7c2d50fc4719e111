"""What the planner makes of queries: filters reach the scan, limits cut before windows, no products of tables."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quarryloom.operators import lookup, search, store, vector_search
from quarryloom.queries import QUERIES, files, locations, table, vector


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    rows = table(spark, SMALL, "lineitem")
    p = plan(store.select_rows(rows, ("l_orderkey",), [F.col("l_returnflag") == "R"]))
    assert "EqualTo(l_returnflag,R)" in p and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in p
    docs = table(spark, SMALL, "documents").withColumnRenamed("source", "repo_root").withColumn("path", F.col("doc_id").cast("string"))
    assert "EqualTo(source,src1)" in plan(lookup.by_repo(docs, "src1"))


def test_top_k_is_no_full_sort(spark):
    e = table(spark, SMALL, "embeddings").withColumn("id", F.col("vec_id"))
    assert "TakeOrderedAndProject" in plan(vector_search.top_k(e, vector(spark, SMALL), 5))
    # Eviction sorts times and keys elsewhere; rows are filtered where they are.
    p = plan(store.evict(e.withColumnRenamed("vec_id", "content_hash").withColumn("last_accessed", F.col("label")), 5))
    assert "Exchange" not in p and "Sort" not in p and "Filter" in p


def test_caps_are_pushed_below_the_window(spark):
    p = plan(search.keyword_search(files(spark, SMALL), "tion", 5))
    assert "WindowGroupLimit" in p and "TakeOrderedAndProject" in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_products(spark, name):
    p = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in p
    # The only nested loop is over the few projects that own a path.
    assert "BroadcastNestedLoopJoin" not in p or name in ("events_to_project", "reindex_queue")


def test_existence_is_one_join(spark):
    rows = locations(spark, SMALL)
    assert plan(lookup.existing(rows, rows, ("content_hash",))).count("Join") == 1
