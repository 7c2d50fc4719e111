"""Every registered query runs; those with SQL give the same as DuckDB."""

import pytest
from conftest import SMALL

from quarryloom.queries import QUERIES, SQL, flagship


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, oracle, rows_of, name):
    assert rows_of(QUERIES[name](spark, SMALL)) == rows_of(oracle(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_flagship(spark):
    rows = flagship(spark, SMALL).collect()
    assert rows and [r["position"] for r in rows] == list(range(1, len(rows) + 1))


def test_entry_without_llm(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
