import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Runs SQL in DuckDB over a folder of tables."""
    import duckdb

    def run(sql: str, folder: str = SMALL):
        con = duckdb.connect()
        for f in os.listdir(folder):
            at = f"{folder}/{f}"
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
        return con.execute(sql).fetchdf()

    return run


@pytest.fixture(scope="session")
def rows_of():
    """A frame's rows, in an order of their own and free of number types."""

    def plain(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, list | tuple):
            return [plain(y) for y in x]
        return None if x is None or x != x else x

    def rows(frame):
        pdf = frame if hasattr(frame, "columns") and not hasattr(frame, "toPandas") else frame.toPandas()
        cols = sorted(pdf.columns)
        return cols, sorted(repr([plain(x) for x in r]) for r in pdf[cols].itertuples(index=False, name=None))

    return rows
