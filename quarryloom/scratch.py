"""Scratch tables in the cluster's shared folder.

``spark.checkpoint.dir`` names that folder. A table written there cuts the
lineage and outlives any executor; it is plain Parquet, so it is read again
by as many tasks as it needs.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "quarryloom-"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a single machine gets a folder of its own; a cluster, whose executors don't see the driver's folders, an error."""
    said = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    said = said or spark.conf.get("spark.checkpoint.dir", None)
    if not said and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (said or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    """A folder of this process, deleted at its end: for tests and single machines."""
    path = tempfile.mkdtemp(prefix=LOCAL_FALLBACK)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


#: Folders that settle() wrote in this process and nothing has deleted yet, by application.
_settled: dict[str, list[str]] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for something other than a table; clear_scratch() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and returns the table that was written. It stays until drop_settled() or clear_scratch()."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_settled(*tables: DataFrame) -> None:
    """Deletes the files behind tables that settle() returned and nothing reads any more."""
    for df in tables:
        mine = _settled.get(df.sparkSession.sparkContext.applicationId, [])
        names = {f.rstrip("/").rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        for path in [p for p in mine if p.rpartition("/")[2] in names]:
            _delete(df.sparkSession, path)
            mine.remove(path)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes all scratch tables of this application and says how many: for when results have been written and their frames aren't read again."""
    mine = _settled.pop(spark.sparkContext.applicationId, [])
    for path in mine:
        _delete(spark, path)
    return len(mine)
