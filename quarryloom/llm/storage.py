"""Scratch tables (of the library's scratch module) and Python workers that stay small."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from quarryloom.scratch import clear_scratch, drop_settled, settle, shared_dir

__all__ = ["clear_scratch", "drop_settled", "prepare_workers", "settle", "shared_dir"]

#: Arrow batches of more bytes than this are made smaller.
BATCH_BYTES = 16 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare_workers(spark: SparkSession) -> None:
    """Lets Python workers find this package when it isn't installed, and keeps them small.

    Batches of long texts are bounded in bytes, unless the session says how
    itself, and the workers' allocator gives large arrays back to the system
    instead of holding them for later.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    for name, value in (("MALLOC_MMAP_THRESHOLD_", "1048576"), ("MALLOC_TRIM_THRESHOLD_", "1048576"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
