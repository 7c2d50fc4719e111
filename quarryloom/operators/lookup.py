"""Reading rows of an index by their keys. Reads change nothing: accesses are logged and folded in later (store.fold_accesses)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lists up to this length become a filter that reaches the scan; longer ones a semi join.
SHORT_LIST = 1000


def by_repo(rows: DataFrame, repo_root: str) -> DataFrame:
    return rows.filter(F.col("repo_root") == repo_root)


def by_path(rows: DataFrame, repo_root: str, path: str) -> DataFrame:
    """Rows of one file in the order of their lines."""
    order = [c for c in ("start_line", "start_byte", "line") if c in rows.columns]
    return rows.filter((F.col("repo_root") == repo_root) & (F.col("path") == path)).orderBy(*order)


def by_hash(rows: DataFrame, content_hash: str) -> DataFrame:
    return rows.filter(F.col("content_hash") == content_hash)


def by_hashes(rows: DataFrame, hashes: list[str] | DataFrame, repos: list[str] | None = None) -> DataFrame:
    """Rows of any of these hashes, of all repositories or some. hashes: a list, or a table with content_hash."""
    some = rows.filter(F.col("repo_root").isin(*repos)) if repos else rows
    if isinstance(hashes, DataFrame):
        return some.join(hashes.select("content_hash"), "content_hash", "left_semi")
    if len(hashes) <= SHORT_LIST:
        return some.filter(F.col("content_hash").isin(*hashes))
    keys = rows.sparkSession.createDataFrame([(h,) for h in hashes], "content_hash string")
    return some.join(keys, "content_hash", "left_semi")


def by_attribute(rows: DataFrame, **values: str) -> DataFrame:
    """Rows whose columns have these values, as in by_attribute(locations, node_type="class_definition")."""
    for column, value in values.items():
        rows = rows.filter(F.col(column) == value)
    return rows


def existing(keys: DataFrame, rows: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """keys with exists: whether rows has them. One join answers for all keys."""
    known = rows.select(*on).distinct().withColumn("exists", F.lit(True))
    return keys.join(known, list(on), "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def count_rows(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def attach_locations(hits: DataFrame, records: DataFrame) -> DataFrame:
    """hits (content_hash, ...) with path and lines of one record each, the last by place; null for hashes without one."""
    last = records.groupBy("content_hash").agg(F.max(F.struct("path", "start_line", "end_line")).alias("at")).select("content_hash", "at.*")
    return hits.join(last, "content_hash", "left")


def config_of(config: DataFrame, repo_root: str | None = None) -> DataFrame:
    """The embedding settings of one repository, or of all in their order."""
    return config.orderBy("repo_root") if repo_root is None else by_repo(config, repo_root)
