"""Figures about an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def location_stats(locations: DataFrame, repo: str | None = None, exact: bool = True) -> DataFrame:
    """By repository, or of one: locations, distinct hashes and distinct paths; exact False estimates the two."""
    rows = locations if repo is None else locations.filter(F.col("repo_root") == repo)
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return rows.groupBy("repo_root").agg(F.count("*").alias("locations"), distinct("content_hash").alias("hashes"), distinct("path").alias("paths"))


def counts_by(rows: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    """(value, n) of one column, null counted as unknown."""
    return rows.groupBy(F.coalesce(column, F.lit(unknown)).alias("value")).agg(F.count("*").alias("n"))


def cache_stats(cache: DataFrame) -> DataFrame:
    """One row: entries, accesses (sum, mean, least, most), first and last creation."""
    return cache.agg(
        F.count("*").alias("entries"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("accesses"), F.avg("access_count").alias("mean_accesses"), F.min("access_count").alias("least_accesses"), F.max("access_count").alias("most_accesses"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"),
    )


def symbol_stats(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row: symbols and files."""
    one = lambda rows, s, f: rows.select(F.lit(s).alias("symbols"), F.lit(f).alias("files"))
    return one(symbols, 1, 0).unionByName(one(files, 0, 1)).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("symbols", "files")])


def index_stats(locations: DataFrame, cache: DataFrame) -> DataFrame:
    """(metric, value, n): totals, and locations by type and by language."""
    total = locations.agg(F.count("*").alias("chunks"), F.count_distinct("content_hash").alias("hashes"), F.count_distinct("repo_root", "path").alias("files"))
    rows = total.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in total.columns]), F.array(*total.columns))).alias("value", "n")).select(F.lit("total").alias("metric"), "value", "n")
    rows = rows.unionByName(cache.agg(F.count("*").alias("n")).select(F.lit("total").alias("metric"), F.lit("cached").alias("value"), "n"))
    for metric, column in (("type", "node_type"), ("language", "language")):
        rows = rows.unionByName(counts_by(locations, column).select(F.lit(metric).alias("metric"), "value", "n"))
    return rows


#: Registers of a sketch as a power of two: distinct hashes are estimated with a standard error of 0.8 %. Files of few chunks have small sketches.
SKETCH = 14


def file_stats(locations: DataFrame) -> DataFrame:
    """A row for each file: (repo_root, path, chunks, types, languages, hashes), in parts that merge: counts, and a sketch of the hashes.

    A changed file's row replaces its old one, so counts stay exact and hashes that went don't linger in the sketches.
    """
    counted = lambda c: F.coalesce(c, F.lit("unknown"))
    each = locations.groupBy("repo_root", "path", counted("node_type").alias("t"), counted("language").alias("l")).agg(F.count("*").alias("n"), F.hll_sketch_agg("content_hash", SKETCH).alias("h"))
    by = each.groupBy("repo_root", "path").agg(F.sum("n").alias("chunks"), F.collect_list(F.struct(F.col("t").alias("k"), "n")).alias("ts"), F.collect_list(F.struct(F.col("l").alias("k"), "n")).alias("ls"), F.hll_union_agg("h").alias("hashes"))
    return by.select("repo_root", "path", "chunks", _summed("ts").alias("types"), _summed("ls").alias("languages"), "hashes")


def _summed(pairs: str) -> Column:
    """A map of sums from (key, n) pairs: as many as a file has types and languages."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.aggregate(F.filter(pairs, lambda p: p["k"] == k), F.lit(0).cast("long"), lambda a, p: a + p["n"])))


def merged_stats(kept: DataFrame, cache: DataFrame, repo: str | None = None) -> DataFrame:
    """index_stats() from rows of file_stats(): (metric, value, n). All are exact but the total of distinct hashes, which is an estimate."""
    rows = kept if repo is None else kept.filter(F.col("repo_root") == repo)
    total = rows.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("hashes")), F.lit(0)).alias("hashes"), F.count("*").alias("files"))
    out = total.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in total.columns]), F.array(*total.columns))).alias("value", "n")).select(F.lit("total").alias("metric"), "value", "n")
    out = out.unionByName(cache.agg(F.count("*").alias("n")).select(F.lit("total").alias("metric"), F.lit("cached").alias("value"), "n"))
    for metric, column in (("type", "types"), ("language", "languages")):
        out = out.unionByName(rows.select(F.explode(column).alias("value", "n")).groupBy("value").agg(F.sum("n").alias("n")).select(F.lit(metric).alias("metric"), "value", "n"))
    return out


def distinct_values(rows: DataFrame, column: str, repo: str | None = None) -> DataFrame:
    some = rows if repo is None else rows.filter(F.col("repo_root") == repo)
    return some.select(column).distinct().orderBy(column)


def registry_stats(projects: DataFrame) -> DataFrame:
    return projects.agg(F.count("*").alias("projects"), F.count(F.when(F.col("watch_enabled"), 1)).alias("watched"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("symbols", "embeddings", "db_bytes")])


def table_layout(table: DataFrame) -> DataFrame:
    """One row: how many files a table is read from and what Catalyst knows of its size."""
    files = table.inputFiles()
    size = str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return table.sparkSession.createDataFrame([(len(files), int(size))], "files long, bytes decimal(38,0)")
