"""Keyword, symbol and semantic search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions import text as X
from quarryloom.functions import vectors as V
from quarryloom.operators import symbols as S
from quarryloom.operators.fusion import ranked

SNIPPET = 500


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern with (?P<name>...) as Java writes it; ValueError if it doesn't compile."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(out)
    except Exception as e:
        raise ValueError(f"not a regular expression: {pattern}") from e
    return out


def matching_lines(files: DataFrame, pattern: str) -> DataFrame:
    """(repo_root, path, line, text) of the lines that match, from 1."""
    pattern = java_pattern(files.sparkSession, pattern)
    # Files without any match are left out before their lines are taken apart.
    some = files.filter(F.col("text").rlike("(?m)" + pattern)) if not re.search(r"\\[AzZ]|\(\?", pattern) else files.filter(F.col("text").isNotNull())
    lines = some.select("repo_root", "path", F.posexplode(X.file_lines("text")).alias("i", "text"))
    return lines.filter(F.col("text").rlike(pattern)).select("repo_root", "path", (F.col("i") + 1).cast("int").alias("line"), "text")


def keyword_search(files: DataFrame, pattern: str, top_k: int = 20, per_file: int | None = None) -> DataFrame:
    """The first top_k matching lines by path and line, per_file (2 * top_k) of a file at most; score 100, 99, ..."""
    per_file = 2 * top_k if per_file is None else per_file
    hits = matching_lines(files, pattern)
    w = Window.partitionBy("repo_root", "path").orderBy("line")
    capped = hits.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_file).drop("n")
    best = capped.orderBy("path", "line", "repo_root").limit(top_k).withColumn("one", F.lit(1))
    rank = F.row_number().over(Window.partitionBy("one").orderBy("path", "line", "repo_root"))
    return best.withColumn("rank", rank).select("repo_root", "path", F.col("line").alias("line_start"), F.col("line").alias("line_end"), F.col("text").alias("snippet"), (F.lit(101.0) - F.col("rank")).alias("score"), "rank")


def get_file(files: DataFrame, repo_root: str, path: str, start: int = 1, end: int = 0) -> DataFrame:
    """(path, content) of one file's lines; no row if there is no such file."""
    return files.filter((F.col("repo_root") == repo_root) & (F.col("path") == path)).select("path", X.line_slice("text", start, end).alias("content"))


def semantic_search(records: DataFrame, query: list[float], limit: int = 10, repos: list[str] | None = None, min_score: float | None = 0.0) -> DataFrame:
    """The limit best records (path, start_line, end_line, embedding, ...) by cosine, of all repositories or some; with min_score only those above it."""
    rows = records.filter(F.col("repo_root").isin(*repos)) if repos else records
    scored = rows.filter(F.col("embedding").isNotNull()).withColumn("score", V.cosine(F.col("embedding"), V.literal(query))).drop("embedding")
    best = scored.orderBy(F.col("score").desc(), "path", "start_line", "repo_root").limit(limit)
    return best if min_score is None else best.filter(F.col("score") > min_score)


def semantic_search_by_hash(cache: DataFrame, locations: DataFrame, query: list[float], limit: int = 10, repos: list[str] | None = None) -> DataFrame:
    """The best hashes, twice as many as asked for, at all their places, each path and range once; of these the limit best."""
    scored = cache.filter(F.col("embedding").isNotNull()).withColumn("score", V.cosine(F.col("embedding"), V.literal(query))).select("content_hash", "score")
    best = scored.orderBy(F.col("score").desc(), "content_hash").limit(2 * limit)
    places = locations.filter(F.col("repo_root").isin(*repos)) if repos else locations
    at = places.join(best, "content_hash")  # 2 * limit rows on that side
    first = at.groupBy("repo_root", "path", "start_line", "end_line").agg(F.max("score").alias("score"), F.max_by("content_hash", F.struct("score", "content_hash")).alias("content_hash"))
    return first.orderBy(F.col("score").desc(), "path", "start_line", "repo_root").limit(limit)


def with_snippets(hits: DataFrame, files: DataFrame, start: str = "start_line", end: str = "end_line", length: int = SNIPPET) -> DataFrame:
    """hits with the text of their lines, cut to length; files is read for their paths only."""
    few = hits.join(files.select("repo_root", "path", "text").join(hits.select("repo_root", "path").distinct(), ["repo_root", "path"], "left_semi"), ["repo_root", "path"], "left")
    lines = F.array_join(F.slice(X.file_lines("text"), F.col(start), F.greatest(F.lit(0), F.col(end) - F.col(start) + 1)), "\n")
    return few.withColumn("snippet", X.hard_truncated(lines, length)).drop("text")


# The same as ranked lists, ready to be fused.


def keyword_signal(files: DataFrame, pattern: str, limit: int = 30) -> DataFrame:
    hits = keyword_search(files, pattern, limit)
    return hits.select(X.keyword_id("path", "line_start").alias("id"), "path", F.col("line_start").alias("line"), F.col("line_end").alias("end_line"), "score", F.lit("keyword").alias("source"), "rank", "snippet")


def semantic_signal(hits: DataFrame, limit: int = 20) -> DataFrame:
    rows = hits.select(X.chunk_id("path", "start_line", "end_line").alias("id"), "path", F.col("start_line").alias("line"), "end_line", "score", (F.col("snippet") if "snippet" in hits.columns else F.lit(None).cast("string")).alias("snippet"))
    return ranked(rows, "semantic", limit=limit)


def symbol_signal(symbols: DataFrame, name: str, limit: int = 10) -> DataFrame:
    """Scores limit, limit - 1, ... in the order of find_symbols()."""
    found = S.find_symbols(symbols, name, limit=limit).withColumn("one", F.lit(1))
    place = F.row_number().over(Window.partitionBy("one").orderBy("match", "name", "path", "line"))
    rows = found.withColumn("rank", place)
    snippet = F.col("signature") if "signature" in found.columns else F.lit(None).cast("string")
    return rows.select(X.symbol_id("path", "line", "name").alias("id"), "path", "line", F.col("line").alias("end_line"), (F.lit(float(limit)) - F.col("rank") + 1).alias("score"), F.lit("symbol").alias("source"), "rank", snippet.alias("snippet"))


def into_chunks(hits: DataFrame, chunks: DataFrame, size: int = 64) -> DataFrame:
    """hits (path, line, ...) with the id of the chunk that covers their line, the first if several do; their own id without one.

    Lines are cut into blocks of size, so that the range condition joins by equal blocks.
    """
    spread = chunks.select("path", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size))).alias("block"))
    own = hits.withColumn("block", F.floor(F.col("line") / size))
    over = own.join(spread.select(F.col("path").alias("c_path"), "block", "start_line", F.col("end_line").alias("c_end")).withColumnRenamed("block", "c_block"), (F.col("path") == F.col("c_path")) & (F.col("block") == F.col("c_block")) & F.col("line").between(F.col("start_line"), F.col("c_end")), "left")
    columns = [c for c in hits.columns if c != "id"]
    best = over.groupBy("id", *columns).agg(F.min(F.struct("start_line", "c_end")).alias("c"))
    covered: Column = X.chunk_id("path", "c.start_line", "c.c_end")
    return best.withColumn("id", F.when(F.col("c.start_line").isNull(), F.col("id")).otherwise(covered)).drop("c")
