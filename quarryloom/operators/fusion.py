"""Fusing ranked lists.

A ranked list is a DataFrame of id, score, source and rank, with path, line,
end_line, snippet and metadata where it has them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.operators.ordering import numbered

RRF_K = 60
CARRIED = ("path", "line", "end_line", "snippet", "metadata")


def ranked(hits: DataFrame, source: str, by: list | None = None, limit: int = 0) -> DataFrame:
    """hits with source and rank from 1, by falling score and id unless by says otherwise.

    With a limit only that many rows are sorted to one place; without one all
    are ranked, over all tasks.
    """
    order = by or [F.col("score").desc(), F.col("id")]
    return numbered(hits, order, most=limit if limit > 0 else None).withColumn("source", F.lit(source))


def _together(lists: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


def _fused(rows: DataFrame, part: Column) -> DataFrame:
    """One row for each id: the sum of its parts, its best score, its sources and what the first source says of it."""
    carried = [c for c in CARRIED if c in rows.columns]
    first = F.min_by(F.struct(*carried), F.struct("source", "rank")).alias("of") if carried else F.lit(None).alias("of")
    out = rows.withColumn("part", part).groupBy("id").agg(F.sum("part").alias("rrf_score"), F.max("score").alias("score"), F.array_sort(F.collect_list("source")).alias("sources"), first)
    return out.select("id", "rrf_score", "score", "sources", *[F.col("of").getField(c).alias(c) for c in carried])


def rrf(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank) over the lists that hold an id."""
    return _fused(_together(lists), F.lit(1.0) / (F.lit(k) + F.col("rank")))


def weighted_rrf(weights: dict[str, float], *lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """The same with a weight for each source; one that is missing or 0 counts as 1."""
    weight = F.lit(1.0)
    for source, w in sorted(weights.items()):
        if w:
            weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    return _fused(_together(lists), weight / (F.lit(k) + F.col("rank")))


def fused_order() -> list[Column]:
    return [F.round("rrf_score", 12).desc(), F.col("score").desc(), F.size("sources").desc(), F.col("id")]


def top_n(fused: DataFrame, n: int) -> DataFrame:
    """The n best; all of them if n isn't positive."""
    return fused.orderBy(*fused_order()).limit(n) if n > 0 else fused.orderBy(*fused_order())


def at_least(fused: DataFrame, score: float) -> DataFrame:
    return fused.filter(F.col("rrf_score") >= score)


def min_sources(fused: DataFrame, n: int) -> DataFrame:
    """Those that n lists or more hold; repeats count."""
    return fused if n <= 1 else fused.filter(F.size("sources") >= n)


def source_count(sources: str = "sources") -> Column:
    return F.size(F.array_distinct(sources))


def weighted_sum(keyword: DataFrame, semantic: DataFrame, keyword_weight: float = 0.6, semantic_weight: float = 0.4) -> DataFrame:
    """Keyword hits count keyword_weight each, semantic ones semantic_weight times their score, added up by key.

    Both have key, path, start_line, end_line, snippet; semantic also score. source
    is keyword, semantic or both; the snippet is the keyword one if there is one.
    """
    k = keyword.select("key", "path", "start_line", "end_line", "snippet", F.lit(float(keyword_weight)).alias("part"), F.lit("keyword").alias("signal"))
    s = semantic.select("key", "path", "start_line", "end_line", "snippet", (F.col("score") * semantic_weight).alias("part"), F.lit("semantic").alias("signal"))
    both = k.unionByName(s).groupBy("key").agg(
        F.sum("part").alias("score"), F.collect_set("signal").alias("signals"), F.min_by(F.struct("path", "start_line", "end_line", "snippet"), F.struct("signal", "snippet")).alias("of"),
    )
    source = F.when(F.size("signals") > 1, F.lit("both")).otherwise(F.get("signals", F.lit(0)))
    return both.select("key", "of.*", "score", source.alias("source"))
