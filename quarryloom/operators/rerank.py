"""Reranking the head of a fused list."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.functions import vectors as V
from quarryloom.operators.embed import Embedder
from quarryloom.operators.fusion import fused_order
from quarryloom.operators.ordering import numbered
from quarryloom.scratch import settle

Provider = Callable[[Column], Column]


def fixed_scores(score: float = 1.0) -> Provider:
    return lambda content: F.lit(float(score))


def overlap_scores(query: str) -> Provider:
    """The share of the query's words that the content has, as words."""
    words = sorted({w for w in query.lower().split() if w})

    def score(content: Column) -> Column:
        have = F.split(F.lower(content), r"[^\p{L}\p{N}]+")
        return F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in words]))) / F.lit(float(max(1, len(words))))

    return score


def embedding_scores(query: list[float], embed: Callable[[Column], Column], on_error: float = 0.5) -> Provider:
    """The cosine of the query's vector and the content's; on_error where there is none."""
    return lambda content: F.coalesce(V.cosine(V.literal(query), embed(content)), F.lit(on_error))


@dataclass(frozen=True)
class Scorer:
    """A provider that needs a table: (id, content) to (id, rerank_score); ids it leaves out get on_error."""

    score: Callable[[DataFrame], DataFrame]
    on_error: float = 0.5


def embedder_scores(query: str, embedder: Embedder, on_error: float = 0.5) -> Scorer:
    """The cosine of the query's and the content's vectors, which the embedder makes in Arrow batches; on_error for contents that it has no vector for."""
    asked = embedder.embed_text(query)

    def score(rows: DataFrame) -> DataFrame:
        vectors = embedder.embed(rows, "id", "content")
        return vectors.select("id", F.when(F.col("embedding").isNotNull(), V.cosine(F.col("embedding"), V.literal(asked))).alias("rerank_score"))

    return Scorer(score, on_error)


def _scored(head: DataFrame, contents: DataFrame, provider: Provider | Scorer) -> DataFrame:
    """head with rerank_score, null without content."""
    if not isinstance(provider, Scorer):
        both = head.join(contents.select("id", "content"), "id", "left")
        return both.withColumn("rerank_score", F.when(F.col("content").isNotNull(), provider(F.col("content")).cast("double"))).drop("content")
    known = settle(contents.filter(F.col("content").isNotNull()).select("id", "content").join(head.select("id"), "id", "left_semi"), "contents")
    scores = known.select("id").join(provider.score(known), "id", "left").select("id", F.coalesce("rerank_score", F.lit(provider.on_error)).cast("double").alias("rerank_score"))
    return head.join(scores, "id", "left")


def rerank(candidates: DataFrame, contents: DataFrame, provider: Provider | Scorer | None, top_k: int = 20, threshold: float = 0.0, most: int | None = None, on_failure: str = "raise") -> DataFrame:
    """candidates in their new order, with position, rerank_score and reranked.

    The first top_k, by fused_order(), that have a content get the provider's
    score and are sorted by it; those under the threshold go. The ones without
    content follow in their old order, then the tail. Without a provider, or
    if none has a content, the old order stays and reranked is false. contents: id, content.

    most: candidates are cut at that many and numbered in one task; without it
    they are numbered over all tasks. Only the first top_k are sorted again,
    all if that isn't positive. The provider is asked at once and only once;
    on_failure "keep" returns the old order if it fails.
    """
    placed = numbered(candidates, fused_order(), "old", most)
    none = F.lit(None).cast("double").alias("rerank_score")
    untouched = placed.select("*", none, F.lit(False).alias("reranked")).withColumnRenamed("old", "position")
    if provider is None:
        return untouched
    head = placed.filter(F.col("old") <= top_k) if top_k > 0 else placed
    try:
        scored = settle(_scored(head, contents, provider), "scored")
    except Exception:
        if on_failure == "keep":
            return untouched
        raise
    kept = scored.filter(F.col("rerank_score").isNull() | (F.col("rerank_score") >= threshold))
    bound = most if top_k <= 0 else top_k if most is None else min(top_k, most)
    first = numbered(kept, [F.col("rerank_score").desc_nulls_last(), F.col("old")], "position", bound).withColumn("reranked", F.col("rerank_score").isNotNull()).drop("old")
    if top_k <= 0:
        return first
    gone = scored.filter(F.col("rerank_score") < threshold).count()  # of the head; the tail moves up by them
    rest = placed.filter(F.col("old") > top_k).withColumn("position", F.col("old") - gone).drop("old")
    return first.unionByName(rest.select("*", none, F.lit(False).alias("reranked")))
