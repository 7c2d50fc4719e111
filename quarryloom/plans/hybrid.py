"""Several signals in one plan."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.config import SearchConfig
from quarryloom.functions import text as X
from quarryloom.operators import fusion as R
from quarryloom.operators import rerank as K
from quarryloom.operators import search as S
from quarryloom.scratch import settle


def hybrid_by_sum(files: DataFrame, records: DataFrame, pattern: str, query: list[float], keyword_limit: int = 20, semantic_limit: int = 10, keyword_weight: float = 0.6, semantic_weight: float = 0.4) -> DataFrame:
    """Keyword and semantic hits added up by path:start-end, the best keyword_limit + semantic_limit of them."""
    k = S.keyword_search(files, pattern, keyword_limit).select(X.range_key("path", "line_start", "line_end").alias("key"), "path", F.col("line_start").alias("start_line"), F.col("line_end").alias("end_line"), "snippet")
    s = S.semantic_search(records, query, semantic_limit)
    s = s.select(X.range_key("path", "start_line", "end_line").alias("key"), "path", "start_line", "end_line", (F.col("content") if "content" in s.columns else F.lit(None).cast("string")).alias("snippet"), "score")
    return R.weighted_sum(k, s, keyword_weight, semantic_weight).orderBy(F.col("score").desc(), "key").limit(keyword_limit + semantic_limit)


def _signals(files: DataFrame | None, records: DataFrame | None, symbols: DataFrame | None, pattern: str | None, query: list[float] | None, name: str | None, config: SearchConfig, chunks: DataFrame | None) -> dict[str, Callable[[], DataFrame]]:
    """The ranked lists that there are a table and a query for, by source."""
    into = (lambda hits: S.into_chunks(hits, chunks)) if chunks is not None else (lambda hits: hits)
    out: dict[str, Callable[[], DataFrame]] = {}
    if files is not None and pattern:
        out["keyword"] = lambda: into(S.keyword_signal(files, pattern, config.keyword_limit))
    if symbols is not None and name:
        out["symbol"] = lambda: into(S.symbol_signal(symbols, name, config.symbol_limit))
    if records is not None and query:
        out["semantic"] = lambda: S.semantic_signal(S.semantic_search(records, query, config.semantic_limit, min_score=None), config.semantic_limit)
    if not out:
        raise ValueError("no signal: give a table and a query for one of them")
    return out


def retrieve(files: DataFrame | None, records: DataFrame | None, symbols: DataFrame | None, pattern: str | None, query: list[float] | None, name: str | None, config: SearchConfig | None = None, limit: int = 20, chunks: DataFrame | None = None) -> DataFrame:
    """Three signals fused by weight; a signal without its table or query is left out.

    With chunks, keyword and symbol hits take the id of the chunk that covers
    their line, so that signals can agree; otherwise each kind of hit has ids of its own.
    """
    config = config or SearchConfig()
    lists = [signal() for signal in _signals(files, records, symbols, pattern, query, name, config, chunks).values()]
    return R.top_n(R.weighted_rrf(config.weights, *lists, k=config.rrf_k), limit)


def gathered(signals: dict[str, Callable[[], DataFrame]], timeout: float | None = None) -> tuple[list[DataFrame], dict[str, str]]:
    """(the signals' rows, why the others are missing by name): all run at once, each is written; one that fails or takes longer than timeout seconds is left out, its jobs stopped."""

    def run(name: str, tag: str) -> DataFrame:
        rows = signals[name]()
        rows.sparkSession.addTag(tag)
        try:
            return settle(rows, f"signal-{name}")
        finally:
            rows.sparkSession.removeTag(tag)

    found, missing = [], {}
    pool = ThreadPoolExecutor(max(1, len(signals)))
    try:
        tags = {name: f"signal-{uuid.uuid4().hex}" for name in signals}
        waiting = {name: pool.submit(run, name, tags[name]) for name in signals}
        until = None if timeout is None else time.monotonic() + timeout
        for name, answer in waiting.items():
            try:
                found.append(answer.result(None if until is None else max(0.0, until - time.monotonic())))
            except TimeoutError:
                missing[name] = f"no answer in {timeout} s"
                if spark := SparkSession.getActiveSession():
                    spark.interruptTag(tags[name])
            except Exception as e:
                missing[name] = f"{type(e).__name__}: {e}".splitlines()[0]
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return found, missing


def retrieve_tolerant(files: DataFrame | None, records: DataFrame | None, symbols: DataFrame | None, pattern: str | None, query: list[float] | None, name: str | None, config: SearchConfig | None = None, limit: int = 20, chunks: DataFrame | None = None, timeout: float | None = 30.0) -> tuple[DataFrame, dict[str, str]]:
    """(what retrieve() gives of the signals that answer in time, why the others are missing); RuntimeError if none answers."""
    config = config or SearchConfig()
    lists, missing = gathered(_signals(files, records, symbols, pattern, query, name, config, chunks), timeout)
    if not lists:
        raise RuntimeError(f"no signal answered: {missing}")
    return R.top_n(R.weighted_rrf(config.weights, *lists, k=config.rrf_k), limit), missing


def hybrid(files: DataFrame, cache: DataFrame, locations: DataFrame, pattern: str, query: list[float], limit: int = 20, config: SearchConfig | None = None, contents: DataFrame | None = None, provider: K.Provider | K.Scorer | None = None) -> DataFrame:
    """Keyword and hash-level semantic search, fused by weight and cut at twice the limit; reranked with a provider, if that works; cut at the limit.

    contents: id, content of the candidates, needed for reranking.
    """
    config = config or SearchConfig()
    k = S.keyword_signal(files, pattern, limit)
    s = S.semantic_signal(S.semantic_search_by_hash(cache, locations, query, limit), limit)
    fused = R.top_n(R.weighted_rrf(config.weights, k, s, k=config.rrf_k), 2 * limit)
    if provider is None or contents is None:
        return fused.limit(limit)
    return K.rerank(fused, contents, provider, config.rerank_top_k, config.rerank_threshold, most=2 * limit, on_failure="keep").orderBy("position").limit(limit)
