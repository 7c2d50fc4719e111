"""The calls that a client makes, each one row of JSON.

A Workspace holds the tables; every call returns a DataFrame of one column,
json, so that a server only has to pass it on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.config import SearchConfig
from quarryloom.operators import embed, rerank, search
from quarryloom.operators import symbols as symbol_ops
from quarryloom.plans import hybrid


def _document(rows: DataFrame, name: str = "results", order: list | None = None, **more: Column) -> DataFrame:
    """{name: [rows], ...}; rows are the few that a call returns."""
    fields = F.struct(*rows.columns)
    keyed = rows.select(F.struct(*[F.col(c) for c in (order or [])], fields.alias("row")).alias("x")) if order else rows.select(F.struct(fields.alias("row")).alias("x"))
    listed = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"])
    return keyed.agg(F.to_json(F.struct(listed.alias(name), *[v.alias(k) for k, v in more.items()])).alias("json"))


@dataclass
class Workspace:
    files: DataFrame
    symbols: DataFrame | None = None
    cache: DataFrame | None = None
    locations: DataFrame | None = None
    embedder: embed.Embedder | None = None
    repo_root: str | None = None

    def _mine(self, rows: DataFrame) -> DataFrame:
        return rows if self.repo_root is None else rows.filter(F.col("repo_root") == self.repo_root)

    def _vector(self, query: str) -> list[float] | None:
        ready = self.embedder is not None and self.embedder.available() and self.cache is not None and self.locations is not None
        return self.embedder.embed_text(query) if ready else None

    def search_keyword(self, query: str, top_k: int = 20) -> DataFrame:
        hits = search.keyword_search(self._mine(self.files), query, top_k)
        return _document(hits.select("rank", "path", "line_start", "line_end", "snippet", "score"), order=["rank"])

    def get_file(self, path: str, start_line: int = 1, end_line: int = 0) -> DataFrame:
        found = self._mine(self.files).filter(F.col("path") == path)
        return search.get_file(found, found.select("repo_root").first()[0], path, start_line, end_line).select(F.to_json(F.struct("path", "content")).alias("json")) if found.take(1) else found.limit(0).select(F.lit("").alias("json"))

    def find_symbol(self, name: str, kind: str | None = None, limit: int = 50) -> DataFrame:
        found = symbol_ops.find_symbols(self._mine(self.symbols), name, kind, limit)
        return _document(found.select("match", "name", "kind", "path", "line", "language", "scope", "signature"), "symbols", ["match", "name", "path", "line"])

    def list_defs_in_file(self, path: str) -> DataFrame:
        found = self._mine(self.symbols).filter(F.col("path") == path)
        return _document(found.select("line", "name", "kind", "scope", "signature"), "symbols", ["line", "name"], path=F.lit(path))

    def search_semantic(self, query: str, limit: int = 10) -> DataFrame:
        """available says whether there are vectors; without any the list is empty."""
        v = self._vector(query)
        if v is None:
            return _document(self.files.limit(0).select("path"), available=F.lit(False))
        hits = search.semantic_search_by_hash(self.cache, self._mine(self.locations), v, limit)
        hits = search.with_snippets(hits, self.files).select("path", "start_line", "end_line", "score", "snippet")
        return _document(hits.withColumn("order", -F.col("score")).select("order", "path", "start_line", "end_line", "score", "snippet"), order=["order", "path", "start_line"], available=F.lit(True))

    def hybrid_search(self, query: str, keyword_limit: int = 20, semantic_limit: int = 10) -> DataFrame:
        v = self._vector(query)
        records = self._mine(self.locations).join(self.cache.select("content_hash", "embedding"), "content_hash") if v else None
        if records is None:
            return self.search_keyword(query, keyword_limit)
        found = hybrid.hybrid_by_sum(self._mine(self.files), records, query, v, keyword_limit, semantic_limit)
        return _document(found.withColumn("order", -F.col("score")).select("order", "path", "start_line", "end_line", "score", "source", "snippet"), order=["order", "path", "start_line"])

    def hybrid_search_v2(self, query: str, limit: int = 20, rerank_results: bool = False, config: SearchConfig | None = None) -> DataFrame:
        """Fused results; reranked by the embedder's cosine if asked for, and reranked says for each whether that was done. If the embedder fails the fused order stays."""
        v = self._vector(query)
        files = self._mine(self.files)
        if v is None:
            found = hybrid.retrieve(files, None, None, query, None, None, config, limit)
            return _document(found.withColumn("order", -F.col("rrf_score")).select("order", "id", "path", "line", "end_line", "rrf_score", "sources", "snippet"), order=["order", "id"], semantic_available=F.lit(False))
        fused = hybrid.hybrid(files, self.cache, self._mine(self.locations), query, v, 2 * limit if rerank_results else limit, config)
        if not rerank_results:
            return _document(fused.withColumn("order", -F.col("rrf_score")).select("order", "id", "path", "line", "end_line", "rrf_score", "sources", "snippet"), order=["order", "id"], semantic_available=F.lit(True))
        few = fused.withColumn("repo_root", F.lit(self.repo_root)) if self.repo_root else fused.join(files.groupBy("path").agg(F.min("repo_root").alias("repo_root")), "path")
        contents = search.with_snippets(few.drop("snippet"), files, "line", "end_line").select("id", F.col("snippet").alias("content"))
        found = rerank.rerank(fused, contents, rerank.embedder_scores(query, self.embedder), most=2 * limit, on_failure="keep").orderBy("position").limit(limit)
        return _document(found.select("position", "id", "path", "line", "end_line", "rrf_score", "rerank_score", "reranked", "sources"), order=["position"], semantic_available=F.lit(True))
