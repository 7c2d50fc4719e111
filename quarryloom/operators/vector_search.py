"""Nearest neighbours, exact; ann.py has the approximate ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions import vectors as V

#: A block of queries that tasks hold at a time, in bytes, and how many of them are multiplied at once.
BLOCK_BYTES, PIECE = 32 << 20, 256
#: Vectors that a piece is multiplied with at once.
ROWS = 2048


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", mode: str = "metric", id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """The k rows nearest to the query: all columns but the vector, with distance and score; equal ones by id."""
    d = V.distance(metric, F.col(vector_column), V.literal(query))
    rows = vectors.filter(F.col(vector_column).isNotNull()).withColumn("distance", d).drop(vector_column)
    return rows.orderBy("distance", id_column).limit(k).withColumn("score", V.score(F.col("distance"), metric, mode))


def top_k_by_similarity(vectors: DataFrame, query: list[float], k: int, min_score: float | None = None, id_column: str = "id", vector_column: str = "embedding") -> DataFrame:
    """The k rows of highest cosine similarity as score; with min_score only those above it."""
    rows = vectors.filter(F.col(vector_column).isNotNull()).withColumn("score", V.cosine(F.col(vector_column), V.literal(query))).drop(vector_column)
    best = rows.orderBy(F.col("score").desc(), F.col(id_column)).limit(k)
    return best if min_score is None else best.filter(F.col("score") > min_score)


def filtered_top_k(vectors: DataFrame, query: list[float], k: int, repos: list, repo_column: str = "repo_root", **options) -> DataFrame:
    """The same within some repositories: filtered first, so that k rows come if there are so many. No repositories means all."""
    rows = vectors.filter(F.col(repo_column).isin(*repos)) if repos else vectors
    return top_k(rows, query, k, **options)


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_column: str = "id", query_column: str = "query_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query, for many queries.

    Queries go to the tasks in blocks of BLOCK_BYTES, one for most query sets,
    and vectors are read once for each; a task multiplies ROWS of its vectors
    with PIECE queries at a time and keeps k for each, at no time more, and
    those of all tasks are ranked. queries: query_id and the vector column.
    """
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)[id_column], dict(queries.dtypes)[query_column]
    rows = queries.filter(F.col(vector_column).isNotNull()).select(query_column, vector_column).orderBy(query_column).toLocalIterator(prefetchPartitions=True)
    found, block = None, []

    def ask(block: list) -> DataFrame:
        ids = [r[0] for r in block]
        matrix = spark.sparkContext.broadcast(np.stack([r[1] for r in block]))  # BLOCK_BYTES at most
        names = np.array(ids)

        def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # Of each piece of queries the best that were seen: (place of the query, distance, id) in that order, k of a query at most, and the distance to fall below.
            best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            worst = np.full(len(names), np.inf)
            for pdf in frames:
                for first in range(0, len(pdf), ROWS):
                    part = pdf.iloc[first : first + ROWS]
                    x, own = np.array(part[vector_column].tolist(), np.float64), part[id_column].to_numpy()
                    for at in range(0, len(names), PIECE):
                        d = distances(matrix.value[at : at + PIECE].astype(np.float64), x, metric)
                        fresh = nearest(d, own, worst[at : at + PIECE], k)
                        if len(fresh[0]):
                            kept = best_of(best[at], fresh, k) if at in best else fresh
                            full = np.flatnonzero(np.bincount(kept[0]) == k)
                            last = np.searchsorted(kept[0], full, "right") - 1
                            worst[at + full] = np.round(kept[1][last], 12)
                            best[at] = kept
            for at, (i, d, own) in best.items():
                yield pd.DataFrame({query_column: names[at + i], id_column: own, "distance": d})

        return vectors.filter(F.col(vector_column).isNotNull()).select(id_column, vector_column).mapInPandas(near, f"{query_column} {kinds[1]}, {id_column} {kinds[0]}, distance double")

    for r in rows:
        block.append((r[0], np.array(r[1], np.float32)))
        if len(block) * max(1, len(r[1])) * 4 >= BLOCK_BYTES:
            found, block = ask(block) if found is None else found.union(ask(block)), []
    if block or found is None:
        part = ask(block) if block else spark.createDataFrame([], f"{query_column} {kinds[1]}, {id_column} {kinds[0]}, distance double")
        found = part if found is None else found.union(part)
    w = Window.partitionBy(query_column).orderBy(F.round("distance", 12), id_column)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(d: np.ndarray, ids: np.ndarray, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance, id) of the k smallest of each row of d, equal ones by id, of those no farther than the row's worst."""
    near = d <= (worst + 1e-12)[:, None]
    if np.count_nonzero(near) > 4 * k * len(d) and d.shape[1] > k:
        near &= d <= (np.partition(d, k - 1, axis=1)[:, k - 1] + 1e-12)[:, None]  # as near as the k-th once rounded
    i, j = np.nonzero(near)
    return best_of((i[:0], d[:0, :0].ravel(), ids[:0]), (i, d[i, j], ids[j]), k)


def best_of(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of both, in order."""
    i, d, ids = (np.concatenate(x) for x in zip(a, b, strict=True))
    order = np.lexsort((ids, np.round(d, 12), i))
    i, d, ids = i[order], d[order], ids[order]
    some = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[some], d[some], ids[some]


def distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(rows - q).sum(1) for q in queries])
    dots = queries @ rows.T
    if metric == "dot_product":
        return -dots
    if metric == "euclidean":
        return np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * dots))
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None]
    return 1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def sync_index(index: DataFrame, vectors: DataFrame, id_column: str = "id") -> DataFrame:
    """index without rows that vectors lacks, with those that it lacks itself."""
    ids = vectors.select(id_column)
    return index.join(ids, id_column, "left_semi").unionByName(vectors.filter(F.col("embedding").isNotNull()).join(index.select(id_column), id_column, "left_anti"), allowMissingColumns=True)
