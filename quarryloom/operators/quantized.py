"""Nearest neighbours by cosine from byte codes, with exact distances for the few best.

A unit vector is cut into short parts, and each part becomes the number of the
nearest of 256 centres: a byte for three numbers. A query has a table of its
products with all centres, so its product with a coded vector is a sum of table
entries. That pass reads codes only; the best of it are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions import vectors as V
from quarryloom.operators.versioned import Spec, VersionedTables
from quarryloom.operators.vector_search import BLOCK_BYTES

#: Numbers in a part, centres of a part, and vectors that centres are fitted to at most.
WIDTH, CENTERS, SAMPLE = 3, 256, 8_192
#: How many times k rows are compared exactly, and the queries that a task looks at together.
OVER, PIECE = 5, 64
ROUNDS = 12

SPECS = {"codes": Spec("id bigint, code binary", ("id",)), "books": Spec("part int, centers array<double>", ("part",))}


def centers_of(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """CENTERS centres of rows by k-means; rows themselves where they are no more."""
    known = np.unique(x, axis=0)
    if len(known) <= CENTERS:
        return np.concatenate([known, np.repeat(known[-1:], CENTERS - len(known), axis=0)])
    c = known[np.random.default_rng(seed).choice(len(known), CENTERS, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=CENTERS)
        sums = np.stack([np.bincount(near, x[:, j], CENTERS) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, axis=1)


def parted(v: np.ndarray) -> np.ndarray:
    """Rows cut into parts of WIDTH numbers, the last one filled up with zeros."""
    pad = -v.shape[1] % WIDTH
    return np.pad(v, ((0, 0), (0, pad))).reshape(len(v), -1, WIDTH)


def _best(d: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """For each row of d the places of its smallest numbers, equal ones by id; ids are sorted."""
    if d.shape[1] <= most:
        return list(np.argsort(d, axis=1, kind="stable"))
    edge = np.partition(d, most - 1, axis=1)[:, most - 1]
    some = [np.flatnonzero(row <= e) for row, e in zip(d, edge, strict=True)]
    return [at[np.argsort(row[at], kind="stable")][:most] for row, at in zip(d, some, strict=True)]


class QuantizedIndex:
    """Codes and centres under one folder, of one version; vectors stay where they are."""

    def __init__(self, spark: SparkSession, path: str, id_column: str = "id", vector_column: str = "embedding", buckets: int = 16):
        self.spark, self.id, self.vector = spark, id_column, vector_column
        self.tables = VersionedTables(spark, path, SPECS, buckets)

    def _own(self, vectors: DataFrame) -> DataFrame:
        return vectors.filter(F.col(self.vector).isNotNull()).select(F.col(self.id).cast("long").alias("id"), V.normalized(F.col(self.vector)).alias("v"))

    def build(self, vectors: DataFrame, sample: int = SAMPLE) -> QuantizedIndex:
        """Replaces the index by one of these rows, of one length and with distinct ids; rows without a vector are left out.

        Centres are fitted to at most sample of them, in the order of a hash of the id; all are coded.
        """

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.array(pdf.sort_values("id")["x"].tolist(), float)  # sample rows at most
            return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "centers": [centers_of(x).ravel()]})

        own = self._own(vectors)
        first = own.select(F.size("v").alias("d")).first()
        change = self.tables.begin("codes")
        for table in SPECS:
            if self.tables.version():
                change.replace(table, None, change.read(table).select(*SPECS[table].keys))
        if first is not None:
            parts = -(-first["d"] // WIDTH)
            v = F.concat("v", F.array_repeat(F.lit(0.0), parts * WIDTH - first["d"]))
            cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice(v, i * WIDTH + 1, WIDTH))).alias("part", "x")
            books = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").select("id", cut).groupBy("part").applyInPandas(fit, "part int, centers array<double>")
            change.replace("books", books)
        change.commit()
        return self.put(vectors) if first is not None else self

    def _books(self, version: int) -> np.ndarray:
        rows = sorted(self.tables.read("books", version).select("part", "centers").collect())  # CENTERS times a vector's length
        return np.array([r["centers"] for r in rows]).reshape(len(rows), CENTERS, WIDTH)

    def put(self, vectors: DataFrame) -> QuantizedIndex:
        """Codes rows by the present centres; earlier codes of their ids go."""
        books = self.spark.sparkContext.broadcast(self._books(self.tables.version()))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = parted(batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                    code = np.stack([nearest(x[:, j], c) for j, c in enumerate(books.value)], axis=1).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([batch["id"], pa.array([r.tobytes() for r in code], pa.binary())], ["id", "code"])

        own = self._own(vectors)
        change = self.tables.begin("codes")
        change.replace("codes", own.mapInArrow(coded, "id bigint, code binary"), own.select("id"))
        change.commit()
        books.unpersist()
        return self

    def delete(self, ids: DataFrame) -> QuantizedIndex:
        change = self.tables.begin("codes")
        change.replace("codes", None, ids.select(F.col(self.id).cast("long").alias("id")))
        change.commit()
        return self

    def candidates(self, queries: DataFrame, most: int, query_column: str = "query_id") -> DataFrame:
        """(query_id, id): the most rows of highest coded product with each query. Reads codes, no vectors, once for each BLOCK_BYTES of queries."""
        version = self.tables.version()
        kind = dict(queries.dtypes)[query_column]
        schema = f"{query_column} {kind}, id bigint, d double"
        books = self._books(version)
        if not len(books):
            return self.spark.createDataFrame([], schema).drop("d")
        codes = self.tables.read("codes", version).select("id", "code")

        def ask(block: list) -> DataFrame:
            held = self.spark.sparkContext.broadcast((np.array([r[0] for r in block]), np.array([r[1] for r in block]), books))

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
                names, asked, centers = held.value
                best: list[pd.DataFrame] = []
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    ids = batch["id"].to_numpy()
                    order = np.argsort(ids, kind="stable")
                    code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                    ids = ids[order]
                    for at in range(0, len(names), PIECE):
                        tables = np.einsum("qpw,pcw->pqc", parted(asked[at : at + PIECE]), centers)
                        d = 1 - sum(t[:, code[:, j]] for j, t in enumerate(tables))
                        places = _best(d, ids, most)
                        best += [pd.DataFrame({query_column: q, "id": ids[p], "d": row[p]}) for q, p, row in zip(names[at : at + PIECE], places, d, strict=True)]
                    best = [pd.concat(best).sort_values([query_column, "d", "id"]).groupby(query_column).head(most)]
                for b in best:
                    yield b

            def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for pdf in near(batches):
                    yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

            return codes.mapInArrow(arrow, schema)

        found, block = [], []
        rows = queries.filter(F.col(self.vector).isNotNull()).select(query_column, V.normalized(F.col(self.vector))).orderBy(query_column)
        for r in rows.toLocalIterator(prefetchPartitions=True):
            block.append(r)
            if len(block) * len(r[1]) * 8 >= BLOCK_BYTES:
                found.append(ask(block))
                block = []
        if block:
            found.append(ask(block))
        if not found:
            return self.spark.createDataFrame([], schema).drop("d")
        w = Window.partitionBy(query_column).orderBy("d", "id")
        return reduce(DataFrame.unionByName, found).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= most).select(query_column, "id")

    def search_many(self, vectors: DataFrame, queries: DataFrame, k: int, over: int = OVER, query_column: str = "query_id") -> DataFrame:
        """(query_id, id, distance, rank): the k nearest of the over * k rows that the codes name for each query, by exact distances. A query without a vector has no rows."""
        asked = queries.filter(F.col(self.vector).isNotNull()).select(query_column, V.normalized(F.col(self.vector)).alias("asked"))
        pairs = self.candidates(queries, over * k, query_column).join(self._own(vectors), "id").join(asked, query_column)
        rows = pairs.select(query_column, F.col("id").alias(self.id), (1 - V.dot(F.col("asked"), F.col("v"))).alias("distance"))
        w = Window.partitionBy(query_column).orderBy(F.round("distance", 12), self.id)
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
