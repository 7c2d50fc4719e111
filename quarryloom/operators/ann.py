"""Approximate nearest neighbours from a saved index.

Vectors are dealt to cells and written partitioned by cell, so a search reads
the files of the cells it probes and no others. Cells lie around k-means
centres (ivf), or are the sides of random planes on which a vector lies (lsh,
probed in the order of how little of the query has to be turned round).
Inserts are appended, deletes are remembered until the next rebuild.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quarryloom.functions import vectors as V
from quarryloom.operators.store import Snapshots
from quarryloom.operators.vector_search import distances, top_k

#: A block of a cell has about so many vectors at most, and so many queries meet it at a time.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 14, 1 << 12


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass(frozen=True)
class Cells:
    """Which cell a vector belongs to, and which ones are worth probing for a query."""

    kind: str
    model: np.ndarray

    @property
    def n(self) -> int:
        return len(self.model) if self.kind == "ivf" else 1 << len(self.model)

    def _costs(self, x: np.ndarray) -> np.ndarray:
        """For each vector and cell how far they are apart."""
        x = _unit(np.asarray(x, np.float64))
        if self.kind == "ivf":
            return (self.model**2).sum(1)[None] - 2 * x @ self.model.T
        turned = x @ self.model.T
        bits = (np.arange(self.n)[:, None] >> np.arange(len(self.model))) & 1
        # A side on which the vector doesn't lie costs as much as it lies away from the plane.
        return np.maximum(turned, 0) @ (1 - bits).T + np.maximum(-turned, 0) @ bits.T

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        return np.argsort(self._costs(x), axis=1, kind="stable")[:, :n]


def fit_cells(vectors: DataFrame, kind: str = "ivf", cells: int = 100, seed: int = 7, sample: int = 100_000, id_column: str = "id", vector_column: str = "embedding") -> Cells:
    """Cells of the vectors' directions; centres are fitted on a sample by a hash of the id, of about sample vectors."""
    rows = vectors.filter(F.col(vector_column).isNotNull())
    if kind == "lsh":
        first = rows.select(F.size(vector_column)).first()
        planes = np.random.default_rng(seed).normal(size=(max(1, (cells - 1).bit_length()), first[0] if first else 1))
        return Cells("lsh", planes)
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = rows.count()
    if not n:
        return Cells("ivf", np.zeros((1, 1)))
    some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64(id_column), F.lit(n)) < sample)
    unit = some.select(array_to_vector(V.normalized(F.col(vector_column))).alias("unit"))
    centres = KMeans(k=max(2, min(cells, n // 4 or 2)), seed=seed, featuresCol="unit", maxIter=10).fit(unit).clusterCenters() if n > 1 else [np.zeros(rows.select(F.size(vector_column)).first()[0])]
    return Cells("ivf", np.array(centres))


class AnnIndex:
    """A saved index of id, vector and any other columns under one folder."""

    def __init__(self, spark: SparkSession, path: str, id_column: str = "id", vector_column: str = "embedding"):
        self.spark, self.path, self.id_column, self.vector_column = spark, path.rstrip("/"), id_column, vector_column
        self.meta = Snapshots(spark, f"{self.path}/meta")

    def _meta(self):
        rows = self.meta.read()
        if rows is None:
            raise LookupError(f"no index at {self.path}")
        return rows.first()

    def cells(self) -> Cells:
        m = self._meta()
        return Cells(m["kind"], np.array([list(r) for r in m["model"]], np.float64))

    def build(self, vectors: DataFrame, kind: str = "ivf", cells: int = 100, seed: int = 7, sample: int = 100_000) -> AnnIndex:
        """Fits cells, writes all vectors by cell and then names the new files; an index that is there is read until then. Rows without a vector are left out."""
        model = fit_cells(vectors, kind, cells, seed, sample, self.id_column, self.vector_column)
        folder = f"rows-{uuid.uuid4().hex[:8]}"
        schema = self._write(vectors, model, folder, "errorifexists")
        old = self.meta.read()
        gone = [r["folder"] for r in old.select("folder").collect()] if old is not None else []
        self.meta.write(self.spark.createDataFrame([(kind, model.model.tolist(), folder, schema)], "kind string, model array<array<double>>, folder string, schema string"), keep=1)
        for f in gone:
            self._remove(f)
            self._remove(f.replace("rows-", "gone-"))
        return self

    def _write(self, vectors: DataFrame, model: Cells, folder: str, mode: str) -> str:
        """Appends or writes rows, and says their schema: of no rows no files come that would tell it."""
        name = self.vector_column
        rows = vectors.filter(F.col(name).isNotNull())
        cell = F.pandas_udf(lambda x: pd.Series(model.nearest(np.stack(x.to_list()))[:, 0] if len(x) else [], dtype="int32"), "int")
        rows = rows.withColumn("seq", F.lit(time.time_ns())).withColumn("cell", cell(name))
        rows.write.mode(mode).partitionBy("cell").parquet(f"{self.path}/{folder}")
        return rows.schema.json()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _remove(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def rows(self, where: Column | None = None) -> DataFrame:
        """What the index holds, with each row's cell. where reaches the scan."""
        meta = self._meta()
        folder = meta["folder"]
        rows = self.spark.read.schema(StructType.fromJson(json.loads(meta["schema"]))).parquet(f"{self.path}/{folder}")
        rows = rows if where is None else rows.filter(where)
        gone = folder.replace("rows-", "gone-")
        if self._fs().exists(self._path(gone)):
            last = self.spark.read.parquet(f"{self.path}/{gone}").groupBy(self.id_column).agg(F.max("seq").alias("_gone"))
            rows = rows.join(last, self.id_column, "left").filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone")
        return rows.drop("seq")

    def insert(self, vectors: DataFrame) -> None:
        """Puts rows in, over those of the same ids."""
        self.delete(vectors)
        self._write(vectors, self.cells(), self._meta()["folder"], "append")

    def delete(self, ids: DataFrame) -> None:
        """Leaves out the rows of these ids from now on."""
        gone = self._meta()["folder"].replace("rows-", "gone-")
        ids.select(self.id_column).distinct().withColumn("seq", F.lit(time.time_ns())).write.mode("append").parquet(f"{self.path}/{gone}")

    def count(self) -> int:
        return self.rows().count()

    def sync(self, vectors: DataFrame) -> None:
        """Deletes what vectors lacks and inserts what the index lacks."""
        have, want = self.rows().select(self.id_column), vectors.filter(F.col(self.vector_column).isNotNull())
        stale = have.join(want.select(self.id_column), self.id_column, "left_anti")
        new = want.join(have, self.id_column, "left_anti")
        self.delete(stale)
        self._write(new, self.cells(), self._meta()["folder"], "append")

    def rebuild(self, cells: int = 100, seed: int = 7, sample: int = 100_000) -> AnnIndex:
        return self.build(self.rows().drop("cell"), self._meta()["kind"], cells, seed, sample)

    def drop(self) -> None:
        """Deletes the index; nothing happens if there is none."""
        if self._fs().exists(self._path(".")):
            self._fs().delete(self._path("."), True)

    def search(self, query: list[float], k: int, probes: int = 10, metric: str = "cosine", where: Column | None = None) -> DataFrame:
        """About the k nearest rows, from the files of the probed cells."""
        near = self.cells().nearest(np.array([query]), probes)[0]
        inside = F.col("cell").isin(*near.tolist())
        return top_k(self.rows(inside if where is None else inside & where).drop("cell"), query, k, metric, id_column=self.id_column, vector_column=self.vector_column)

    def search_many(self, queries: DataFrame, k: int, probes: int = 10, metric: str = "cosine", query_column: str = "query_id", where: Column | None = None) -> DataFrame:
        """(query_id, id, distance, rank): about the k nearest rows of each query, which has the column vector_column too.

        Queries go to the cells they probe; a cell of many vectors or queries is
        split into blocks, each of which gives k rows for a query at most.
        """
        i, v, q = self.id_column, self.vector_column, query_column
        model = self.cells()
        rows = self.rows(where).select(i, v, "cell")
        probed = F.pandas_udf(lambda x: pd.Series(model.nearest(np.stack(x.to_list()), probes).tolist() if len(x) else []), "array<int>")
        asked = queries.filter(F.col(v).isNotNull()).select(q, F.col(v).alias("asked")).withColumn("cell", F.explode(probed("asked")))
        # How many blocks each cell has: a row for each cell, of which there are model.n.
        blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts")).join(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns")), "cell")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = rows.join(F.broadcast(blocks), "cell").withColumn("part", deal(i, "parts")).withColumn("turn", each("turns")).select(i, v, "cell", "part", "turn")
        right = asked.join(F.broadcast(blocks), "cell").withColumn("turn", deal(q, "turns")).withColumn("part", each("parts")).select(q, "asked", "cell", "part", "turn")
        kinds = {i: dict(rows.dtypes)[i], q: dict(queries.dtypes)[q]}

        def near(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            return _nearest(some, asked, k, metric, i, v, q)

        key = ["cell", "part", "turn"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(near, f"{q} {kinds[q]}, {i} {kinds[i]}, distance double")
        w = Window.partitionBy(q).orderBy(F.round("distance", 12), i)
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(some: pd.DataFrame, asked: pd.DataFrame, k: int, metric: str, i: str, v: str, q: str) -> pd.DataFrame:
    out = [pd.DataFrame({q: [], i: [], "distance": []})]
    if len(some) and len(asked):
        some = some.sort_values(i, kind="stable")
        x, ids = np.stack(some[v].to_list()).astype(np.float64), some[i].to_numpy()
        n = min(k, len(ids))
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            d = distances(np.stack(part["asked"].to_list()).astype(np.float64), x, metric)
            best = np.argsort(np.round(d, 12), axis=1, kind="stable")[:, :n]
            out.append(pd.DataFrame({q: np.repeat(part[q].to_numpy(), n), i: ids[best].ravel(), "distance": np.take_along_axis(d, best, 1).ravel()}))
    return pd.concat(out[1:] or out)


def recall(found: DataFrame, exact: DataFrame, query_column: str = "query_id", id_column: str = "id") -> float:
    """The share of exact's rows that found has."""
    on = [query_column, id_column]
    r = exact.select(*on).join(found.select(*on).withColumn("hit", F.lit(1)), on, "left").agg(F.count("*"), F.count("hit")).first()
    return r[1] / r[0] if r[0] else 1.0


def cached(vectors: DataFrame, id_column: str = "id", vector_column: str = "embedding") -> Callable[..., DataFrame]:
    """An exact search over vectors that are held in the executors' memory: search(query, k, repos=None), over-fetching nothing as it filters first."""
    rows = vectors.filter(F.col(vector_column).isNotNull()).persist()

    def search(query: list[float], k: int, repos: list | None = None, repo_column: str = "repo_root", **options) -> DataFrame:
        some = rows.filter(F.col(repo_column).isin(*repos)) if repos else rows
        return top_k(some, query, k, id_column=id_column, vector_column=vector_column, **options)

    return search
