"""Approximate nearest neighbours by cosine from graphs of neighbours.

Nodes are dealt to segments of SEGMENT at most, by a hash; each segment has a
graph of its own, whose lists one task finds by comparing the segment's nodes
with one another. A search asks every segment: a task holds one segment and
takes the queries batch by batch, keeps a beam of the nearest nodes that each
has seen and opens what it hasn't opened yet. The best of all segments are
ranked. Equal vectors are one node.

So vectors move once to their segment, and queries once to each; no vector
moves for a comparison. neighbour_lists() finds lists across a whole table by
descent: lists of near vectors, begun in blocks along random directions, get
better by comparing the neighbours of each vector with one another, until
hardly any entry changes. There a vector compares with 3 * width others at
most in a round, but moves to each of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions import vectors as V
from quarryloom.operators.versioned import Spec, VersionedTables
from quarryloom.scratch import drop_settled, settle

#: Neighbours of a node that are looked for.
WIDTH = 24
#: Blocks in which lists begin, and random directions along which they are cut.
BLOCK, DEALS = 256, 3
#: A share of new entries at which descent stops, and the rounds it takes at most.
STOP, ROUNDS = 0.003, 12
#: Nodes from which searches begin in a segment, and a segment's nodes, about.
ENTRIES, SEGMENT = 32, 32_768
#: By how much beams are wider where there are several segments: there each finds a few of the nearest only, all of which count.
WIDER = 1.5
#: Rows that are compared with a segment at once, and queries that are taken through it side by side.
ROWS, SIDE = 128, 64
SEED = 7

SPECS = {
    "graph": Spec("node bigint, segment int, v array<double>, near array<bigint>", ("node",)),
    "copies": Spec("node bigint, id bigint", ("node",)),
}
LINK = "node bigint, id bigint, d double"


def walk_for(n: int, width: int = WIDTH) -> int:
    """Along how many of a node's nearest neighbours a search among n walks; and against as many, to twice that number in all. Small graphs need few, in which many would be most of the nodes."""
    return min(width, int(10 * (max(n, 500) / 2_000) ** 0.27))


def beam_for(n: int, k: int) -> int:
    """The nearest nodes that a search among n keeps, k at least. More of them find more and visit more; vectors without clusters, as those here, ask for a beam that grows with n."""
    return max(k, int(n**0.6 / 8.36))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _links(node: np.ndarray, other: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(d, pa.float64())], ["node", "id", "d"])


def within_blocks(width: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For sorted rows of (node, v) the nearest of each in its block."""
        for batch in batches:
            ids, v = batch["node"].to_numpy(), _vectors(batch["v"]) if batch.num_rows else np.empty((0, 1))
            for part in np.array_split(np.arange(len(ids)), max(1, len(ids) // BLOCK)):
                k = min(width, len(part) - 1)
                if k < 1:
                    continue
                d = 1 - v[part] @ v[part].T
                np.fill_diagonal(d, np.inf)
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield _links(np.repeat(ids[part], k), ids[part][best].ravel(), np.take_along_axis(d, best, 1).ravel())

    return near


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of (center, node, v, worst) sorted by center the pairs around one center that are nearer than the worst in one's list."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        center = table["center"].to_numpy()
        if not len(center):
            continue
        last = int(np.searchsorted(center, center[-1]))  # a later batch may have more of this center
        rest = table.slice(last)
        if last:
            yield _pairs(table.slice(0, last))
    if rest is not None:
        yield _pairs(rest)


def _pairs(table: pa.Table) -> pa.RecordBatch:
    center, ids, worst = table["center"].to_numpy(), table["node"].to_numpy(), table["worst"].to_numpy()
    v = _vectors(table["v"].combine_chunks())
    edge = np.concatenate(([0], np.flatnonzero(center[1:] != center[:-1]) + 1, [len(center)]))
    out = []
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        d = 1 - v[i:j] @ v[i:j].T
        np.fill_diagonal(d, np.inf)
        a, b = np.nonzero(d < worst[i:j, None] - 1e-12)
        out.append((ids[i:j][a], ids[i:j][b], d[a, b]))
    return _links(*[np.concatenate(x) for x in zip(*out, strict=True)])


def _best(links: DataFrame, width: int) -> DataFrame:
    """(node, near, fresh): the nearest of the links (node, id, d, new) of each node, each id once, and how many of them are new."""
    rows = links.filter("node <> id").repartition("node").groupBy("node", "id").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    near = F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "new"))), 1, width)
    return rows.groupBy("node").agg(near.alias("near")).withColumn("fresh", F.aggregate("near", F.lit(0).cast("long"), lambda a, x: a + x["new"]))


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("node", F.explode("near").alias("x")).select("node", F.col("x.id").alias("id"), F.col("x.d").alias("d"))


def _around(edges: DataFrame, width: int) -> DataFrame:
    """(node, id, d) along the edges and against them, of the latter the 2 * width nearest of each node."""
    back = edges.select(F.col("id").alias("node"), F.col("node").alias("id"), "d")
    w = Window.partitionBy("node").orderBy("d", "id")
    return edges.unionByName(back.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= 2 * width).drop("i")).dropDuplicates(["node", "id"])


def neighbour_lists(nodes: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(node, near) of nodes (node, v), near an array of (d, id), by descent. nodes is read in each round."""
    first = nodes.select(F.size("v").alias("d")).first()
    if first is None:
        return nodes.select("node", F.array().cast("array<struct<d:double,id:bigint>>").alias("near"))
    rng = np.random.default_rng(seed)
    begun = []
    for _ in range(DEALS):
        along = nodes.withColumn("at", V.dot(F.col("v"), F.lit(rng.normal(size=first["d"]).tolist())))
        begun.append(along.repartitionByRange("at").sortWithinPartitions("at").select("node", "v").mapInArrow(within_blocks(width), LINK))
    links = reduce(DataFrame.unionByName, begun)
    lists = settle(_best(links.withColumn("new", F.lit(0)), width), "near")
    for _ in range(ROUNDS):
        edges = _edges(lists)
        around = _around(edges, width).select(F.col("node").alias("center"), F.col("id").alias("node"))
        around = around.unionByName(lists.select(F.col("node").alias("center"), "node"))
        worst = lists.select("node", F.when(F.size("near") >= width, F.element_at("near", -1)["d"]).otherwise(F.lit(3.0)).alias("worst"))
        met = around.join(nodes.join(worst, "node"), "node").select("center", "node", "v", "worst")
        found = met.repartition("center").sortWithinPartitions("center").mapInArrow(compared, LINK)
        better = settle(_best(edges.withColumn("new", F.lit(0)).unionByName(found.withColumn("new", F.lit(1))), width), "near")
        fresh, all_of = better.agg(F.sum("fresh"), F.sum(F.size("near"))).first()
        drop_settled(lists)
        lists = better
        if (fresh or 0) <= STOP * (all_of or 0):
            break
    return lists.drop("fresh")


def by_segment(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """Rows of each of n segments together in a partition, in order."""
    return rows.repartition(n, "segment").sortWithinPartitions("segment", *order)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """The batches of each segment, of rows sorted by segment. A segment's have to be read before the next one's."""
    pieces = (batch.slice(i, j - i) for batch in batches if batch.num_rows for i, j in itertools.pairwise(np.flatnonzero(np.diff(batch["segment"].to_numpy(), prepend=-1, append=-1))))
    return itertools.groupby(pieces, lambda b: b["segment"][0].as_py())


def within_segments(width: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For rows of (segment, node, v) the nearest of each in its segment."""
        for _, parts in segments(batches):
            held = [(b["node"].to_numpy(), _vectors(b["v"])) for b in parts]
            ids, v = (np.concatenate(x) for x in zip(*held, strict=True))
            if (k := min(width, len(ids) - 1)) < 1:
                continue
            for at in range(0, len(ids), ROWS):
                d = 1 - v[at : at + ROWS] @ v.T
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield _links(np.repeat(ids[at : at + ROWS], k), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel())

    return near


def lists_in_segments(nodes: DataFrame, n: int, width: int = WIDTH) -> DataFrame:
    """(node, near) as neighbour_lists(), of nodes (segment, node, v) in n segments: the nearest of a node's segment."""
    links = by_segment(nodes.select("segment", "node", "v"), n).mapInArrow(within_segments(width), LINK)
    return links.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("near"))


def searched(k: int, beam: int | None, wider: float = 1.0):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For rows of (segment, q, node, v, near), in each segment nodes (q null) before queries, the k nearest nodes to each query; visited, how many it was compared with, stands in the first of its rows, the others have 0."""
        for _, parts in segments(batches):
            held, v, near = [], None, None
            for batch in parts:
                own = batch.filter(batch["q"].is_null())
                if own.num_rows:
                    held.append((own["node"].to_numpy(), _vectors(own["v"]), own["near"]))
                asked = batch.filter(batch["q"].is_valid())
                if not asked.num_rows or not held:
                    continue
                if v is None:
                    ids, v = (np.concatenate([h[i] for h in held]) for i in (0, 1))
                    near = _places(ids, [h[2] for h in held])
                    wide = max(beam or int(wider * beam_for(len(ids), k)), k)
                for at in range(0, asked.num_rows, SIDE):
                    some = asked.slice(at, SIDE)
                    i, d, j, visited = _walked(_vectors(some["v"]), v, near, ids, wide)
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, d, j, place = (x[place < k] for x in (i, d, j, place))
                    yield pa.RecordBatch.from_arrays([some["q"].take(pa.array(i)), pa.array(d), pa.array(ids[j]), pa.array(np.where(place == 0, visited[i], 0))], ["q", "d", "node", "visited"])

    return found


def _places(ids: np.ndarray, near: list[pa.ListArray]) -> np.ndarray:
    """Lists of nodes as a matrix of their places in ids, -1 where a list is shorter."""
    order = np.argsort(ids)
    length = np.concatenate([pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in near])
    out = np.full((len(ids), max(1, int(length.max(initial=0)))), -1, np.int32)
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in near])
    out[np.arange(out.shape[1])[None] < length[:, None]] = order[np.searchsorted(ids, flat, sorter=order)]
    return out


def _walked(asked: np.ndarray, v: np.ndarray, near: np.ndarray, ids: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, place) of the beams of these queries, nearest first, and how many nodes each was compared with. Searches begin at the first ENTRIES nodes."""
    n, begin = len(v), min(ENTRIES, len(v))
    seen = np.zeros(len(asked) * n, bool)
    i, j = np.repeat(np.arange(len(asked)), begin), np.tile(np.arange(begin), len(asked))
    d, done = np.empty(0), np.empty(0, bool)
    kept_i, kept_j = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(i):
        seen[i * n + j] = True
        measured = 1 - np.einsum("xy,xy->x", asked[i], v[j])
        i, j, d = np.concatenate((kept_i, i)), np.concatenate((kept_j, j)), np.concatenate((d, measured))
        done = np.concatenate((np.ones(len(kept_i), bool), np.zeros(len(measured), bool)))
        order = np.lexsort((ids[j], d, i))
        kept_i = i[order]
        order = order[np.arange(len(order)) - np.searchsorted(kept_i, kept_i) < beam]
        kept_i, kept_j, d, done = i[order], j[order], d[order], done[order]
        to = near[kept_j[~done]]
        reached = (kept_i[~done, None] * n + to)[to >= 0]
        reached = np.unique(reached[~seen[reached]])
        i, j = reached // n, reached % n
    return kept_i, d, kept_j, seen.reshape(len(asked), n).sum(1)


class GraphIndex:
    """A graph of neighbours under one folder, its tables of one version."""

    def __init__(self, spark: SparkSession, path: str, id_column: str = "id", vector_column: str = "embedding", buckets: int = 16):
        self.spark, self.id, self.vector = spark, id_column, vector_column
        self.tables = VersionedTables(spark, path, SPECS, buckets)

    def build(self, vectors: DataFrame, width: int = WIDTH, walk: int | None = None, seed: int = SEED) -> GraphIndex:
        """Replaces the graph by one of these rows (id, vector); rows without a vector are left out. Vectors have one length."""
        own = vectors.filter(F.col(self.vector).isNotNull()).select(F.col(self.id).cast("long").alias("id"), V.normalized(F.col(self.vector)).alias("v"))
        nodes = settle(own.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("n")).select("node", "v", "n"), "nodes")
        count = nodes.count()
        n = max(1, -(-count // SEGMENT))
        dealt = nodes.withColumn("segment", F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(n)).cast("int"))
        lists = settle(lists_in_segments(dealt, n, width), "near")
        walk = walk or walk_for(count // n, width)
        w = Window.partitionBy("node").orderBy("d", "id")
        some = _edges(lists.select("node", F.slice("near", 1, walk).alias("near")))
        wide = _around(some, walk).withColumn("i", F.row_number().over(w)).filter(F.col("i") <= 2 * walk)
        near = wide.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("near"))
        graph = dealt.join(near, "node", "left").select("node", "segment", "v", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
        copies = own.join(nodes.filter("n > 1").select("node", "v"), "v").select("node", "id")
        change = self.tables.begin("graph")
        for table, rows in (("graph", graph), ("copies", copies)):
            old = change.read(table).select("node").distinct()
            change.replace(table, rows, old if self.tables.version() else None)
        change.commit()
        drop_settled(nodes, lists)
        return self

    def search_many(self, queries: DataFrame, k: int, beam: int | None = None, query_column: str = "query_id") -> DataFrame:
        """(query_id, id, distance, rank, visited): about the k nearest rows of each query, and how many different vectors it was compared with.

        beam, of each segment, is beam_for() the number of its nodes, WIDER if there are several, unless given, and k at least. A query without a vector has no rows.
        """
        version = self.tables.version()
        graph = self.tables.read("graph", version)
        n = (graph.agg(F.max("segment")).first()[0] or 0) + 1
        kind = dict(queries.dtypes)[query_column]
        asked = queries.filter(F.col(self.vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("segment"), F.col(query_column).alias("q"), F.lit(None).cast("long").alias("node"), V.normalized(F.col(self.vector)).alias("v"), F.lit(None).cast("array<bigint>").alias("near"))
        both = graph.select("segment", F.lit(None).cast(kind).alias("q"), "node", "v", "near").unionByName(asked)
        # Nodes come first, in the order of their hashes.
        rows = by_segment(both.withColumn("asks", F.col("node").isNull()).withColumn("at", F.xxhash64("node")), n, "asks", "at")
        reached = rows.drop("asks", "at").mapInArrow(searched(k, beam, WIDER if n > 1 else 1.0), f"q {kind}, d double, node bigint, visited bigint")
        of_all = Window.partitionBy("q").orderBy(F.round("d", 12), "node")
        hits = reached.withColumn("i", F.row_number().over(of_all)).withColumn("visited", F.sum("visited").over(Window.partitionBy("q"))).filter(F.col("i") <= k).select("q", "visited", F.col("d").alias("distance"), "node")
        # Of a vector's copies no more than k can be among the k nearest.
        some = self.tables.read("copies", version).withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("i") <= k).drop("i")
        rows = hits.join(some, "node", "left").select(F.col("q").alias(query_column), F.coalesce("id", "node").alias(self.id), "distance", "visited")
        w = Window.partitionBy(query_column).orderBy(F.round("distance", 12), self.id)
        return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
