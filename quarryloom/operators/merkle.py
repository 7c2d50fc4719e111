"""Hash trees of repositories as flat tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.functions import lookups as L
from quarryloom.functions import text as X
from quarryloom.scratch import drop_settled, settle

#: Directories whose children are asked for by value, in a filter that reaches the scan; more of them are joined.
ASKED = 512


def parent_of(path: Column) -> Column:
    """The directory that holds path; "" is the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth_of(path: Column) -> Column:
    """0 for the root, else the number of names in the path."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).cast("int")


def not_ignored(path: Column, names: tuple[str, ...] = L.IGNORED_DIRS) -> Column:
    """No part of the path is one of these names or begins with a dot."""
    return ~F.exists(F.split(path, "/"), lambda p: p.isin(*names) | p.startswith("."))


def file_nodes(files: DataFrame) -> DataFrame:
    """MERKLE rows of files: path, and text or content."""
    content = F.col("content") if "content" in files.columns else F.col("text").cast("binary")
    return files.select("path", parent_of(F.col("path")).alias("parent"), depth_of(F.col("path")).alias("depth"), F.lit(False).alias("is_dir"), X.content_hash(content).alias("hash"), F.octet_length(content).cast("long").alias("size"))


def _directories(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (parent, fed, size) in the order of parent and path one row for each parent; what is kept of an open directory is its digest, whatever the number of its children."""
    parent, digest, size = None, None, 0

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["path", "hash", "size"])

    for batch in batches:
        rows = []
        for p, h, n in zip(*(batch[c].to_pylist() for c in ("parent", "fed", "size")), strict=True):
            if digest is None or p != parent:
                if digest is not None:
                    rows.append((parent, digest.hexdigest(), size))
                parent, digest, size = p, hashlib.sha256(), 0
            digest.update((h or "").encode())
            size += n or 0
        if rows:
            yield closed(rows)
    if digest is not None:
        yield closed([(parent, digest.hexdigest(), size)])


def rollup(nodes: DataFrame, names: bool = False) -> DataFrame:
    """nodes and all their directories up to the root "".

    A directory's hash is the SHA-256 of its children's hashes, in the order
    of their paths, with names that of their names and hashes; its size is the sum of theirs. Goes up one level for each
    step of the deepest path; files are hashed once, and each level's
    directories are written before the next one is built on them, so that
    the plan doesn't grow with the depth. Children are sorted, on disk where
    they are many, and their hashes fed to the digest one by one: a digest over
    a sequence keeps a directory in one task, but in no memory to speak of.
    """
    nodes = settle(nodes, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done, dirs = [nodes], None
    for d in range(deepest, 0, -1):
        here = nodes.filter(F.col("depth") == d)
        here = here if dirs is None else here.unionByName(dirs)
        fed = F.concat_ws("\0", F.regexp_extract("path", "[^/]*$", 0), F.coalesce("hash", F.lit("")), F.lit("")) if names else F.col("hash")
        children = here.select("parent", "path", fed.alias("fed"), "size").repartition("parent").sortWithinPartitions("parent", "path").select("parent", "fed", "size")
        dirs = children.mapInArrow(_directories, "path string, hash string, size long").select("path", parent_of(F.col("path")).alias("parent"), F.lit(d - 1).cast("int").alias("depth"), F.lit(True).alias("is_dir"), "hash", "size")
        dirs = settle(dirs, "level")
        done.append(dirs)
    return reduce(lambda a, b: a.unionByName(b), done)


def save_tree(tree: DataFrame, path: str) -> DataFrame:
    """Writes a tree with its directories so that the children of a few directories are read without the rest: a folder for each depth, rows in the order of their parents."""
    tree.repartitionByRange("depth", "parent").sortWithinPartitions("depth", "parent").write.mode("overwrite").partitionBy("depth").parquet(path)
    return read_tree(tree.sparkSession, path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, parent string, is_dir boolean, hash string, size long, depth int").parquet(path)


def pruned_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, int]:
    """(the rows of diff(), the number of rows compared), for trees of rollup(names=True), best as saved by save_tree().

    Begins at the roots and goes down only into directories whose hashes
    differ or that one tree lacks. Hashes without names would hide a file that
    was renamed within its place in the order.
    """
    key = ("path", "is_dir")

    def children(tree: DataFrame, depth: int, asked: list[str] | None, below: DataFrame | None, name: str) -> DataFrame:
        rows = tree.filter(F.col("depth") == depth)
        if depth == 0:
            rows = rows.filter("is_dir")
        else:
            rows = rows.filter(F.col("parent").isin(asked)) if asked is not None else rows.join(below, F.col("parent") == F.col("below"), "left_semi")
        return rows.select(*key, F.col("hash").alias(name))

    found, compared, depth, asked, below = [], 0, 0, [""], None
    while True:
        both = children(old, depth, asked, below, "old_hash").join(children(new, depth, asked, below, "new_hash"), list(key), "full_outer")
        level = settle(both, "compared")
        compared += level.count()
        differ = level.filter("NOT old_hash <=> new_hash")
        change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").otherwise("modified")
        found.append(differ.filter("NOT is_dir").select("path", change.alias("change")))
        below = differ.filter("is_dir").select(F.col("path").alias("below"))
        few = [r["below"] for r in below.limit(ASKED + 1).collect()]
        if not few:
            break
        asked, depth = few if len(few) <= ASKED else None, depth + 1
    rows = settle(reduce(lambda a, b: a.unionByName(b), found), "changes")
    drop_settled(*found)
    return rows, compared


def root_hash(tree: DataFrame) -> str | None:
    row = tree.filter("path = '' and is_dir").select("hash").first()
    return row[0] if row else None


def directory_sizes(nodes: DataFrame) -> DataFrame:
    """(path, files, bytes) of each directory, all below it counted."""
    names = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "/")))
    return nodes.filter("not is_dir").select(above.alias("dir"), "size").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes")).withColumnRenamed("dir", "path")


def diff(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """(path, change) of files: added, modified or deleted. No tree counts as an empty one."""
    known = new if new is not None else old
    side = lambda t, name: (t if t is not None else known.limit(0)).filter("not is_dir").select("path", F.col("hash").alias(name))
    both = side(old, "old_hash").join(side(new, "new_hash"), "path", "full_outer")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return both.withColumn("change", change).filter("change is not null").select("path", "change")


def to_reindex(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change").isin("added", "modified")).select("path").orderBy("path")


def changed_hash_sets(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("repo_root", "path")) -> DataFrame:
    """Files whose set of content hashes differs between two tables of locations; new ones too."""
    of = lambda t, name: t.groupBy(*keys).agg(F.array_sort(F.collect_set("content_hash")).alias(name))
    both = of(new, "new_set").join(of(old, "old_set"), list(keys), "left")
    return both.filter(~F.col("new_set").eqNullSafe(F.col("old_set"))).select(*keys)
