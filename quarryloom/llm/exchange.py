"""Exchanges of many small keys between chunks of documents.

Documents are dealt out to chunks of a few MB, many chunks to a partition. A
chunk sends its keys, sorted and packed in binary cells, to buckets of the
key space; a bucket finds the keys that more than one document has and sends
those, with their counts, back to the chunks they came from. There are as
many buckets as partitions, not as chunks, so a cell keeps its size when the
corpus grows. A chunk sends a key a bounded number of times however often it
occurs there, so a key that half of the corpus has costs its bucket a few
entries for each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.storage import settle

#: Bytes of text in a chunk, which one call in Python holds, and in a partition, which is a task and a bucket.
CHUNK_BYTES = 4 << 20
PART_BYTES = 32 << 20
#: A chunk sends a key at most so many times.
TIMES = 16
#: A row that stands in a table so many times or more is dealt out once, with its number.
MANY = 64
HAS_WORDS = r"[^\x20\x09-\x0D]"

SENT = "bucket int, chunk int, keys binary"
SHARED = "chunk int, bucket int, keys binary, counts binary"


@dataclass(frozen=True)
class Layout:
    """How many chunks a table of so many bytes of text is dealt out to, and to how many partitions and buckets."""

    chunks: int
    parts: int

    @classmethod
    def of(cls, size: int, least: int) -> Layout:
        parts = max(1, least, math.ceil(size / PART_BYTES))
        return cls(min(max(parts, math.ceil(size / CHUNK_BYTES)), (1 << 31) - 1), parts)


def gathered(docs: DataFrame) -> tuple[DataFrame, Layout]:
    """(doc_id, text and copies, the rows of docs that have words; their layout).

    A row that stands in docs MANY times or more comes once, with their
    number as copies, so that no chunk holds a third of all rows; other rows
    come as they are. Which those are is counted by a hash of the row before
    any text moves; rows of one hash but another text are told apart.
    """
    rows = docs.filter(F.col("text").rlike(HAS_WORDS))
    key = F.xxhash64("doc_id", "text")
    counts = rows.groupBy(key.alias("same")).agg(F.count("*").alias("c"), F.sum(F.octet_length("text")).alias("size"))
    often = settle(counts.groupBy(F.when(F.col("c") >= MANY, F.col("same")).alias("same")).agg(F.sum("size").alias("size")), "often")
    size = often.agg(F.sum("size")).first()[0] or 0
    layout = Layout.of(int(size), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = often.filter("same is not null").select("same")
    if often.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long")), layout
    marked = rows.withColumn("same", key)
    alone = marked.join(often, "same", "left_anti").select("doc_id", "text", F.lit(1).cast("long").alias("copies"))
    together = marked.join(often, "same", "left_semi").groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    return alone.unionByName(together), layout


def chunk_of(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def dealt(docs: DataFrame, layout: Layout, *by: str) -> DataFrame:
    """docs with their chunk, each chunk in one partition; built alike each time, so that one shuffle serves all that read it."""
    return docs.withColumn("chunk", chunk_of(layout.chunks, *by)).repartition(layout.parts, "chunk")


def bytes_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece's texts have about size bytes, or are one text."""
    for batch in batches:
        i, total = 0, 0
        lens = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        for j, x in enumerate(lens):
            if total + x > size and j > i:
                yield batch.slice(i, j - i)
                i, total = j, 0
            total += x
        if batch.num_rows > i:
            yield batch.slice(i)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as int64; null as the largest one."""
    return np.asarray(column.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy(), np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def cut(sorted_keys: np.ndarray, n: int):
    """(bucket, from, to) for each bucket that has some of the sorted keys."""
    b = bucket_of(sorted_keys, n)
    if not len(b):
        return
    edge = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]))
    for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(b[i]), i, j


def send(chunk: int, keys: np.ndarray, n: int) -> pa.Table:
    """Packs keys (one for each document that has it) for their buckets, n at most and so many cells."""
    keys = np.sort(keys)
    if len(keys) > TIMES:
        again = np.zeros(len(keys), bool)
        again[TIMES:] = keys[TIMES:] == keys[:-TIMES]
        keys = keys[~again]
    rows = [(b, keys[i:j].astype(np.uint32).tobytes()) for b, i, j in cut(keys, n)]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary())})


def shared_in(table: pa.Table) -> pa.Table:
    """What a bucket answers: for each chunk those of its keys that occur twice or more in all, and how often (up to 255)."""
    cells = [np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()]
    chunks = table["chunk"].to_numpy()
    bucket = table["bucket"][0].as_py()
    keys = np.concatenate(cells)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    owner = np.repeat(np.arange(len(cells), dtype=np.int32), [len(c) for c in cells])[order]
    edge = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    count = np.repeat(np.diff(edge), np.diff(edge))
    keep = count >= 2
    keys, owner, count = keys[keep], owner[keep], np.minimum(count[keep], 255).astype(np.uint8)
    once = np.ones(len(keys), bool)
    if len(keys):
        once[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner, count = keys[once], owner[once], count[once]
    by = np.argsort(owner, kind="stable")
    keys, owner, count = keys[by], owner[by], count[by]
    edge = np.searchsorted(owner, np.arange(len(cells) + 1))
    out = [(int(chunks[c]), bucket, keys[i:j].tobytes(), count[i:j].tobytes()) for c, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i]
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int32()), "bucket": pa.array([r[1] for r in out], pa.int32()), "keys": pa.array([r[2] for r in out], pa.binary()), "counts": pa.array([r[3] for r in out], pa.binary())})


def shared_keys(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(shared_in, SHARED)


class Shared:
    """The answers that a chunk got: how many documents have a key, 1 where no other has it."""

    def __init__(self, table: pa.Table, n: int):
        self.n = n
        cells = [(np.uint64(b) << np.uint64(32)) | np.frombuffer(k, np.uint32).astype(np.uint64) for b, k in zip(table["bucket"].to_pylist(), table["keys"].to_pylist(), strict=True)]
        counts = [np.frombuffer(c, np.uint8) for c in table["counts"].to_pylist()]
        keys = np.concatenate(cells) if cells else np.empty(0, np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.counts = (np.concatenate(counts) if counts else np.empty(0, np.uint8))[order]

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), np.uint8)
        short = (bucket_of(keys, self.n) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))
        order = np.argsort(short)  # a search in order stays in the cache
        at = np.minimum(np.searchsorted(self.keys, short[order]), len(self.keys) - 1)
        out = np.empty(len(short), np.uint8)
        out[order] = np.where(self.keys[at] == short[order], self.counts[at], 1)
        return out
