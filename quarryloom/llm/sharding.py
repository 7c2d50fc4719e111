"""Sharding by sampled splitters, in DataFrame operations only.

Rows are ordered by a hash of their text, so equal texts are neighbours. A
size-weighted sample of these keys gives quantiles that cut the order into
ranges of about one size; ranges that turn out overfull are sampled again and
subdivided, and a text whose copies alone overfill a range gets a range of its
own. Whole ranges are dealt to shards, the largest first; only copies of one
text that don't fit into any shard are cut, at an exact row.

The driver sees the sampled keys and a few figures for each range, whose
numbers are bounded by parameters. Places inside a shard come from prefix
sums in three steps, so no range is ordered in one task.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.llm.storage import settle

SHARDS = 16
#: Keys are drawn about so many times, for about so many ranges.
SAMPLE, RANGES = 16_384, 1_024
#: A range with more than so many times its share of all bytes is subdivided, in so many rounds at most.
OVERFULL, ROUNDS = 2, 8
#: Rows that are ordered together, and sums of such that are.
TOGETHER, SUMS = 4_096, 1_024
#: Repeated rows stand together in blocks of so many at most.
BLOCK = 1_024
SEED = "shard-1"
OUT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
_STEP, _FINE = 64, float(1 << 30)


@dataclass(frozen=True)
class Range:
    """What a range holds. each: the size of all its rows if they are copies of one text, else 0."""

    key: int
    rows: int
    bytes: int
    low: int
    high: int
    each: int


def splitters(drawn: list[tuple[int, int]], share: float) -> list[int]:
    """Where ranges begin: (key, draws) in the order of keys, cut as soon as a range has share draws. A key that has as many alone is a range of its own."""
    out, have = [], 0
    for key, n in sorted(drawn):
        if have and n >= share:
            out.append(key)
            have = 0
        have += n
        if have >= share:
            out.append(key + 1)
            have = 0
    return sorted({k for k in out if -(1 << 63) <= k < 1 << 63})


def packed(ranges: list[Range], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(range, from, to, shard, slot of the first) for each piece of a range, the largest range first, always to the emptiest shard.

    Copies of one text that exceed the room left there are cut so that they fill it, unless they are so few that it doesn't matter.
    """
    total = sum(r.bytes for r in ranges)
    most, slack = math.ceil(total / shards), total // (shards * 128)
    heap, rows, out = [(0, k) for k in range(shards)], [0] * shards, []
    for r in sorted(ranges, key=lambda r: (-r.bytes, r.key)):
        at = 0
        while at < r.rows:
            load, k = heapq.heappop(heap)
            take, room = r.rows - at, most - load
            if r.each and take * r.each > max(room, slack):
                take = min(take, max(1, room // r.each))
            out.append((r.key, at, at + take, k, rows[k]))
            rows[k] += take
            heapq.heappush(heap, (load + (take * r.each if r.each else r.bytes), k))
            at += take
    return out


def _longs(values: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_of(key: Column, starts: list[int]) -> Column:
    """How many of the starts lie at or below key: first among every 64th, then among the 64 after that."""
    if not starts:
        return F.lit(0)
    below = lambda a: F.size(F.filter(a, lambda x: x <= key))
    coarse = below(_longs(starts[::_STEP]))
    fine = below(F.slice(_longs(starts), F.greatest(coarse - 1, F.lit(0)) * _STEP + 1, F.lit(_STEP)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * _STEP + fine)


def _drawn(blocks: DataFrame, rate: float, round_: int) -> list[tuple[int, int]]:
    """(key, draws): a block is drawn rate times its bytes, the fraction decided by a hash."""
    unit = F.pmod(F.xxhash64(F.lit(f"{SEED}-{round_}"), "doc_id", "same", "block"), F.lit(1 << 30)) / F.lit(_FINE)
    draws = F.floor(F.col("size") * F.col("n") * F.lit(rate) + unit)
    rows = blocks.select("same", draws.alias("draws")).filter("draws > 0").groupBy("same").agg(F.sum("draws").alias("draws")).collect()
    return [(r["same"], r["draws"]) for r in rows]


def _measured(blocks: DataFrame, starts: list[int]) -> list[Range]:
    size = F.col("size") * F.col("n")
    rows = blocks.groupBy(range_of(F.col("same"), starts).alias("range")).agg(
        F.sum("n").alias("rows"), F.sum(size).alias("bytes"), F.min("same").alias("low"), F.max("same").alias("high"), F.min("size").alias("least"), F.max("size").alias("most"),
    )
    return [Range(r["range"], r["rows"], r["bytes"], r["low"], r["high"], r["least"] if r["low"] == r["high"] and r["least"] == r["most"] else 0) for r in rows.collect()]


def size_ranges(blocks: DataFrame, total: int, sample: int = SAMPLE, ranges: int = RANGES) -> tuple[list[int], list[Range]]:
    """(where ranges begin, what they hold); no range but one of a single text or document is overfull, if the rounds suffice."""
    share = sample / ranges
    starts = splitters(_drawn(blocks, sample / total, 0), share)
    for again in range(1, ROUNDS + 1):
        held = _measured(blocks, starts)
        full = [r for r in held if r.bytes > OVERFULL * total / ranges and r.low < r.high]
        if not full or again == ROUNDS:
            break
        inside = blocks.join(_table(blocks.sparkSession, [(r.key,) for r in full], "range"), range_of(F.col("same"), starts) == F.col("range"), "left_semi")
        found = splitters(_drawn(inside, sample / total, again), share)
        # The middle of what a range holds is a cut too, so a round never leaves it as it was.
        starts = sorted({*starts, *found, *(r.low + (r.high - r.low + 1) // 2 for r in full)})
    return starts, held


def _table(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    """A few rows of longs, of a number that parameters bound, to be joined by broadcast."""
    lines = F.split(F.lit(";".join(",".join(map(str, r)) for r in rows)), ";")
    cells = spark.range(1).select(F.explode(lines).alias("line")).select(F.split("line", ",").alias("c"))
    return F.broadcast(cells.select(*[F.col("c")[i].cast("bigint").alias(n) for i, n in enumerate(names)]))


def _blocks(sized: DataFrame, each: int) -> DataFrame:
    """Rows with their number of copies, in blocks of each at most. The blocks' numbers are made in two steps of bounded arrays."""
    count = F.ceil(F.col("copies") / each).cast("long")
    many = sized.withColumn("outer", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / BLOCK).cast("long"))))
    last = F.least(count - 1, F.col("outer") * BLOCK + (BLOCK - 1))
    some = many.withColumn("block", F.explode(F.sequence(F.col("outer") * BLOCK, last)))
    return some.withColumn("n", F.least(F.lit(each).cast("long"), F.col("copies") - F.col("block") * each)).drop("outer", "copies")


def shard_documents(docs: DataFrame, shards: int = SHARDS, keep: tuple = (), sample: int = SAMPLE, ranges: int = RANGES) -> DataFrame:
    """Which shard each document belongs to, and its place there. Shards have about the same number of bytes.

    Returns a row for each row of docs: doc_id, size (UTF-8 bytes of the text
    plus 1), text_crc32, law (bytes), shard, slot (from 0 in each shard,
    without gaps), grown_shard (null: the number of shards decides about all
    documents), after the columns named in keep. A column in keep with one of these
    names is replaced.

    Copies of one text share a shard unless that would make it larger than
    the others. No shard exceeds an equal share by more than a document, or
    the largest range, beyond it. A null text counts as an
    empty one. Repeated rows get a place each. Two texts of one 64-bit hash count as
    neighbours, nothing else. No documents give no rows. The same rows give the same places, in whatever
    order and partitions they come.
    """
    spark = docs.sparkSession
    keep = tuple(c for c in keep if c not in OUT)
    kept = F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    text = docs["text"].cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    crc = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long")
    rows = docs.select(kept.alias("kept"), docs["doc_id"].cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"))
    sized = settle(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "sharded")  # from here on without the texts
    n, total = sized.agg(F.sum("copies"), F.sum(F.col("size") * F.col("copies"))).first()
    blocks = _blocks(sized, max(1, min(BLOCK, (n or 0) // (shards * 256))))
    starts, held = size_ranges(blocks, total, sample, ranges) if n else ([], [])
    by_key = {r.key: r.rows for r in held}
    buckets = [max(1, math.ceil(by_key.get(k, 0) / TOGETHER)) for k in range(len(starts) + 1)]
    key = ("range", "outer", "bucket")
    placed = blocks.withColumn("range", range_of(F.col("same"), starts))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "same", "block"), F.element_at(_longs(buckets), F.col("range") + 1)))
    placed = placed.withColumn("outer", F.floor(F.col("bucket") / SUMS).cast("long"))
    sums = placed.groupBy(*key).agg(F.sum("n").alias("rows"))
    before = lambda c, part, *order: F.coalesce(F.sum(c).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    outer = sums.groupBy("range", "outer").agg(F.sum("rows").alias("rows")).select(F.col("range").alias("o_range"), F.col("outer").alias("o_outer"), before("rows", ("range",), "outer").alias("o_start"))
    inner = sums.select(*[F.col(c).alias(f"s_{c}") for c in key], before("rows", ("range", "outer"), "bucket").alias("s_start"))
    begun = inner.join(outer, (F.col("s_range") == F.col("o_range")) & (F.col("s_outer") == F.col("o_outer"))).select("s_range", "s_bucket", (F.col("s_start") + F.col("o_start")).alias("start"))
    placed = placed.join(begun, (F.col("range") == F.col("s_range")) & (F.col("bucket") == F.col("s_bucket")))
    # Bucket hashes are of the id, the text and the block; these three tell blocks apart but for colliding texts and kept columns.
    at = F.col("start") + before("n", ("range", "bucket"), "doc_id", "same", "size", "text_crc32", "kept", "block")
    each = placed.withColumn("at", at).withColumn("at", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    pieces = _table(spark, packed(held, shards) or [(-1, 0, 0, 0, 0)], "p_range", "p_from", "p_to", "p_shard", "p_slot")
    out = each.join(pieces, (F.col("range") == F.col("p_range")) & (F.col("at") >= F.col("p_from")) & (F.col("at") < F.col("p_to")))
    return out.select(
        *[F.col("kept").getField(c).alias(c) for c in keep], "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("p_shard").cast("int").alias("shard"),
        (F.col("p_slot") + F.col("at") - F.col("p_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes docs as Parquet, a folder for each shard (shard=0, ...), its files in the order of slots, with all columns of docs."""
    placed = shard_documents(docs, shards, keep=tuple(docs.columns)).select(*docs.columns, *[c for c in ("shard", "slot") if c not in docs.columns])
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
