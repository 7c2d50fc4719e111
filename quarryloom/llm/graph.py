"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.storage import drop_settled, settle


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node long, label long): for each node of an edge the smallest node that it reaches.

    Each round links every node's larger neighbours to the smallest one, then
    the node and its smaller neighbours; it uses joins and minima only, so a
    node's neighbours are never gathered. Rounds grow with the logarithm of the
    number of nodes. Rows with a null end and loops are left out; repeated
    edges don't matter; no edges give no rows.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    cur = settle(edges.filter(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = _state(cur)
    while seen[0]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        new = settle(small.distinct(), "edges")
        drop_settled(cur)
        now, cur = _state(new), new
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("label")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
