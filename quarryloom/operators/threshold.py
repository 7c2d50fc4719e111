"""The best of several ranked lists by reciprocal rank, without ranking any list as a whole.

Only the beginning of each list is read in order. An id seen there has its
places in the other lists counted (how many rows come before it, one pass
without a sort), and the search ends when nothing below the beginnings could
still reach the n-th score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryloom.operators import fusion
from quarryloom.operators.ordering import numbered
from quarryloom.scratch import drop_settled, settle

#: Rows whose places one pass counts, and the depth beyond which lists are ranked as a whole.
COUNTED, DEEPEST = 64, 16_384
#: The first round reads so many times n rows of each list.
FIRST = 32


def _before(score: float | None, id_: object) -> Column:
    """Whether a row comes before (score, id) in the order of falling score, nulls last, and id."""
    if score is None:
        return F.col("score").isNotNull() | (F.col("id") < F.lit(id_))
    return (F.col("score") > F.lit(score)) | ((F.col("score") == F.lit(score)) & (F.col("id") < F.lit(id_)))


def places(hits: DataFrame, rows: list[tuple]) -> list[int]:
    """The places from 1 of rows (score, id) in the order of falling score and id of hits, COUNTED of them in a pass."""
    out: list[int] = []
    for at in range(0, len(rows), COUNTED):
        counts = [F.count_if(_before(s, i)) for s, i in rows[at : at + COUNTED]]
        out += [n + 1 for n in hits.agg(*[c.alias(f"c{j}") for j, c in enumerate(counts)]).first()]
    return out


def _below(hits: DataFrame, head: DataFrame, some: DataFrame, source: str) -> list[DataFrame]:
    """What hits has of some ids below its beginning, ranked."""
    rows = hits.join(some, "id", "left_semi").join(head.select("id"), "id", "left_anti")
    found = rows.collect()  # ids of the beginnings that can be among the best
    if not found:
        return []
    rank = places(hits, [(r["score"], r["id"]) for r in found])
    schema = T.StructType([*rows.schema.fields, T.StructField("rank", T.IntegerType())])
    named = hits.sparkSession.createDataFrame([(*r, p) for r, p in zip(found, rank, strict=True)], schema)
    return [named.withColumn("source", F.lit(source))]


def top_n_by_threshold(lists: dict[str, DataFrame], n: int, k: int = fusion.RRF_K, weights: dict[str, float] | None = None, depth: int | None = None) -> DataFrame:
    """top_n(rrf(...), n), or of weighted_rrf with weights, of lists (id, score) by source, with depth, how far each list was read.

    Lists are in the order of falling score and id; an id stands once in a list and isn't null.
    depth is where the first round stops; each further round reads twice as far, until nothing unseen
    can be among the n best and few of what was seen can. Lists that don't decide within DEEPEST
    rows are ranked as a whole, and depth is null.
    """
    weights = {s: float((weights or {}).get(s) or 1.0) for s in lists}
    depth, fuse = depth or FIRST * n, lambda *ranked: fusion.weighted_rrf(weights, *ranked, k=k)
    while n > 0 and depth <= DEEPEST:
        heads = {s: settle(numbered(h, [F.col("score").desc_nulls_last(), F.col("id")], most=depth).withColumn("source", F.lit(s)), "head") for s, h in lists.items()}
        unseen = {s: weights[s] / (k + depth + 1) if heads[s].count() == depth else 0.0 for s in lists}
        seen = reduce(DataFrame.unionByName, [h.select("id", "source", (F.lit(weights[s]) / (F.lit(k) + F.col("rank"))).alias("part")) for s, h in heads.items()])
        most = F.lit(sum(unseen.values())) - sum((F.when(F.array_contains("in", s), F.lit(u)).otherwise(F.lit(0.0)) for s, u in unseen.items()), F.lit(0.0))
        bounds = seen.groupBy("id").agg(F.sum("part").alias("least"), F.collect_set("source").alias("in")).withColumn("most", F.col("least") + most)
        bounds = settle(bounds.select("id", "least", "most"), "bounds")
        nth = [r["least"] for r in bounds.orderBy(F.col("least").desc()).limit(n).collect()]
        enough = len(nth) == n and sum(unseen.values()) < nth[-1] - 1e-9
        some = bounds.filter(F.col("most") >= F.lit(nth[-1] - 1e-9 if len(nth) == n else -1.0)).select("id")
        if not any(unseen.values()) or (enough and (2 * depth > DEEPEST or some.count() <= max(2 * n, COUNTED))):
            ranked = [heads[s].join(some, "id", "left_semi") for s in lists]
            for s in [s for s in lists if unseen[s]]:
                ranked += _below(lists[s], heads[s], some, s)
            return fusion.top_n(fuse(*ranked), n).withColumn("depth", F.lit(depth))
        drop_settled(bounds, *heads.values())
        depth *= 2
    whole = [fusion.ranked(h, s, [F.col("score").desc_nulls_last(), F.col("id")]) for s, h in lists.items()]
    return fusion.top_n(fuse(*whole), n).withColumn("depth", F.lit(None).cast("int"))
