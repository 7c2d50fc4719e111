"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a random key from the hash of its id and text. Within each source
the keys are cut into ranges, as many as the source's size asks for; sums
over the ranges and then inside each range give every document the number of
words before it in its source, so no source, however large, is ordered in one
task. The source's budget is cut at exactly that many words, in as many
rounds over the source as the budget needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.llm.storage import settle

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: A range of keys has about so many documents.
RANGE_ROWS = 2048
SEED = "mix-1"
OUT = ("doc_id", "size", "source_size", "target", "taken")
_HEX = 12
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """From (source, source_size, ...) the same with target, as many words as the mix wants of the source.

    The weights go to the sources in the order of their code points, null
    last, again and again. All words are shared out by weight; what exceeds
    most times a source's size is shared out anew among the others. Written
    as one level that all shares rise to: sources whose limit lies below it stop at
    the limit. The window goes over sources, not documents.
    """
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    ranked = sizes.withColumn("weight", weight).withColumn("most", limit).withColumn("ratio", limit / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("level", level)
    # The level rises while the sources taken out lie below it, and falls after that.
    leveled = leveled.withColumn("water", F.max("level").over(total))
    target = F.least(F.col("most"), F.col("weight") * F.col("water"))
    return leveled.withColumn("target", target).drop("weight", "most", "ratio", "level", "water")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED, keep: tuple = ()) -> DataFrame:
    """How much of each document a mix of the sources takes.

    The size of a document is its number of [^\\x20\\x09-\\x0D]+ words. A
    source's documents are taken in random order, again from the first when
    all are taken, up to the target's whole number of words; the document at
    the cut gives the words that still fit. No document is taken more than
    most times.

    Returns a row for each row of docs: doc_id, size, source_size, target,
    taken, after the columns named in keep. A column in keep with one of these
    names is replaced.

    A null text has size 0. A null source is a source of its own, the last.
    Repeated rows stand together, as one row with their number until their words
    are dealt out. A source without words has target 0. No documents give no rows.
    """
    keep = tuple(c for c in keep if c not in OUT)
    size = F.regexp_count(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    # A key that SQL can make too: the first hex digits of an md5.
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("|"), F.coalesce(docs["text"].cast("string"), F.lit(""))).cast("binary"))
    kept = F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    sized = docs.select(kept.alias("kept"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), digest.alias("key"))
    sized = sized.groupBy(*sized.columns).agg(F.count("*").alias("copies"))
    sized = settle(sized, "sized")  # read three times from here on, without the texts
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sources, weights, most).withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("long")).withColumnRenamed("source", "of")
    unit = F.conv(F.substring("key", 1, _HEX), 16, 10).cast("double") / F.lit(float(16**_HEX))
    ranged = sized.join(targets, sized["source"].eqNullSafe(targets["of"])).withColumn("range", F.floor(unit * F.col("ranges")))
    sums = ranged.groupBy("of", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("range_size"))
    start = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("of").alias("s_of"), F.col("range").alias("s_range"), F.coalesce(F.sum("range_size").over(start), F.lit(0)).alias("range_start"))
    placed = ranged.join(starts, F.col("of").eqNullSafe(F.col("s_of")) & (F.col("range") == F.col("s_range")))
    inside = Window.partitionBy("of", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("range_start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0))
    placed = placed.withColumn("begin", begin).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    before = F.col("begin") + F.col("copy") * F.col("size")
    budget = F.floor(F.col("target")).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - before))
    return placed.withColumn("taken", taken.cast("long")).select(*[F.col("kept").getField(c).alias(c) for c in keep], "doc_id", "size", "source_size", "target", "taken")
