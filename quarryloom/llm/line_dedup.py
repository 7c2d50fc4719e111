"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. For each line hash a
HyperLogLog sketch of its sites is merged by aggregation; a line whose
estimate lies near the threshold gets its sites counted exactly. Lines that
reach the threshold are taken out of all texts.

Every site of every document counts. A text that was copied around so has
all its lines on many sites; with min_texts a line must also stand in that
many distinct texts, counted in the same way, which leaves copies to
near-duplicate removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.storage import drop_settled, settle

MIN_SITES = 10
LG_K = 12
#: Estimates within this share of the threshold are counted exactly: three standard errors of a sketch of 2^LG_K registers.
NEAR = 3 * 1.04 / 2 ** (LG_K / 2)
#: A list of lines up to this long goes to all tasks; a longer one meets the lines in a join that deals each line over SALTS tasks.
LISTED = 1 << 16
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    """The line's hash without white space around it, null for a line without words."""
    bare = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.xxhash64(bare, F.length(bare)))


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_texts: int = 1) -> DataFrame:
    """(line, sites): hashes of the lines on min_sites sites or more; sites is exact near the threshold, else estimated."""
    return _boilerplate(_text_lines(docs, site), min_sites, min_texts, LISTED)


def _text_lines(docs: DataFrame, site: str) -> DataFrame:
    """text_key, line, site: each line of each distinct text once for every site it is on."""
    text = docs["text"].cast("string")
    place = F.coalesce(F.concat(F.lit("="), docs[site].cast("string")), F.lit("?"))
    each = docs.select(_key(text).alias("text_key"), place.alias("site"), F.explode(F.array_distinct(F.transform(_lines(text), _hash))).alias("line"))
    return settle(each.filter("line is not null").distinct(), "lines")


def _among(rows: DataFrame, some: DataFrame, salt: str, listed: int) -> DataFrame:
    """rows whose line is in some, a settled table. A line that is everywhere is dealt out by the column salt."""
    if some.count() <= listed:
        return rows.join(F.broadcast(some.select("line")), "line", "left_semi")
    again = some.select("line", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).join(again, ["line", "salt"], "left_semi").drop("salt")


def _boilerplate(lines: DataFrame, min_sites: int, min_texts: int, listed: int) -> DataFrame:
    """(line, sites) of the lines that stand on min_sites sites and in min_texts distinct texts, however the two meet."""
    kinds = {"site": ("sites", min_sites)} | ({"text_key": ("texts", min_texts)} if min_texts > 1 else {})
    pairs = lines if min_texts > 1 else lines.select("line", "site").distinct()
    sketched = pairs.groupBy("line").agg(*[F.hll_sketch_agg(c, F.lit(LG_K)).alias(n) for c, (n, _) in kinds.items()])
    out = sketched.select("line", *[F.hll_sketch_estimate(n).alias(n) for n, _ in kinds.values()])
    for n, least in kinds.values():
        out = out.filter(F.col(n) >= least * (1 - NEAR))
    out = settle(out, "spread")
    for c, (n, least) in kinds.items():
        near = settle(out.filter(F.col(n) <= least * (1 + NEAR)).select("line"), "near")
        exact = _among(lines.select("line", c).distinct(), near, c, listed).groupBy("line").agg(F.count("*").alias("exact"))
        out = out.join(exact, "line", "left").withColumn(n, F.coalesce("exact", F.col(n).cast("long"))).drop("exact").filter(F.col(n) >= least)
    return settle(out.select("line", "sites"), "boilerplate")


def _table_of(some: DataFrame) -> tuple[Column, int]:
    """(a table of hash slots of the lines in some, LISTED rows at most, as one value that tasks get; how many slots)."""
    found = [r[0] for r in some.select("line").collect()]
    slots: list[list[int]] = [[] for _ in range(1 << max(1, (2 * len(found)).bit_length()))]
    for x in found:
        slots[x % len(slots)].append(x)
    return some.sparkSession.createDataFrame([(slots,)], "slots array<array<bigint>>").scalar(), len(slots)


def _without(parts: Column, slots: Column, n: int) -> Column:
    """The parts whose line isn't in slots, which is named once: so that the value stays one, and isn't written into each row."""

    def left(s: Column, hashes: Column) -> Column:
        has = lambda x: F.array_contains(F.get(s, F.pmod(x, F.lit(n)).cast("int")), x)
        return F.filter(parts, lambda x, i: ~F.coalesce(has(F.get(hashes, i)), F.lit(False)))

    once = F.struct(slots.alias("slots"), F.transform(parts, _hash).alias("hashes"))
    return F.get(F.transform(F.array(once), lambda v: left(v["slots"], v["hashes"])), F.lit(0))


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, min_texts: int = 1, listed: int = LISTED) -> DataFrame:
    """docs without the lines that stand on min_sites distinct sites or more and in min_texts distinct texts or more.

    Lines are \\n-separated and compared without white space around them; lines
    without words are never removed. Returns docs' columns, text without those
    lines, and n_lines and n_removed (columns of docs with these two names are
    replaced).

    A null text stays null with no lines, an empty one has one line. A null
    site is a site of its own. A text all of whose lines go stays as "".
    Repeated rows are treated alike and all returned.

    Up to listed lines are handed to the tasks, and no text moves; more are
    brought to the texts by a join.
    """
    lines = _text_lines(docs, site)
    boilerplate = _boilerplate(lines, min_sites, min_texts, listed)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    parts = _lines(F.col("row.text").cast("string"))
    if boilerplate.count() <= listed:
        known, n = _table_of(boilerplate)
        cut = docs.select(row, known.alias("slots")).select("row", parts.alias("parts"), _without(parts, F.col("slots"), n).alias("kept"))
        drop_settled(lines)
    else:
        gone = _among(lines.select("text_key", "line"), boilerplate, "text_key", listed).groupBy("text_key").agg(F.collect_set("line").alias("gone"))
        some = docs.filter(docs["text"].isNotNull()).select(row, _key(docs["text"].cast("string")).alias("key"))
        found = some.join(gone, some["key"] == gone["text_key"], "left")
        kept = F.filter(parts, lambda x: ~F.coalesce(F.array_contains(F.col("gone"), _hash(x)), F.lit(False)))
        cut = found.select("row", parts.alias("parts"), F.when(F.col("gone").isNull(), parts).otherwise(kept).alias("kept"))
        none = F.lit(None).cast("array<string>")
        cut = cut.unionByName(docs.filter(docs["text"].isNull()).select(row, none.alias("parts"), none.alias("kept")))
    size = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.size(c)).cast("long")
    columns = [F.array_join("kept", "\n").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*columns, size("parts").alias("n_lines"), (size("parts") - size("kept")).alias("n_removed"))
