"""Places in a total order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.scratch import settle

#: monotonically_increasing_id() has the partition above these bits and the place in it below.
_BITS = 33


def numbered(rows: DataFrame, order: list, name: str = "rank", most: int | None = None) -> DataFrame:
    """rows with their place from 1 in the order, which has to tell all rows apart.

    Rows are range-sorted over all tasks and written with their place inside
    their range; what the ranges before it hold is added, a row for each range.
    With most, of which the caller knows that rows has no more, one task numbers them.
    """
    if most is not None:
        return rows.orderBy(*order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(*order)))
    placed = settle(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", _BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))  # a row for each range of the sort
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    return placed.withColumn("_part", part).join(starts, "_part").withColumn(name, place).drop("_at", "_part", "_before")


def row_at(rows: DataFrame, order: list, place: int) -> tuple | None:
    """The row at that place from 1; None beyond the end."""
    found = numbered(rows, order, "_place").filter(F.col("_place") == place).drop("_place").first() if place > 0 else None
    return tuple(found) if found else None




#: What one round of a selection counts, and the largest range of whole numbers that it narrows.
BINS, WIDEST = 4_096, 1 << 62
_WHOLE = ("tinyint", "smallint", "int", "bigint", "date", "timestamp")


def as_whole(column: str, kind: str) -> Column | None:
    """A column as whole numbers in the same order, or None if its type has none."""
    if kind not in _WHOLE:
        return None
    return F.unix_micros(column) if kind == "timestamp" else F.unix_date(column).cast("long") if kind == "date" else F.col(column).cast("long")


def _cut(counts: list[tuple], place: int) -> tuple:
    """The first of (bin, n) in order with which the sum reaches place, and the place in it."""
    for b, n in counts:
        if place <= n:
            return b, place, n
        place -= n
    raise ValueError("the place lies beyond the rows")


def whole_at(rows: DataFrame, value: Column, place: int, descending: bool = False) -> tuple[int, int, int] | None:
    """(the value at a place from 1, the place among the rows of that value, their number), found without a sort.

    Each round counts the rows in BINS bins of what is left of the range; the driver
    sees BINS counts. None if the values lie further apart than WIDEST. Nulls don't count.
    """
    own = rows.select(value.alias("v")).filter("v is not null")
    low, high = own.agg(F.min("v"), F.max("v")).first()
    if low is None or high - low >= WIDEST:
        return None
    while True:
        width = (high - low) // BINS + 1
        inside = own.filter(F.col("v").between(low, high)).groupBy(F.expr(f"(v - ({low}L)) div {width}L").alias("b")).count()
        counts = sorted(((r["b"], r["count"]) for r in inside.collect()), reverse=descending)
        b, place, n = _cut(counts, place)
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
        if low == high:
            return low, place, n


def text_at(rows: DataFrame, column: str, place: int) -> str:
    """The text at a place from 1 in the order of its bytes, two more of them in each round, without a sort. Nulls don't count."""
    own = rows.select(F.col(column).alias("t"), F.hex(F.col(column).cast("binary")).alias("h")).filter("t is not null")
    known = ""
    while True:
        part = F.substring("h", len(known) + 1, 4).alias("b")
        counted = own.filter(F.col("h").startswith(known)).groupBy(part).agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).collect()  # 65,793 rows at most
        ends = {r["b"]: (r["low"], r["high"]) for r in counted}
        b, place, _ = _cut(sorted((r["b"], r["n"]) for r in counted), place)
        if ends[b][0] == ends[b][1]:
            return ends[b][0]
        known += b
