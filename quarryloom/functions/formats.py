"""Sizes and durations for people to read, and estimates for ANN indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = "KMGTP"


def byte_size(n: Column) -> Column:
    """512 B, 1.5 KiB, 2.0 MiB ...; tenths are rounded, halves to the even one."""
    n = n.cast("long")
    out = F.format_string("%d B", n)
    for i, u in enumerate(_UNITS):
        unit = 1 << (10 * (i + 1))
        # Whole units and the rest apart, so that nothing overflows.
        tenths, rest = F.floor((n % unit) * 10 / unit), (n % unit) * 10 % unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (tenths % 2 == 1))
        rounded = F.floor(n / unit) * 10 + tenths + F.when(up, 1).otherwise(0)
        out = F.when(n >= unit, F.format_string(f"%d.%d {u}iB", F.floor(rounded / 10), rounded % 10)).otherwise(out)
    return out


def duration(ns: Column) -> Column:
    """Nanoseconds as whole milliseconds below a second, else as seconds with one decimal."""
    return F.when(ns < 1_000_000_000, F.format_string("%dms", F.floor(ns / 1_000_000).cast("long"))).otherwise(F.format_string("%.1fs", ns / 1e9))


def hnsw_memory_bytes(vectors: int, dimensions: int, m: int = 16) -> int:
    return vectors * dimensions * 4 + vectors * m * 2 * 8


def hnsw_build_seconds(vectors: int, dimensions: int, ef_construction: int = 64) -> float:
    """By about 100 vectors of 768 dimensions a second at ef 64."""
    return vectors / 100 * (dimensions / 768) * (ef_construction / 64)
