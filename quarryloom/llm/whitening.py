"""Whitening of embeddings by one aggregation over all pairs of dimensions.

The sums of centred products that make the covariance are Spark SQL
expressions, generated for the upper triangle and summed in one pass over the
vectors. What comes back is one row of d (d + 1) / 2 numbers, whatever the
number of vectors; LAPACK decomposes it, and the projection is again a set of
generated expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 8
#: Pairs that one aggregation sums; 90 dimensions have fewer. Wider vectors take an aggregation for each so many pairs.
PAIRS = 4_096
#: Directions with less than this share of the largest variance count as having none.
NO_VARIANCE = 1e-12
SCALE, SHIFT, FAR = 1024, 100_000, float(1 << 52)


def quantised(column: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry c as long. Entries beyond 2^42 count as 2^42, so that every product of x stays a number."""
    return F.transform(column.cast("array<double>"), lambda c: F.floor(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), c * F.lit(float(SCALE))))).cast("long") + F.lit(SHIFT).cast("long"))


def usable(frame: DataFrame, column: str, into: str) -> DataFrame:
    """frame without the rows whose vector is null or holds nulls, NaN or infinities, and with the column into of doubles as longs.

    Vectors have as many entries as most of those rows do (the larger number
    among equals); others, and empty ones, can't be compared with them and go
    too.
    """
    whole = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    rows = frame.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(F.forall(F.col(column), lambda x: F.coalesce(whole(x), F.lit(False))))
    lengths = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return rows.filter(F.size(column) == d).withColumn(into, quantised(F.col(column)))


@dataclass(frozen=True)
class Whitening:
    """Means and principal directions of n vectors. values fall; vectors has a row for each; total is the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    span: int
    values: np.ndarray
    vectors: np.ndarray
    total: float

    @property
    def mean(self) -> list[float]:
        return [_ratio(s, self.n) for s in self.sums]

    @classmethod
    def fit(cls, rows: DataFrame, column: str, components: int = COMPONENTS) -> Whitening | None:
        """None if rows has none. column holds arrays of long, all of one length."""
        first = rows.select(F.size(column).alias("d")).first()
        if first is None:
            return None
        d = first["d"]
        at = [F.col(column)[i] for i in range(d)]
        got = rows.agg(F.count("*").alias("n"), F.min(F.array_min(column)).alias("low"), F.max(F.array_max(column)).alias("high"), F.array(*[F.sum(x.cast("decimal(18,0)")) for x in at]).alias("sums")).first()
        n, sums = got["n"], tuple(int(s) for s in got["sums"])
        cov = covariance(rows, column, [_ratio(s, n) for s in sums], n)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors.T[order]
        total = float(np.trace(cov))
        some = int(min(components, (values > max(NO_VARIANCE * values[0], 0)).sum()))
        return cls(n, sums, int(got["high"] - got["low"]), values[:some], vectors[:some], total)

    def whitened(self, column: str) -> Column:
        """The array of a vector's whitened coordinates."""
        centred = F.zip_with(F.col(column).cast("array<double>"), F.lit(self.mean), lambda x, m: x - m)
        scaled = [(row / math.sqrt(e)).tolist() for e, row in zip(self.values, self.vectors, strict=True)]
        return F.array(*[F.aggregate(F.zip_with(centred, F.lit(row), lambda x, p: x * p), F.lit(0.0), lambda t, x: t + x) for row in scaled])

    def deviation(self, column: str) -> Column:
        """The sum over dimensions of (n x - S)^2, exact; null if it isn't a long. Decimals take over where the range of x allows products beyond a long."""
        most = max(map(abs, self.sums))
        if len(self.sums) * (self.n * self.span) ** 2 < 1 << 63 and most + self.n * self.span < 1 << 62:
            apart = F.zip_with(F.col(column), F.lit(list(self.sums)), lambda x, s: x * F.lit(self.n).cast("long") - s)
            return F.aggregate(apart, F.lit(0).cast("long"), lambda t, x: t + x * x)
        sums = F.transform(F.lit([str(s) for s in self.sums]), lambda s: s.cast("decimal(38,0)"))
        short = lambda x: x.try_cast("decimal(19,0)")
        apart = F.zip_with(F.col(column), sums, lambda x, s: short(F.try_subtract(F.try_multiply(x.cast("decimal(19,0)"), F.lit(str(self.n)).cast("decimal(19,0)")), s)))
        return F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda t, x: F.try_add(t, F.try_multiply(x, x)).cast("decimal(38,0)")).try_cast("bigint")


def _ratio(s: int, n: int) -> float:
    """s / n, rounded once."""
    return s / n


def _literal(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else "double('NaN')"


def _centred(column: str, mean: list[float]) -> list[Column]:
    return [F.expr(f"double(`{column}`[{i}]) - {_literal(m)}").alias(f"c{i}") for i, m in enumerate(mean)]


def covariance(rows: DataFrame, column: str, mean: list[float], n: int) -> np.ndarray:
    """The covariance with divisor n, from the sums of centred products of every pair of dimensions."""
    d = len(mean)
    centred = rows.select(*_centred(column, mean))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        got = centred.selectExpr(f"array({', '.join(f'sum(c{i} * c{j})' for i, j in some)}) AS sums").first()["sums"]
        for (i, j), s in zip(some, got, strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def identity_error(rows: DataFrame, column: str, k: int) -> float:
    """How far the covariance of the k coordinates in column is from the identity, at most."""
    own = rows.select(*[F.col(column)[i].alias(f"w{i}") for i in range(k)])
    got = own.agg(F.count("*").alias("n"), F.array(*[F.avg(f"w{i}") for i in range(k)]).alias("mean")).first()
    cov = covariance(own.select(F.array(*[F.col(f"w{i}") for i in range(k)]).alias("w")), "w", got["mean"], got["n"])
    return float(np.abs(cov - np.eye(k)).max())


def whiten(frame: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened coordinates of every usable vector, a row for each component.

    Returns key, component (from 1, by falling variance), n, deviation (sum over
    dimensions of (n x - S)^2, null beyond a long), whitened, explained (share of
    the whole variance) and identity_error, one value for all rows.

    x is floor(1024 c) + 100000 of each entry c. Vectors that are null or hold
    nulls, NaN or infinities give no rows, nor do vectors of another length than
    most. Repeated rows and ids give rows each. Directions without variance can't
    be whitened and give no rows, so a single vector, or copies of one, gives none. No
    vectors give no rows.
    """
    own = frame.select(F.col(key).alias("id_"), F.col(vector).alias("v_"))
    rows = usable(own, "v_", "x_")
    fit = Whitening.fit(rows, "x_", components)
    k = len(fit.values) if fit else 0
    if not k:
        return own.filter("false").select(F.col("id_").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    error = identity_error(rows.select(fit.whitened("x_").alias("w_")), "w_", k)
    share = F.array(*[F.lit(float(e / fit.total)) for e in fit.values])
    each = rows.select("id_", fit.deviation("x_").cast("long").alias("deviation"), F.posexplode(fit.whitened("x_")).alias("at_", "whitened"))
    return each.select(F.col("id_").alias(key), (F.col("at_") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", share[F.col("at_")].alias("explained"), F.lit(error).alias("identity_error"))
