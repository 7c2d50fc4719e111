"""Quality classifier by co-training.

Two views of a document judge it apart: its text, by character and
repetition statistics, and its metadata, by language, source and size. Each
view's classifier labels those unlabelled documents that it is most sure of
for the other view, round after round. The views are then calibrated on
labelled documents that neither has seen, and their calibrated log-odds are
weighed together.

The labelled sample is bounded (SAMPLE) and on the driver. All unlabelled
documents take part: their feature vectors stay in a scratch table, and the
driver sees only histograms of how sure a view is and the sums of Newton's
steps. Which documents were passed on is worked out again in each pass from
the views and bounds of the rounds so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import textnum as T
from quarryloom.llm.exchange import bytes_of, pieces
from quarryloom.llm.storage import drop_settled, prepare_workers, settle

SAMPLE = 6000
ROUNDS, SHARE = 5, 0.05
#: In each round a view passes on about SHARE of the unlabelled documents at most, those it is this sure of.
SURE = 0.9
#: Log-odds, 30 at most, are counted in so many steps.
BINS = 3000
#: A document that was passed on weighs this much; all that were passed to a view together weigh at most this share of the labelled ones.
PASSED = 0.5
FOLDS = 5
RIDGE = 1e-2
#: Rows of sums that one task or the driver takes, 24 KB each at most.
MERGED = 256
SOURCES, LANGS = 32, 8
OUT = "doc_id long, score double, text_score double, meta_score double, predicted int, kept boolean"

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>@^~=+_{}[]\\/")] = True


def text_view(texts: list[bytes]) -> np.ndarray:
    """Statistics of each text, a row for each."""
    rows = []
    h, off = T.hash_words(texts, T.LOWER)
    for text, i, j in zip(texts, off[:-1].tolist(), off[1:].tolist(), strict=True):
        n = j - i
        b = np.frombuffer(text, np.uint8)
        size = max(1, len(b))
        words = h[i:j]
        pairs = T.grams(words, 2)
        rows.append(
            [
                np.log1p(n), len(b) / max(1, n), _UPPER[b].sum() / size, _DIGIT[b].sum() / size, _MARK[b].sum() / max(1, n), _STOP[b].sum() / max(1, n), _SYMBOL[b].sum() / max(1, n),
                len(np.unique(words)) / max(1, n), (words[1:] == words[:-1]).sum() / max(1, n), len(np.unique(pairs)) / max(1, len(pairs)), float((b == 10).sum()) / max(1, n),
            ]
        )
    return np.array(rows, float).reshape(len(texts), 11)


def meta_view(sources: list, langs: list, sizes: list) -> np.ndarray:
    """Indicators of source and language (hashed) and of the size's order of magnitude."""
    out = np.zeros((len(sources), SOURCES + LANGS + 4))
    rows = np.arange(len(sources))
    out[rows, [xxhash.xxh32_intdigest(s or "") % SOURCES for s in sources]] = 1
    out[rows, [SOURCES + xxhash.xxh32_intdigest(s or "") % LANGS for s in langs]] = 1
    size = np.log1p(np.maximum(0, np.array([s or 0 for s in sizes], float)))
    out[:, -4], out[:, -3], out[:, -2], out[:, -1] = size / 10, np.maximum(0, 6 - size), np.maximum(0, size - 8), np.maximum(0, size - 10)
    return out


class Logistic:
    """Ridge logistic regression on standardised columns, by Newton's steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(25):
            if self.step(self.sums(x, y, weight), weight.sum()) < 1e-6:
                break

    @classmethod
    def blank(cls, mean: np.ndarray, scale: np.ndarray) -> Logistic:
        out = cls.__new__(cls)
        out.mean, out.scale, out.w = mean, scale, np.zeros(len(mean) + 1)
        return out

    def sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient and curvature of the rows, one after the other."""
        z = self._z(x)
        p = sigmoid(np.clip(z @ self.w, -30, 30))
        return np.append(z.T @ (weight * (y - p)), (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z)

    def step(self, sums: np.ndarray, n: float) -> float:
        """Takes a step by the sums of n rows; its largest part."""
        k = len(self.w)
        grad = sums[:k] - RIDGE * n * np.append(self.w[:-1], 0)
        step = np.linalg.solve(sums[k:].reshape(k, k) + RIDGE * n * np.eye(k), grad)
        self.w = self.w + step
        return np.abs(step).max()

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.append(np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1)), 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def _level(z: np.ndarray) -> np.ndarray:
    return np.minimum((np.abs(z) * (BINS / 30)).astype(np.int64), BINS - 1)


def passed_on(rounds: list, x: tuple, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the view each document was passed to, -1 for none; its label), by what was passed on so far: (view, its model, bound, share of the level at the bound)."""
    to, mark = np.full(len(ids), -1), np.zeros(len(ids))
    chance = (T.mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53
    for v, model, bound, share in rounds:
        z = model.logit(x[v])
        level = _level(z)
        new = (to < 0) & _sure(z) & ((level > bound) | ((level == bound) & (chance < share)))
        to[new], mark[new] = 1 - v, z[new] >= 0
    return to, mark


def _sure(z: np.ndarray) -> np.ndarray:
    return np.abs(z) >= np.log(SURE / (1 - SURE))


class CoTrained:
    """The two views, their calibrations and how they are weighed together."""

    def __init__(self, x: tuple, y: np.ndarray, fresh: np.ndarray, over: Callable, weight: np.ndarray | None = None):
        """x: labelled rows of both views; fresh: those kept for calibration; over: the sum of an array-valued function of (views, ids) over all unlabelled rows, nothing without rows.

        weight: how many labelled documents each labelled row stands for, so
        that a sample holding both labels in shares of its own gives the chances
        that all labels give.
        """
        old = ~fresh
        weight = np.ones(len(y)) if weight is None else weight * (len(y) / weight.sum())
        known, known_weight = tuple(a[old] for a in x), weight[old]
        moments = over(lambda x, ids: np.concatenate([[len(ids)], *[f(a) for a in x for f in (lambda a: a.sum(0), lambda a: (a * a).sum(0))]]))
        n = int(moments[0]) if moments is not None else 0
        self.views, at = [], 1
        for a in known:
            k = a.shape[1]
            total, square = known_weight @ a, known_weight @ (a * a)
            if n:
                total, square = total + moments[at : at + k], square + moments[at + k : at + 2 * k]
            at += 2 * k
            mean = total / (known_weight.sum() + n)
            self.views.append(Logistic.blank(mean, np.sqrt(np.maximum(0, square / (known_weight.sum() + n) - mean**2)) + 1e-9))
        self.rounds: list = []
        self._fit(known, y[old], known_weight, over, np.zeros(2))
        for _ in range(ROUNDS if n else 0):
            any_new = False
            for v in (0, 1):
                rounds, model = self.rounds, self.views[v]
                hist = over(lambda x, ids, v=v, rounds=rounds, model=model: _histogram(rounds, model, v, x, ids))
                if hist.sum() == 0:
                    continue
                above = np.append(np.cumsum(hist[::-1])[::-1], 0)  # rows at this level or over it
                most = max(1, int(SHARE * n))
                bound = int(np.flatnonzero(above[1:] <= most)[0])
                share = min(1.0, (most - above[bound + 1]) / max(1, hist[bound]))
                frozen = Logistic.blank(model.mean, model.scale)
                frozen.w = model.w
                self.rounds = [*self.rounds, (v, frozen, bound, share)]
                any_new = True
            if not any_new:
                break
            rounds = self.rounds
            self._fit(known, y[old], known_weight, over, over(lambda x, ids, rounds=rounds: np.bincount(passed_on(rounds, x, ids)[0] + 1, minlength=3)[1:].astype(float)))
        judge = fresh if len(np.unique(y[fresh])) == 2 else np.ones(len(y), bool)
        self.scales = [Logistic(self.views[v].logit(x[v][judge])[:, None], y[judge], weight[judge]) for v in (0, 1)]
        self.both = Logistic(self._calibrated(tuple(a[judge] for a in x)), y[judge], weight[judge])

    def _fit(self, x: tuple, y: np.ndarray, own: np.ndarray, over: Callable, counts: np.ndarray) -> None:
        """Both views from the labelled rows and from counts rows that were passed to each, whose weight is bounded."""
        weight = PASSED * np.minimum(1, own.sum() / np.maximum(1, counts))
        for _ in range(25):
            views, rounds = self.views, self.rounds
            more = over(lambda x, ids, views=views, rounds=rounds: _newton(views, rounds, weight, x, ids)) if counts.any() else None
            at, moved = 0, 0.0
            for v in (0, 1):
                sums = views[v].sums(x[v], y, own)
                if more is not None:
                    sums = sums + more[at : at + len(sums)]
                at += len(sums)
                moved = max(moved, views[v].step(sums, own.sum() + counts[v] * weight[v] / PASSED))
            if moved < 1e-5:
                break

    def _calibrated(self, x: tuple) -> np.ndarray:
        return np.stack([s.logit(v.logit(a)[:, None]) for s, v, a in zip(self.scales, self.views, x, strict=True)], 1)

    def score(self, x: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self._calibrated(x)
        return sigmoid(self.both.logit(z)), sigmoid(z[:, 0]), sigmoid(z[:, 1])


def _histogram(rounds: list, model: Logistic, v: int, x: tuple, ids: np.ndarray) -> np.ndarray:
    z = model.logit(x[v])
    free = (passed_on(rounds, x, ids)[0] < 0) & _sure(z)
    return np.bincount(_level(z[free]), minlength=BINS).astype(float)


def _newton(views: list, rounds: list, weight: np.ndarray, x: tuple, ids: np.ndarray) -> np.ndarray:
    to, mark = passed_on(rounds, x, ids)
    return np.concatenate([views[v].sums(x[v][to == v], mark[to == v], np.full(int((to == v).sum()), weight[v])) for v in (0, 1)])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for sums in batch["sums"]:
            part = np.frombuffer(sums.as_buffer())
            total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def summed_over(table: DataFrame) -> Callable:
    """over() of CoTrained for a table of doc_id, x and m: a row of sums from each task, of which tasks add MERGED at a time until the driver gets no more than MERGED."""
    tasks = table.select(F.spark_partition_id().alias("task")).distinct().count()

    def over(f: Callable) -> np.ndarray | None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = f((_matrix(batch["x"]), _matrix(batch["m"])), batch["doc_id"].to_numpy())
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(total, float).tobytes()], pa.binary())], ["sums"])

        sums, n = table.mapInArrow(run, "sums binary"), tasks
        while n > MERGED:
            n = -(-n // MERGED)
            sums = sums.repartition(n).mapInArrow(_added, "sums binary")
        parts = [np.frombuffer(bytes(r[0])) for r in sums.collect()]
        return np.sum(parts, axis=0) if parts else None

    return over


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def quality_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The quality of each whole document: the chance that its label is 1.

    Returns a row for each row of docs: doc_id, score (of both views),
    text_score, meta_score (of each), predicted (1 from 0.5 on) and kept (the
    same as a boolean). Reads doc_id, text, source, lang and n_chars.

    At most sample labelled documents, equally of both labels as far as there
    are so many, are used for fitting, in the order of a hash of the id, and all
    documents without a label; one in FOLDS of the labelled is kept for
    calibration. A labelled document counts for as many as it was drawn from, so
    scores don't move with the bound. A doc_id with several labels counts as 0 if one
    says so. A null or empty text and null metadata have features too. Unless
    both labels occur all documents get the share of label 1 (1.0 without any label).
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["source"].cast("string").alias("source"), docs["lang"].cast("string").alias("lang"), docs["n_chars"].cast("long").alias("n_chars"))
    marks = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("quality")).filter("id is not null and quality in (0, 1)").groupBy("id").agg(F.min("quality").alias("quality"))
    total = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = text_view(bytes_of(batch["text"]))
            m = meta_view(batch["source"].to_pylist(), batch["lang"].to_pylist(), batch["n_chars"].to_pylist())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(list(x), kind), pa.array(list(m), kind)], ["doc_id", "x", "m"])

    def features(ids: DataFrame) -> list:
        """ids has sample rows at most; a doc_id of several rows gives the first in order."""
        some = table.join(F.broadcast(ids), table["doc_id"] == ids["id"]).groupBy("doc_id").agg(F.min(F.struct("x", "m")).alias("v"), F.first("quality").alias("quality"))
        return sorted(some.select("doc_id", "v.x", "v.m", "quality").collect(), key=lambda r: r["doc_id"])

    order = (F.xxhash64("id"), "id")
    each = [marks.filter(F.col("quality") == q).orderBy(*order).limit(sample // 2) for q in (0, 1)]
    if len(total) == 2:  # texts are read once; what follows reads their features
        table = settle(docs.mapInArrow(views, "doc_id long, x array<double>, m array<double>"), "features")
    known = features(settle(each[0].unionByName(each[1]), "sample")) if len(total) == 2 else []
    y = np.array([float(r["quality"]) for r in known])
    if len(set(y.tolist())) < 2:
        p = total.get(1, 0) / max(1, sum(total.values())) if total else 1.0
        return docs.select("doc_id", F.lit(p).alias("score"), F.lit(p).alias("text_score"), F.lit(p).alias("meta_score"), F.lit(int(p >= 0.5)).alias("predicted"), F.lit(p >= 0.5).alias("kept"))
    free = table.filter("doc_id is not null").join(marks.select("id"), table["doc_id"] == F.col("id"), "left_anti")
    rest = settle(free.groupBy("doc_id").agg(F.min(F.struct("x", "m")).alias("v")).select("doc_id", "v.x", "v.m"), "unlabelled")
    matrix = lambda rows, k, width: np.array([r[k] for r in rows], float).reshape(len(rows), width)
    width = (11, SOURCES + LANGS + 4)
    fresh = np.array([xxhash.xxh32_intdigest(str(r["doc_id"])) % FOLDS == 0 for r in known])
    weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    model = spark.sparkContext.broadcast(CoTrained((matrix(known, "x", width[0]), matrix(known, "m", width[1])), y, fresh, summed_over(rest), weight))

    drop_settled(rest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"]), _matrix(batch["m"])
            both, text, meta = model.value.score(x)
            good = pa.array(both >= 0.5)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(both), pa.array(text), pa.array(meta), pc.cast(good, pa.int32()), good], ["doc_id", "score", "text_score", "meta_score", "predicted", "kept"])

    return table.mapInArrow(scored, OUT)
