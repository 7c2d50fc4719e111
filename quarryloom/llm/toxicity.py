"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is a logistic function
of the words and word beginnings in it; a document's score is the noisy-or
of its sentences, 1 - prod(1 - p). Only documents are labelled: the
gradient of the document's likelihood tells each sentence its share, so the
model finds the sentences that make a document toxic.

Features are 64-bit hashes, chosen from the labelled sample by a likelihood
ratio test of their document counts, so the model is small and nothing is
folded into shared bins. The labelled sample is bounded in documents
(SAMPLE), whose texts are read whole: tasks count their features, and the
driver gets the chosen ones and where they stand, no texts. Scoring reads
whole texts of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quarryloom.llm import textnum as T
from quarryloom.llm.exchange import bytes_of, pieces
from quarryloom.llm.storage import drop_settled, prepare_workers, settle

#: At most so many labelled documents of each label are used.
SAMPLE = 4000
#: Features need this likelihood ratio (chi-square, one degree of freedom) and so many toxic documents; the strongest MOST stay.
LEAST_RATIO, LEAST_DOCS, MOST = 10.0, 3, 4096
PREFIXES = (4, 5)
STEPS, RATE, DECAY = 300, 0.3, 1e-3
FOLDS = 5

_SALTS = np.array([0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of FOLDS; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def sentence_features(texts: list[bytes]):
    """(features [words x kinds], sentence of each word, document of each sentence), in slices of texts.

    Sentences end at . ! ? and line ends; each document has at least one, which may have no words.
    """
    raw = b" " + b"\n".join(texts) + b"\n"
    b = np.frombuffer(raw.translate(T.ALNUM), np.uint8)
    inside = b != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    breaks = np.cumsum(_BREAK[np.frombuffer(raw, np.uint8)])
    last = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    per_doc = np.diff(np.concatenate(([0], breaks[last])))
    doc = np.repeat(np.arange(len(texts)), per_doc)
    if not len(starts):
        return np.empty((0, 3), np.uint64), np.empty(0, np.int64), doc
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(first, lens)
    values = T._CHARS.take(((pos & 63) << 8) | b[inside])
    if lens.max() > 64:
        values *= T.long_word_powers(int(lens.max()))[pos >> 6]
    kinds = [T.mix(np.add.reduceat(values, first) * _SALTS[0])]
    for p, salt in zip(PREFIXES, _SALTS[1:], strict=True):
        kinds.append(T.mix(np.add.reduceat(np.where(pos < p, values, np.uint64(0)), first) * salt))
    return np.stack(kinds, 1), breaks[starts], doc


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= T.SLICE_BYTES):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


class Model:
    """Weights by feature hash, and the bias of a sentence."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(features)
        self.features, self.weights, self.bias = features[order], weights[order], bias
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.features & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of x are features of the model, which feature each of those is)"""
        if not len(self.features):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        maybe = np.flatnonzero(self.sieve[(x & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.features, x[maybe]), len(self.features) - 1)
        ok = self.features[at] == x[maybe]
        return maybe[ok], at[ok]

    def bags(self, texts: list[bytes]):
        """(distinct (sentence, feature) pairs, document of each sentence, which sentences are in the bag)

        A run of marks isn't a sentence: those without words stay out, but for one in a document that has no others.
        """
        pairs, docs, worded, done = [], [], [], 0
        for i, j in _slices(texts):
            x, sentence, doc = sentence_features(texts[i:j])
            for kind in range(x.shape[1]):
                which, feature = self.places(x[:, kind])
                pairs.append(np.stack([sentence[which] + done, feature], 1))
            docs.append(doc + i)
            counts = np.zeros(len(doc), bool)
            counts[sentence] = True
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            counts[first[np.add.reduceat(counts, first, dtype=np.int64) == 0]] = True
            worded.append(counts)
            done += len(doc)
        if not docs:
            return np.empty((0, 2), np.int64), np.empty(0, np.int64), np.empty(0, bool)
        return np.unique(np.concatenate(pairs), axis=0), np.concatenate(docs), np.concatenate(worded)

    def sentences(self, pairs: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(pairs[:, 0], self.weights[pairs[:, 1]], n) if len(pairs) else np.full(n, self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, texts: list[bytes]):
        """(score of each text, its worst sentence from 0, that one's score, sentences)"""
        pairs, doc, worded = self.bags(texts)
        p = self.sentences(pairs, len(doc)) * worded
        first = np.searchsorted(doc, np.arange(len(texts)))
        count = np.bincount(doc, minlength=len(texts))
        score = 1 - np.exp(np.add.reduceat(np.log1p(-p), first)) if len(p) else np.zeros(len(texts))
        top = np.maximum.reduceat(p, first) if len(p) else np.zeros(len(texts))
        worst = np.zeros(len(texts), np.int64)
        hits = np.flatnonzero(p == top[doc])[::-1]
        worst[doc[hits]] = hits - first[doc[hits]]
        return np.clip(score, 0, 1), worst, top, count


@dataclass
class Bags:
    """Some documents as the learner sees them: which chosen features stand in which of their sentences.

    A sentence without any counts by number only, as all of those score alike.
    """

    toxic: np.ndarray
    weight: np.ndarray
    bare: np.ndarray  # of each document the sentences without a chosen feature
    doc: np.ndarray  # of each other sentence its document
    pairs: np.ndarray  # (sentence, feature)

    @classmethod
    def of(cls, rows: list[tuple[bytes, int, bool, float]]) -> Bags:
        """rows: packed pairs of one document, its number of sentences, its label and weight."""
        pairs, doc, bare, done = [], [], [], 0
        for d, (packed, n, _, _) in enumerate(rows):
            x = np.frombuffer(packed, np.int64).reshape(-1, 2)
            filled, sentence = np.unique(x[:, 0], return_inverse=True)
            pairs.append(np.stack([sentence + done, x[:, 1]], 1))
            doc.append(np.full(len(filled), d))
            bare.append(n - len(filled))
            done += len(filled)
        none = np.empty((0, 2), np.int64)
        return cls(np.array([r[2] for r in rows], bool), np.array([r[3] for r in rows], float), np.array(bare, float), np.concatenate([none[:, 0], *doc]).astype(np.int64), np.concatenate([none, *pairs]).astype(np.int64))

    def gradient(self, w: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray]:
        """(log-likelihood, its gradient) of feature weights w[:-1] and bias w[-1]."""
        n, k = len(self.doc), len(w) - 1
        z = np.clip(w[k] + np.bincount(self.pairs[:, 0], w[:k][self.pairs[:, 1]], n), -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-np.clip(w[k], -30, 30)))
        # The noisy-or: a document stays clean if all its sentences do.
        stays = np.minimum(np.bincount(self.doc, np.log1p(-p), len(self.bare)) + self.bare * np.log1p(-p0), -1e-9)
        likely = (scale * np.where(self.toxic, np.log(-np.expm1(stays)), stays)).sum()
        push = np.where(self.toxic, np.exp(stays) / -np.expm1(stays), -1.0) * scale
        g = push[self.doc] * p
        grad = np.empty(k + 1)
        grad[:k] = np.bincount(self.pairs[:, 1], g[self.pairs[:, 0]], k)
        grad[k] = g.sum() + (push * self.bare).sum() * p0
        return float(likely), grad


def fit(features: np.ndarray, bags: Bags) -> Model:
    """Weights of features from labelled documents; their weights make up for labels that the sample holds in other shares than the corpus."""
    if not bags.toxic.any() or bags.toxic.all():
        rate = float((bags.weight * bags.toxic).sum() / max(bags.weight.sum(), 1e-9)) if len(bags.toxic) else 0.0
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return Model(np.empty(0, np.uint64), np.empty(0), float(np.log(rate / (1 - rate))) - 3)
    k = len(features)
    w = np.full(k + 1, 2.0)
    w[k] = -6.0
    seen = np.full(k + 1, 1e-8)
    scale = bags.weight / bags.weight.sum()
    for _ in range(STEPS):
        _, grad = bags.gradient(w, scale)
        grad[:k] -= DECAY * scale.min() * w[:k]
        seen += grad * grad
        w = w + RATE * grad / np.sqrt(seen)
    return Model(features, w[:k], float(w[k]))


def _chosen(sampled: DataFrame, n_bad: int, n_good: int) -> np.ndarray:
    """Features that toxic documents have more often than chance allows, MOST at most, counted by the tasks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, toxic = bytes_of(batch["text"]), batch["toxic"].to_numpy() == 1
            for i, j in _slices(texts):
                x, sentence, doc = sentence_features(texts[i:j])
                if len(x):
                    owner = np.repeat(doc[sentence], x.shape[1])
                    pairs = np.unique(np.stack([x.ravel(), owner.astype(np.uint64)], 1), axis=0)
                    keys, at = np.unique(pairs[:, 0], return_inverse=True)
                    bad = toxic[i:j][pairs[:, 1].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at[bad], minlength=len(keys))), pa.array(np.bincount(at[~bad], minlength=len(keys)))], ["key", "a", "c"])

    def likely(k, n: int, x):
        x = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), x))
        return k * F.log(x) + (n - k) * F.log1p(-x)

    a, c = F.col("a"), F.col("c")
    p, q, r = a / n_bad, c / n_good, (a + c) / (n_bad + n_good)
    ratio = 2 * (likely(a, n_bad, p) + likely(c, n_good, q) - likely(a, n_bad, r) - likely(c, n_good, r))
    each = sampled.select("text", "toxic").mapInArrow(counted, "key long, a long, c long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("c").alias("c")).filter(a >= LEAST_DOCS)
    best = each.filter((ratio >= LEAST_RATIO) & (p > 4 * q)).select("key", F.round(ratio, 6).alias("ratio")).orderBy(F.col("ratio").desc(), "key").limit(MOST)
    return np.sort(np.array([x["key"] for x in best.collect()], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most sample labelled documents of each label, in the order of a hash of their ids.

    Held-out ids, null ids and labels aren't used; an id with several labels
    counts as toxic if one of them says so, one with several texts has the
    least of them.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marks = marks.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    order = (F.xxhash64("doc_id"), "doc_id")
    some = [marks.filter(F.col("toxic") == y).orderBy(*order).limit(sample) for y in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]).withColumnRenamed("doc_id", "id"))  # 2 * sample ids at most
    text = docs.select(docs["doc_id"].cast("long").alias("id"), docs["text"].cast("string").alias("text"))
    sampled = settle(text.join(ids, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")), "sampled")
    have = {r["toxic"]: r["count"] for r in sampled.groupBy("toxic").count().collect()}
    share = {y: total.get(y, 0) / max(1, have.get(y, 0)) for y in (0, 1)}
    features = _chosen(sampled, have[1], have[0]) if len(have) == 2 else np.empty(0, np.uint64)
    known = sampled.sparkSession.sparkContext.broadcast(Model(features, np.zeros(len(features)), 0.0))

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            pairs, doc, worded = known.value.bags(bytes_of(batch["text"]))
            count, bag = (np.bincount(d, minlength=batch.num_rows) for d in (doc, doc[worded]))
            first = np.cumsum(count) - count
            edge = np.searchsorted(pairs[:, 0], np.append(first, len(doc)))
            packed = [(pairs[i:j] - np.array([f, 0])).tobytes() for f, i, j in zip(first.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["toxic"], pa.array(bag, pa.int64()), pa.array(packed, pa.binary())], ["id", "toxic", "n", "pairs"])

    rows = sorted(sampled.select("id", "toxic", "text").mapInArrow(bagged, "id long, toxic int, n long, pairs binary").collect(), key=lambda r: r["id"])
    drop_settled(sampled)
    return fit(features, Bags.of([(bytes(r["pairs"]), r["n"], r["toxic"] == 1, share[r["toxic"]]) for r in rows]))


OUT = (("score", S.DoubleType(), pa.float64()), ("predicted", S.IntegerType(), pa.int32()), ("worst_sentence", S.LongType(), pa.int64()), ("worst_score", S.DoubleType(), pa.float64()), ("n_sentences", S.LongType(), pa.int64()))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with the toxicity of each whole text.

    Adds score (0 to 1), predicted (1 from 0.5 on), worst_sentence (number of
    the sentence with the highest score, from 0, the first of equals),
    worst_score and n_sentences; columns of docs with these names are replaced.
    Nothing but the text enters a score.

    A null or empty text is one sentence without words and gets the score of
    that; in other texts sentences without words don't count for the score. Without toxic or without clean labels all sentences score alike,
    by the share of toxic labels. Repeated rows score alike.
    """
    prepare_workers(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # MOST weights at most
    names = [c for c in docs.columns if c not in {n for n, *_ in OUT}]
    docs = docs.select(*[docs[c] for c in names])
    schema = S.StructType(list(docs.schema.fields) + [S.StructField(n, t) for n, t, _ in OUT])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            score, worst, top, count = model.value.score(bytes_of(batch["text"]))
            more = (score, (score >= 0.5).astype(np.int32), worst, top, count)
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(x, t) for x, (_, _, t) in zip(more, OUT, strict=True)], batch.schema.names + [n for n, *_ in OUT])

    return docs.mapInArrow(scored, schema)
