"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every run of ``min_words`` words one k-gram is
chosen by the run's content alone, so two texts that share such a run share
its anchor at the same place of it. Documents are joined on anchors by an
exchange of their hashes; what only one document has leaves here. Around each
shared anchor the match is then extended word by word to both sides: by the
words before it and after it to each run of ``min_words`` words that chose
it, and by the 128-bit value of that run the smallest doc_id that has it is
found. Runs that a smaller document has too join up to the maximal repeats,
which are removed.

No pairs of documents are made, and no key gathers its documents: a chunk of
documents sends each run once, with its own smallest doc_id and its place
there, and gets back the places at which a smaller document elsewhere has the
run. An anchor that is everywhere has many different words around it, so its
runs are dealt out to as many buckets.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import textnum as T
from quarryloom.llm.exchange import HAS_WORDS, SENT, Shared, bytes_of, cut, dealt, gathered, ids_of, send, shared_keys
from quarryloom.llm.storage import prepare_workers

#: Cells of runs for a bucket; a row without bucket number of its own (least is null) carries what a chunk knows by itself.
_RUNS = "bucket int, chunk int, runs binary, least binary, places binary"
_GONE = "chunk int, places binary, like binary"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
TEXT = DIGEST + ", spans array<struct<start:long,end:long>>, kept string"
_NO_WORDS = hashlib.sha256(b"").hexdigest()


def _in_order(table: pa.Table) -> tuple[np.ndarray, list[bytes], pa.Table]:
    """(ids, texts, table) of a chunk in the one order that all passes over it use: by id, then by text."""
    ids, texts = ids_of(table["doc_id"]), bytes_of(table["text"])
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    return ids[order], [texts[i] for i in order], table.take(pa.array(order, pa.int64()))


def _anchors(h: np.ndarray, off: np.ndarray, gram: int, width: int):
    """(grams, starts of runs, place of the anchor that each run chose)"""
    g = T.grams(h, gram)
    at = T.winnow(g, width)
    runs = np.flatnonzero(T.within(off, gram + width - 1, len(at)))
    return g, runs, at[runs]


def _grouped(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first of each group in it) of 128-bit values; equal ones keep their order."""
    order = np.argsort(low, kind="stable")
    lo, hi = low[order], high[order]
    if np.any((lo[1:] == lo[:-1]) & (hi[1:] != hi[:-1])):
        order = np.lexsort((high, low))
        lo, hi = low[order], high[order]
    first = np.ones(len(order), bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return order, np.flatnonzero(first)


def _extended(texts: list[bytes], ids: np.ndarray, gram: int, width: int, shared: Shared | None, min_words: int):
    """The runs around the chunk's anchors that shared has: those to be asked about, and what the chunk knows itself.

    Returns (low, high, least, places) of each distinct run, with its smallest
    document and its first place there; the places at which a smaller document
    of the chunk has the run; and (place, first place) of runs that the
    smallest document has again.
    """
    h, off = T.hash_words(texts, T.PLAIN)
    g, runs, at = _anchors(h, off, gram, width)
    chosen, back = np.unique(at, return_inverse=True)
    if shared is not None:
        runs = runs[(shared.count(g[chosen]) > 1)[back]]
    low, high = T.grams(h, min_words)[runs], T.grams(h, min_words, salt=1)[runs]
    owner = ids[T.text_of(off)[runs]]
    order, first = _grouped(low, high)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    head = order[first]
    least, place = owner[head], runs[head]  # runs stand in the order of ids
    rest = np.ones(len(order), bool)
    rest[first] = False
    other, kin = order[rest], group[rest]
    later = owner[other] > least[kin]
    return (low[head], high[head], least, place), runs[other[later]], np.stack([runs[other[~later]], place[kin[~later]]], 1)


def _cells(chunk: int, found: tuple, gone: np.ndarray, like: np.ndarray, n: int) -> pa.Table:
    (low, high, least, place) = found
    rows = [(b, chunk, np.concatenate((low[i:j], high[i:j])).tobytes(), least[i:j].tobytes(), place[i:j].astype(np.uint32).tobytes()) for b, i, j in cut(low, n)]
    if len(gone) or len(like):
        rows.append((chunk % n, chunk, like.astype(np.uint32).tobytes(), None, gone.astype(np.uint32).tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(("bucket", "chunk", "runs", "least", "places"), kinds, strict=True))})


def _smallest(table: pa.Table) -> pa.Table:
    """What a bucket answers: of each cell the places whose run a smaller document has."""
    asked = table.filter(table["least"].is_valid())
    runs = [np.frombuffer(x, np.uint64) for x in asked["runs"].to_pylist()]
    low = np.concatenate([np.empty(0, np.uint64), *[r[: len(r) // 2] for r in runs]])
    high = np.concatenate([np.empty(0, np.uint64), *[r[len(r) // 2 :] for r in runs]])
    least = np.concatenate([np.empty(0, np.int64), *[np.frombuffer(x, np.int64) for x in asked["least"].to_pylist()]])
    edge = np.concatenate(([0], np.cumsum([len(r) // 2 for r in runs]))).astype(np.int64)
    order, first = _grouped(low, high)
    gone = np.zeros(len(low), bool)
    if len(low):
        known = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(order))))
        gone[order] = known < least[order]
    out = []
    for c, (chunk, places) in enumerate(zip(asked["chunk"].to_pylist(), asked["places"].to_pylist(), strict=True)):
        mine = np.frombuffer(places, np.uint32)[gone[edge[c] : edge[c + 1]]]
        if len(mine):
            out.append((chunk, mine.tobytes(), b""))
    own = table.filter(table["least"].is_null())
    out += zip(own["chunk"].to_pylist(), own["places"].to_pylist(), own["runs"].to_pylist(), strict=True)
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int32()), "places": pa.array([r[1] for r in out], pa.binary()), "like": pa.array([r[2] for r in out], pa.binary())})


def substring_dedup(docs: DataFrame, min_words: int = 13, with_text: bool = False) -> DataFrame:
    """Removes from each document the runs of at least min_words words that a document with a smaller doc_id has too.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. A word goes if it lies in a
    window of min_words consecutive words whose sequence also starts in a
    document with a smaller doc_id; windows are judged on the input.

    Returns a row for each row of docs: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words, joined by one space), and with with_text
    also spans (the maximal repeats, [start, end) in words) and kept.

    A null text counts as empty: no words, and the hash of "". A null doc_id
    counts as larger than all others. Rows with one doc_id don't remove each
    other's words; repeated rows are looked at once and returned each. A text
    of fewer than min_words words stays whole. Columns other than doc_id and
    text are neither read nor returned.
    """
    prepare_workers(docs.sparkSession)
    gram = max(1, min_words // 2)
    width = min_words - gram + 1
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows, layout = gathered(docs)
    chunks = dealt(rows, layout, "doc_id", "text")
    n = layout.parts

    def seeds(key: tuple, table: pa.Table) -> pa.Table:
        ids, texts, _ = _in_order(table)
        h, off = T.hash_words(texts, T.PLAIN)
        g, _, at = _anchors(h, off, gram, width)
        places = np.unique(at)
        keys, owner = g[places], ids[T.text_of(off)[places]]
        order = np.argsort(keys, kind="stable")  # owners stay in order
        keys, owner = keys[order], owner[order]
        own = np.ones(len(keys), bool)
        own[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        return send(key[0].as_py(), keys[own], n)

    def extend(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return _cells(0, (np.empty(0, np.uint64),) * 4, np.empty(0), np.empty((0, 2)), n)
        ids, texts, _ = _in_order(table)
        return _cells(key[0].as_py(), *_extended(texts, ids, gram, width, Shared(answers, n), min_words), n)

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        _, texts, table = _in_order(table)
        words = [t.split() for t in texts]
        off = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        begins = np.zeros(off[-1], bool)
        for x in answers["places"].to_pylist():
            begins[np.frombuffer(x, np.uint32)] = True
        for x in answers["like"].to_pylist():
            pair = np.frombuffer(x, np.uint32).reshape(-1, 2)
            begins[pair[:, 0]] |= begins[pair[:, 1]]
        gone = T.runs(np.flatnonzero(begins), min_words, len(begins))
        n_words, n_gone, digest, found, kept = [], [], [], [], []
        for d, ws in enumerate(words):
            out = gone[off[d] : off[d + 1]]
            n_words.append(len(ws))
            n_gone.append(int(out.sum()))
            left = b" ".join(compress(ws, (~out).tolist()) if n_gone[-1] else ws)
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                found.append([{"start": a, "end": b} for a, b in T.spans(out)])
                kept.append(left.decode("utf-8", "replace"))
        out = {"doc_id": table["doc_id"].cast(pa.int64()), "copies": table["copies"], "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            out |= {"spans": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string())}
        return pa.table(out)

    schema = TEXT if with_text else DIGEST
    answers = shared_keys(chunks.groupBy("chunk").applyInArrow(seeds, SENT))
    sent = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(extend, _RUNS)
    smallest = sent.groupBy("bucket").applyInArrow(_smallest, _GONE)
    done = chunks.groupBy("chunk").cogroup(smallest.groupBy("chunk")).applyInArrow(remove, schema.replace("doc_id long", "doc_id long, copies long"))
    each = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies", "copy")
    none = docs.filter(~F.coalesce(F.col("text").rlike(HAS_WORDS), F.lit(False))).select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(_NO_WORDS).alias("kept_sha256"))
    if with_text:
        none = none.select("*", F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.lit("").alias("kept"))
    return each.unionByName(none)
