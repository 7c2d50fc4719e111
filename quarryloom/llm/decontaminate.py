"""Benchmark decontamination by winnowing.

For every run of ``window`` words one k-gram hash is kept, the least of the
run: its fingerprint. A document and a benchmark item that share such a run
share its fingerprint, so joining the fingerprints of both sides finds every
shared run; each hit is then extended to the whole window and compared word
by word. Items shorter than a window have one fingerprint, of the whole item.

Documents are scanned once, whatever the benchmark's size, which is measured
first. The windows of a small benchmark go to the tasks as a broadcast. Of a
larger one only a sieve of fixed size goes there; what passes it is joined
with the table of the benchmark's windows, once for each window and text, by
128-bit values.

Items that have a window in common stand behind it as one set, and documents
that meet the same sets share one digest, so a window of many items isn't
multiplied by its occurrences.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quarryloom.llm import textnum as T
from quarryloom.llm.exchange import bytes_of, pieces
from quarryloom.llm.storage import prepare_workers, settle

#: A benchmark of more bytes of text than this isn't broadcast.
BROADCAST_BYTES = 16 << 20
#: Bits of the sieve that a larger one gets.
SIEVE_BITS = 1 << 27

FOUND = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Words as a pattern over texts that aren't lower-cased.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Windows:
    """Where windows begin in some texts, by length: (starts, fingerprint of each start)."""

    def __init__(self, h: np.ndarray, off: np.ndarray, window: int, sizes: tuple = ()):
        """sizes: the shorter lengths to look for everywhere; None for a text's own length if that is shorter."""
        self.gram = max(1, window // 2)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        g = T.grams(h, self.gram)
        at = T.winnow(g, window - self.gram + 1)
        full = np.flatnonzero(T.within(off, window, len(at)))
        if len(full):
            self.by_size[window] = full, g[at[full]]
        if sizes is None:
            long = np.diff(off)
            for n in np.unique(long[(long > 0) & (long < window)]).tolist():
                starts = off[:-1][long == n]
                self.by_size[n] = starts, T.grams_at(h, starts, n)
        for n in sizes or ():
            starts = np.flatnonzero(T.within(off, n, max(0, len(h) - n + 1)))
            if len(starts):
                self.by_size[n] = starts, T.grams_at(h, starts, n)


class Fingerprints:
    """The windows of benchmark items, by the fingerprint that finds them."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.h, off = T.hash_words([t for _, t in items], T.ALNUM)
        self.names = sorted({n for n, _ in items})
        number = {n: i for i, n in enumerate(self.names)}
        owner = np.array([number[n] for n, _ in items], np.int64)[T.text_of(off)]
        self.sets: list[np.ndarray] = []  # sets of several items; a set of one has the item's number
        #: By window length: sorted fingerprints, then sorted hashes of windows with a place in self.h and the set of each.
        self.windows = {n: self._table(starts, prints, owner[starts], n) for n, (starts, prints) in Windows(self.h, off, window, None).by_size.items()}

    def _table(self, starts: np.ndarray, prints: np.ndarray, items: np.ndarray, n: int):
        low, high = T.grams_at(self.h, starts, n), T.grams_at(self.h, starts, n, salt=1)
        order = np.lexsort((items, high, low))
        low, high, starts, items = low[order], high[order], starts[order], items[order]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        first = np.flatnonzero(new)
        sets = items[first].copy()
        last = np.append(first[1:], len(low))
        for w in np.flatnonzero(items[last - 1] != items[first]).tolist():
            self.sets.append(np.unique(items[first[w] : last[w]]))
            sets[w] = len(self.names) + len(self.sets) - 1
        return np.unique(prints), low[first], starts[first], sets

    def hits(self, h: np.ndarray, off: np.ndarray):
        """For the words of some documents: which are hit, and distinct (document, set) pairs."""
        hit = np.zeros(len(h), bool)
        found = []
        owner = T.text_of(off)
        mine = Windows(h, off, self.window, tuple(n for n in self.windows if n < self.window)).by_size
        for n, (prints, low, places, sets) in self.windows.items():
            if n not in mine:
                continue
            starts, own = mine[n]
            starts = starts[_member(prints, own)]
            if not len(starts):
                continue
            at = np.searchsorted(low, w := T.grams_at(h, starts, n))
            while len(at):  # one round unless windows agree in 64 bits of their hash
                here = np.minimum(at, len(low) - 1)
                same = (at < len(low)) & (low[here] == w)
                starts, w, at = starts[same], w[same], at[same]
                equal = np.ones(len(starts), bool)
                for j in range(n):  # the words themselves
                    equal &= h[starts + j] == self.h[places[at] + j]
                hit |= T.runs(starts[equal], n, len(h))
                found.append(np.unique(np.stack([owner[starts[equal]], sets[at[equal]]], 1), axis=0))
                starts, w, at = starts[~equal], w[~equal], at[~equal] + 1
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return hit, pairs

    @functools.cached_property
    def digest(self):
        """(number of items, digest) of the items in some sets."""

        @functools.lru_cache(maxsize=1 << 14)
        def of(sets: tuple) -> tuple[int, str]:
            items = {i for s in sets for i in ([s] if s < len(self.names) else self.sets[s - len(self.names)].tolist())}
            return len(items), _digest([self.names[i] for i in items])

        return of

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "digest"}


def _member(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_bytes: int = BROADCAST_BYTES, keep: tuple = ("doc_id",)) -> DataFrame:
    """Where documents hold windows of benchmark items.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. A
    window is that many consecutive words of an item; an item of fewer, but not
    none, is one window. A document word inside any occurrence is hit.

    Returns a row for each row of docs: the columns named in keep, n_words,
    n_hit, n_items (items with a window here), items_sha256 (of their ids,
    sorted as strings and joined by commas) and contaminated (n_hit > 0). A
    column in keep with one of these names is replaced.

    A null or empty text has no words; an item without words has no window. An
    item_id of several rows counts once, a null one as the id "null". An empty
    benchmark hits nothing. Other columns are neither read nor returned.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    keep = tuple(c for c in keep if c not in FOUND)
    kept = F.struct(*[docs[c] for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    docs = docs.select(kept.alias("kept"), docs["text"].cast("string").alias("text"))
    items = benchmark.select(F.coalesce(benchmark["item_id"].cast("string"), F.lit("null")).alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    names = [F.col("kept").getField(c).alias(c) for c in keep]
    if size <= broadcast_bytes:
        known = spark.sparkContext.broadcast(Fingerprints([(r[0], bytes(r[1])) for r in items.select("item_id", F.col("text").cast("binary")).collect()], window))
        schema = S.StructType([docs.schema["kept"], *S._parse_datatype_string(COLUMNS).fields])
        return docs.mapInArrow(_scan(known), schema).select(*names, *FOUND)

    worded = docs.filter(F.coalesce(F.col("text").rlike(_WORD), F.lit(False)))
    hits = _joined(worded.select("text"), items, window)
    none = _digest([])
    both = worded.select("kept", _row(F.col("text")).alias("row"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("n_words")).join(hits, "row", "left").select(
        "kept", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
    zero = F.lit(0).cast("long")
    empty = docs.filter(~F.coalesce(F.col("text").rlike(_WORD), F.lit(False))).select("kept", zero.alias("n_words"), zero.alias("n_hit"), zero.alias("n_items"), F.lit(none).alias("items_sha256"), F.lit(False).alias("contaminated"))
    return both.unionByName(empty).select(*names, *FOUND)


def _row(text):
    return F.unhex(F.md5(text.cast("binary")))


def _scan(known):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, none = known.value, (0, _digest([]))
        for batch in pieces(batches):
            h, off = T.hash_words(bytes_of(batch["text"]), T.ALNUM)
            hit, pairs = marks.hits(h, off)
            total = np.concatenate(([0], np.cumsum(hit)))
            n_hit = total[off[1:]] - total[off[:-1]]
            sets: dict[int, list[int]] = {}
            for d, s in pairs.tolist():
                sets.setdefault(d, []).append(s)
            said = [marks.digest(tuple(sets[d])) if d in sets else none for d in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch["kept"], pa.array(np.diff(off), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([n for n, _ in said], pa.int64()), pa.array([x for _, x in said], pa.string()), pa.array(n_hit > 0, pa.bool_())],
                ["kept", *FOUND],
            )

    return scan


def _slot(prints: np.ndarray, n: int) -> np.ndarray:
    return (T.mix(prints + np.uint64(n)) % np.uint64(SIEVE_BITS)).astype(np.int64)


def _joined(texts: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(row, n_hit, n_items, items_sha256) of each distinct text that has a window of an item, row being its MD5."""

    def benchmark_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, off = T.hash_words(bytes_of(batch["text"]), T.ALNUM)
            owner, names = T.text_of(off), batch["item_id"]
            for n, (starts, prints) in Windows(h, off, window, None).by_size.items():
                slot = _slot(prints, n)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(owner[starts])), pa.array(T.grams_at(h, starts, n).view(np.int64)), pa.array(T.grams_at(h, starts, n, salt=1).view(np.int64)), pa.array(np.full(len(starts), n, np.int32)), pa.array(slot >> 6), pa.array(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)).view(np.int64))],
                    ["item_id", "low", "high", "n", "word", "bit"],
                )

    key = ["low", "high", "n"]
    told = settle(items.mapInArrow(benchmark_windows, "item_id string, low long, high long, n int, word long, bit long"), "windows")
    sizes = tuple(sorted(r[0] for r in told.select("n").distinct().collect()))  # window lengths at most
    sieve = np.zeros(SIEVE_BITS // 64, np.uint64)
    bits = told.groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()  # SIEVE_BITS / 64 rows at most
    sieve[bits["word"].to_numpy()] = bits["bit"].to_numpy().view(np.uint64)
    known = texts.sparkSession.sparkContext.broadcast(sieve)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = known.value
        for batch in pieces(batches):
            raw = bytes_of(batch["text"])
            h, off = T.hash_words(raw, T.ALNUM)
            owner = T.text_of(off)
            row = [hashlib.md5(t).digest() for t in raw]
            for n, (starts, prints) in Windows(h, off, window, tuple(n for n in sizes if n < window)).by_size.items():
                slot = _slot(prints, n)
                some = starts[(marks[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1]
                if not len(some):
                    continue
                low, high, doc = T.grams_at(h, some, n), T.grams_at(h, some, n, salt=1), owner[some]
                order = np.lexsort((some, high, low, doc))
                low, high, doc, some = low[order], high[order], doc[order], some[order]
                new = np.ones(len(low), bool)
                new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (doc[1:] != doc[:-1])
                first = np.flatnonzero(new)
                at = (some - off[doc]).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[d] for d in doc[first].tolist()], pa.binary()), pa.array(low[first].view(np.int64)), pa.array(high[first].view(np.int64)), pa.array(np.full(len(first), n, np.int32)), pa.array([x.tobytes() for x in np.split(at, first[1:])], pa.binary())],
                    ["row", "low", "high", "n", "starts"],
                )

    asked = texts.mapInArrow(passed, "row binary, low long, high long, n int, starts binary").dropDuplicates(["row", *key])
    asked = settle(asked, "asked")
    # Each window of the documents once, so that one that is everywhere meets the benchmark as one row.
    live = told.select("item_id", *key).join(asked.select(*key).distinct(), key, "left_semi")
    sets = live.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("set", F.unhex(F.md5(F.concat_ws("\x00", "items").cast("binary"))))
    sets = settle(sets, "sets")
    found = asked.join(sets.select(*key, "set"), key).select("row", "n", "starts", "set")
    hit = settle(found.groupBy("row").applyInArrow(_together, "row binary, n_hit long, sets array<binary>"), "hit")
    combined = hit.select("sets").distinct().withColumn("set", F.explode("sets")).join(sets.dropDuplicates(["set"]).select("set", "items"), "set")
    items_of = combined.select("sets", F.explode("items").alias("item")).groupBy("sets").agg(F.collect_set("item").alias("items"))
    digest = items_of.select("sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"))
    return hit.join(digest, "sets").select("row", "n_hit", "n_items", "items_sha256")


def _together(table: pa.Table) -> pa.Table:
    """How many words of one text its windows cover, and their sets."""
    width = np.repeat(table["n"].to_numpy(), [len(x) // 4 for x in table["starts"].to_pylist()])
    starts = np.concatenate([np.frombuffer(x, np.uint32) for x in table["starts"].to_pylist()]).astype(np.int64)
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate((starts + width)[order])
    new = ends - np.maximum(starts, np.concatenate(([0], ends[:-1])))
    sets = sorted(set(table["set"].to_pylist()))
    return pa.table({"row": pa.array([table["row"][0].as_py()], pa.binary()), "n_hit": pa.array([int(np.maximum(new, 0).sum())], pa.int64()), "sets": pa.array([sets], pa.list_(pa.binary()))})
