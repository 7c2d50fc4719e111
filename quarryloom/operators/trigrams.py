"""Keyword search through a table of trigrams.

Every file is listed under each run of three printable ASCII characters, in
lower case, that its text has: files have places in blocks of about BLOCK bytes
of text, and a row holds the places of all files of a block that have a
trigram. What a regular expression can't match without is
read off its own syntax tree; files that have it are opened and searched as
ever, so the result is that of a search through all files.
"""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Iterable, Iterator
from functools import reduce
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.operators import search
from quarryloom.operators.versioned import BUCKETS, FOLDERS, Spec, VersionedTables
from quarryloom.scratch import drop_settled, settle

KEYS = ("repo_root", "path")
#: Bytes of text in a block, but for a longer text alone, its files at most, and the bytes that are taken apart at once.
BLOCK, FILES, WINDOW = 8 << 20, 32_000, 1 << 20
LISTED = "trigram string, block bigint, places array<smallint>, repo_root string, path string, place smallint"
#: What this and the JVM's expressions read differently: intersections of classes and octal numbers.
READ_OTHERWISE = re.compile(r"&&|\\0")
REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT)

#: A trigram, or ("all" or "any", parts); ("all", ()) holds for every text.
Needed = str | tuple[str, tuple]
ANYTHING: Needed = ("all", ())


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of (repo_root, path, text), text in lower case, those of both tables: a block's postings, its places under the empty trigram too, and its files."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch["text"]).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right"))), at + FILES, batch.num_rows)
            yield from _block(batch.slice(at, to - at))
            at = to


def _block(files: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n, block = files.num_rows, uuid.uuid4().int >> 65
    places = pa.array(np.arange(n), pa.int16())
    keys = trigrams_of(files["text"])  # trigram * n + place, rising
    code, place = keys // n, keys % n
    edge = np.flatnonzero(np.diff(code, prepend=-1))
    chars = (np.stack((code[edge] // 9025, code[edge] // 95 % 95, code[edge] % 95), 1) + 32).astype(np.uint8)
    names = pa.StringArray.from_buffers(len(edge), pa.py_buffer(np.arange(0, 3 * len(edge) + 1, 3, np.int32)), pa.py_buffer(np.ascontiguousarray(chars)))
    of_all = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), places)
    lists = pa.concat_arrays([of_all, pa.ListArray.from_arrays(pa.array(np.append(edge, len(keys)), pa.int32()), pa.array(place, pa.int16()))])
    columns = ["trigram", "block", "places", "repo_root", "path", "place"]
    m = len(lists)
    yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([""]), names]), pa.array(np.full(m, block)), lists, pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.int16())], columns)
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.array(np.full(n, block)), pa.nulls(n, lists.type), files["repo_root"].cast(pa.string()), files["path"].cast(pa.string()), places], columns)


def trigrams_of(texts: pa.StringArray) -> np.ndarray:
    """Each distinct trigram of each of n texts in lower case, as its number * n + the text's place, in order."""
    n = len(texts)
    wide = texts.cast(pa.large_binary())
    start = np.frombuffer(wide.buffers()[1], np.int64, n + 1, 8 * wide.offset)
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[start[0] : start[-1]]
    last = start[1:] - start[0]
    found = [np.empty(0, np.int64)]
    for at in range(0, len(data), WINDOW):
        part = data[at : at + WINDOW + 2].astype(np.int64) - 32
        good = (part >= 0) & (part < 95)
        i = np.flatnonzero(good[:-2] & good[1:-1] & good[2:])
        of = np.searchsorted(last, at + i, "right")
        within = at + i + 3 <= last[of]
        i, of = i[within], of[within]
        found.append(np.unique(((part[i] * 95 + part[i + 1]) * 95 + part[i + 2]) * n + of))
    return np.unique(np.concatenate(found))


def _both(parts: Iterable[Needed]) -> Needed:
    flat = [p for x in parts for p in (x[1] if isinstance(x, tuple) and x[0] == "all" else (x,))]
    flat = list(dict.fromkeys(flat))
    return flat[0] if len(flat) == 1 else ("all", tuple(flat))


def _either(parts: list[Needed]) -> Needed:
    some = tuple(dict.fromkeys(parts))
    return ANYTHING if ANYTHING in some else some[0] if len(some) == 1 else ("any", some)


def _flat(items) -> Iterable[tuple]:
    for op, arg in items:
        if op is C.SUBPATTERN:
            yield from _flat(arg[-1])
        else:
            yield op, arg


def _sequence(items) -> Needed:
    out: list[Needed] = []
    run = ""

    def end() -> None:
        nonlocal run
        out.extend(run[i : i + 3] for i in range(len(run) - 2))
        run = ""

    for op, arg in _flat(items):
        if op is C.LITERAL and 0x20 <= arg < 0x7F:
            run += chr(arg).lower()
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue  # no width: what stands before and after is adjacent
        else:
            end()
            if op is C.BRANCH:
                out.append(_either([_sequence(x) for x in arg[1]]))
            elif op in REPEATS and arg[0] >= 1:
                out.append(_sequence(arg[2]))
            elif op is C.ATOMIC_GROUP:
                out.append(_sequence(arg))
    end()
    return _both(out)


def needed(pattern: str) -> Needed:
    """The trigrams that a line has to have for pattern to match. Of an expression that can't be read here with certainty, none."""
    if READ_OTHERWISE.search(pattern):
        return ANYTHING
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # sets within sets
            return _sequence(_parser.parse(pattern))
    except (re.error, Warning, OverflowError, RecursionError):
        return ANYTHING


def leaves(tree: Needed) -> list[str]:
    return [tree] if isinstance(tree, str) else list(dict.fromkeys(t for p in tree[1] for t in leaves(p)))


def holds(tree: Needed, has) -> Column:
    """tree as a condition; has makes one of a trigram."""
    if isinstance(tree, str):
        return has(tree)
    parts = [holds(p, has) for p in tree[1]]
    return reduce((lambda a, b: a & b) if tree[0] == "all" else (lambda a, b: a | b), parts) if parts else F.lit(True)


class TrigramIndex:
    """The places of each trigram, sorted by trigram in each bucket of blocks, so that a search reads the row groups of a few trigrams."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        postings, texts = Spec("trigram string, block bigint, places array<smallint>", ("block",), ("trigram",)), Spec("repo_root string, path string, block bigint, place smallint", KEYS)
        self.tables = VersionedTables(spark, path, {"postings": postings, "texts": texts}, buckets)

    def put(self, files: DataFrame, gone: DataFrame | None = None) -> int:
        """Lists files (repo_root, path, text) and leaves out those of gone, which also has to name files that are listed with another text. Files without text aren't listed.
        Places of files that went stay in the postings until compact(); they lead to no file."""
        own = files.filter(F.col("text").isNotNull()).select(*KEYS, F.lower("text").alias("text"))
        both = settle(own.mapInArrow(listed, LISTED), "listed")
        change = self.tables.begin()
        change.replace("postings", both.filter("trigram IS NOT NULL"))
        change.replace("texts", both.filter("trigram IS NULL"))
        if gone is not None:
            change.forget(("texts",), gone)
        out = change.commit()
        drop_settled(both)
        return out

    def compact(self, most: int = FOLDERS) -> dict[str, int]:
        """Rewrites the postings of blocks with files that have gone, without these, and buckets of more than so many folders."""
        change = self.tables.begin("compact")
        postings = change.read("postings")
        live = change.read("texts").groupBy("block").agg(F.collect_list("place").alias("live"))  # FILES at most
        stale = postings.filter("trigram = ''").join(live, "block", "left").filter(F.size("places") > F.coalesce(F.size("live"), F.lit(0)))
        stale = settle(stale.select("block", F.coalesce("live", F.array().cast("array<smallint>")).alias("live")), "stale")
        if not stale.isEmpty():
            kept = postings.join(stale, "block").withColumn("places", F.array_intersect("places", "live")).filter(F.size("places") > 0)
            change.replace("postings", kept, stale)
            change.commit()
        drop_settled(stale)
        return self.tables.compact(most)

    def candidates(self, pattern: str) -> DataFrame:
        """(repo_root, path) of the files that may have a line for pattern."""
        tree, version = needed(pattern), self.tables.version()
        some = leaves(tree)
        texts = self.tables.read("texts", version)
        if not some:
            return texts.select(*KEYS)
        rows = self.tables.read("postings", version).filter(F.col("trigram").isin(*some)).select("trigram", "block", F.explode("places").alias("place"))
        if tree != some[0]:
            # A row for each file: which of the trigrams it has, as one array of as many entries at most.
            have = rows.groupBy("block", "place").agg(F.collect_set("trigram").alias("have"))
            rows = have.filter(holds(tree, lambda t: F.array_contains("have", t)))
        return texts.join(rows, ["block", "place"], "left_semi").select(*KEYS)

    def opened(self, files: DataFrame, pattern: str) -> DataFrame:
        """The rows of files that have to be searched."""
        return files.join(self.candidates(pattern), list(KEYS), "left_semi")

    def keyword_search(self, files: DataFrame, pattern: str, top_k: int = 20, **options) -> DataFrame:
        """search.keyword_search, with only the candidates' texts taken apart."""
        return search.keyword_search(self.opened(files, pattern), pattern, top_k, **options)

    def matching_lines(self, files: DataFrame, pattern: str) -> DataFrame:
        return search.matching_lines(self.opened(files, pattern), pattern)
