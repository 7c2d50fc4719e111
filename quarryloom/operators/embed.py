"""Texts into vectors, by built-in expressions or by a model server."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from quarryloom.functions import lookups as L
from quarryloom.functions import text as X
from quarryloom.scratch import drop_settled, settle

#: Texts that are embedded between two commits of their vectors.
SLICE = 1_000_000
WORDS = r"[^\p{L}\p{N}]+"
#: Bytes of text, and texts, whose words are counted at once.
WINDOW, TEXTS = 8 << 20, 8_192
#: ASCII letters in lower case; digits and the bytes of other letters stay as they are, all else becomes a space.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _as_bytes(content: Column) -> Column:
    """The text as bytes in which its words, in lower case, stand between spaces once _PLAIN has been put on them: ASCII as it is, of other texts the words that the JVM's expressions see."""
    ascii_only = (F.octet_length(content) == F.char_length(content)) & F.is_valid_utf8(content)
    return F.coalesce(F.when(ascii_only, content).otherwise(F.regexp_replace(F.lower(content), WORDS, " ")), F.lit("")).cast("binary")


def _places(texts: pa.Array, dimensions: int) -> np.ndarray:
    """For n texts as _as_bytes() gives them n rows of dimensions: how many words fall on each place, the first 8 hex digits of a word's MD5 modulo dimensions. A word is hashed once, however often it is there."""
    n, wide = len(texts), texts.cast(pa.large_binary())
    start = np.frombuffer(wide.buffers()[1], np.int64, n + 1, 8 * wide.offset)
    plain = bytes(memoryview(wide.buffers()[2] or b"")[start[0] : start[-1]]).translate(_PLAIN)
    words = pa.compute.split_pattern(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(start - start[0]), pa.py_buffer(plain)]), " ")
    each = words.values.dictionary_encode()
    known = each.dictionary.to_pylist()
    place = np.frombuffer(b"".join([hashlib.md5(w).digest() for w in known]), ">u4")[::4].astype(np.int64) % dimensions
    place[[i for i, w in enumerate(known) if not w]] = dimensions  # between two spaces
    of = np.repeat(np.arange(n), np.diff(words.offsets.to_numpy()))
    return np.bincount(of * (dimensions + 1) + place[each.indices.to_numpy()], minlength=n * (dimensions + 1)).reshape(n, -1)[:, :dimensions]


def _counted(dimensions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of (id, text in bytes) rows of (id, counts), about WINDOW bytes at a time."""
    for batch in batches:
        ends = np.cumsum(pa.compute.binary_length(batch[1]).to_numpy().astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(at + 1, int(np.searchsorted(ends, before + WINDOW, "right"))), at + TEXTS, batch.num_rows)
            counts = _places(batch[1].slice(at, to - at), dimensions)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, dimensions), pa.int32()), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([batch[0].slice(at, to - at), lists], [batch.schema.names[0], "counts"])
            at = to


def _all_counts(docs: DataFrame, id_column: str, content: str, dimensions: int) -> DataFrame:
    """(id, counts): a row for each id, a number for each place. What leaves the tasks that split texts into words are these numbers, not words."""
    shape = StructType([docs.schema[id_column]]).add("counts", ArrayType(LongType()))
    each = docs.select(id_column, _as_bytes(F.col(content)).alias("text")).mapInArrow(partial(_counted, dimensions), shape)
    summed = each.groupBy(id_column).agg(*[F.sum(F.col("counts")[i]).alias(f"_{i}") for i in range(dimensions)])
    return summed.select(id_column, F.array(*[f"_{i}" for i in range(dimensions)]).alias("counts"))


def hash_counts(docs: DataFrame, id_column: str, content: str, dimensions: int) -> DataFrame:
    """(id, bucket, n): how many words of each text fall on each place; a text without words has no rows."""
    return _all_counts(docs, id_column, content, dimensions).select(id_column, F.posexplode("counts").alias("bucket", "n")).filter("n > 0")


def hash_embed(docs: DataFrame, id_column: str, content: str, dimensions: int = 64) -> DataFrame:
    """(id, embedding): hashed bags of words of unit length, zero vectors for texts without words."""
    norm = F.sqrt(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n * n))
    rows = _all_counts(docs, id_column, content, dimensions).withColumn("norm", norm)
    # Named twice, so that the planner keeps it once for a row instead of working it out for each place.
    unit = F.transform("counts", lambda n: F.when(F.col("norm") > 0, n / F.col("norm")).otherwise(0.0).cast("float"))
    return rows.select(id_column, unit.alias("embedding"))


def hash_embed_text(text: str, dimensions: int = 64) -> list[float]:
    """The same for one text on the driver: a query."""
    out = [0.0] * dimensions
    for w in re.split(r"[\W_]+", text.lower()):
        if w:
            out[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dimensions] += 1
    norm = sum(x * x for x in out) ** 0.5 or 1.0
    return [x / norm for x in out]


def length_embedding(content: Column, dimensions: int) -> Column:
    """A stand-in for tests: place j holds (bytes + j) / dimensions."""
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda j: ((F.octet_length(content) + j) / float(dimensions)).cast("float"))


def rolling_embedding(content: Column, dimensions: int) -> Column:
    """A stand-in for tests: ((h + j) mod 1000) / 1000, h the 31-multiplier hash of the characters, in 32 bits."""
    chars = F.filter(F.split(content, ""), lambda c: c != "")
    wrap = lambda x: F.pmod(x + 2147483648, F.lit(4294967296)) - 2147483648
    h = F.aggregate(chars, F.lit(0).cast("long"), lambda a, c: wrap(a * 31 + F.ascii(c)))
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda j: (F.pmod(h + j, F.lit(1000)) / 1000.0).cast("float"))


@dataclass(frozen=True)
class Embedder:
    """Gives a table (id, content) its embeddings; name and dimensions say whose they are."""

    name: str
    dimensions: int
    embed: Callable[[DataFrame, str, str], DataFrame]
    embed_text: Callable[[str], list[float]] | None = None
    #: Asks whoever makes the vectors whether that works now; None if there is nobody to ask.
    probe: Callable[[], bool] | None = None
    #: Like embed, with a column error: of a text without a vector why it has none. For those that call a server.
    attempt: Callable[[DataFrame, str, str], DataFrame] | None = None

    def available(self) -> bool:
        if self.name == "off":
            return False
        try:
            return self.probe is None or self.probe()
        except Exception:
            return False


def hashing_embedder(dimensions: int = 64) -> Embedder:
    return Embedder(f"hash:{dimensions}", dimensions, lambda df, i, c: hash_embed(df, i, c, dimensions), lambda t: hash_embed_text(t, dimensions))


def no_embedder() -> Embedder:
    return Embedder("off", 0, lambda df, i, c: df.limit(0).select(i, F.array().cast("array<float>").alias("embedding")))


def _post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.loads(r.read())


def one_by_one(url: str, model: str, timeout: float = 60) -> Callable[[list[str]], list[list[float]]]:
    """A server that takes one prompt at a time and answers {"embedding": [...]}"""
    return lambda texts: [_post(url.rstrip("/") + "/api/embeddings", {"model": model, "prompt": t}, None, timeout)["embedding"] for t in texts]


def in_batches(url: str, model: str, key: str | None = None, timeout: float = 60) -> Callable[[list[str]], list[list[float]]]:
    """A server that takes a list and answers {"data": [{"index", "embedding"}]} in any order, as many as were asked for."""

    def call(texts: list[str]) -> list[list[float]]:
        data = _post(url.rstrip("/") + "/v1/embeddings", {"model": model, "input": texts}, key, timeout)["data"]
        if len(data) != len(texts):
            raise ValueError(f"asked for {len(texts)} embeddings, got {len(data)}")
        return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

    return call


class EmbeddingFailed(RuntimeError):
    """Calls failed for good. The vectors of all others have been kept."""


NOT_ASKED = "not asked after a failure"


def http_embedder(
    name: str, model: str, call: Callable[[list[str]], list[list[float]]], batch: int = 32, on_error: str = "raise", dimensions: int | None = None, tries: int = 3, wait: float = 0.5, in_flight: int = 1, most_calls: int | None = None,
) -> Embedder:
    """Calls a model server from the tasks, batch texts at a time, in_flight calls of a task at once.

    A call that fails is made again, up to tries in all, after wait seconds and
    twice as long each time; on_error "skip" then leaves its texts out. With
    most_calls the texts are dealt to so few tasks that no more calls than that are under way at any time
    (a task that Spark runs twice at once counts twice).
    """
    size = dimensions or L.MODEL_DIMENSIONS.get(model.removesuffix(":latest"), L.DEFAULT_DIMENSIONS)
    window = min(in_flight, most_calls or in_flight)
    if window < 1 or tries < 1:
        raise ValueError("in_flight, most_calls and tries have to be positive")

    def again(texts: list[str]) -> list[list[float]]:
        for n in range(tries):
            try:
                return call(texts)
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)
        raise AssertionError

    def attempt(df: DataFrame, id_column: str, content: str) -> DataFrame:
        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            failed = False

            def answer(future: Future, ids: pd.Series) -> pd.DataFrame:
                nonlocal failed
                try:
                    return pd.DataFrame({id_column: ids.to_numpy(), "embedding": future.result(), "error": None})
                except Exception as e:
                    failed = True
                    return refused(ids, f"{type(e).__name__}: {e}")

            def refused(ids: pd.Series, why: str) -> pd.DataFrame:
                return pd.DataFrame({id_column: ids.to_numpy(), "embedding": [None] * len(ids), "error": why})

            with ThreadPoolExecutor(window) as pool:
                for part, ended in _windowed(pool, window, again, _parts(frames, content, batch), lambda: failed and on_error == "raise"):
                    yield refused(part[id_column], NOT_ASKED) if ended is None else answer(ended, part[id_column])

        kind = dict(df.dtypes)[id_column]
        rows = df.select(id_column, content)
        if most_calls:
            rows = rows.repartition(most_calls // window)
        out = rows.mapInPandas(ask, f"{id_column} {kind}, embedding array<float>, error string")
        return out.filter("error is null") if on_error == "skip" else out

    def embed(df: DataFrame, id_column: str, content: str) -> DataFrame:
        rows = attempt(df, id_column, content)
        if on_error == "skip":
            return rows.drop("error")
        good = F.when(F.col("error").isNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("embedding failed: "), "error")).cast("array<float>"))
        return rows.select(id_column, good.alias("embedding"))

    return Embedder(f"{name}:{model}", size, embed, lambda t: again([t])[0], lambda: len(call(["probe"])[0]) == size, attempt)


def _parts(frames: Iterator[pd.DataFrame], content: str, batch: int) -> Iterator[tuple[pd.DataFrame, list[str]]]:
    for pdf in frames:
        for i in range(0, len(pdf), batch):
            part = pdf.iloc[i : i + batch]
            yield part, part[content].fillna("").tolist()


def _windowed(pool: ThreadPoolExecutor, window: int, call: Callable, parts: Iterator[tuple[pd.DataFrame, list[str]]], stop: Callable[[], bool]) -> Iterator[tuple[pd.DataFrame, Future | None]]:
    """Parts with their calls as these end, window under way at most; once stop() holds, parts that haven't begun come without one."""
    running: dict[Future, pd.DataFrame] = {}

    def ended() -> Iterator[tuple[pd.DataFrame, Future]]:
        for f in wait(running, return_when=FIRST_COMPLETED).done:
            yield running.pop(f), f

    for part, texts in parts:
        if len(running) >= window:
            yield from ended()
        if stop():
            yield part, None
        else:
            running[pool.submit(call, texts)] = part
    while running:
        yield from ended()


def embedder(kind: str = "hashing", **options) -> Embedder:
    """By name: hashing, off, single (one prompt a call) or batch."""
    if kind == "hashing":
        return hashing_embedder(**options)
    if kind == "off":
        return no_embedder()
    url, model = options.pop("url"), options.pop("model")
    if kind == "single":
        return http_embedder("single", model, one_by_one(url, model), **options)
    if kind == "batch":
        return http_embedder("batch", model, in_batches(url, model, options.pop("key", None)), **options)
    raise ValueError(f"no such embedder: {kind}")


def split_by_cache(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks whose hash is in the cache, one chunk for each hash that isn't)"""
    hashes = cache.select("content_hash")
    missing = chunks.join(hashes, "content_hash", "left_anti").groupBy("content_hash").agg(F.min("content").alias("content"))
    return chunks.join(hashes, "content_hash", "left_semi"), missing


def embed_with_cache(chunks: DataFrame, cache: DataFrame, by: Embedder, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(new cache rows, locations of all chunks). chunks have repo_root, path, lines, content, content_hash, node_type, node_name, language."""
    now = F.current_timestamp() if now is None else now
    _, missing = split_by_cache(chunks, cache)
    new = cache_rows(by.embed(missing, "content_hash", "content"), by, now)
    locations = chunks.select("repo_root", "path", "start_line", "end_line", "content_hash", *[X.null_if_empty(c).alias(c) for c in ("node_type", "node_name", "language")], now.alias("created_at"))
    return new, locations


def slices_of(rows: DataFrame, key: str, most: int) -> list[Column]:
    """Conditions that deal rows to parts of about so many by a hash of key, one part after the other."""
    n = max(1, -(-rows.count() // most))
    return [F.pmod(F.xxhash64(key, F.lit(n)), F.lit(n)) == i for i in range(n)]


def embed_in_slices(missing: DataFrame, by: Embedder, keep: Callable[[DataFrame], int], most: int = SLICE, name: str = "slice") -> int:
    """Embeds missing (content_hash, content) slice by slice; keep() puts each slice's (content_hash, embedding) where the next run finds them.

    A call that fails for good ends its task's calls, but the vectors that the
    slice has by then are kept before EmbeddingFailed is raised, so a run that begins again without the
    hashes that were kept asks for none of them twice. What a lost driver loses is one slice. Returns
    how many were embedded.
    """
    todo, done = settle(missing.select("content_hash", "content"), "missing"), 0
    ask = by.attempt or (lambda df, i, c: by.embed(df, i, c).withColumn("error", F.lit(None).cast("string")))
    for part in slices_of(todo, "content_hash", most):
        got = settle(ask(todo.filter(part), "content_hash", "content"), name)  # once: what was asked isn't asked again by a second pass
        good = got.filter("error is null")
        done += keep(good.drop("error"))
        bad = got.filter("error is not null").agg(F.count("*").alias("n"), F.min(F.when(F.col("error") != NOT_ASKED, F.col("error"))).alias("why")).first()
        drop_settled(got)
        if bad["n"]:
            drop_settled(todo)
            raise EmbeddingFailed(f"{bad['n']} texts have no vector: {bad['why']}")
    drop_settled(todo)
    return done


def cache_rows(vectors: DataFrame, by: Embedder, now: Column | None = None) -> DataFrame:
    """Vectors (content_hash, embedding) as new rows of the cache."""
    now = F.current_timestamp() if now is None else now
    return vectors.select("content_hash", "embedding", now.alias("created_at"), F.lit(1).cast("long").alias("access_count"), now.alias("last_accessed"), F.lit(by.name).alias("model"), F.lit(by.dimensions).alias("dimensions"))


def embed_statistics(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: chunks, distinct hashes, hits by hash and by chunk, hashes to embed, hit rate of chunks (0 without any)."""
    known = cache.select("content_hash").distinct().withColumn("hit", F.lit(1))
    each = chunks.groupBy("content_hash").agg(F.count("*").alias("n")).join(known, "content_hash", "left")
    hit = F.col("hit").isNotNull()
    out = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"), F.count("*").alias("unique_hashes"), F.count(F.when(hit, 1)).alias("hit_hashes"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("hit_chunks"))
    return out.withColumn("to_embed", F.col("unique_hashes") - F.col("hit_hashes")).withColumn("hit_rate", F.coalesce(F.try_divide("hit_chunks", "total_chunks"), F.lit(0.0)))
