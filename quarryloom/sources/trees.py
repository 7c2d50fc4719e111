"""Source trees as a Spark data source: listings by tasks, contents only of files that are wanted, and a stream of changes.

A tree is dealt to partitions by a hash of its directories' paths, so no
process lists all of it, and a directory stays with its partition from one
listing to the next.
"""

from __future__ import annotations

import contextlib
import functools
import os
import time
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from quarryloom.functions import text as X
from quarryloom.operators.merkle import not_ignored
from quarryloom.sources.files import gitignored, ignore_patterns

LISTED = "path string, mtime timestamp, size long"
EVENTS = "ts timestamp, path string, op string"
#: Tasks that list a tree, and the levels of directories by which they share it.
PARTS, DEPTH = 32, 2
ROWS = 4096
#: A batch of contents ends after so many bytes.
BYTES = 16 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"

_listed = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("size", pa.int64())])
_events = pa.schema([("ts", pa.timestamp("us", "UTC")), ("path", pa.string()), ("op", pa.string())])
Row = tuple[str, int, int]


def _open(url: str) -> tuple[arrow_fs.FileSystem, str]:
    system, base = arrow_fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else "file://" + url)
    return system, base.rstrip("/")


def _entries(system: arrow_fs.FileSystem, at: str) -> Iterator[tuple[str, bool, Callable[[], tuple[int, int] | None]]]:
    """(name, whether it is a directory, what gives a file's time in microseconds and size, None if it has gone) of a directory's entries.

    A local directory is read entry by entry, and no file is asked for its size until it is wanted. Other systems hand over a directory as a whole.
    """
    if isinstance(system, arrow_fs.LocalFileSystem):
        with contextlib.suppress(FileNotFoundError), os.scandir(at) as found:
            for e in found:
                if (directory := e.is_dir()) or e.is_file():
                    yield e.name, directory, functools.partial(_local, f"{at}/{e.name}")
        return
    for i in system.get_file_info(arrow_fs.FileSelector(at, allow_not_found=True)):
        if i.type in (arrow_fs.FileType.Directory, arrow_fs.FileType.File):
            yield i.base_name, i.type == arrow_fs.FileType.Directory, lambda i=i: (i.mtime_ns // 1000, i.size)


def _local(path: str) -> tuple[int, int] | None:
    try:
        found = os.stat(path)
    except FileNotFoundError:
        return None
    return found.st_mtime_ns // 1000, found.st_size


def walk(url: str, part: int = 0, parts: int = 1, depth: int = DEPTH, skip: Iterable[str] = (), prefixes: Iterable[str] = ("",)) -> Iterator[Row]:
    """(path below url, modification time in microseconds, size) of a part's files, in the order of their paths' parts.

    Directories named in skip aren't entered, nor those in which no path can
    begin with one of prefixes. All parts list the upper levels, each the rest of its own
    directories. What goes while it is listed is passed over.
    """
    system, base = _open(url)
    skip, prefixes = frozenset(skip), tuple(prefixes)

    def below(at: str, level: int) -> Iterator[Row]:
        # Of a directory's files this part's names alone are held: tens of thousands of others may lie beside them.
        names = []
        for name, directory, info in _entries(system, f"{base}/{at}" if at else base):
            path = f"{at}/{name}" if at else name
            mine = level > depth or zlib.crc32(path.encode("utf-8", "surrogateescape")) % parts == part
            if directory:
                inside = path + "/"
                if name not in skip and (mine or level < depth) and any(p.startswith(inside) or inside.startswith(p) for p in prefixes):
                    names.append((name, path, None))
            elif mine and path.startswith(prefixes):
                names.append((name, path, info))
        for _, path, info in sorted(names, key=lambda n: n[0]):
            if info is None:
                yield from below(path, level + 1)
            elif found := info():
                yield path, *found

    return below("", 1)


def _batches(rows: Iterable[tuple], schema: pa.Schema, most: int = ROWS) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Part(InputPartition):
    def __init__(self, part: int, start: int = 0, end: int = 0):
        self.part, self.start, self.end = part, start, end


class TreeSource(DataSource):
    """Format "tree". Options: path, parts, depth, skip (names with commas between); for a stream also state, a folder for its listings.

    A batch has (path, mtime, size), a stream (ts, path, op).
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return EVENTS if "state" in self.options else LISTED

    def _walk(self) -> dict:
        o = self.options
        return {"url": o["path"], "parts": int(o.get("parts", PARTS)), "depth": int(o.get("depth", DEPTH)), "skip": [s for s in o.get("skip", "").split(",") if s]}

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self._walk())

    def streamReader(self, schema: StructType) -> TreeStream:
        return TreeStream(self._walk(), self.options["state"])


class TreeReader(DataSourceReader):
    def __init__(self, how: dict):
        self.how, self.prefixes = how, [("",)]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on how a path begins decide which directories are entered. All are handed back: Spark tests the rows too."""
        for f in filters:
            if isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",):
                self.prefixes.append((f.value,))
            elif isinstance(f, In) and f.attribute == ("path",):
                self.prefixes.append(tuple(v for v in f.value if v is not None))
            yield f

    def partitions(self) -> list[Part]:
        return [Part(i) for i in range(self.how["parts"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        narrow = min(self.prefixes, key=lambda p: -min(map(len, p), default=1 << 30))  # the one that prunes most; the others are tested by Spark
        return _batches(walk(part=partition.part, prefixes=narrow, **self.how), _listed)


class TreeStream(DataSourceStreamReader):
    """Changes between two listings. An offset names a listing, whose parts the tasks write to the state folder: one that is there already is read
    again, so a batch that is repeated gives the same rows."""

    def __init__(self, how: dict, state: str):
        self.how, self.state = how, state.rstrip("/")

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        return {"poll": time.time_ns()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(i, start["poll"], end["poll"]) for i in range(self.how["parts"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        self._take(partition.end, partition.part)
        rows = changes(self._listing(partition.start, partition.part), self._listing(partition.end, partition.part), partition.end // 1000)
        return _batches(rows, _events)

    def commit(self, end: dict) -> None:
        """Listings older than the one that the next batch begins with go."""
        system, base = _open(self.state)
        for e in system.get_file_info(arrow_fs.FileSelector(base, allow_not_found=True)):
            if e.base_name.isdigit() and int(e.base_name) < end["poll"]:
                system.delete_dir(e.path)

    def _take(self, poll: int, part: int) -> None:
        system, base = _open(self.state)
        at = f"{base}/{poll}/{part}.arrow"
        if system.get_file_info(at).type == arrow_fs.FileType.File:
            return
        system.create_dir(f"{base}/{poll}", recursive=True)
        fresh = f"{at}.{time.time_ns()}"
        with system.open_output_stream(fresh) as out, pa.ipc.new_stream(out, _listed) as writer:
            for batch in _batches(walk(part=part, **self.how), _listed):
                writer.write_batch(batch)
        try:
            system.move(fresh, at)
        except OSError:  # another attempt of this task was first
            if system.get_file_info(at).type != arrow_fs.FileType.File:
                raise
            system.delete_file(fresh)

    def _listing(self, poll: int, part: int) -> Iterator[Row]:
        system, base = _open(self.state)
        if poll:
            with system.open_input_stream(f"{base}/{poll}/{part}.arrow") as given, pa.ipc.open_stream(given) as reader:
                for batch in reader:
                    yield from zip(batch["path"].to_pylist(), batch["mtime"].cast(pa.int64()).to_pylist(), batch["size"].to_pylist(), strict=True)


def changes(old: Iterator[Row], new: Iterator[Row], now: int) -> Iterator[tuple[int, str, str]]:
    """(time, path, create, write or remove) between two listings in one order; now is when what is missing was missed."""
    order = lambda row: row[0].split("/")
    a, b = next(old, None), next(new, None)
    while a or b:
        if b is None or (a and order(a) < order(b)):
            yield now, a[0], "remove"
            a = next(old, None)
        elif a is None or order(b) < order(a):
            yield b[1], b[0], "create"
            b = next(new, None)
        else:
            if a != b:
                yield b[1], b[0], "write"
            a, b = next(old, None), next(new, None)


def list_tree(spark: SparkSession, root: str, parts: int = PARTS, depth: int = DEPTH, skip: Iterable[str] = (".git",)) -> DataFrame:
    """(path, mtime, size) of all files below root. A condition on how path begins keeps other directories from being listed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("parts", parts).option("depth", depth).option("skip", ",".join(skip)).load(root)


def scan_tree(spark: SparkSession, root: str, purpose: str | None = "symbols", ignore: list[str] | None = None, repo_root: str | None = None, everywhere: str | None = None, **how) -> DataFrame:
    """(repo_root, path, mtime, size) of the files that read_tree() would read, by the same rules, none of them opened."""
    rows = list_tree(spark, root, **how).filter(not_ignored(F.col("path")))
    if purpose:
        rows = rows.filter(X.is_code_file("path", purpose))
    if patterns := ignore_patterns(spark, root, everywhere) + (ignore or []):
        rows = rows.filter(~gitignored(F.col("path"), patterns))
    return rows.select(F.lit(repo_root or root).alias("repo_root"), "path", "mtime", "size")


def with_text(files: DataFrame, root: str) -> DataFrame:
    """files (path below root, ...) with their text: those that are wanted are opened, such as changed_files(scan_tree(...), indexed).

    Bytes that aren't UTF-8 are replaced; files with a zero byte are left out as binary, files that have gone since they were listed too.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            at, held, size = [], [], 0
            for i, path in enumerate(batch["path"].to_pylist()):
                try:
                    with system.open_input_stream(f"{base}/{path}") as given:
                        body = given.read()
                except FileNotFoundError:
                    continue
                if b"\x00" in body:
                    continue
                at.append(i)
                held.append(body)
                size += len(body)
                if size >= BYTES:
                    yield joined(batch, at, held)
                    at, held, size = [], [], 0
            if at:
                yield joined(batch, at, held)

    def joined(batch: pa.RecordBatch, at: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        rows = batch.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(bodies, pa.binary())], [*batch.schema.names, "_body"])

    out = files.mapInArrow(opened, StructType([*files.schema.fields]).add("_body", "binary"))
    return out.withColumn("text", F.make_valid_utf8(F.col("_body").cast("string"))).drop("_body")


def _small_batches(spark: SparkSession) -> None:
    """Batches of bodies have BYTES at most, or one body, unless the session says otherwise."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_CONF):
        spark.conf.set(BATCH_CONF, str(BYTES))


def write_files(files: DataFrame, root: str) -> None:
    """Writes each row (path below root, body) as a file, by the tasks. A file that is there already is written anew, so a repeated task does no harm."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        made: set[str] = set()
        for batch in batches:
            for path, body in zip(batch["path"], batch["body"], strict=True):
                at = f"{base}/{path}"
                if (folder := at.rpartition("/")[0]) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(at) as out:
                    out.write(body.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    _small_batches(files.sparkSession)
    files.select("path", "body").mapInArrow(written, "n long").agg(F.sum("n")).collect()


def tree_events(spark: SparkSession, root: str, state: str, parts: int = PARTS, depth: int = DEPTH, skip: Iterable[str] = (".git",)) -> DataFrame:
    """A stream of (ts, path below root, op): each micro-batch lists the tree and gives what was created, written or removed since the last.

    state is a folder of this stream's own on a file system that all executors share. The first batch creates every file. Changes undone between
    two listings aren't seen.
    """
    spark.dataSource.register(TreeSource)
    return spark.readStream.format("tree").option("parts", parts).option("depth", depth).option("skip", ",".join(skip)).option("state", state).load(root)
