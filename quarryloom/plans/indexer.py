"""Index runs: from files to chunks, symbols, vectors and their tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom import schemas
from quarryloom.operators import chunking, embed, merkle, stats, store, symbols
from quarryloom.operators.versioned import BUCKETS, FOLDERS, Conflict, Spec, Transaction, VersionedTables
from quarryloom.scratch import drop_settled, settle

FILE = ("repo_root", "path")
SPECS = {
    "merkle": Spec("repo_root string, " + schemas.MERKLE, FILE),
    "chunk_locations": Spec(schemas.LOCATIONS, FILE),
    "embedding_cache": Spec(schemas.CACHE, ("content_hash",)),
    "symbols": Spec(schemas.SYMBOLS, FILE),
    "chunks": Spec(schemas.CHUNKS, FILE),
}
#: What the index knows of each file's chunks, kept beside the tables.
KEPT = {"file_stats": Spec(schemas.FILE_STATS, FILE)}


@dataclass
class IndexResult:
    added: int
    modified: int
    deleted: int
    chunks: int
    embedded: int
    #: Rows that the run wrote to each table of Index.TABLES.
    written: dict[str, int]


class Index:
    """The tables of an index under one folder, of one version at any time.

    A run writes the rows of changed files and the keys of those that changed
    or went; everything else stays where it is.
    """

    TABLES = tuple(SPECS)

    def __init__(
        self, spark: SparkSession, path: str, embedder: embed.Embedder | None = None, chunker: Callable[[DataFrame], DataFrame] = chunking.structural_chunks,
        finder: Callable[[DataFrame], DataFrame] = symbols.extract_symbols, buckets: int = BUCKETS, slice_rows: int = embed.SLICE,
    ):
        self.spark = spark
        self.embedder = embedder or embed.hashing_embedder()
        self.chunker, self.finder, self.slice = chunker, finder, slice_rows
        self.tables = VersionedTables(spark, path, SPECS | KEPT, buckets)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.tables.read(table, version)

    def run(self, files: DataFrame, repo_root: str, force: bool = False, tries: int = 3) -> IndexResult:
        """Brings the index up to the files of one repository.

        Only files whose hash changed are chunked, only hashes that the cache
        lacks are embedded; rows of changed and deleted files are replaced in
        all tables at once. A run that fails changes nothing but that vectors which a server gave by then stay in the cache. If another run of the same repository
        ends first, this one begins again from what that one left.
        """
        for n in range(tries):
            try:
                return self._run(files, repo_root, force)
            except Conflict:
                if n == tries - 1:
                    raise
        raise ValueError("tries has to be positive")

    def _run(self, files: DataFrame, repo_root: str, force: bool) -> IndexResult:
        change = self.tables.begin(repo_root)
        mine = files.filter(F.col("repo_root") == repo_root)
        nodes = merkle.rollup(merkle.file_nodes(mine)).withColumn("repo_root", F.lit(repo_root))
        old = change.read("merkle").filter(F.col("repo_root") == repo_root)
        if not force and (known := merkle.root_hash(old)) is not None and known == merkle.root_hash(nodes) and not merkle.diff(old, nodes).take(1):
            return IndexResult(0, 0, 0, 0, 0, self._written(change))
        changes = settle(merkle.diff(None if force else old, nodes).withColumn("repo_root", F.lit(repo_root)), "changes")
        fresh = mine.join(merkle.to_reindex(changes), "path", "left_semi")
        asks = self.embedder.attempt is not None
        was_there = change.read("chunk_locations").filter(F.col("repo_root") == repo_root).select(*FILE) if force else changes.filter("change <> 'added'").select(*FILE)
        same = ["path", "hash", "is_dir"]
        stale = old if force else old.join(nodes.select(*same), same, "left_anti")
        new_nodes = nodes if force else nodes.join(old.select(*same), same, "left_anti")
        try:
            change.replace("chunks", self.chunker(fresh))  # parsed and written once; the three tables made of them read what was written
            chunks = change.fresh("chunks")
            embedded_before = self._embed_first(chunks) if asks else 0
            new_cache, new_locations = embed.embed_with_cache(chunks, change.read("embedding_cache"), self.embedder)
            # Independent writes, whose jobs may run beside each other.
            with ThreadPoolExecutor(6) as pool:
                jobs = [
                    pool.submit(lambda: 0 if asks else change.append("embedding_cache", new_cache)), pool.submit(change.replace, "chunk_locations", new_locations),
                    pool.submit(change.replace, "symbols", self.finder(fresh)), pool.submit(change.replace, "merkle", new_nodes, stale.select(*FILE)),
                    pool.submit(change.forget, ("chunk_locations", "chunks", "symbols", "file_stats"), was_there), pool.submit(change.replace, "file_stats", stats.file_stats(new_locations)),
                ]
            embedded = [j.result() for j in jobs][0] + embedded_before
            change.commit()
        except BaseException:
            change.abort()
            raise
        n = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        drop_settled(changes)
        written = self._written(change)
        written["embedding_cache"] += embedded_before
        return IndexResult(n.get("added", 0), n.get("modified", 0), n.get("deleted", 0), written["chunk_locations"], embedded, written)

    def _written(self, change: Transaction) -> dict[str, int]:
        return {t: n for t, n in change.written().items() if t in self.TABLES}

    def _embed_first(self, chunks: DataFrame) -> int:
        """Vectors that come from a server are kept slice by slice, in versions of their own before that of the run: the cache is the ledger from which a run
        that failed is taken up again. Until the run ends no place refers to them."""

        def keep(vectors: DataFrame) -> int:
            change = self.tables.begin()
            rows = change.append("embedding_cache", embed.cache_rows(vectors, self.embedder))
            if rows:
                change.commit()
            return rows

        _, missing = embed.split_by_cache(chunks, self.read("embedding_cache"))
        return embed.embed_in_slices(missing, self.embedder, keep, self.slice)

    def stats(self) -> DataFrame:
        return stats.index_stats(self.read("chunk_locations"), self.read("embedding_cache"))

    def kept_stats(self, repo: str | None = None) -> DataFrame:
        """stats() from what runs have kept of each file, without reading places or vectors (the cache is counted, by its files' footers where no hash has gone); distinct hashes are an estimate."""
        return stats.merged_stats(self.read("file_stats"), self.read("embedding_cache"), repo)

    def clean(self) -> None:
        """Drops vectors that no place needs any more."""
        change = self.tables.begin("embedding_cache")
        change.replace("embedding_cache", None, store.orphans(change.read("embedding_cache"), change.read("chunk_locations")))
        change.commit()

    def compact(self, most: int = FOLDERS, keep: int = 2) -> dict[str, int]:
        """Rewrites buckets that lie in many folders, and deletes versions but the newest ones. Says how many rows of each table were rewritten."""
        out = self.tables.compact(most)
        self.tables.vacuum(keep)
        return out
