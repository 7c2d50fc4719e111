"""Changing tables: every change is a new table made from the old one.

Parquet has no updates in place. A change is a DataFrame over the old rows
and the new; Snapshots writes it as a new version and then moves a pointer,
so readers see the old version or the new one, never a part.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.operators.ordering import as_whole, numbered, row_at, text_at, whole_at

LOCATION_KEY = ("repo_root", "path", "start_line", "end_line")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], update: tuple[str, ...] | None = None, newest: Column | None = None) -> DataFrame:
    """old with the rows of new put in or over those of the same key.

    update names the columns that an existing row takes from new, all if None; the
    others keep their value. Of several new rows with one key that with the largest newest counts,
    by default the one largest in all columns.
    """
    order = newest if newest is not None else F.struct(*[c for c in new.columns])
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("row")).select("row.*")
    if update is None:
        return old.join(last.select(*keys), list(keys), "left_anti").unionByName(last)
    named = last.select(*keys, *[F.col(c).alias(f"new_{c}") for c in last.columns if c not in keys], F.lit(True).alias("is_new"))
    both = old.withColumn("is_old", F.lit(True)).join(named, list(keys), "full_outer")
    pick = lambda c: F.col(c) if c in keys else F.when(F.col("is_old").isNull(), F.col(f"new_{c}")).when(F.col("is_new").isNotNull() & F.lit(c in update), F.col(f"new_{c}")).otherwise(F.col(c)) if c in last.columns else F.col(c)
    return both.select(*[pick(c).alias(c) for c in old.columns])


def replace_files(old: DataFrame, new: DataFrame, changed: DataFrame, keys: tuple[str, ...] = ("repo_root", "path")) -> DataFrame:
    """old without the rows of changed files (deleted ones too), and the new rows."""
    return old.join(changed.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def replace_repo(old: DataFrame, new: DataFrame, repo: str) -> DataFrame:
    return old.filter(~F.col("repo_root").eqNullSafe(F.lit(repo))).unionByName(new.select(*old.columns))


def delete_where(old: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null doesn't delete."""
    return old.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(old: DataFrame, keys: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return old.join(keys.select(*on), list(on), "left_anti")


def save_locations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by place; created_at stays that of the first time."""
    return upsert(old, new, LOCATION_KEY, ("content_hash", "node_type", "node_name", "language"))


def put_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """New hashes come in; known ones count one access for each row and keep their embedding. Both: content_hash, embedding, created_at, access_count, last_accessed; old has a hash once.

    Only the new rows are grouped. The cache's vectors meet counts by hash, which are few beside them, and aren't
    dealt out anew unless the new rows are many.
    """
    columns = ("content_hash", "embedding", "created_at", "access_count", "last_accessed")
    seen = new.groupBy("content_hash").agg(F.min_by("embedding", "created_at").alias("embedding"), F.min("created_at").alias("created_at"), F.sum("access_count").cast("long").alias("access_count"), F.max("last_accessed").alias("last_accessed"))
    told = seen.select("content_hash", F.col("created_at").alias("first"), F.col("access_count").alias("n"), F.col("last_accessed").alias("latest"))
    known = old.select(*columns).join(told, "content_hash", "left").select(
        "content_hash", "embedding", F.least("created_at", "first").alias("created_at"), (F.col("access_count") + F.coalesce("n", F.lit(0))).cast("long").alias("access_count"), F.greatest("last_accessed", "latest").alias("last_accessed"),
    )
    return known.unionByName(seen.join(old.select("content_hash"), "content_hash", "left_anti").select(*columns))


def fold_accesses(cache: DataFrame, log: DataFrame) -> DataFrame:
    """cache with the accesses of an append-only log (content_hash, accessed_at) added."""
    seen = log.groupBy("content_hash").agg(F.count("*").alias("n"), F.max("accessed_at").alias("latest"))
    return cache.join(seen, "content_hash", "left").withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).withColumn("last_accessed", F.greatest("last_accessed", "latest")).drop("n", "latest")


def evict(cache: DataFrame, keep: int, key: str = "content_hash", used: str = "last_accessed") -> DataFrame:
    """The keep most recently used rows, by key among equals; rows are only filtered by the last that stays.

    It is found by counting in ever smaller ranges of times and then of keys, without a sort; of types that have no such ranges,
    by a sort of times and keys alone.
    """
    if keep <= 0:
        return cache.limit(0)
    last = _last_kept(cache, keep, key, used)
    if last is None:
        return cache
    at, name = F.lit(last[0]).cast(cache.schema[used].dataType), F.lit(last[1])
    later = F.col(used).isNotNull() if last[0] is None else F.coalesce(F.col(used) > at, F.lit(False))
    return cache.filter(later | (F.col(used).eqNullSafe(at) & (F.col(key) <= name)))


def _last_kept(cache: DataFrame, keep: int, key: str, used: str) -> tuple | None:
    """(time, key) of the last row that stays; None if all do."""
    kinds = dict(cache.dtypes)
    value, number = as_whole(used, kinds[used]), as_whole(key, kinds[key]) if kinds[key] not in ("date", "timestamp") else None
    sorted_ = lambda: row_at(cache.select(used, key), [F.col(used).desc_nulls_last(), F.col(key)], keep)
    n, timed, keyed = cache.agg(F.count("*"), F.count(used), F.count(key)).first()
    if keep >= n:
        return None
    if value is None or keyed < n or (number is None and kinds[key] != "string"):
        return sorted_()
    if keep > timed:
        at, place, equal = None, keep - timed, cache.filter(F.col(used).isNull())
    else:
        found = whole_at(cache, value, keep, descending=True)
        if found is None:
            return sorted_()
        at, place, _ = found
        equal = cache.filter(value == at)
        at = {"timestamp": F.timestamp_micros(F.lit(at)), "date": F.date_from_unix_date(F.lit(at).cast("int"))}.get(kinds[used], at)
    if number is None:
        return at, text_at(equal, key, place)
    found = whole_at(equal, number, place)
    return (at, found[0]) if found else sorted_()


def orphans(cache: DataFrame, locations: DataFrame) -> DataFrame:
    """Hashes that no location names."""
    return cache.select("content_hash").join(locations.select("content_hash"), "content_hash", "left_anti").distinct()


def remove_orphans(cache: DataFrame, locations: DataFrame) -> DataFrame:
    return cache.join(locations.select("content_hash"), "content_hash", "left_semi")


def dimension_mismatch(config: DataFrame, repo: str, dimensions: int) -> DataFrame:
    """The repository's config row if its dimensions differ from these."""
    return config.filter((F.col("repo_root") == repo) & (F.col("dimensions") != dimensions))


def switch_dimensions(embeddings: DataFrame, config: DataFrame, repo: str, model: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(embeddings without the repository's of other dimensions, config with the new ones)"""
    kept = delete_where(embeddings, (F.col("repo_root") == repo) & (F.col("dimensions") != dimensions))
    new = config.sparkSession.range(1).select(F.lit(repo).alias("repo_root"), F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), F.current_timestamp().alias("updated_at"))
    return kept, upsert(config, new, ("repo_root",), ("model", "dimensions", "updated_at"))


def migrate(source: DataFrame, target: DataFrame, keys: tuple[str, ...], skip_existing: bool = True) -> DataFrame:
    """target with the rows of source; existing keys stay as they are, or are replaced."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti")) if skip_existing else upsert(target, source, keys)


def migration_plan(source: DataFrame, target: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: how many rows source has, how many are there already and how many would come."""
    known = target.select(*keys).distinct().withColumn("there", F.lit(1))
    return source.join(known, list(keys), "left").agg(F.count("*").alias("total"), F.count("there").alias("existing"), (F.count("*") - F.count("there")).alias("to_copy"))


def migration_errors(source: DataFrame, target: DataFrame, keys: tuple[str, ...], every: int = 1, tolerance: float = 1e-4, vector: str = "embedding") -> DataFrame:
    """Rows of source, every so many by a hash of the key, that target lacks or whose vector differs by more than tolerance somewhere."""
    some = source.filter(F.pmod(F.xxhash64(*keys), F.lit(every)) == 0).select(*keys, F.col(vector).alias("a"))
    both = some.join(target.select(*keys, F.col(vector).alias("b")), list(keys), "left")
    apart = F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), lambda d: d.isNull() | (d > tolerance))
    return both.filter(F.col("b").isNull() | (F.size("a") != F.size("b")) | apart).select(*keys)


def every_nth(rows: DataFrame, order: tuple[str, ...], sample: int) -> DataFrame:
    """sample rows at even distances in order, which has to tell all rows apart; all if there are fewer. Only keys are sorted."""
    step = max(1, rows.count() // max(1, sample))
    picked = numbered(rows.select(*order), list(order), "_n").filter((F.col("_n") % step == (1 % step)) & (F.col("_n") <= step * sample)).drop("_n")
    return rows.join(picked, list(order), "left_semi")


def text_to_vector(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """A column of JSON arrays as array<float>; one that is a vector already stays."""
    return rows if dict(rows.dtypes)[column].startswith("array") else rows.withColumn(column, F.from_json(column, "array<float>"))


class Snapshots:
    """Versions of a table under one folder, read through a pointer file.

    Paths go through Hadoop's file systems, so any store that Spark writes to will do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self) -> dict | None:
        at = self._path(f"{self.path}/CURRENT")
        if not self._fs.exists(at):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/CURRENT", wholetext=True).first()[0])

    def version(self) -> int:
        return (self._pointer() or {"version": 0})["version"]

    def read(self) -> DataFrame | None:
        """The current version; None before the first."""
        now = self._pointer()
        return self.spark.read.parquet(f"{self.path}/{now['folder']}") if now else None

    def write(self, rows: DataFrame, partition_by: tuple[str, ...] = (), keep: int = 2) -> int:
        """A new version; it counts once the pointer names it. Older ones beyond keep are deleted."""
        now = self._pointer() or {"version": 0, "older": []}
        folder = f"v{now['version'] + 1}-{uuid.uuid4().hex[:8]}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.path}/{folder}")
        older = ([now["folder"]] if "folder" in now else []) + now.get("older", [])
        text = json.dumps({"version": now["version"] + 1, "folder": folder, "older": older[: max(0, keep - 1)]})
        self._point(text)
        for old in older[max(0, keep - 1) :]:
            self._fs.delete(self._path(f"{self.path}/{old}"), True)
        return now["version"] + 1

    def _point(self, text: str) -> None:
        """Puts the new pointer in the place of the old one in one step, so that there is one at any time."""
        fresh = self._path(f"{self.path}/.CURRENT-{uuid.uuid4().hex}")
        out = self._fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        to = self._fs.makeQualified(self._path(f"{self.path}/CURRENT"))
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(fresh), to, options)


def select_rows(table: DataFrame, columns: tuple[str, ...] = (), where: list[Column] | None = None, order: list | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """SELECT columns WHERE all conditions ORDER BY order LIMIT limit OFFSET offset; what is empty or not positive is left out."""
    rows = reduce(lambda t, c: t.filter(c), where or [], table)
    rows = rows.orderBy(*order) if order else rows
    rows = rows.offset(offset) if offset > 0 else rows
    rows = rows.limit(limit) if limit > 0 else rows
    return rows.select(*columns) if columns else rows
