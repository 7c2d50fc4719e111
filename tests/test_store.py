import pytest
from pyspark.sql import functions as F

from quarryloom import schemas
from quarryloom.operators import embed as E
from quarryloom.operators import merkle as M
from quarryloom.operators import store as D
from quarryloom.plans.indexer import Index


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 99), (2, "d", 98), (3, "e", 30)], "k int, v string, t int")
    assert rows(D.upsert(old, new, ("k",))) == [(1, "a", 10), (2, "d", 98), (3, "e", 30)]
    assert rows(D.upsert(old, new, ("k",), ("v",), F.col("t"))) == [(1, "a", 10), (2, "c", 20), (3, "e", 30)]
    assert rows(D.upsert(old, new.limit(0), ("k",), ("v",))) == rows(old)


def test_replace_and_delete(spark):
    old = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("s", "a", 3)], "repo_root string, path string, x int")
    new = spark.createDataFrame([("r", "a", 9)], old.schema)
    assert rows(D.replace_files(old, new, new)) == [("r", "a", 9), ("r", "b", 2), ("s", "a", 3)]
    assert rows(D.replace_repo(old, new, "r")) == [("r", "a", 9), ("s", "a", 3)]
    assert rows(D.delete_where(old, F.col("x") > 1)) == [("r", "a", 1)]


def test_cache(spark):
    ts = lambda n: F.timestamp_seconds(F.lit(n))
    old = spark.createDataFrame([("a", [1.0], 2)], "content_hash string, embedding array<float>, access_count long").withColumn("created_at", ts(5)).withColumn("last_accessed", ts(5))
    new = spark.createDataFrame([("a", [9.0], 1), ("b", [2.0], 1)], "content_hash string, embedding array<float>, access_count long").withColumn("created_at", ts(7)).withColumn("last_accessed", ts(7))
    out = {r["content_hash"]: (r["embedding"], r["access_count"], r["created_at"].timestamp(), r["last_accessed"].timestamp()) for r in D.put_cache(old, new).collect()}
    assert out == {"a": ([1.0], 3, 5, 7), "b": ([2.0], 1, 7, 7)}


def test_eviction_and_orphans(spark):
    cache = spark.createDataFrame([(str(i), i) for i in range(10)], "content_hash string, last_accessed int")
    assert rows(D.evict(cache, 5), "content_hash") == [(str(i),) for i in range(5, 10)]
    loc = spark.createDataFrame([("3",), ("3",), ("x",)], "content_hash string")
    assert D.orphans(cache, loc).count() == 9 and D.remove_orphans(cache, loc).count() == 1


def test_switch_and_migrate(spark):
    e = spark.createDataFrame([("r", 3, [1.0]), ("r", 4, [2.0]), ("s", 3, [3.0])], "repo_root string, dimensions int, embedding array<float>")
    config = schemas.empty(spark, "repo_config")
    kept, config = D.switch_dimensions(e, config, "r", "m", 4)
    assert rows(kept, "repo_root", "dimensions") == [("r", 4), ("s", 3)] and rows(config, "repo_root", "dimensions") == [("r", 4)]
    assert D.dimension_mismatch(config, "r", 3).count() == 1 and D.dimension_mismatch(config, "r", 4).count() == 0
    a = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "id int, embedding array<float>")
    b = a.filter("id < 2").withColumn("embedding", F.array(F.lit(7.0).cast("float")))
    assert D.migrate(a, b, ("id",)).count() == 6 and D.migration_errors(a, D.migrate(a, b, ("id",)), ("id",)).count() == 2
    assert D.migration_errors(a, D.migrate(a, b, ("id",), skip_existing=False), ("id",)).count() == 0
    text = spark.createDataFrame([("[1.5,2]",)], "embedding string")
    assert D.text_to_vector(text).first()[0] == [1.5, 2.0]
    assert D.every_nth(a, ("id",), 3).count() == 3


def test_snapshots(spark, tmp_path):
    s = D.Snapshots(spark, f"file://{tmp_path}/t")
    assert s.read() is None and s.version() == 0
    for n in (3, 4, 5):
        s.write(spark.range(n) if n == 3 else s.read().union(spark.range(1)))
        assert s.read().count() == n
    assert s.version() == 3 and len(list((tmp_path / "t").glob("v*"))) == 2


FILES = {"file1.txt": "content1", "file2.txt": "content2", "subdir/file3.txt": "content3", "subdir/nested/file4.txt": "content4"}


def tree(spark, texts):
    return M.rollup(M.file_nodes(spark.createDataFrame(list(texts.items()), "path string, text string")))


def test_merkle(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    old = tree(spark, FILES)
    got = {r["path"]: r["hash"] for r in old.collect()}
    nested = sha(sha("content4"))
    sub = sha(sha("content3") + nested)
    assert got["subdir/nested"] == nested and got["subdir"] == sub and got[""] == sha(sha("content1") + sha("content2") + sub)
    new = tree(spark, {"file1.txt": "changed", "subdir/file3.txt": "content3", "subdir/nested/file4.txt": "content4", "new.txt": "n"})
    assert rows(M.diff(old, new)) == [("file1.txt", "modified"), ("file2.txt", "deleted"), ("new.txt", "added")]
    swap = {"added": "deleted", "deleted": "added", "modified": "modified"}
    assert rows(M.diff(new, old)) == sorted((p, swap[c]) for p, c in rows(M.diff(old, new)))
    assert M.diff(old, old).count() == 0 and M.diff(None, old).count() == 4
    # A rename that keeps the order of siblings leaves the root's hash, but not the table.
    renamed = tree(spark, {("file2b.txt" if p == "file2.txt" else p): t for p, t in FILES.items()})
    assert M.root_hash(renamed) == M.root_hash(old) and M.diff(old, renamed).count() == 2
    assert rows(M.directory_sizes(old)) == [("", 4, 32), ("subdir", 2, 16), ("subdir/nested", 1, 8)]


def test_hash_sets(spark):
    schema = "repo_root string, path string, content_hash string"
    old = spark.createDataFrame([("r", "a", "1"), ("r", "a", "1"), ("r", "b", "2")], schema)
    new = spark.createDataFrame([("r", "a", "1"), ("r", "b", "3"), ("r", "c", "4")], schema)
    assert rows(M.changed_hash_sets(old, new)) == [("r", "b"), ("r", "c")]


def test_embedding_with_cache(spark):
    chunks = spark.createDataFrame([("r", f"{p}.go", 1, 9, c, c, "block", None, "go") for p, c in (("a", "same"), ("b", "same"), ("c", "other"))], "repo_root string, path string, start_line int, end_line int, content string, content_hash string, node_type string, node_name string, language string")
    cache = schemas.empty(spark, "embedding_cache")
    by = E.hashing_embedder(16)
    new, loc = E.embed_with_cache(chunks, cache, by)
    assert new.count() == 2 and loc.count() == 3
    again, _ = E.embed_with_cache(chunks, cache.unionByName(new), by)
    assert again.count() == 0
    s = E.embed_statistics(chunks, cache.unionByName(new).filter("content_hash = 'same'")).first()
    assert (s["total_chunks"], s["unique_hashes"], s["hit_hashes"], s["hit_chunks"], s["to_embed"]) == (3, 2, 1, 2, 1)


def test_hashing_agrees_with_the_driver(spark):
    text = "The quick, brown fox; the dog_1 Été"
    got = E.hash_embed(spark.createDataFrame([(1, text), (2, "")], "id int, t string"), "id", "t", 32).orderBy("id").collect()
    assert got[0]["embedding"] == pytest.approx(E.hash_embed_text(text, 32), abs=1e-6) and got[1]["embedding"] == [0.0] * 32


def test_words_are_counted_where_they_are_split(spark):
    """No row for a word: on odd texts the numbers are those of the plain way, and only they are shuffled."""
    texts = ["İstanbul ıI ẞß ΑΣ. ÀÉ é", "½ ² Ⅷ ٣٤ 一二三 nul\0nb\u00a0z\u2028q", "A_b-C\tC", "  ", ".,;", None, "", "smile😀y K Å ﬁ", "x" * 5000, "b a"]
    df = spark.createDataFrame([(i % 9, t) for i, t in enumerate(texts)], "id int, t string").union(spark.sql("SELECT 20, cast(X'6162806364FF65' AS string)"))  # id 0 twice, bytes that are no UTF-8
    words = df.select("id", F.explode(F.filter(F.split(F.lower("t"), E.WORDS), lambda w: w != "")).alias("w"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(16)).cast("int")
    plain = words.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    counts = E.hash_counts(df, "id", "t", 16)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, plain.collect()))
    got = E.hash_embed(df, "id", "t", 16)
    assert got.count() == got.select("id").distinct().count() == 10
    for r in got.collect():
        own = {c["bucket"]: c["n"] for c in counts.filter(F.col("id") == r["id"]).collect()}
        norm = sum(n * n for n in own.values()) ** 0.5 or 1.0
        assert r["embedding"] == pytest.approx([own.get(i, 0) / norm for i in range(16)], abs=1e-6)
    p = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in p and "Join" not in p and "MapInArrow" in p


def test_mock_embedders(spark):
    df = spark.createDataFrame([("ab",)], "t string")
    assert df.select(E.length_embedding(F.col("t"), 4)).first()[0] == [0.5, 0.75, 1.0, 1.25]
    h = 97 * 31 + 98
    assert df.select(E.rolling_embedding(F.col("t"), 2)).first()[0] == pytest.approx([h % 1000 / 1000, (h + 1) % 1000 / 1000])


def test_http_embedder(spark):
    calls = lambda texts: [[float(len(t)), 0.0] for t in texts]
    by = E.http_embedder("fake", "m", calls, batch=2, dimensions=2)
    df = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id int, t string")
    assert {r["id"]: r["embedding"] for r in by.embed(df, "id", "t").collect()} == {i: [float(i), 0.0] for i in range(5)}

    def fails(texts):
        raise OSError("down")

    assert E.http_embedder("fake", "m", fails, on_error="skip").embed(df, "id", "t").count() == 0
    assert E.embedder("off").available() is False


def test_index_runs(spark, tmp_path):
    texts = {"a.py": "def f():\n    return 1\n", "b.py": "def g():\n    return 2\n", "c.py": "def f():\n    return 1\n"}
    files = lambda t: spark.createDataFrame([("r", p, x) for p, x in t.items()], "repo_root string, path string, text string")
    index = Index(spark, f"file://{tmp_path}/ix", E.hashing_embedder(16))
    first = index.run(files(texts), "r")
    assert (first.added, first.modified, first.deleted) == (3, 0, 0) and first.embedded < first.chunks
    again = index.run(files(texts), "r")
    assert (again.added, again.embedded) == (0, 0)
    del texts["b.py"]
    texts["a.py"] = "def h():\n    return 3\n"
    third = index.run(files(texts), "r")
    assert (third.added, third.modified, third.deleted) == (0, 1, 1)
    assert rows(index.read("symbols"), "path", "name") == [("a.py", "h"), ("c.py", "f")]
    assert {r["path"] for r in index.read("chunk_locations").collect()} == {"a.py", "c.py"}
    before = index.read("embedding_cache").count()
    index.clean()
    assert index.read("embedding_cache").count() < before
    assert index.stats().filter("value = 'files'").first()["n"] == 2


def test_a_run_that_dies_at_the_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    """Killed before, while or after the new pointer is written: there is a version to read at any time, and the next write goes on from it."""
    at = f"file://{tmp_path}/table"
    snaps = D.Snapshots(spark, at)
    assert snaps.write(spark.range(3)) == 1
    point = D.Snapshots._point

    def dies(self, text):
        raise KeyboardInterrupt

    monkeypatch.setattr(D.Snapshots, "_point", dies)
    with pytest.raises(KeyboardInterrupt):
        snaps.write(spark.range(9))
    assert D.Snapshots(spark, at).version() == 1 and D.Snapshots(spark, at).read().count() == 3

    def dies_halfway(self, text):
        self._fs.create(self._path(f"{self.path}/.CURRENT-half"), True).close()
        raise KeyboardInterrupt

    monkeypatch.setattr(D.Snapshots, "_point", dies_halfway)
    with pytest.raises(KeyboardInterrupt):
        snaps.write(spark.range(9))
    assert D.Snapshots(spark, at).read().count() == 3

    seen = []

    def watched(self, text):
        exists, delete = self._fs.exists, self._fs.delete
        point(self, text)
        seen.append((exists(self._path(f"{self.path}/CURRENT")), delete))

    monkeypatch.setattr(D.Snapshots, "_point", watched)
    assert snaps.write(spark.range(5)) == 2 and seen[0][0] and D.Snapshots(spark, at).read().count() == 5


def test_deep_trees_are_rolled_up_level_by_level(spark):
    files = spark.createDataFrame([("/".join(["d"] * k + [f"f{k}"]), f"text {k}") for k in range(12)], "path string, text string")
    tree = M.rollup(M.file_nodes(files))
    assert tree.count() == 12 + 12 and tree.filter("path = ''").first()["size"] == sum(len(f"text {k}") for k in range(12))
    assert tree._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 13  # files and one table a level
