"""Trees as a data source, against listings by os.walk."""

import os

import pytest
from pyspark.sql import functions as F

from quarryloom.sources import files as R
from quarryloom.sources import trees


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, body in {"a.go": b"package a", "x/b.py": b"b = 1\n", "x/y/c.py": b"c = 1\n", "x/y/z/d.py": b"\xffd", "x/y/z/e.py": b"e\x00", "x.d/f.py": b"", "ü/g.py": b"g", ".git/h.py": b"h", "x/n.txt": b"n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(body)
    return root


def by_hand(root):
    return sorted((os.path.relpath(os.path.join(d, f), root), os.path.getsize(os.path.join(d, f))) for d, _, fs in os.walk(root) for f in fs if ".git" not in d)


@pytest.mark.parametrize(("parts", "depth"), [(1, 1), (5, 1), (7, 2), (3, 4)])
def test_every_file_is_listed_once(spark, tree, parts, depth):
    rows = trees.list_tree(spark, f"file://{tree}", parts, depth).collect()
    assert sorted((r["path"], r["size"]) for r in rows) == by_hand(tree)
    assert all(r["mtime"].timestamp() == pytest.approx(os.path.getmtime(tree / r["path"]), abs=1e-3) for r in rows)


def test_a_prefix_reaches_the_listing(spark, tree):
    reader = trees.TreeReader({"url": str(tree), "parts": 1, "depth": 1, "skip": []})
    left = list(reader.pushFilters([trees.StringStartsWith(("path",), "x/y/"), trees.StringStartsWith(("path",), "x")]))
    listed = [p for b in reader.read(trees.Part(0)) for p in b["path"].to_pylist()]
    assert len(left) == 2 and listed == ["x/y/c.py", "x/y/z/d.py", "x/y/z/e.py"]
    rows = trees.list_tree(spark, str(tree))
    assert {r[0] for r in rows.filter(F.col("path").startswith("x/y/z")).select("path").collect()} == {"x/y/z/d.py", "x/y/z/e.py"}
    assert [r[0] for r in rows.filter(F.col("path").isin("a.go", "no")).select("path").collect()] == ["a.go"]
    assert rows.filter("path = 'x/b.py' and size > 100").count() == 0


def test_scan_and_texts_equal_read_tree(spark, tree):
    (tree / ".gitignore").write_text("x.d/\n")
    want = R.read_tree(spark, f"file://{tree}", ignore=["*.go"], repo_root="r")
    got = trees.with_text(trees.scan_tree(spark, f"file://{tree}", ignore=["*.go"], repo_root="r"), f"file://{tree}")
    key = lambda rows: sorted((r["repo_root"], r["path"], r["size"], r["text"]) for r in rows.collect())
    assert key(got) == key(want) and len(key(got)) == 4


def test_only_changed_files_are_opened(spark, tree):
    seen = trees.scan_tree(spark, str(tree), repo_root="r").collect()
    indexed = spark.createDataFrame(seen)
    (tree / "x/b.py").write_bytes(b"b = 22\n")
    now = trees.scan_tree(spark, str(tree), repo_root="r")
    assert [(r["path"], r["text"]) for r in trees.with_text(R.changed_files(now, indexed), str(tree)).collect()] == [("x/b.py", "b = 22\n")]
    (tree / "a.go").unlink()
    assert trees.with_text(indexed.filter("path = 'a.go'"), str(tree)).count() == 0


def test_no_tree_no_files(spark, tmp_path):
    assert trees.list_tree(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "empty").mkdir()
    assert trees.list_tree(spark, f"{tmp_path}/empty").count() == 0


def test_changes_by_listings():
    old = [("a/b", 1, 1), ("a/c", 1, 1), ("a.x", 1, 1)]
    new = [("a/c", 2, 1), ("a/d", 3, 1), ("a.x", 1, 1)]
    assert list(trees.changes(iter(old), iter(new), 9)) == [(9, "a/b", "remove"), (2, "a/c", "write"), (3, "a/d", "create")]
    assert list(trees.changes(iter([]), iter([]), 9)) == []


def test_a_stream_gives_changes_and_goes_on_after_a_restart(spark, tree, tmp_path):
    got = []

    def run():
        rows = trees.tree_events(spark, str(tree), f"{tmp_path}/state", parts=3)
        take = lambda batch, _: got.append(sorted((r["path"], r["op"]) for r in batch.collect()))
        query = rows.writeStream.option("checkpointLocation", f"file://{tmp_path}/check").foreachBatch(take).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    assert sum(got, []) == sorted((p, "create") for p, _ in by_hand(tree))
    got.clear()
    (tree / "x/y/c.py").write_bytes(b"c = 22\n")
    (tree / "a.go").unlink()
    (tree / "new").mkdir()
    (tree / "new/i.py").write_bytes(b"i")
    run()
    assert sum(got, []) == [("a.go", "remove"), ("new/i.py", "create"), ("x/y/c.py", "write")]
    got.clear()
    run()
    assert sum(got, []) == []
    assert len(os.listdir(tmp_path / "state")) <= 3


def test_a_task_holds_its_own_files_alone(tmp_path):
    """A directory of the upper levels is read by all tasks, each of which keeps the names that are its own."""
    import tracemalloc

    from quarryloom.sources.trees import walk

    (tmp_path / "d").mkdir()
    for i in range(8_000):
        (tmp_path / "d" / f"f{i}").touch()
    tracemalloc.start()
    sizes = sum(1 for _ in walk(str(tmp_path), 0, 64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 60 < sizes < 200 and peak < 400_000
    rows = [r for part in range(64) for r in walk(str(tmp_path), part, 64)]
    assert len(rows) == 8_000 == len({r[0] for r in rows}) and {r[2] for r in rows} == {0}
