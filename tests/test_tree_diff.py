"""Directory hashes fed from sorted rows, and the descent that compares only what differs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarryloom.operators import merkle as M


def files(spark, paths):
    return spark.createDataFrame(sorted(paths.items()), "path string, text string").repartition(3)


def by_hand(paths, names):
    tree = {p: hashlib.sha256(t.encode()).hexdigest() for p, t in paths.items()}
    dirs = {"/".join(p.split("/")[:i]) for p in paths for i in range(len(p.split("/")))}
    for d in sorted(dirs, key=lambda d: -(0 if d == "" else d.count("/") + 1)):
        kids = sorted((p for p in tree if p != "" and p.rpartition("/")[0] == d), key=str.encode)
        fed = "".join(f"{p.rpartition('/')[2]}\0{tree[p]}\0" if names else tree[p] for p in kids)
        tree[d] = hashlib.sha256(fed.encode()).hexdigest()
    return tree


@pytest.mark.parametrize("names", [False, True])
def test_hashes_by_hand(spark, names):
    rng = random.Random(names)
    paths = {"/".join(rng.choice(["a", "b", "c-d", "é"]) for _ in range(rng.randint(0, 3))) + ("/" if rng.random() < 0.9 else "") + f"f{i}": f"t{i % 7}" for i in range(60)}
    paths = {p.lstrip("/"): t for p, t in paths.items()}
    got = {r["path"]: r["hash"] for r in M.rollup(M.file_nodes(files(spark, paths)), names=names).collect()}
    assert got == by_hand(paths, names)


def test_a_directory_of_many_children_passes_in_batches(spark):
    n = 50_000  # five Arrow batches of one parent
    nodes = M.file_nodes(spark.range(n).select(F.format_string("big/%06d", "id").alias("path"), F.col("id").cast("string").alias("text")))
    got = {r["path"]: (r["hash"], r["size"]) for r in M.rollup(nodes).filter("is_dir").collect()}
    fed = hashlib.sha256("".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)).encode()).hexdigest()
    assert got["big"] == (fed, sum(len(str(i)) for i in range(n)))


def changed(spark, tmp_path, old, new):
    trees = [M.save_tree(M.rollup(M.file_nodes(files(spark, p)), names=True), f"file://{tmp_path}/{i}") for i, p in enumerate((old, new))]
    rows, compared = M.pruned_diff(*trees)
    got = sorted((r["path"], r["change"]) for r in rows.collect())
    assert got == sorted((r["path"], r["change"]) for r in M.diff(*trees).collect())
    return got, compared


def test_one_change_compares_a_handful(spark, tmp_path):
    old = {f"d{i}/e{j}/f{k}": "x" for i in range(10) for j in range(10) for k in range(10)}
    assert changed(spark, tmp_path / "a", old, old) == ([], 1)
    new = old | {"d3/e4/f5": "y"}
    assert changed(spark, tmp_path / "b", old, new) == ([("d3/e4/f5", "modified")], 1 + 10 + 10 + 10)


def test_renames_new_and_lost_directories_and_files_that_become_directories(spark, tmp_path, monkeypatch):
    old = {"a/b": "x", "a/c": "x", "a/z": "x", "k": "x", "was/file": "1", "gone/deep/f": "2", "same/f": "3"}
    new = {"a/b": "x", "a/d": "x", "a/z": "x", "k/now": "x", "was/file/under": "1", "new/deep/g": "2", "same/f": "3"}
    want = [("a/c", "deleted"), ("a/d", "added"), ("gone/deep/f", "deleted"), ("k", "deleted"), ("k/now", "added"), ("new/deep/g", "added"), ("was/file", "deleted"), ("was/file/under", "added")]
    assert changed(spark, tmp_path / "a", old, new)[0] == want
    monkeypatch.setattr(M, "ASKED", 1)  # directories are joined
    assert changed(spark, tmp_path / "b", old, new)[0] == want
