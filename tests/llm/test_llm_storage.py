"""Scratch tables: where they go and when they go away."""

import os
from types import SimpleNamespace

import pytest

from quarryloom.llm import storage


def fake(master, folder=None):
    conf = SimpleNamespace(get=lambda name, default=None: folder if name == "spark.checkpoint.dir" else default)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(fake(master))
    assert storage.shared_dir(fake(master, "hdfs:///scratch/")) == "hdfs:///scratch"


def test_one_machine_has_its_own(tmp_path):
    for master in ("local", "local[*]", "local[4,2]"):
        assert storage.shared_dir(fake(master)).startswith("file://")


def test_scratch_is_removed(spark):
    folder = storage.shared_dir(spark).removeprefix("file://")
    a, b, c = (storage.settle(spark.range(n), f"mine{n}") for n in (0, 3, 5))
    assert b.count() == 3 and len([f for f in os.listdir(folder) if f.startswith("mine")]) == 3
    storage.drop_settled(b)
    assert sorted(f.split("-")[0] for f in os.listdir(folder) if f.startswith("mine")) == ["mine0", "mine5"]
    assert storage.clear_scratch(spark) >= 2 and not [f for f in os.listdir(folder) if f.startswith("mine")]
    assert storage.clear_scratch(spark) == 0


def test_what_the_session_says_of_batches_stays(spark):
    before = spark.conf.get(storage.BATCH_CONF)
    spark.conf.set(storage.BATCH_CONF, "12345")
    storage.prepare_workers(spark)
    assert spark.conf.get(storage.BATCH_CONF) == "12345"
    spark.conf.set(storage.BATCH_CONF, before)
