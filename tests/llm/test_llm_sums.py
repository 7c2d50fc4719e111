"""Sums over tasks equal those in one process, and the driver gets a bounded number of rows however many tasks there are."""

import numpy as np

from quarryloom.llm import quality_classifier as QC


def test_sums_over_tasks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for i in range(90)]
    table = spark.createDataFrame(rows, "doc_id long, x array<double>, m array<double>").repartition(9)
    f = lambda x, ids: np.concatenate([(x[0] * ids[:, None]).sum(0), x[1].sum(0), [len(ids)]])
    ids = np.arange(90)
    want = f((np.array([r[1] for r in rows]), np.array([r[2] for r in rows])), ids)
    got, collect = [], type(table).collect

    def counted(frame):
        rows = collect(frame)
        got.append(len(rows))
        return rows

    monkeypatch.setattr(type(table), "collect", counted)
    for merged, most in ((256, 9), (4, 4), (2, 2)):
        monkeypatch.setattr(QC, "MERGED", merged)
        over = QC.summed_over(table)
        got.clear()
        assert np.allclose(over(f), want) and np.allclose(over(f), want)
        assert len(got) == 2 and max(got) <= most
    assert QC.summed_over(table.filter("doc_id < 0"))(f) is None
