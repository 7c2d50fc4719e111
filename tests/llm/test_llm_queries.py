"""The registered queries against DuckDB, their models on held-out labels, and the pipeline stage by stage."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline as P
from quarryloom.llm import queries as Q
from quarryloom.llm.line_dedup import line_dedup
from quarryloom.llm.quality_classifier import quality_classifier
from quarryloom.llm.quality_rules import quality_rules
from quarryloom.llm.storage import settle

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, oracle, rows_of, name):
    assert rows_of(Q.queries()[name](spark, SMALL)) == rows_of(oracle(Q.oracle_sql()[name]))


def test_line_stage_equals_sql(spark, oracle, rows_of):
    """The pipeline's reading of line dedup, in which copies of one text aren't boilerplate by that alone."""
    out = line_dedup(spark.read.parquet(f"{MIDDLE}/documents.parquet"), min_texts=10)
    out = out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    assert rows_of(out) == rows_of(oracle(Q.line_dedup_sql(min_texts=10), MIDDLE))


def test_registered():
    assert {n.split("_")[0] for n in Q.queries()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", ["op2_url_filter", "op3_quality_rules", "op5_license_scan", "op6_quality_classifier", "op8_toxicity"])
def test_covers_the_table(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op2") else ("documents", "doc_id")
    ids = lambda df: sorted(r[0] for r in df.select(key).collect())
    assert ids(Q.queries()[name](spark, SMALL)) == ids(spark.read.parquet(f"{SMALL}/{table}.parquet"))


def labels(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").filter("toxic is not null")


def test_toxicity_on_held_out_labels(spark):
    out = Q.queries()["op8_toxicity"](spark, "/root/testdata/sf0.1").join(labels(spark, "/root/testdata/sf0.1"), "doc_id").filter("held_out").select("toxic", "predicted").collect()
    bad = [r for r in out if r["toxic"] == 1]
    assert len(bad) > 50 and sum(r["predicted"] for r in bad) >= 0.85 * len(bad)  # some junk is labelled toxic without a toxic word
    assert sum(r["predicted"] for r in out if r["toxic"] == 0) <= 0.01 * len(out)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op6_quality_classifier"])
def test_quality_on_labels(spark, name):
    out = Q.queries()[name](spark, MIDDLE).join(labels(spark, MIDDLE), "doc_id").collect()
    good, junk = [r for r in out if r["quality"] == 1], [r for r in out if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.93 * len(good) and sum(not r["kept"] for r in junk) >= 0.9 * len(junk)


def test_pipeline(spark, oracle):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]
    before = docs
    for name, stage in P.STAGES:
        after = settle(stage(spark, before, SMALL), "test")
        if name == "mixing sources to target weights":
            assert after.filter("taken <= 0 or taken > 3 * size").count() == 0
            target = after.select("source", "target").distinct().agg(F.sum("target")).first()[0]
            assert abs(after.agg(F.sum("taken")).first()[0] - target) <= after.select("source").distinct().count()
            break
        assert set(after.columns) == set(docs.columns)
        if name == "line dedup":
            assert after.count() == before.count()
        else:
            assert after.count() < before.count() and after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    # No near copies and no benchmark passages are left.
    again = P.one_of_each_group(spark, before, SMALL)
    assert again.count() == before.count() and P.remove_contaminated(spark, before, SMALL).count() == before.count()
    assert P.run(spark, SMALL).count() == after.count()


def test_pipeline_of_nothing_and_nulls(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (None, "a b", "en", "s", 3), (None, None, None, None, None), (2, "", "en", None, 0), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)], kinds)
    for rows in (docs, docs.limit(0)):
        d, left = rows, []
        for _, stage in P.STAGES:
            d = settle(stage(spark, d, SMALL), "test")
            left.append(d.count())
        # Rows of one id and text become one; documents without words aren't taken into the mix.
        assert left == ([7, 7, 5, 5, 2] if rows is docs else [0] * 5)


def test_one_of_each_group_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    near = text + " more"
    rows = [(5, text, "en", "a", 1), (5, text, "en", "b", 1), (6, near, "en", "a", 1), (7, "other words", "en", "a", 1), (7, "something else", "en", "a", 1), (None, "no id", "en", "a", 1), (None, "no id", "fr", "a", 1), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r["doc_id"], r["text"]) for r in P.one_of_each_group(spark, docs, "").collect()), key=repr)
    assert out == sorted([(5, text), (7, "other words"), (7, "something else"), (None, "no id"), (None, None), (None, None)], key=repr)


@pytest.mark.parametrize("name", ["op3_quality_rules", "op6_quality_classifier"])
def test_quality_on_labels_it_hasnt_seen(spark, name):
    """Fitted without a fifth of the labels, judged on that fifth."""
    d = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    judge = quality_rules if name.startswith("op3") else quality_classifier
    out = judge(docs, marks.filter(~fold)).join(marks.filter(fold), "doc_id").select("quality", "kept").collect()
    good, junk = [r["kept"] for r in out if r["quality"] == 1], [r["kept"] for r in out if r["quality"] == 0]
    found = {"good kept": sum(good) / len(good), "junk dropped": 1 - sum(junk) / len(junk), "good of kept": sum(good) / (sum(good) + sum(junk))}
    print(name, len(good), len(junk), found)
    assert len(junk) > 50 and found["good kept"] >= 0.93 and found["junk dropped"] >= 0.9 and found["good of kept"] >= 0.95
