"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Each is written as Parquet in the
shared folder and read again before the next begins, so a lost executor costs
one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.decontaminate import decontaminate
from quarryloom.llm.exchange import HAS_WORDS
from quarryloom.llm.jaccard_join import jaccard_components
from quarryloom.llm.line_dedup import MIN_SITES, line_dedup
from quarryloom.llm.mixing import mix_sources
from quarryloom.llm.storage import drop_settled, settle
from quarryloom.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or of their sentences doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs.select(*COLUMNS), labels).filter("predicted = 0").select(*COLUMNS)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites in as many distinct texts; n_chars is that of the new text."""
    out = line_dedup(docs.select(*COLUMNS), min_texts=MIN_SITES)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id, and of rows with one id and one text a single one.

    Rows of one id with different texts are one node of the links and stay or
    go together. Rows without an id take no part in links; those with words
    and one text count as one document, those without words all stay.
    """
    component = jaccard_components(docs.select("doc_id", "text"))
    losers = component.filter("doc_id <> component_id").select(F.col("doc_id").alias("loser")).distinct()
    docs = docs.select(*COLUMNS)
    kept = docs.join(losers, F.col("doc_id") == F.col("loser"), "left_anti")
    again = settle(docs.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("rows")).filter("rows > 1").select("id"), "again")
    if again.isEmpty():
        return kept
    is_again = F.col("doc_id").eqNullSafe(F.col("id"))
    words = F.coalesce(F.col("text").rlike(HAS_WORDS), F.lit(False))
    repeated = kept.join(again, is_again, "left_semi")
    once = repeated.filter(words | F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return kept.join(again, is_again, "left_anti").unionByName(once).unionByName(repeated.filter(~words & F.col("doc_id").isNull()))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.filter("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document of which it takes words."""
    return mix_sources(docs, keep=("source",)).filter("taken > 0")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_boilerplate),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", remove_contaminated),
    ("mixing sources to target weights", mix),
]

#: The first stage is a trained model, which SQL can't express. tests/llm hold line dedup, the Jaccard join, decontamination and mixing
#: against SQL or brute force, and the model's scores and gradient against their definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix; the tables of the stages before the last are deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), "stage-" + "-".join(name.lower().split()))
        if before is not None:
            drop_settled(before)
        before = docs
    return docs
