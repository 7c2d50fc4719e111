"""Reports, registries and tables from databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.functions import formats
from quarryloom.operators import evals


def write_report(compared: DataFrame, summary: DataFrame, folder: str) -> None:
    """An evaluation's rows as JSON lines: folder/results and folder/summary."""
    compared.write.mode("overwrite").json(f"{folder}/results")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def text_report(compared: DataFrame, summary: DataFrame, cases: int = 50) -> str:
    """The same for people to read: both modes side by side and the first cases by id. summary has two rows at most."""
    shown = summary.withColumn("time", formats.duration(F.round("avg_duration_ns").cast("long"))).collect()
    by = {r["mode"]: r for r in shown}
    lines = [f"{'':24}{evals.WITH:>16}{evals.WITHOUT:>16}"]
    for title, column, form in (("runs", "runs", "d"), ("success rate", "success_rate", ".1%"), ("accuracy", "accuracy", ".3f"), ("time", "time", "s"), ("tokens", "avg_tokens_used", ".0f"), ("turns", "avg_num_turns", ".1f"), ("total cost", "total_cost_usd", ".4f")):
        cells = [format(by[m][column], form) if m in by and by[m][column] is not None else "-" for m in (evals.WITH, evals.WITHOUT)]
        lines.append(f"{title:24}{cells[0]:>16}{cells[1]:>16}")
    lines.append("")
    for r in compared.orderBy("test_case_id").limit(cases).collect():
        lines.append(f"{r['test_case_id']:24}{r['with_f1']:>16.3f}{r['without_f1']:>16.3f}  {r['winner'] or 'equal'}")
    return "\n".join(lines)


def write_registry(projects: DataFrame, path: str) -> None:
    """Projects as one JSON document {"projects": [...]}; there are few of them by add_project()'s limit."""
    document = projects.orderBy("path").agg(F.to_json(F.struct(F.collect_list(F.struct(*projects.columns)).alias("projects"))).alias("value"))
    document.coalesce(1).write.mode("overwrite").text(path)


def read_database(spark: SparkSession, url: str, table: str, partition: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A database table through JDBC, in parts by a numeric column if there is one. The driver's jar has to be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition and bounds:
        reader = reader.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
