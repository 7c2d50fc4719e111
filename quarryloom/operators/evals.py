"""Measuring answers against what should have been found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.functions import text as X

# The two modes of a run.
WITH, WITHOUT = "with_mcp", "without_mcp"

CASE = "id string, category string, description string, prompt string, ground_truth struct<files:array<string>,symbols:array<string>,lines:map<string,array<int>>,content:array<string>>, difficulty string"
RUN = "test_case_id string, mode string, success boolean, output string, session_id string, duration_ns long, tokens_used long, input_tokens long, output_tokens long, cache_read_tokens long, cache_create_tokens long, cost_usd double, num_turns long, tool_call_count long, error string"


def _some(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def validate(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """For each run of a known case what its output names: test_case_id, mode, files_found, files_missed, symbols_found, symbols_missed, recall, precision, ref_precision, f1.

    Names count in any case. A file is found if the output contains it or names
    a path that contains it or lies in it. A failed run finds nothing and misses
    nothing. ref_precision is the recall if anything was found; precision is
    the share of the paths named in the output that are expected, and f1 goes by ref_precision.
    """
    files, symbols = _some(F.col("ground_truth.files")), _some(F.col("ground_truth.symbols"))
    both = runs.join(cases.select(F.col("id").alias("test_case_id"), files.alias("files"), symbols.alias("symbols")), "test_case_id")
    text = F.lower(F.coalesce("output", F.lit("")))
    rows = both.withColumn("text", text).withColumn("named", X.paths_in(F.coalesce("output", F.lit(""))))
    ok = F.coalesce("success", F.lit(False))
    file_in = lambda f: X.mentions_path("named", f) | F.col("text").contains(F.lower(f))
    symbol_in = lambda s: F.col("text").contains(F.lower(s))
    none = F.array().cast("array<string>")
    rows = rows.select(
        "test_case_id", "mode", "success", "files", "symbols", "named",
        F.when(ok, F.filter("files", file_in)).otherwise(none).alias("files_found"), F.when(ok, F.filter("files", lambda f: ~file_in(f))).otherwise(none).alias("files_missed"),
        F.when(ok, F.filter("symbols", symbol_in)).otherwise(none).alias("symbols_found"), F.when(ok, F.filter("symbols", lambda s: ~symbol_in(s))).otherwise(none).alias("symbols_missed"),
    )
    found, expected = F.size("files_found") + F.size("symbols_found"), F.size("files") + F.size("symbols")
    recall = F.coalesce(F.try_divide(found.cast("double"), expected.cast("double")), F.lit(0.0))
    right = F.size(F.filter("named", lambda n: X.mentions_path("files", n)))
    rows = rows.withColumn("recall", recall).withColumn("precision", F.when(ok, F.coalesce(F.try_divide(right.cast("double"), F.size("named").cast("double")), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("ref_precision", F.when(found > 0, F.col("recall")).otherwise(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("ref_precision") * F.col("recall"), F.col("ref_precision") + F.col("recall")), F.lit(0.0))
    return rows.withColumn("f1", f1).drop("files", "symbols", "named")


def compare(cases: DataFrame, validated: DataFrame) -> DataFrame:
    """A row for each case with a run: f1 and recall of both modes (0 without a run), accuracy_diff and winner (null if equal)."""
    pick = lambda m, c: F.coalesce(F.max(F.when(F.col("mode") == m, F.col(c))), F.lit(0.0))
    by_case = validated.groupBy("test_case_id").agg(pick(WITH, "f1").alias("with_f1"), pick(WITHOUT, "f1").alias("without_f1"), pick(WITH, "recall").alias("with_recall"), pick(WITHOUT, "recall").alias("without_recall"))
    diff = F.col("with_f1") - F.col("without_f1")
    rows = cases.select(F.col("id").alias("test_case_id"), "category", "description").join(by_case, "test_case_id")
    return rows.withColumn("accuracy_diff", diff).withColumn("winner", F.when(diff > 0, WITH).when(diff < 0, WITHOUT))


def summarize(runs: DataFrame, compared: DataFrame) -> DataFrame:
    """A row for each mode: runs, success_rate, means and sums of what runs cost, ref_accuracy (mean f1 of the cases above 0) and accuracy (of all cases)."""
    means = ("duration_ns", "input_tokens", "output_tokens", "cache_read_tokens", "cache_create_tokens", "tokens_used", "cost_usd", "num_turns")
    cost = runs.groupBy(F.when(F.col("mode") == WITH, WITH).otherwise(WITHOUT).alias("mode")).agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("double")).alias("success_rate"), *[F.avg(F.coalesce(c, F.lit(0))).alias(f"avg_{c}") for c in means], F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("total_cost_usd"), F.sum(F.coalesce("tool_call_count", F.lit(0))).alias("total_tool_calls"),
    )
    each = compared.select(F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(p + "_f1").alias("f1"), F.col(p + "_recall").alias("recall")) for m, p in ((WITH, "with"), (WITHOUT, "without"))])).alias("x")).select("x.*")
    accuracy = each.groupBy("mode").agg(F.coalesce(F.avg(F.when((F.col("f1") > 0) | (F.col("recall") > 0), F.col("f1"))), F.lit(0.0)).alias("ref_accuracy"), F.avg("f1").alias("accuracy"))
    return cost.join(accuracy, "mode", "left")


def reduction(baseline: Column, new: Column) -> Column:
    """By how many per cent new is less than baseline; 0 if that is 0."""
    return F.when(baseline == 0, 0.0).otherwise((baseline - new) / F.nullif(baseline, F.lit(0.0)) * 100)


def reductions(summary: DataFrame, columns: tuple[str, ...] = ("avg_duration_ns", "avg_tokens_used", "avg_cost_usd", "avg_num_turns")) -> DataFrame:
    """One row: by how much the mode with tools costs less, in per cent."""
    pick = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c).cast("double")))
    return summary.agg(*[reduction(pick(WITHOUT, c), pick(WITH, c)).alias(c.removeprefix("avg_") + "_reduction") for c in columns])


def parse_log_name(path: Column) -> Column:
    """struct<timestamp, test_case, mode> of a log file's name, yyyy-MM-dd-HHmmss-case-mode.log; null if it isn't one."""
    form = r"(?:^|/)(\d{4}-\d{2}-\d{2}-\d{6})-([^/]+)-(with_mcp|without_mcp)(?:\.log)?$"
    part = lambda i: F.regexp_extract(path, form, i)
    return F.when(part(1) != "", F.struct(F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd-HHmmss")).alias("timestamp"), part(2).alias("test_case"), part(3).alias("mode")))
