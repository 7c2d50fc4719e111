"""Reading source trees and the files around an index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom import schemas
from quarryloom.functions import text as X
from quarryloom.operators.evals import CASE, RUN, parse_log_name
from quarryloom.operators.merkle import not_ignored


def gitignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regular expression for relative paths, whether a match brings a path back); None for blank lines and comments."""
    line = pattern.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    inside = line.rstrip("/")
    anchored = "/" in inside
    only_dir = line.endswith("/")
    body, i = "", 0
    inside = inside.removeprefix("/")
    while i < len(inside):
        if inside.startswith("**/", i):
            body, i = body + "(?:[^/]+/)*", i + 3
        elif inside.startswith("**", i):
            body, i = body + ".*", i + 2
        elif inside[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif inside[i] == "?":
            body, i = body + "[^/]", i + 1
        elif inside[i] == "[" and "]" in inside[i + 1 :]:
            end = inside.index("]", i + 1)
            kept = inside[i + 1 : end]
            body, i = body + "[" + ("^" + kept[1:] if kept.startswith("!") else kept) + "]", end + 1
        elif inside[i] == "\\" and i + 1 < len(inside):
            body, i = body + re.escape(inside[i + 1]), i + 2
        else:
            body, i = body + re.escape(inside[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if only_dir else "(?:/.*)?$"), back


def gitignored(path: Column, patterns: list[str]) -> Column:
    """Whether the patterns leave the path out; the last one that matches counts."""
    out = F.lit(False)
    for p in patterns:
        if (rule := gitignore_regex(p)) is not None:
            out = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(out)
    return out


def ignore_patterns(spark: SparkSession, root: str, everywhere: str | None = None) -> list[str]:
    """The patterns of the file everywhere, which holds for all trees, and then of root's own .gitignore; files that aren't there add none."""
    out: list[str] = []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in (everywhere, root.rstrip("/") + "/.gitignore"):
        at = jvm.org.apache.hadoop.fs.Path(name) if name else None
        if at is not None and at.getFileSystem(conf).exists(at):
            stream = at.getFileSystem(conf).open(at)  # a reader would pass over a name that begins with a dot
            try:
                out += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
            finally:
                stream.close()
    return out


def read_tree(spark: SparkSession, root: str, purpose: str | None = "symbols", ignore: list[str] | None = None, repo_root: str | None = None, everywhere: str | None = None) -> DataFrame:
    """files below root: repo_root, path (relative), mtime, size, text. purpose picks the extensions, None takes all.

    Left out is what the file everywhere, root's own .gitignore and the
    patterns in ignore say, in this order.

    Names are tested before contents are decoded, so contents of other files
    aren't kept. Bytes that aren't UTF-8 are replaced; files with a zero byte are left out as binary.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[A-Za-z][\w+.-]*:/*", "/", root).rstrip("/")
    whole = F.regexp_replace(F.col("path"), r"^[A-Za-z][\w+.-]*:/*", "/")
    path = F.when(whole.startswith(base + "/"), F.substring(whole, len(base) + 2, 1 << 30)).otherwise(whole)
    rows = raw.withColumn("path", path).filter(not_ignored(F.col("path")))
    if purpose:
        rows = rows.filter(X.is_code_file("path", purpose))
    if patterns := ignore_patterns(spark, root, everywhere) + (ignore or []):
        rows = rows.filter(~gitignored(F.col("path"), patterns))
    rows = rows.filter(F.position(F.lit(b"\x00"), F.col("content")) == 0)
    return rows.select(F.lit(repo_root or root).alias("repo_root"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def changed_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """files that are new or whose time or size isn't that of indexed (repo_root, path, mtime, size)."""
    return files.join(indexed.select("repo_root", "path", "mtime", "size"), ["repo_root", "path", "mtime", "size"], "left_anti")


def deleted_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    return indexed.select("repo_root", "path").join(files.select("repo_root", "path"), ["repo_root", "path"], "left_anti")


def documents_as_files(documents: DataFrame) -> DataFrame:
    """A table of documents in the place of a source tree: source as repository, doc_id as path."""
    return documents.select(F.col("source").alias("repo_root"), F.col("doc_id").cast("string").alias("path"), "text", F.col("lang").alias("language"))


def parse_match_lines(lines: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    """(path, line, text) from path:line:text output of a line searcher; other lines are left out."""
    form = r"^([^:]*):([0-9]+):(.*)$"
    prefix = root.rstrip("/") + "/"
    path = F.regexp_extract(column, form, 1)
    path = F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path) if root else path
    return lines.filter(F.col(column).rlike(form)).select(path.alias("path"), F.regexp_extract(column, form, 2).cast("int").alias("line"), F.regexp_extract(column, form, 3).alias("text"))


def parse_match_events(lines: DataFrame, root: str = "", column: str = "value") -> DataFrame:
    """(path, line, text) from JSON events of type match; text that came as base64 bytes is decoded."""
    text = "struct<text:string,bytes:string>"
    e = F.from_json(F.col(column), f"type string, data struct<path:{text},lines:{text},line_number:int>")
    rows = lines.select(e.alias("e")).filter("e.type = 'match'")
    read = lambda c: F.coalesce(F.col(f"e.data.{c}.text"), F.make_valid_utf8(F.unbase64(f"e.data.{c}.bytes").cast("string")))
    prefix = root.rstrip("/") + "/"
    path = F.when(read("path").startswith(prefix), F.substring(read("path"), len(prefix) + 1, 1 << 30)).otherwise(read("path")) if root else read("path")
    return rows.select(path.alias("path"), F.col("e.data.line_number").alias("line"), F.regexp_replace(read("lines"), r"\r?\n$", "").alias("text"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    """Exported tags, a JSON object on each line; rows of other types are left out."""
    rows = spark.read.schema("_type string, name string, path string, line int, kind string, language string, pattern string, scope string, scopeKind string, signature string").json(path)
    return rows.filter("_type is null or _type = 'tag'").drop("_type")


def read_cases(spark: SparkSession, folder: str, categories: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """Evaluation cases from the .jsonl files of a folder and of those directly in it; blank lines and // comments are passed over."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder).select(F.trim("value").alias("value"), F.input_file_name().alias("file"))
    depth = F.size(F.split(F.regexp_replace("file", "^.*?" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/", ""), "/"))
    rows = lines.filter((depth <= 2) & (F.col("value") != "") & ~F.col("value").startswith("//")).select(F.from_json("value", CASE, {"mode": "FAILFAST"}).alias("c")).select("c.*")
    if categories:
        rows = rows.filter(F.col("category").isin(*categories))
    return rows.filter(F.col("id").isin(*ids)) if ids else rows


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Recorded runs, a JSON object on each line."""
    return spark.read.schema(RUN).json(path)


def run_results(lines: DataFrame, column: str = "value") -> DataFrame:
    """What the result events of recorded stream-JSON output say: output, success, session_id, duration_ns, turns, cost and tokens."""
    usage = "struct<input_tokens:long,output_tokens:long,cache_read_input_tokens:long,cache_creation_input_tokens:long>"
    e = F.from_json(F.col(column), f"type string, is_error boolean, result string, session_id string, duration_ms long, num_turns long, total_cost_usd double, usage {usage}")
    rows = lines.select(e.alias("e")).filter("e.type = 'result'").select("e.*", "e.usage.*")
    return rows.select(F.col("result").alias("output"), (~F.coalesce("is_error", F.lit(False))).alias("success"), "session_id", (F.col("duration_ms") * 1_000_000).alias("duration_ns"), "num_turns", F.col("total_cost_usd").alias("cost_usd"), "input_tokens", "output_tokens", F.col("cache_read_input_tokens").alias("cache_read_tokens"), F.col("cache_creation_input_tokens").alias("cache_create_tokens"))


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, timestamp, test_case, mode, text) of the logs of runs in folder, by their names; other files are left out."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(folder)
    rows = raw.select("path", parse_log_name(F.col("path")).alias("of"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return rows.filter("of is not null").select("path", "of.*", "text")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Projects from a JSON document {"projects": [...]}."""
    rows = spark.read.option("multiLine", "true").schema(f"projects array<struct<{', '.join(c.replace(' ', ':', 1) for c in schemas.PROJECTS.split(', '))}>>").json(path)
    return rows.select(F.explode("projects").alias("p")).select("p.*")


def add_project(projects: DataFrame, path: str, name: str | None = None, most: int = 50) -> DataFrame:
    """projects with one more; unchanged if it is there, ValueError beyond most."""
    rows = projects.select("path").collect()  # most rows at most
    if any(r[0] == path for r in rows):
        return projects
    if len(rows) >= most:
        raise ValueError(f"no more than {most} projects")
    new = projects.sparkSession.range(1).select(F.lit(path).alias("path"), F.lit(name or path.rstrip("/").rsplit("/", 1)[-1]).alias("name"), F.lit(True).alias("watch_enabled"), F.current_timestamp().alias("added_at"))
    return projects.unionByName(new, allowMissingColumns=True)


def get_project(projects: DataFrame, path: str) -> DataFrame:
    return projects.filter(F.col("path") == path)


def remove_project(projects: DataFrame, path: str) -> DataFrame:
    """projects without that one; ValueError if it isn't there."""
    if get_project(projects, path).isEmpty():
        raise ValueError(f"no such project: {path}")
    return projects.filter(~F.col("path").eqNullSafe(F.lit(path)))


def set_project(projects: DataFrame, path: str, **values) -> DataFrame:
    """projects with new values in the row of that path: watch_enabled, last_indexed, symbols, embeddings, db_bytes."""
    return projects.withColumns({c: F.when(F.col("path") == path, F.lit(v).cast(dict(projects.dtypes)[c])).otherwise(F.col(c)) for c, v in values.items()})


def watched(projects: DataFrame) -> DataFrame:
    return projects.filter("watch_enabled")


def in_order(projects: DataFrame) -> DataFrame:
    """(project, since): the order in which projects were added; by path where that isn't known."""
    since = F.col("added_at").cast("timestamp") if "added_at" in projects.columns else F.lit(None).cast("timestamp")
    return projects.select(F.col("path").alias("project"), F.coalesce(since, F.timestamp_seconds(F.lit(0))).alias("since"))


def owner(path: Column, projects: DataFrame) -> Column:
    """The first project, as they were added, that contains a path; what lies in a hidden part right below it doesn't count. Null if none does.

    One expression over the projects, which add_project() limits, so paths are neither joined nor moved.
    """
    out = F.lit(None).cast("string")
    for p in reversed([r["project"] for r in in_order(projects).orderBy("since", "project").collect()]):
        out = F.when(path.startswith(p + "/") & ~path.startswith(p + "/."), F.lit(p)).otherwise(out)
    return out


def project_of(paths: DataFrame, projects: DataFrame) -> DataFrame:
    """paths (path, ...) with the project that owns each."""
    return paths.withColumn("project", owner(F.col("path"), projects))
