"""Symbols from lines of code, and looking them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.functions import text as X

# What a declaration looks like on its line, by language: (kind, expression with the name as its group). The first that fits counts.
PATTERNS = {
    "go": (("method", r"^func\s*\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("type", r"^type\s+(\w+)\s")),
    "typescript": (("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>"), ("class", r"^\s*(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*=")),
    "javascript": (("function", r"^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"), ("class", r"^\s*(?:export\s+)?class\s+(\w+)")),
    "python": (("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")),
    "rust": (("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", r"^\s*(?:pub\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(\w+)")),
    "java": (("class", r"^\s*(?:public\s+)?(?:abstract\s+|final\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s*(?:public|private|protected)\s+[\w<>\[\], ]+?\s(\w+)\s*\(")),
    "c": (("struct", r"^\s*struct\s+(\w+)\s*\{"), ("type", r"^\s*typedef\s+.*?(\w+)\s*;"), ("function", r"^[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*\)\s*\{?\s*$")),
    "cpp": (("class", r"^\s*class\s+(\w+)"), ("struct", r"^\s*struct\s+(\w+)"), ("function", r"^[A-Za-z_][\w\s\*&:<>]*?\b(\w+)\s*\([^;]*\)\s*(?:const\s*)?\{?\s*$")),
    "ruby": (("function", r"^\s*def\s+(?:self\.)?(\w+[?!]?)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")),
    "php": (("method", r"^\s*(?:public|private|protected)\s+(?:static\s+)?function\s+(\w+)"), ("function", r"^\s*function\s+(\w+)"), ("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)")),
    "csharp": (("class", r"^\s*(?:public\s+)?(?:static\s+|abstract\s+|sealed\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("method", r"^\s*(?:public|private|protected)\s+[\w<>\[\], ]+?\s(\w+)\s*\(")),
    "kotlin": (("function", r"^\s*fun\s+(?:<[^>]*>\s*)?(\w+)"), ("class", r"^\s*(?:data\s+|open\s+|abstract\s+)*class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)")),
    "swift": (("function", r"^\s*(?:public\s+|private\s+|static\s+)*func\s+(\w+)"), ("class", r"^\s*(?:public\s+|final\s+)*class\s+(\w+)"), ("struct", r"^\s*(?:public\s+)?struct\s+(\w+)"), ("protocol", r"^\s*(?:public\s+)?protocol\s+(\w+)")),
}

SYMBOL_COLUMNS = ("repo_root", "name", "kind", "path", "line", "language", "pattern", "scope", "signature")


def _pattern_struct(line: Column, patterns: tuple) -> Column:
    out = F.lit(None).cast("struct<kind:string,name:string>")
    for kind, form in reversed(patterns):
        name = F.regexp_extract(line, form, 1)
        out = F.when(name != "", F.struct(F.lit(kind).alias("kind"), name.alias("name"))).otherwise(out)
    return out


def extract_symbols(files: DataFrame, language: str | Column | None = None, patterns: dict | None = None) -> DataFrame:
    """A row for each line that declares something: SYMBOL_COLUMNS, line from 1, each path, line and name once.

    files: repo_root, path, text. The language is that of the path's
    extension unless given. signature is the declaring line without white space around it.
    """
    patterns = patterns or PATTERNS
    lang = X.language("path", "pattern") if language is None else F.lit(language) if isinstance(language, str) else language
    lines = files.filter(F.col("text").isNotNull()).select("repo_root", "path", lang.alias("language"), F.posexplode(X.lines_of("text")).alias("i", "text"))
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for name, forms in patterns.items():
        found = F.when(F.col("language") == name, _pattern_struct(F.col("text"), forms)).otherwise(found)
    hits = lines.filter("language is not null").withColumn("hit", found).filter("hit is not null")
    out = hits.select("repo_root", F.col("hit.name").alias("name"), X.normalized_kind("hit.kind").alias("kind"), "path", (F.col("i") + 1).cast("int").alias("line"), "language", F.col("hit.kind").alias("pattern"), F.lit(None).cast("string").alias("scope"), F.trim("text").alias("signature"))
    return unique_symbols(out)


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """The first row, by kind and signature, of each repository, path, line and name."""
    w = Window.partitionBy("repo_root", "path", "line", "name").orderBy("kind", "signature")
    return symbols.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def from_tags(tags: DataFrame, repo_root: str) -> DataFrame:
    """Symbols from exported tag rows: name, path, line, kind, language, pattern, scope, scopeKind, signature; paths relative to repo_root."""
    prefix = repo_root.rstrip("/") + "/"
    path = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 30)).otherwise(F.col("path"))
    rows = tags.select(
        F.lit(repo_root).alias("repo_root"), "name", X.normalized_kind("kind").alias("kind"), path.alias("path"), F.col("line").cast("int").alias("line"), F.lower("language").alias("language"), "pattern",
        X.scope_of("scopeKind", "scope").alias("scope"), X.null_if_empty("signature").alias("signature"),
    )
    return unique_symbols(rows)


def find_symbols(symbols: DataFrame, name: str, kind: str | None = None, limit: int = 50, case_sensitive: bool = False, raw_pattern: bool = False) -> DataFrame:
    """Symbols whose name contains name: equal names first, then those that begin with it; by name, path and line. limit 0 gives all."""
    own, want = (F.col("name"), name) if case_sensitive else (F.lower("name"), name.lower())
    like = X.like_pattern(want, raw_pattern)
    rank = F.when(own == want, 0).when(own.like(like + "%"), 1).otherwise(2)
    rows = symbols.filter(own.like("%" + like + "%"))
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    rows = rows.withColumn("match", rank).orderBy("match", "name", "path", "line")
    return (rows.limit(limit) if limit > 0 else rows)


def list_definitions(symbols: DataFrame, repo_root: str, path: str) -> DataFrame:
    return symbols.filter((F.col("repo_root") == repo_root) & (F.col("path") == path)).orderBy("line", "name")
