"""Text and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryloom.functions import lookups as L

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(literal, key), otherwise)


def content_hash(content: Text) -> Column:
    """SHA-256 of the UTF-8 bytes, in lowercase hex."""
    return F.sha2(col(content).cast("binary"), 256)


def lines_of(text: Text) -> Column:
    """\\n-separated lines; a newline at the end gives an empty last one."""
    return F.split(col(text), "\n", -1)


def file_lines(text: Text) -> Column:
    """Lines as a reader counts them: a newline at the end begins no further line."""
    parts = lines_of(text)
    return F.when(col(text).endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_slice(text: Text, start: Text | int, end: Text | int) -> Column:
    """Lines start to end, counted from 1, both included; to the last line if end is 0. A start beyond it raises an error."""
    parts = file_lines(text)
    first = F.greatest(F.lit(1), F.lit(start) if isinstance(start, int) else col(start))
    last = F.lit(end) if isinstance(end, int) else col(end)
    last = F.when(last <= 0, F.size(parts)).otherwise(F.least(last, F.size(parts)))
    return F.when(first > F.size(parts), F.raise_error(F.lit("start line is beyond the end of the file")).cast("string")).otherwise(
        F.array_join(F.slice(parts, first.cast("int"), F.greatest(F.lit(0), last - first + 1).cast("int")), "\n")
    )


def extension(path: Text, lower: bool = True) -> Column:
    """What follows the last dot of the base name, without the dot; empty without one."""
    ext = F.regexp_extract(col(path), r"\.([^./]*)$", 1)
    return F.lower(ext) if lower else ext


def language(path: Text, table: str = "record") -> Column:
    """The language of a file by its extension: table is pattern, chunk or record; unknown ones are null, or "unknown" for record."""
    if table == "record":
        return mapped(extension(path, lower=False), L.by_name(L.RECORD_LANGUAGES), F.lit("unknown"))
    known = L.PATTERN_LANGUAGES if table == "pattern" else L.CHUNK_LANGUAGES
    return mapped(extension(path), L.by_name(known), F.lit(None).cast("string"))


def is_code_file(path: Text, purpose: str = "symbols") -> Column:
    if purpose == "symbols":
        return extension(path).isin(*L.SYMBOL_FILES)
    return extension(path, lower=False).isin(*(L.EMBED_FILES if purpose == "embed" else L.WATCH_FILES))


def normalized_kind(kind: Text) -> Column:
    return mapped(F.lower(col(kind)), L.by_name(L.KINDS), col(kind))


def name_in(text: Text) -> Column:
    """The name that a matched text declares: known words come off its front, each once and in order, and it ends before ( { < : or =."""
    rest = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    for p in L.NAME_PREFIXES:
        rest = F.regexp_replace(rest, f"^{p}", "")
    name = F.regexp_extract(rest, r"^[({<:=]*([^({<:=]+)", 1)
    return F.when(name == "", F.lit("unknown")).otherwise(F.trim(name))


def scope_of(kind: Text, scope: Text) -> Column:
    """kind:scope, or the scope alone; null without a scope."""
    k, s = null_if_empty(kind), null_if_empty(scope)
    return F.when(s.isNotNull(), F.concat_ws(":", k, s))


def hard_truncated(text: Text, length: int = 500) -> Column:
    t = col(text)
    return F.when(F.length(t) > length, F.concat(F.substring(t, 1, length), F.lit("..."))).otherwise(t)


def soft_truncated(text: Text, length: int) -> Column:
    """As many whole lines as fit into length, and a line of dots; the bare beginning if not even one fits."""
    t = col(text)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"), F.lit(False).alias("stop"))

    def add(s: Column, line: Column) -> Column:
        full = s["stop"] | (s["n"] + F.length(line) + 1 > length)
        out = F.when(s["n"] > 0, F.concat(s["out"], F.lit("\n"), line)).otherwise(line)
        return F.when(full, F.struct(s["out"].alias("out"), s["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(F.struct(out.alias("out"), F.length(out).alias("n"), F.lit(False).alias("stop")))

    whole = F.aggregate(lines_of(t), state, add, lambda s: s["out"])
    return F.when(F.length(t) <= length, t).when(whole == "", F.concat(F.substring(t, 1, length), F.lit("..."))).otherwise(F.concat(whole, F.lit("\n...")))


def snippet_label(path: Text, start: Text, end: Text) -> Column:
    return F.format_string("[%s:%d-%d] (%d lines)", col(path), col(start).cast("long"), col(end).cast("long"), (col(end) - col(start) + 1).cast("long"))


def keyword_id(path: Text, line: Text) -> Column:
    return F.concat_ws(":", col(path), col(line).cast("string"))


def chunk_id(path: Text, start: Text, end: Text) -> Column:
    return F.concat_ws(":", col(path), col(start).cast("string"), col(end).cast("string"))


def symbol_id(path: Text, line: Text, name: Text) -> Column:
    return F.concat_ws(":", col(path), col(line).cast("string"), col(name))


def range_key(path: Text, start: Text, end: Text) -> Column:
    return F.concat(col(path), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))


def null_if_empty(text: Text) -> Column:
    return F.nullif(col(text), F.lit(""))


def empty_if_null(text: Text) -> Column:
    return F.coalesce(col(text), F.lit(""))


def from_epoch(seconds: Text) -> Column:
    return F.timestamp_seconds(col(seconds))


def to_epoch(ts: Text) -> Column:
    return F.unix_timestamp(col(ts).cast("timestamp"))


def paths_in(text: Text) -> Column:
    """Distinct paths named in free text, those with a known extension first, each kind in the order of its places."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(col(text), F.lit(p), F.lit(0)) for p in L.PATH_PATTERNS]))


def mentions_path(paths: Text, target: Text) -> Column:
    """Whether one of the paths contains the target or lies in it, whatever the case."""
    t = F.lower(col(target))
    return F.exists(col(paths), lambda p: F.lower(p).contains(t) | t.contains(F.lower(p)))


def like_pattern(name: str, raw: bool = False) -> str:
    """name for use inside LIKE, its wildcards escaped unless raw."""
    return name if raw else name.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def version_at_least(version: Text, least: str) -> Column:
    """Compares major.minor.patch by numbers; missing or unreadable parts count as 0."""
    want = [int(x) if x.isdigit() else 0 for x in (least.split(".") + ["0", "0"])[:3]]
    have = [F.coalesce(F.try_element_at(F.split(col(version), r"\."), F.lit(i + 1)).try_cast("int"), F.lit(0)) for i in range(3)]
    return F.array(*have) >= F.array(*[F.lit(x) for x in want])
