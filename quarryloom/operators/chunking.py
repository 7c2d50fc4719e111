"""Files into chunks of lines."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.config import ChunkConfig
from quarryloom.functions import lookups as L
from quarryloom.functions import text as X

DEFAULTS = ChunkConfig()
KEYS = ("repo_root", "path")


def _starts(n: Column, size: int, overlap: int) -> Column:
    """0-based first lines of frames of that size, each overlap lines before the end of the last; the last reaches the end."""
    step = max(1, size - overlap)
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step) * step).cast("int"), F.lit(step))


def _cut(lines: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(lines, (start + 1).cast("int"), (end - start).cast("int")), "\n")


def fixed_chunks(files: DataFrame, size: int = DEFAULTS.fallback_lines, overlap: int = DEFAULTS.fallback_overlap) -> DataFrame:
    """Chunks for files of which nothing more is known: whole if they have size lines or fewer, else frames of that size.

    files: repo_root, path, text. Returns those two with start_line, end_line
    (from 1), start_byte, end_byte, content, content_hash, node_type "block" and
    language "unknown". A null text has no chunks, an empty one has one.
    """
    # Each frame's lines up to the next one's start, in bytes: the bytes before a frame are a sum over the frames before it.
    step = max(1, size - overlap)
    lines = files.filter(F.col("text").isNotNull()).select(*KEYS, X.lines_of("text").alias("lines"))
    framed = lines.withColumn("starts", _starts(F.size("lines"), size, overlap))
    bytes_of = F.transform("starts", lambda s: F.octet_length(_cut(F.col("lines"), s, s + step)) + 1)
    rows = framed.withColumn("bytes", bytes_of).select(*KEYS, "lines", "bytes", F.posexplode("starts").alias("i", "start"))
    end = F.least(F.col("start") + size, F.size("lines"))
    before = F.aggregate(F.slice("bytes", 1, F.col("i")), F.lit(0).cast("long"), lambda a, b: a + b)
    content = _cut(F.col("lines"), F.col("start"), F.col("end"))
    out = rows.withColumn("end", end).withColumn("content", content).withColumn("start_byte", before)
    more = F.when(F.col("end") < F.size("lines"), 1).otherwise(0)  # the newline after the last line
    return out.select(
        *KEYS, (F.col("start") + 1).cast("int").alias("start_line"), F.col("end").cast("int").alias("end_line"), "start_byte",
        (F.col("start_byte") + F.octet_length("content") + more).cast("long").alias("end_byte"), "content", X.content_hash("content").alias("content_hash"),
        F.lit("block").alias("node_type"), F.lit(None).cast("string").alias("node_name"), F.lit("unknown").alias("language"),
    )


def _frames(n: Column, size: int, overlap: int, least: int) -> Column:
    """(start, end) of the frames over n lines, without those of fewer than least lines; all n lines if none is left."""
    all_of = F.transform(_starts(n, size, overlap), lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))
    long_enough = F.filter(all_of, lambda f: f["end"] - f["start"] >= least)
    return F.when(F.size(long_enough) > 0, long_enough).otherwise(F.array(F.struct(F.lit(0).alias("start"), n.alias("end"))))


def line_chunks(files: DataFrame, size: int = DEFAULTS.line_lines, overlap: int = DEFAULTS.line_overlap, least: int = DEFAULTS.least_lines) -> DataFrame:
    """Overlapping frames of lines: repo_root, path, start_line, end_line, content, kind "fixed"."""
    lines = files.filter(F.col("text").isNotNull()).select(*KEYS, X.lines_of("text").alias("lines"))
    rows = lines.select(*KEYS, "lines", F.explode(_frames(F.size("lines"), size, overlap, least)).alias("f"))
    return rows.select(*KEYS, (F.col("f.start") + 1).cast("int").alias("start_line"), F.col("f.end").cast("int").alias("end_line"), _cut(F.col("lines"), F.col("f.start"), F.col("f.end")).alias("content"), F.lit("fixed").alias("kind"))


def uncovered_runs(files: DataFrame, covered: DataFrame, least: int = 1) -> DataFrame:
    """Maximal runs of lines that no range of covered holds: repo_root, path, start_line, end_line.

    covered: repo_root, path, start_line, end_line; ranges may overlap. Sorted
    by start, a gap lies between the largest end so far and the next start; the
    window runs over a file's ranges.
    """
    sizes = files.filter(F.col("text").isNotNull()).select(*KEYS, F.size(X.lines_of("text")).alias("n"))
    ranges = covered.select(*KEYS, "start_line", "end_line").join(sizes.select(*KEYS), list(KEYS), "left_semi")
    ends = ranges.unionByName(sizes.select(*KEYS, (F.col("n") + 1).alias("start_line"), (F.col("n") + 1).alias("end_line")))
    w = Window.partitionBy(*KEYS).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    gaps = ends.withColumn("reached", F.coalesce(F.max("end_line").over(w), F.lit(0)))
    return gaps.filter(F.col("start_line") - F.col("reached") - 1 >= least).select(*KEYS, (F.col("reached") + 1).cast("int").alias("start_line"), (F.col("start_line") - 1).cast("int").alias("end_line"))


def symbol_chunks(files: DataFrame, symbols: DataFrame, size: int = DEFAULTS.line_lines, overlap: int = DEFAULTS.line_overlap, least: int = DEFAULTS.least_lines, tail: str = "dense") -> DataFrame:
    """Chunks that begin at symbols and end before the next one; the rest of the file in frames of lines.

    A symbol of fewer than least lines makes no chunk, its lines belong to the
    rest; one of more than size lines is split into frames. tail "reference"
    repeats the last overlap lines of a split symbol in a frame of their own. A file
    without symbols is line_chunks(). Returns repo_root, path, start_line,
    end_line, content, kind (the symbol's, or "fixed").
    """
    lines = files.filter(F.col("text").isNotNull()).select(*KEYS, X.lines_of("text").alias("lines"))
    bounds = symbols.filter(F.col("kind").isin(*L.BOUNDARY_KINDS)).select(*KEYS, "line", "kind").groupBy(*KEYS, "line").agg(F.min("kind").alias("kind"))
    following = F.lead("line").over(Window.partitionBy(*KEYS).orderBy("line"))
    ranged = bounds.withColumn("next", following).join(lines, list(KEYS)).filter(F.col("line") <= F.size("lines"))
    ranged = ranged.select(*KEYS, "kind", "line", F.least(F.coalesce(F.col("next") - 1, F.size("lines")), F.size("lines")).alias("last")).filter(F.col("last") - F.col("line") + 1 >= least)
    n = F.col("last") - F.col("line") + 1
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(_starts(n, size, overlap))
    frames = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))
    if tail == "reference":
        frames = F.when((n > size) & (F.lit(overlap) > 0), F.concat(frames, F.array(F.struct((n - overlap).cast("int").alias("start"), n.alias("end"))))).otherwise(frames)
    own = ranged.select(*KEYS, "kind", "line", F.explode(frames).alias("f")).select(*KEYS, (F.col("line") + F.col("f.start")).cast("int").alias("start_line"), (F.col("line") + F.col("f.end") - 1).cast("int").alias("end_line"), "kind")
    rest = uncovered_runs(files, ranged.select(*KEYS, F.col("line").alias("start_line"), F.col("last").alias("end_line")))
    m = F.col("end_line") - F.col("start_line") + 1
    rest = rest.select(*KEYS, "start_line", F.explode(_frames(m, size, overlap, least)).alias("f")).select(*KEYS, (F.col("start_line") + F.col("f.start")).cast("int").alias("start_line"), (F.col("start_line") + F.col("f.end") - 1).cast("int").alias("end_line"), F.lit("fixed").alias("kind"))
    return own.unionByName(rest).join(lines, list(KEYS)).select(*KEYS, "start_line", "end_line", _cut(F.col("lines"), F.col("start_line") - 1, F.col("end_line")).alias("content"), "kind")


# Structural chunks. Python is parsed; other languages are scanned, each character once, for declarations whose braces (or end words) are balanced.

# Node types by language (the names that grammars give them) and expressions for the lines that begin them.
DECLARATIONS = {
    "go": {"function_declaration": r"func\s+(\w+)", "method_declaration": r"func\s*\([^)]*\)\s*(\w+)", "type_declaration": r"type\s+(\w+)", "const_declaration": r"const\b\s*(\w*)", "var_declaration": r"var\b\s*(\w*)"},
    "javascript": {"export_statement": r"export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)?\s*\*?\s*(\w*)", "function_declaration": r"(?:async\s+)?function\s*\*?\s*(\w+)", "class_declaration": r"class\s+(\w+)", "arrow_function": r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>"},
    "rust": {"function_item": r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", "impl_item": r"impl\b[^{]*?(\w+)\s*(?:<[^{]*>)?\s*\{", "struct_item": r"(?:pub\s+)?struct\s+(\w+)", "enum_item": r"(?:pub\s+)?enum\s+(\w+)", "trait_item": r"(?:pub\s+)?trait\s+(\w+)", "mod_item": r"(?:pub\s+)?mod\s+(\w+)"},
    "java": {"class_declaration": r"(?:(?:public|private|protected|abstract|final|static)\s+)*class\s+(\w+)", "interface_declaration": r"(?:(?:public|private|protected|static)\s+)*interface\s+(\w+)"},
    "c": {"struct_specifier": r"(?:typedef\s+)?struct\s+(\w*)", "enum_specifier": r"(?:typedef\s+)?enum\s+(\w*)", "function_definition": r"[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*$"},
    "cpp": {"class_specifier": r"class\s+(\w+)", "struct_specifier": r"struct\s+(\w+)", "namespace_definition": r"namespace\s+(\w*)", "function_definition": r"[A-Za-z_][\w\s\*&:<>,]*?\b([\w:~]+)\s*\([^;]*$"},
    "ruby": {"class": r"class\s+(\w+)", "module": r"module\s+(\w+)", "singleton_method": r"def\s+self\.(\w+[?!]?)", "method": r"def\s+(\w+[?!]?)"},
}
_NO_FLOW = r"(?!(?:return|new|else|throw|case|if|for|while|switch|try|catch|do|assert|yield|await|goto)\b)"
DECLARATIONS["javascript"]["method_definition"] = _NO_FLOW + r"(?:(?:static|async|get|set|public|private|protected|readonly|abstract|override)\s+)*\*?\s*([\w$#]+)\s*(?:<[^>(]*>)?\([^;]*\)\s*(?::[^={]+)?\{"
DECLARATIONS["java"]["constructor_declaration"] = r"(?:(?:public|private|protected)\s+)*([A-Z]\w*)\s*\([^;]*$"
DECLARATIONS["java"]["method_declaration"] = _NO_FLOW + r"(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?[\w<>\[\],.?]+\s+(\w+)\s*\("
DECLARATIONS["c"]["declaration"] = _NO_FLOW + r"(?:(?:static|extern|const|unsigned|volatile|struct|enum)\s+)*[A-Za-z_]\w*[\s\*]+(\w+)\s*(?:=[^;]*|\[[^\]]*\]|\([^)]*\))?\s*;\s*$"
DECLARATIONS["typescript"] = {**DECLARATIONS["javascript"], "interface_declaration": r"interface\s+(\w+)", "type_alias_declaration": r"type\s+(\w+)\s*="}
DECLARATIONS["tsx"] = DECLARATIONS["typescript"]

CHUNK_SCHEMA = "repo_root string, path string, start_line int, end_line int, start_byte long, end_byte long, content string, node_type string, node_name string, language string"


def _python_nodes(text: str) -> list[tuple[int, int, str, str, list]]:
    """(first line, last line, type, name, nodes inside) of definitions; none if the text can't be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last if it is nested too deep
        return []

    def of(body) -> list:
        out = []
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "decorated_definition" if node.decorator_list else "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                out.append((first, node.end_lineno, kind, node.name, of(node.body)))
            elif hasattr(node, "body") and isinstance(node.body, list):
                out += of(node.body + list(getattr(node, "orelse", [])))
        return out

    return of(tree.body)


def _scanned_nodes(lines: list[str], language: str) -> list[tuple[int, int, str, str, list]]:
    """Declarations at all levels, each up to where its braces close (for ruby: up to an end as far left), with those inside it."""
    forms = [(kind, re.compile(r"\s*" + p)) for kind, p in DECLARATIONS[language].items()]
    depth = [] if language == "ruby" else _depths(lines, language)
    found = []
    for i, line in enumerate(lines):
        if not line.strip() or (depth and depth[i][2]):
            continue
        hit = next(((kind, m) for kind, p in forms if (m := p.match(line))), None)
        if hit is None or hit[1].groups()[:1] and hit[1][1] in _WORDS_OF_FLOW:
            continue
        found.append((i, hit[0], (hit[1].groups() or ("",))[0] or ""))
    ends = _ruby_ends(lines, [i for i, *_ in found]) if language == "ruby" else _brace_ends(lines, depth, [i for i, *_ in found])
    out: list[tuple[int, int, str, str, list]] = []
    open_: list[tuple[int, int, str, str, list]] = []
    for (i, kind, name), last in zip(found, ends, strict=True):
        node = (i + 1, last + 1, kind, name, [])
        while open_ and open_[-1][1] < node[1]:
            open_.pop()
        (open_[-1][4] if open_ else out).append(node)
        open_.append(node)
    return out


#: What an expression for functions would take for a name.
_WORDS_OF_FLOW = frozenset(("if", "for", "while", "switch", "return", "else", "catch", "do", "case", "sizeof", "function"))


def _ruby_ends(lines: list[str], starts: list[int]) -> list[int]:
    """For each line that opens something the next line that says end and stands as far left or further; the last line without one."""
    ends = {}
    waiting: list[tuple[int, int]] = []
    opens = set(starts)
    for j, line in enumerate(lines):
        indent = len(line) - len(line.lstrip())
        if line.strip() == "end":
            while waiting and waiting[-1][0] >= indent:
                ends[waiting.pop()[1]] = j
        if j in opens:
            waiting.append((indent, j))
    return [ends.get(i, len(lines) - 1) for i in starts]


def _depths(lines: list[str], language: str) -> list[tuple[int, int, bool, bool]]:
    """For each line (braces and brackets open before it, after it, whether it begins inside a comment or text, whether a brace opens in it).

    Every character is looked at once. Strings, // and /* */ comments don't
    count; a rust lifetime isn't a string.
    """
    out, depth, inside = [], 0, ""
    for line in lines:
        before, began, braces, k = depth, bool(inside), False, 0
        while k < len(line):
            c = line[k]
            if inside == "*/":
                at = line.find("*/", k)
                k, inside = (len(line), inside) if at < 0 else (at + 1, "")
            elif inside:
                if c == "\\" and not (inside == "`" and language == "go"):
                    k += 1
                elif c == inside:
                    inside = ""
            elif line.startswith("//", k):
                break
            elif line.startswith("/*", k):
                inside, k = "*/", k + 1
            elif c == "'" and language == "rust" and line[k + 2 : k + 3] != "'" and line[k + 1 : k + 2] != "\\":
                pass
            elif c in "\"'`":
                inside = c
            elif c in "{([":
                depth, braces = depth + 1, braces or c == "{"
            elif c in "})]":
                depth -= 1
            k += 1
        if inside in ("'", '"'):  # ends with its line
            inside = ""
        out.append((before, depth, began, braces))
    return out


def _brace_ends(lines: list[str], depth: list[tuple[int, int, bool, bool]], starts: list[int]) -> list[int]:
    """For each of the starts the line that brings the depth back to what it was before, once something opened or the statement is over."""
    n = len(lines)
    # The first line from j on that ends at the depth d or below, by a stack over lines from the end.
    wanted: dict[int, list[tuple[int, int]]] = {}
    out = dict.fromkeys(starts, n - 1)
    for i in starts:
        j, base = i, depth[i][0]
        # A head goes on over lines until a bracket opens or it ends.
        while j < n - 1 and depth[j][1] <= base and not depth[j][3] and lines[j].rstrip().endswith((",", "=", "=>", "->", "|", "&", "+", ")", "(")) and lines[j + 1].strip()[:1] in ("{", "(", "=", "|", "&", "-", ":", "w") and j - i < 32:
            j += 1
        if depth[j][1] <= base:
            out[i] = j
        else:
            wanted.setdefault(j, []).append((base, i))
    stack: list[tuple[int, int, int]] = []  # (depth to come back to, start, line of its head)
    for j in range(n):
        for base, i in sorted(wanted.get(j, ()), key=lambda w: w[1]):
            stack.append((base, i, j))
        while stack and j > stack[-1][2] and depth[j][1] <= stack[-1][0]:
            base, i, head = stack.pop()
            # A signature's brackets may close before its body opens.
            if not any(d[3] for d in depth[head : j + 1]) and j < n - 1 and lines[j + 1].strip().startswith("{"):
                stack.append((base, i, j + 1))
                break
            out[i] = j
    return [out[i] for i in starts]


def chunk_text(text: str, language: str | None, max_bytes: int = DEFAULTS.max_bytes, least_gap: int = DEFAULTS.least_gap, size: int = DEFAULTS.fallback_lines, overlap: int = DEFAULTS.fallback_overlap) -> list[tuple]:
    """(start_line, end_line, start_byte, end_byte, content, node_type, node_name, language), in the order of lines and bytes."""
    lines = text.split("\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line.encode()) + 1)

    def row(first: int, last: int, kind: str, name: str | None, lang: str) -> tuple:
        content = "\n".join(lines[first - 1 : last])
        return (first, last, at[first - 1], at[first - 1] + len(content.encode()), content, kind, name, lang)

    nodes = _python_nodes(text) if language == "python" else _scanned_nodes(lines, language) if language in DECLARATIONS else []
    if not nodes:
        step = max(1, size - overlap)
        starts = range(0, max(1, len(lines) - size + step), step) if len(lines) > size else [0]
        return [row(s + 1, min(s + size, len(lines)), "block", None, "unknown") for s in starts]
    out: list[tuple] = []

    def add(nodes: list) -> None:
        for first, last, kind, name, inside in nodes:
            r = row(first, last, kind, name, language)
            out.append(r)
            if r[3] - r[2] > max_bytes:
                add(inside)

    add(nodes)
    covered = sorted((r[0], r[1]) for r in out)
    reached = 0
    for first, last in [*covered, (len(lines) + 1, len(lines) + 1)]:
        if first - reached - 1 >= least_gap and "".join(lines[reached : first - 1]).strip():
            out.append(row(reached + 1, first - 1, "gap", None, language))
        reached = max(reached, last)
    return sorted(out, key=lambda r: (r[0], r[2], -r[1]))


def structural_chunks(files: DataFrame, config: ChunkConfig = DEFAULTS) -> DataFrame:
    """One chunk for each definition, those inside large ones too, and for gaps between them; other files in frames.

    files: repo_root, path, text. Python is parsed; the other languages of
    lookups.CHUNK_LANGUAGES are scanned line by line for declarations at all
    levels, which doesn't see declarations behind macros or several on a line.
    A null text has no chunks.
    """
    known = files.filter(F.col("text").isNotNull()).select(*KEYS, "text", X.language("path", "chunk").alias("language"))

    def chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for pdf in frames:
            rows = [(repo, path, *c) for repo, path, text, lang in pdf.itertuples(index=False, name=None) for c in chunk_text(text, lang if isinstance(lang, str) else None, config.max_bytes, config.least_gap, config.fallback_lines, config.fallback_overlap)]
            yield pd.DataFrame(rows, columns=names)

    return known.mapInPandas(chunks, CHUNK_SCHEMA).withColumn("content_hash", X.content_hash("content"))
