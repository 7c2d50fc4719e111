"""Registered queries over the driver's tables, each with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom import samples, scratch
from quarryloom.config import ChunkConfig, SearchConfig
from quarryloom.functions import blobs, formats
from quarryloom.functions import lookups as L
from quarryloom.functions import text as X
from quarryloom.functions import vectors as V
from quarryloom.operators import ann, chunking, embed, evals, fusion, graph_index, lookup, merkle, quantized, rerank, search, stats, store, symbols, threshold, trigrams, vector_search
from quarryloom.plans import hybrid as plans
from quarryloom.plans.indexer import Index
from quarryloom.sources import files as sources
from quarryloom.sources import sinks, trees
from quarryloom.sources.files import documents_as_files, gitignored, project_of
from quarryloom.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return documents_as_files(table(spark, d, "documents"))


def vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, d, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


FILES = "files AS (SELECT source AS repo_root, doc_id::VARCHAR AS path, text, lang FROM documents)"
LINES = FILES + ", raw AS (SELECT repo_root, path, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS total, text FROM files), lines AS (SELECT repo_root, path, lang, line, n FROM raw WHERE NOT (n = total AND line = '' AND total > 1))"
PATTERN = r"(?i)\blicense\b"
QVEC = "q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)"

# Keyword search and files

KEYWORD = f"""WITH {LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY repo_root, path ORDER BY n) AS i FROM lines WHERE regexp_matches(line, '{PATTERN}')),
r AS (SELECT *, row_number() OVER (ORDER BY path, n, repo_root) AS rank FROM m WHERE i <= 40)
SELECT repo_root, path, n::INT AS line_start, n::INT AS line_end, line AS snippet, 101.0::DOUBLE - rank AS score, rank::INT AS rank FROM r WHERE rank <= 20"""


@query(KEYWORD)
def keyword_search(spark, d):
    return search.keyword_search(files(spark, d), PATTERN, 20)


@query(f"""WITH {LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY repo_root, path ORDER BY n) AS i FROM lines WHERE regexp_matches(line, 'tion[ .,]')),
r AS (SELECT *, row_number() OVER (ORDER BY path, n, repo_root) AS rank FROM m WHERE i <= 2)
SELECT repo_root, path, n::INT AS line_start, n::INT AS line_end, line AS snippet, 101.0::DOUBLE - rank AS score, rank::INT AS rank FROM r WHERE rank <= 500""")
def keyword_per_file_cap(spark, d):
    return search.keyword_search(files(spark, d), "tion[ .,]", 500, per_file=2)


#: Patterns with what their trigrams ask of a text, as a condition in SQL.
INDEXED = {
    PATTERN: " AND ".join(f"contains(t, '{x}')" for x in ("lic", "ice", "cen", "ens", "nse")),
    "(under the mit|permission is) ?(licen[cs]e|hereby)": f"({' AND '.join(f"contains(t, '{'under the mit'[i : i + 3]}')" for i in range(11))} OR {' AND '.join(f"contains(t, '{'permission is'[i : i + 3]}')" for i in range(11))}) AND (contains(t, 'lic') AND contains(t, 'ice') AND contains(t, 'cen') OR {' AND '.join(f"contains(t, '{x}')" for x in ("her", "ere", "reb", "eby"))})",
    "[A-Z][a-z]*ing[.,]": "contains(t, 'ing')",
    "^[A-Z]\\w+[.]$": "true",
}


def trigram_index(spark, d) -> trigrams.TrigramIndex:
    index = trigrams.TrigramIndex(spark, scratch.folder(spark, "trigrams"), 16)
    index.put(files(spark, d))
    return index


@query(KEYWORD)
def indexed_keyword_search(spark, d):
    return trigram_index(spark, d).keyword_search(files(spark, d), PATTERN, 20)


@query(f"WITH {LINES}, low AS (SELECT lower(text) AS t FROM files WHERE text IS NOT NULL) " + " UNION ALL ".join(
    f"SELECT '{p}' AS pattern, (SELECT count(*) FROM lines WHERE regexp_matches(line, '{p}'))::BIGINT AS lines, (SELECT count(*) FROM low WHERE {c})::BIGINT AS opened, (SELECT count(*) FROM low)::BIGINT AS texts" for p, c in INDEXED.items()))
def indexed_texts_opened(spark, d):
    """How many texts a search opens, of how many, and the lines that it finds."""
    index, own = trigram_index(spark, d), files(spark, d)
    rows = [f.select(F.lit(p).alias("pattern"), F.lit(what).alias("what")) for p in INDEXED for what, f in (("lines", index.matching_lines(own, p)), ("opened", index.candidates(p)), ("texts", own.filter("text IS NOT NULL")))]
    return reduce(DataFrame.unionByName, rows).groupBy("pattern").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("lines", "opened", "texts")])


@query(f"WITH {LINES} SELECT repo_root, path, n::INT AS line, line AS text FROM lines WHERE regexp_matches(line, 'tion[ .,]')")
def matching_lines(spark, d):
    return search.matching_lines(files(spark, d), "tion[ .,]")


@query(f"""WITH {FILES}, l AS (SELECT path, CASE WHEN suffix(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a FROM files)
SELECT path, array_to_string(a[1:3], chr(10)) AS content FROM l""")
def file_slice(spark, d):
    return files(spark, d).select("path", X.line_slice("text", 1, 3).alias("content"))


@query("""SELECT page_id, regexp_matches(path, '^(?:.*/)?en(?:/.*)?$') AS in_en, regexp_matches(path, '^[^/]*\\.example\\.com/.*$') AND NOT regexp_matches(path, '^(?:.*/)?[^/]*\\.html(?:/.*)?$') AS ignored
FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages)""".replace("'^[^/]*\\.example\\.com/.*$'", "'^(?:.*/)?[^/]*\\.example\\.com/.*$'"))
def gitignore_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.select("page_id", gitignored(F.col("path"), ["en"]).alias("in_en"), gitignored(F.col("path"), ["# hosts", "*.example.com/", "!*.html"]).alias("ignored"))


# Symbols

EN = {"en": (("function", r"^(\w+) (?:the|of) "), ("class", r"^(\w+) and "), ("constant", r"^(\w+)[.,] "))}
SYMBOLS_CTE = LINES + r""", hit AS (SELECT repo_root, path, n::INT AS line, lang AS language, trim(line) AS signature,
 CASE WHEN regexp_matches(line, '^(\w+) (?:the|of) ') THEN 'function' WHEN regexp_matches(line, '^(\w+) and ') THEN 'class' WHEN regexp_matches(line, '^(\w+)[.,] ') THEN 'constant' END AS kind,
 regexp_extract(line, '^(\w+)', 1) AS name FROM lines WHERE lang = 'en'), symbols AS (SELECT * FROM hit WHERE kind IS NOT NULL)"""


def english_symbols(spark, d) -> DataFrame:
    return symbols.extract_symbols(files(spark, d), F.col("language"), EN)


@query(f"WITH {SYMBOLS_CTE} SELECT repo_root, name, kind, path, line, language, kind AS pattern, NULL::VARCHAR AS scope, signature FROM symbols")
def symbol_extract(spark, d):
    return english_symbols(spark, d)


FIND = """SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'part' THEN 0 WHEN lower(p_name) LIKE 'part%' THEN 1 ELSE 2 END::INT AS match FROM part WHERE lower(p_name) LIKE '%part%' ORDER BY match, p_name, p_partkey LIMIT 50"""


@query(FIND)
def find_symbol_ranked(spark, d):
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"), F.lit("type").alias("kind"), F.format_string("%09d", "p_partkey").alias("path"), F.lit(1).alias("line"), "p_partkey")
    return symbols.find_symbols(parts, "Part", limit=50).select("p_partkey", F.col("name").alias("p_name"), "match")


@query(f"WITH {SYMBOLS_CTE}, r AS (SELECT *, CASE WHEN lower(name) = 'the' THEN 0 WHEN lower(name) LIKE 'the%' THEN 1 ELSE 2 END AS match FROM symbols WHERE lower(name) LIKE '%the%' AND kind = 'function') SELECT repo_root, name, path, line, match::INT AS match FROM r ORDER BY match, encode(name), path, line LIMIT 50")
def find_symbol_kind(spark, d):
    return symbols.find_symbols(english_symbols(spark, d), "the", kind="function").select("repo_root", "name", "path", "line", "match")


@query(f"WITH {SYMBOLS_CTE}, first AS (SELECT repo_root, path FROM symbols ORDER BY repo_root, path LIMIT 1) SELECT name, kind, line FROM symbols JOIN first USING (repo_root, path)")
def list_defs(spark, d):
    found = english_symbols(spark, d)
    at = found.orderBy("repo_root", "path").select("repo_root", "path").first()
    return symbols.list_definitions(found, at[0], at[1]).select("name", "kind", "line")


HTML_TAGS = r"<(h1|h2|title|p|li|a)\b[^>]*>([^<]+)"


@query(r"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h1|h2|title|p|li|a)\b[^>]*>([^<]+)', 1)) AS tag, unnest(regexp_extract_all(html, '<(h1|h2|title|p|li|a)\b[^>]*>([^<]+)', 2)) AS txt FROM pages)
SELECT page_id, tag, count(*)::BIGINT AS n, count(DISTINCT trim(txt))::BIGINT AS texts FROM t GROUP BY ALL""")
def pattern_extract_html(spark, d):
    pages = table(spark, d, "pages")
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(HTML_TAGS), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(HTML_TAGS), F.lit(2)).alias("txt"))
    rows = pages.select("page_id", F.explode(pairs).alias("x")).select("page_id", "x.tag", F.trim("x.txt").alias("txt"))
    return rows.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.count_distinct("txt").alias("texts"))


def _case(table_: dict, key: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} IN ({', '.join(repr(n) for n in names)}) THEN '{k}'" for k, names in table_.items()) + f" ELSE {otherwise} END"


KIND_SAMPLE = "list_extract(['f', 'Method', 'c', 'STRUCT', 'i', 'typedef', 'var', 'const', 'p', 'member', 'enumerator', 'macro'], 1 + (event_id % 12)::INT)"


@query(f"SELECT event_id, {KIND_SAMPLE} AS kind, {_case(L.KINDS, f'lower({KIND_SAMPLE})', KIND_SAMPLE)} AS normalized FROM events")
def kind_normalize(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("f", "Method", "c", "STRUCT", "i", "typedef", "var", "const", "p", "member", "enumerator", "macro")])
    rows = table(spark, d, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 12 + 1).cast("int")).alias("kind"))
    return rows.withColumn("normalized", X.normalized_kind("kind"))


EXT_SAMPLE = "list_extract(['a.go', 'b/c.TSX', 'x.py', 'lib.h', 'm.hh', 'n.hxx', 'Makefile', 'q.rs', 'z.kt', 'w.yml', 's.bash', 'd.d/e', 'v.Go', 'u.mjs'], 1 + (doc_id % 14)::INT)"
EXT = f"regexp_extract({EXT_SAMPLE}, '\\.([^./]*)$', 1)"


@query(f"SELECT doc_id, {EXT_SAMPLE} AS path, {_case(L.PATTERN_LANGUAGES, f'lower({EXT})', 'NULL')} AS pattern, {_case(L.CHUNK_LANGUAGES, f'lower({EXT})', 'NULL')} AS chunk, {_case(L.RECORD_LANGUAGES, EXT, repr('unknown'))} AS record FROM documents")
def language_detect(spark, d):
    names = F.array(*[F.lit(k) for k in ("a.go", "b/c.TSX", "x.py", "lib.h", "m.hh", "n.hxx", "Makefile", "q.rs", "z.kt", "w.yml", "s.bash", "d.d/e", "v.Go", "u.mjs")])
    rows = table(spark, d, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 14 + 1).cast("int")).alias("path"))
    return rows.select("doc_id", "path", *[X.language("path", t).alias(t) for t in ("pattern", "chunk", "record")])


@query("SELECT p_partkey, CASE WHEN strpos(p_name, ' ') > 0 THEN trim(regexp_extract('func ' || p_name || '(x int) {', '^func ([^({<:=]+)', 1)) ELSE trim(p_name) END AS name FROM part")
def name_extract(spark, d):
    return table(spark, d, "part").select("p_partkey", X.name_in(F.concat(F.lit("  func "), F.col("p_name"), F.lit("(x int) {"))).alias("name"))


# Content hashes

HASHES = "h AS (SELECT source AS repo_root, doc_id::VARCHAR AS path, sha256(text) AS content_hash, lang AS language, len(string_split(text, chr(10)))::INT AS end_line FROM documents)"


def locations(spark, d) -> DataFrame:
    return files(spark, d).select("repo_root", "path", F.lit(1).alias("start_line"), F.size(X.lines_of("text")).alias("end_line"), X.content_hash("text").alias("content_hash"), F.lit("block").alias("node_type"), F.lit(None).cast("string").alias("node_name"), "language", F.timestamp_seconds(F.lit(0)).alias("created_at"))


@query(f"WITH {HASHES} SELECT path, content_hash FROM h")
def content_hash(spark, d):
    return locations(spark, d).select("path", "content_hash")


@query(f"WITH {HASHES} SELECT content_hash, count(*)::BIGINT AS locations, count(DISTINCT repo_root)::BIGINT AS repos, min(path) AS first_path FROM h GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    return locations(spark, d).groupBy("content_hash").agg(F.count("*").alias("locations"), F.count_distinct("repo_root").alias("repos"), F.min("path").alias("first_path")).filter("locations > 1")


@query(f"WITH {HASHES} SELECT DISTINCT content_hash FROM h WHERE repo_root = 'src0'")
def hashes_per_repo(spark, d):
    return stats.distinct_values(locations(spark, d), "content_hash", "src0")


# Chunks

FALLBACK = f"""WITH {FILES}, s AS (SELECT repo_root, path, string_split(text, chr(10)) AS a FROM files), k AS (SELECT *, len(a) AS n FROM s),
f AS (SELECT repo_root, path, a, n, unnest(range(0, CASE WHEN n <= 50 THEN 1 ELSE (ceil((n - 50) / 40.0)::INT * 40 + 1) END, 40)) AS st FROM k)
SELECT repo_root, path, (st + 1)::INT AS start_line, least(st + 50, n)::INT AS end_line,
 CASE WHEN st = 0 THEN 0 ELSE strlen(array_to_string(a[1:st], chr(10))) + 1 END::BIGINT AS start_byte,
 (CASE WHEN st = 0 THEN 0 ELSE strlen(array_to_string(a[1:st], chr(10))) + 1 END + strlen(array_to_string(a[st + 1:least(st + 50, n)], chr(10))) + CASE WHEN st + 50 < n THEN 1 ELSE 0 END)::BIGINT AS end_byte,
 array_to_string(a[st + 1:least(st + 50, n)], chr(10)) AS content, sha256(array_to_string(a[st + 1:least(st + 50, n)], chr(10))) AS content_hash, 'block' AS node_type, NULL::VARCHAR AS node_name, 'unknown' AS language FROM f"""


@query(FALLBACK)
def fallback_chunks(spark, d):
    return chunking.fixed_chunks(files(spark, d))


def frames_sql(n: str, a: str = "0") -> str:
    return f"(CASE WHEN len(list_filter(list_transform(range(0, CASE WHEN {n} <= 30 THEN 1 ELSE ceil(({n} - 30) / 15.0)::INT * 15 + 1 END, 15), lambda s: {{'s': s, 'e': least(s + 30, {n})}}), lambda f: f.e - f.s >= 5)) > 0 THEN list_filter(list_transform(range(0, CASE WHEN {n} <= 30 THEN 1 ELSE ceil(({n} - 30) / 15.0)::INT * 15 + 1 END, 15), lambda s: {{'s': s, 'e': least(s + 30, {n})}}), lambda f: f.e - f.s >= 5) ELSE [{{'s': 0::BIGINT, 'e': {n}}}] END)"


@query(f"""WITH {FILES}, k AS (SELECT repo_root, path, string_split(text, chr(10)) AS a, len(string_split(text, chr(10))) AS n FROM files), f AS (SELECT repo_root, path, a, unnest({frames_sql('n')}) AS f FROM k)
SELECT repo_root, path, (f.s + 1)::INT AS start_line, f.e::INT AS end_line, array_to_string(a[f.s + 1:f.e], chr(10)) AS content, 'fixed' AS kind FROM f""")
def line_chunks(spark, d):
    return chunking.line_chunks(files(spark, d))


EVERY_LINE = "l AS (SELECT repo_root, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM files)"
GAPS = EVERY_LINE + r""",
u AS (SELECT repo_root, path, n, n - row_number() OVER (PARTITION BY repo_root, path ORDER BY n) AS island FROM l WHERE NOT regexp_matches(line, '^(\w+) (?:the|of) '))"""


@query(f"WITH {FILES}, {GAPS} SELECT repo_root, path, min(n)::INT AS start_line, max(n)::INT AS end_line FROM u GROUP BY repo_root, path, island HAVING count(*) >= 3")
def gap_islands(spark, d):
    found = search.matching_lines(files(spark, d), r"^(\w+) (?:the|of) ")
    return chunking.uncovered_runs(files(spark, d), found.select("repo_root", "path", F.col("line").alias("start_line"), F.col("line").alias("end_line")), least=3)


@query(f"""WITH {SYMBOLS_CTE}, b AS (SELECT repo_root, path, line, min(kind) AS kind FROM symbols WHERE kind IN ('function', 'class') GROUP BY ALL), sz AS (SELECT repo_root, path, string_split(text, chr(10)) AS a, len(string_split(text, chr(10))) AS n FROM files),
r AS (SELECT b.*, a, n, least(coalesce(lead(line) OVER (PARTITION BY repo_root, path ORDER BY line) - 1, n), n) AS last FROM b JOIN sz USING (repo_root, path)), k AS (SELECT *, last - line + 1 AS m FROM r WHERE last - line + 1 >= 5),
own AS (SELECT repo_root, path, line + s AS st, line + least(s + 30, m) - 1 AS en, kind FROM (SELECT *, unnest(range(0, CASE WHEN m <= 30 THEN 1 ELSE ceil((m - 30) / 15.0)::INT * 15 + 1 END, 15)) AS s FROM k)),
cov AS (SELECT repo_root, path, unnest(range(line, last + 1)) AS n FROM k), al AS (SELECT repo_root, path, unnest(range(1, n + 1)) AS n FROM sz),
un AS (SELECT repo_root, path, n, n - row_number() OVER (PARTITION BY repo_root, path ORDER BY n) AS i FROM al ANTI JOIN cov USING (repo_root, path, n)), runs AS (SELECT repo_root, path, min(n) AS st, count(*)::BIGINT AS m FROM un GROUP BY repo_root, path, i),
rest AS (SELECT repo_root, path, st + f.s AS st, st + f.e - 1 AS en, 'fixed' AS kind FROM (SELECT repo_root, path, st, unnest({frames_sql('m')}) AS f FROM runs)),
al2 AS (SELECT * FROM own UNION ALL SELECT * FROM rest)
SELECT repo_root, path, st::INT AS start_line, en::INT AS end_line, array_to_string(a[st:en], chr(10)) AS content, kind FROM al2 JOIN sz USING (repo_root, path)""")
def symbol_chunks(spark, d):
    return chunking.symbol_chunks(files(spark, d), english_symbols(spark, d))


@query()
def structural_chunks(spark, d):
    rows = files(spark, d).withColumn("path", F.concat("path", F.lit(".py")))
    return chunking.structural_chunks(rows).select("repo_root", "path", "start_line", "end_line", "node_type", "content_hash")


# Index runs by deltas

#: An earlier state of the documents as a tree, a folder for each source: those labelled toxic weren't there, those of low quality had another text, and the benchmark lay beside them.
TREES = """lb AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
tree AS (SELECT coalesce(source, 'none') || '/' || d.doc_id AS path, text AS now, CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN 'draft of ' || text ELSE text END AS before FROM documents d LEFT JOIN lb USING (doc_id)
         UNION ALL SELECT 'benchmark/' || item_id, NULL, text FROM benchmark),
state AS (SELECT 'now' AS v, path, now AS text FROM tree WHERE now IS NOT NULL UNION ALL SELECT 'before', path, before FROM tree WHERE before IS NOT NULL),
changed AS (SELECT path FROM tree WHERE now IS DISTINCT FROM before),
k AS (SELECT v, path, string_split(text, chr(10)) AS a, len(string_split(text, chr(10))) AS n FROM state),
f AS (SELECT v, path, a, n, unnest(range(0, CASE WHEN n <= 50 THEN 1 ELSE (ceil((n - 50) / 40.0)::INT * 40 + 1) END, 40)) AS st FROM k),
chunk AS (SELECT v, path, (st + 1)::INT AS start_line, least(st + 50, n)::INT AS end_line, sha256(array_to_string(a[st + 1:least(st + 50, n)], chr(10))) AS content_hash FROM f)"""


def tree_states(spark, d) -> tuple[DataFrame, DataFrame]:
    docs, label = table(spark, d, "documents"), table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), "doc_id")
    rows = docs.join(label, F.col("doc_id") == F.col("id"), "left")
    shape = lambda t, p, text: t.select(F.lit("all").alias("repo_root"), p.alias("path"), text.alias("text"))
    earlier = F.when(F.col("quality") == 0, F.concat(F.lit("draft of "), "text")).otherwise(F.col("text"))
    before = shape(rows.filter("toxic IS DISTINCT FROM 1"), path, earlier).unionByName(shape(table(spark, d, "benchmark"), F.concat_ws("/", F.lit("benchmark"), "item_id"), F.col("text")))
    return before, shape(docs, path, F.col("text"))


def index_of_states(spark, d) -> tuple[Index, dict[str, int]]:
    """An index of the earlier state that has then been brought up to the documents, and the rows that took."""
    before, now = tree_states(spark, d)
    index = Index(spark, scratch.folder(spark, "index"), embed.hashing_embedder(16), chunking.fixed_chunks, lambda f: symbols.extract_symbols(f, "en", EN), buckets=16)
    index.run(before, "all")
    return index, index.run(now, "all").written


@query(f"""WITH {TREES},
nodes AS (SELECT v, path, 'f' AS kind FROM state UNION ALL SELECT DISTINCT v, split_part(path, '/', 1), 'd' FROM state UNION ALL SELECT DISTINCT v, '', 'd' FROM state),
moved AS (SELECT path FROM changed UNION SELECT split_part(path, '/', 1) FROM changed UNION SELECT '' FROM changed),
line AS (SELECT v, path, unnest(a) AS line FROM k), sy AS (SELECT DISTINCT v, path, n, regexp_extract(line, '^(\\w+)', 1) AS name FROM (SELECT v, path, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM k) WHERE regexp_matches(line, '^(\\w+) (?:the|of) |^(\\w+) and |^(\\w+)[.,] ')),
hashes AS (SELECT DISTINCT content_hash FROM chunk WHERE v = 'before'), fresh AS (SELECT DISTINCT content_hash FROM chunk WHERE v = 'now' AND path IN (FROM changed) AND content_hash NOT IN (FROM hashes)),
c AS (SELECT count(*) FILTER (WHERE v = 'before') AS b, count(*) FILTER (WHERE v = 'now') AS n, count(*) FILTER (WHERE v = 'before' AND path IN (FROM changed)) AS g, count(*) FILTER (WHERE v = 'now' AND path IN (FROM changed)) AS w FROM chunk),
s AS (SELECT count(*) FILTER (WHERE v = 'before') AS b, count(*) FILTER (WHERE v = 'now') AS n, count(*) FILTER (WHERE v = 'before' AND path IN (FROM changed)) AS g, count(*) FILTER (WHERE v = 'now' AND path IN (FROM changed)) AS w FROM sy),
m AS (SELECT count(*) FILTER (WHERE v = 'before') AS b, count(*) FILTER (WHERE v = 'now') AS n, count(*) FILTER (WHERE v = 'before' AND path IN (FROM moved)) AS g, count(*) FILTER (WHERE v = 'now' AND path IN (FROM moved)) AS w FROM nodes),
e AS (SELECT (SELECT count(*) FROM hashes) AS b, (SELECT count(*) FROM hashes) + (SELECT count(*) FROM fresh) AS n, 0 AS g, (SELECT count(*) FROM fresh) AS w)
SELECT t AS table_name, b::BIGINT AS rows_before, g::BIGINT AS rows_gone, w::BIGINT AS rows_written, n::BIGINT AS rows_after FROM (
SELECT 'chunk_locations' AS t, * FROM c UNION ALL SELECT 'chunks', * FROM c UNION ALL SELECT 'symbols', * FROM s UNION ALL SELECT 'merkle', * FROM m UNION ALL SELECT 'embedding_cache', * FROM e)""")
def incremental_run(spark, d):
    index, written = index_of_states(spark, d)
    now = index.tables.version()
    count = lambda t, v, name: index.read(t, v).select(F.lit(t).alias("table_name"), F.lit(name).alias("state"), F.lit(written[t]).cast("long").alias("rows_written"))
    each = reduce(DataFrame.unionByName, [count(t, v, name) for t in index.TABLES for v, name in ((now - 1, "before"), (now, "after"))])
    out = each.groupBy("table_name", "rows_written").agg(F.count_if(F.col("state") == "before").alias("rows_before"), F.count_if(F.col("state") == "after").alias("rows_after"))
    return out.select("table_name", "rows_before", (F.col("rows_before") + F.col("rows_written") - F.col("rows_after")).alias("rows_gone"), "rows_written", "rows_after")


@query(f"WITH {TREES} SELECT path, start_line, end_line, content_hash FROM chunk WHERE v = 'now'")
def incremental_locations(spark, d):
    return index_of_states(spark, d)[0].read("chunk_locations").select("path", "start_line", "end_line", "content_hash")


@query(f"WITH {TREES} SELECT path, start_line, end_line, content_hash FROM chunk WHERE v = 'now'")
def compacted_locations(spark, d):
    index = index_of_states(spark, d)[0]
    index.compact(0, keep=1)
    return index.read("chunk_locations").select("path", "start_line", "end_line", "content_hash")


@query(f"""WITH {TREES}, c AS (SELECT * FROM chunk WHERE v = 'now'), hashes AS (SELECT content_hash FROM chunk WHERE v = 'before' UNION SELECT content_hash FROM c WHERE path IN (FROM changed))
SELECT 'total' AS metric, 'chunks' AS value, count(*)::BIGINT AS n FROM c UNION ALL SELECT 'total', 'files', count(DISTINCT path) FROM c UNION ALL SELECT 'total', 'cached', count(*) FROM hashes
UNION ALL SELECT 'type', 'block', count(*) FROM c UNION ALL SELECT 'language', 'unknown', count(*) FROM c""")
def kept_stats(spark, d):
    """Distinct hashes, an estimate, are left out here."""
    return index_of_states(spark, d)[0].kept_stats().filter("value <> 'hashes'")


def documents_on_disk(spark, d) -> str:
    """Each document with a text as a file source/doc_id.txt, written by the tasks to a scratch folder."""
    root = scratch.folder(spark, "tree")
    rows = table(spark, d, "documents").filter("text is not null").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("body"))
    trees.write_files(rows, root)
    return root


ON_DISK = "SELECT 'r' AS repo_root, coalesce(source, 'none') || '/' || doc_id || '.txt' AS path, strlen(text)::BIGINT AS size"


@query(f"{ON_DISK} FROM documents WHERE text IS NOT NULL")
def tree_listing(spark, d):
    return trees.scan_tree(spark, documents_on_disk(spark, d), None, repo_root="r").drop("mtime")


@query(f"{ON_DISK}, sha256(text) AS content_hash FROM documents WHERE contains(text, chr(0)) IS FALSE AND lang <> 'en'")
def tree_texts_of_changed(spark, d):
    """Only files that an index of the English documents doesn't have are opened."""
    root = documents_on_disk(spark, d)
    known = table(spark, d, "documents").filter("coalesce(lang, 'en') = 'en'").select(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    now = trees.scan_tree(spark, root, None, repo_root="r")
    return trees.with_text(sources.changed_files(now, now.join(known, "path", "left_semi")), root).select("repo_root", "path", "size", X.content_hash("text").alias("content_hash"))


@query("""WITH t AS (SELECT sha256(text) AS content_hash, min(text) AS text FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT content_hash, 8 AS dimensions, round(((strlen(text)) / 8.0)::FLOAT::DOUBLE, 4) AS head, round(((strlen(text) + 7) / 8.0)::FLOAT::DOUBLE, 4) AS tail FROM t""")
def embed_in_slices(spark, d):
    """Through the window of calls and the slices, with a stand-in for the server: all texts once."""
    docs = table(spark, d, "documents").filter("text is not null").select(X.content_hash("text").alias("content_hash"), F.col("text").alias("content"))
    missing = docs.groupBy("content_hash").agg(F.min("content").alias("content"))
    by = embed.http_embedder("stand-in", "length", lambda texts: [[(len(t.encode()) + j) / 8.0 for j in range(8)] for t in texts], dimensions=8, in_flight=4, most_calls=16)
    kept = []

    def keep(vectors: DataFrame) -> int:
        kept.append(scratch.settle(vectors, "kept"))
        return kept[-1].count()

    embed.embed_in_slices(missing, by, keep, most=100_000)
    out = reduce(DataFrame.unionByName, kept)
    return out.select("content_hash", F.size("embedding").alias("dimensions"), F.round(F.col("embedding")[0].cast("double"), 4).alias("head"), F.round(F.col("embedding")[7].cast("double"), 4).alias("tail"))


# Vectors


def _distance_sql(metric: str) -> str:
    return {"cosine": "1 - list_cosine_similarity(embedding::DOUBLE[], v)", "euclidean": "list_distance(embedding::DOUBLE[], v)", "dot_product": "-list_inner_product(embedding::DOUBLE[], v)", "manhattan": "list_sum([abs(embedding[i]::DOUBLE - v[i]) for i in range(1, len(v) + 1)])"}[metric]


def _topk_query(metric: str, name: str) -> None:
    score = {"cosine": "1 - d", "dot_product": "-d"}.get(metric, "1 / (1 + d)")

    @query(f"WITH {QVEC}, s AS (SELECT vec_id, label, {_distance_sql(metric)} AS d FROM embeddings, q) SELECT vec_id, label, round(d, 6) AS distance, round({score}, 6) AS score FROM s ORDER BY round(d, 9), vec_id LIMIT 10", name)
    def top(spark, d):
        rows = table(spark, d, "embeddings").withColumn("id", F.col("vec_id"))
        found = vector_search.top_k(rows, vector(spark, d), 10, metric)
        return found.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


for _m, _n in (("cosine", "cosine_topk"), ("euclidean", "euclidean_topk"), ("dot_product", "dot_topk"), ("manhattan", "manhattan_topk")):
    _topk_query(_m, _n)


@query("WITH m AS (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(norm, 6) AS norm, [round(x / norm, 6) for x in e] AS unit FROM m")
def normalize_vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.rounded(V.magnitude(F.col("embedding")), 6).alias("norm"), F.transform(V.normalized(F.col("embedding")), lambda x: V.rounded(x, 6)).alias("unit"))


@query(f"WITH {QVEC} SELECT vec_id, round({_distance_sql('cosine')}, 6) AS cosine, round({_distance_sql('euclidean')}, 6) AS euclidean, round({_distance_sql('manhattan')}, 6) AS manhattan, round({_distance_sql('dot_product')}, 6) AS dot_product FROM embeddings, q")
def all_distances(spark, d):
    q = V.literal(vector(spark, d))
    return table(spark, d, "embeddings").select("vec_id", *[(F.round if m == "cosine" else V.rounded)(V.distance(m, F.col("embedding"), q), 6).alias(m) for m in V.METRICS])


@query(f"WITH {QVEC}, s AS (SELECT vec_id, label, {_distance_sql('cosine')} AS d FROM embeddings, q WHERE label IN (1, 2)) SELECT vec_id, label, round(d, 6) AS distance FROM s ORDER BY round(d, 9), vec_id LIMIT 10")
def vector_repo_filter(spark, d):
    rows = table(spark, d, "embeddings").withColumn("id", F.col("vec_id"))
    return vector_search.filtered_top_k(rows, vector(spark, d), 10, [1, 2], "label").select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"WITH {QVEC}, s AS (SELECT vec_id, label, 1 - ({_distance_sql('cosine')}) AS sc FROM embeddings, q) SELECT label::VARCHAR AS repo_root, vec_id::VARCHAR AS path, round(sc, 6) AS score FROM s WHERE sc > 0 ORDER BY round(sc, 9) DESC, path LIMIT 25")
def cross_repo_topk(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("repo_root"), F.col("vec_id").cast("string").alias("path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "embedding")
    return search.semantic_search(rows, vector(spark, d), 25).select("repo_root", "path", F.round("score", 6).alias("score"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 5 = 0), s AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS d FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), vec_id) AS rank FROM s) SELECT query_id, vec_id, round(d, 6) AS distance, rank::INT AS rank FROM r WHERE rank <= 10""")
def batch_knn(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_search.batch_knn(rows, asked, 10, id_column="vec_id")
    return found.select("query_id", "vec_id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")


def ann_index(spark, d, kind: str, cells: int) -> ann.AnnIndex:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("repo_root"))
    return ann.AnnIndex(spark, scratch.folder(spark, f"index-{kind}")).build(rows, kind, cells)


def ann_queries(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


#: Cells and how many of them are probed. These vectors have hardly any clusters, so it takes many: ivf finds 0.96 and lsh 0.93 or more at every size of the test data.
IVF, LSH = ("ivf", 32, 20), ("lsh", 32, 26)


def ann_topk(spark, d, kind: str, cells: int, probes: int) -> DataFrame:
    return ann_index(spark, d, kind, cells).search_many(ann_queries(spark, d), 10, probes).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank")


@query()
def ann_lsh_topk(spark, d):
    return ann_topk(spark, d, *LSH)


@query()
def ivf_topk(spark, d):
    return ann_topk(spark, d, *IVF)


@query()
def graph_recall(spark, d):
    """Two rows: the share of the exact ten nearest that the graph finds for all ids divisible by 20, and the share of the vectors that a query was compared with."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = graph_index.GraphIndex(spark, scratch.folder(spark, "graph")).build(rows)
    found = scratch.settle(index.search_many(ann_queries(spark, d), 10), "found")
    exact = vector_search.batch_knn(rows, ann_queries(spark, d), 10)
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    visits = found.groupBy("query_id").agg(F.max("visited").alias("visited")).agg(F.avg("visited").alias("mean"))
    shares = hits.agg((F.count("hit") / F.count("*")).alias("recall")).select(F.lit("recall").alias("what"), F.col("recall").alias("share"))
    seen = visits.select(F.lit("visited").alias("what"), (F.col("mean") / F.lit(float(max(1, rows.count())))).alias("share"))
    return shares.unionByName(seen)


@query()
def quantized_recall(spark, d):
    """Two rows: the share of the exact ten nearest that byte codes find for all ids divisible by 20, and the codes' share of the vectors' bytes."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = quantized.QuantizedIndex(spark, scratch.folder(spark, "quantized")).build(rows)
    found = index.search_many(rows, ann_queries(spark, d), 10)
    exact = vector_search.batch_knn(rows, ann_queries(spark, d), 10)
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    recall = hits.agg((F.count("hit") / F.count("*")).alias("share")).select(F.lit("recall").alias("what"), "share")
    coded = index.tables.read("codes").agg(F.sum(F.octet_length("code")).alias("coded")).crossJoin(rows.agg(F.sum(4 * F.size("embedding")).alias("whole")))  # one row each
    return recall.unionByName(coded.select(F.lit("bytes").alias("what"), (F.col("coded") / F.col("whole")).alias("share")))


@query("SELECT * FROM (VALUES ('ivf', true), ('lsh', true)) AS t(kind, enough)")
def ann_recall(spark, d):
    """Whether 0.9 of the exact neighbours are found."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    exact = vector_search.batch_knn(rows, ann_queries(spark, d), 10)
    return spark.createDataFrame([(k[0], ann.recall(ann_topk(spark, d, *k), exact) >= 0.9) for k in (IVF, LSH)], "kind string, enough boolean")


@query("SELECT * FROM (VALUES ('built', (SELECT count(*) FROM embeddings)), ('after delete', (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0)), ('after insert', (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0)), ('after sync', (SELECT count(*) FROM embeddings)), ('rebuilt', (SELECT count(*) FROM embeddings))) AS t(step, n)")
def ann_maintenance(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index, steps = ann_index(spark, d, "ivf", 16), []
    steps.append(("built", index.count()))
    index.delete(rows.filter("id % 3 = 0"))
    steps.append(("after delete", index.count()))
    index.insert(rows.filter("id % 2 = 0").withColumn("repo_root", F.lit("r")))
    steps.append(("after insert", index.count()))
    index.sync(rows.withColumn("repo_root", F.lit("r")))
    steps.append(("after sync", index.count()))
    steps.append(("rebuilt", index.rebuild(16).count()))
    index.drop()
    return spark.createDataFrame(steps, "step string, n long")


# Embedding and the cache

HASH_COUNTS = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM documents),
c AS (SELECT doc_id, (('0x' || substr(md5(word), 1, 8))::BIGINT % 64)::INT AS bucket, count(*)::BIGINT AS n FROM w GROUP BY ALL)"""


@query(f"WITH {HASH_COUNTS} SELECT * FROM c")
def hash_embed(spark, d):
    return embed.hash_counts(table(spark, d, "documents"), "doc_id", "text", 64)


@query("SELECT doc_id, [round(((strlen(text) + j) / 8.0)::FLOAT::DOUBLE, 4) for j in range(0, 8)] AS v FROM documents")
def mock_embed(spark, d):
    v = embed.length_embedding(F.col("text"), 8)
    return table(spark, d, "documents").select("doc_id", F.transform(v, lambda x: F.round(x.cast("double"), 4)).alias("v"))


CACHE = "cache AS (SELECT DISTINCT content_hash FROM h WHERE path::BIGINT % 2 = 0)"


def half_cache(spark, d) -> DataFrame:
    return locations(spark, d).filter(F.col("path").cast("long") % 2 == 0).select("content_hash").distinct()


@query(f"WITH {HASHES}, {CACHE}, e AS (SELECT content_hash, count(*) AS n, max(cache.content_hash IS NOT NULL) AS hit FROM h LEFT JOIN cache USING (content_hash) GROUP BY 1) SELECT sum(n)::BIGINT AS total_chunks, count(*)::BIGINT AS unique_hashes, count(*) FILTER (WHERE hit)::BIGINT AS hit_hashes, coalesce(sum(n) FILTER (WHERE hit), 0)::BIGINT AS hit_chunks, count(*) FILTER (WHERE NOT hit)::BIGINT AS to_embed, round(coalesce(sum(n) FILTER (WHERE hit), 0) / sum(n), 9) AS hit_rate FROM e")
def embed_cache_split(spark, d):
    return embed.embed_statistics(locations(spark, d), half_cache(spark, d)).withColumn("hit_rate", F.round("hit_rate", 9))


EMB_CACHE = "SELECT vec_id, vec_id % 7 AS access_count, '2024-01-01'::TIMESTAMP + to_seconds(vec_id % 50) AS last_accessed, '2023-01-01'::TIMESTAMP + to_seconds(vec_id % 30) AS created_at FROM embeddings"


def vector_cache(spark, d) -> DataFrame:
    at = lambda start, n: F.timestamp_seconds(F.lit(start) + F.col("vec_id") % n)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("content_hash"), "embedding", at(1672531200, 30).alias("created_at"), (F.col("vec_id") % 7).alias("access_count"), at(1704067200, 50).alias("last_accessed"))


@query(f"WITH c AS ({EMB_CACHE}), n AS (SELECT vec_id, 1 AS access_count, '2024-02-01'::TIMESTAMP AS last_accessed, '2024-02-01'::TIMESTAMP AS created_at FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id + 1000000, 1, '2024-02-01'::TIMESTAMP, '2024-02-01'::TIMESTAMP FROM embeddings WHERE vec_id % 5 = 0) SELECT vec_id AS content_hash, sum(access_count)::BIGINT AS access_count, epoch(max(last_accessed))::BIGINT AS last_accessed, epoch(min(created_at))::BIGINT AS created_at FROM (SELECT * FROM c UNION ALL SELECT * FROM n) GROUP BY vec_id")
def cache_upsert(spark, d):
    cache = vector_cache(spark, d)
    stamp = F.timestamp_seconds(F.lit(1706745600))
    new = lambda rows, key: rows.select(key.alias("content_hash"), "embedding", stamp.alias("created_at"), F.lit(1).cast("long").alias("access_count"), stamp.alias("last_accessed"))
    more = new(cache.filter("content_hash % 3 = 0"), F.col("content_hash")).unionByName(new(cache.filter("content_hash % 5 = 0"), F.col("content_hash") + 1000000))
    return store.put_cache(cache, more).select("content_hash", "access_count", X.to_epoch("last_accessed").alias("last_accessed"), X.to_epoch("created_at").alias("created_at"))


@query(f"WITH c AS ({EMB_CACHE}) SELECT count(*)::BIGINT AS entries, sum(access_count)::BIGINT AS accesses, round(avg(access_count), 6) AS mean_accesses, min(access_count) AS least_accesses, max(access_count) AS most_accesses, epoch(min(created_at))::BIGINT AS oldest, epoch(max(created_at))::BIGINT AS newest FROM c")
def cache_stats(spark, d):
    out = stats.cache_stats(vector_cache(spark, d))
    return out.select("entries", "accesses", F.round("mean_accesses", 6).alias("mean_accesses"), "least_accesses", "most_accesses", X.to_epoch("oldest").alias("oldest"), X.to_epoch("newest").alias("newest"))


@query(f"WITH c AS ({EMB_CACHE}) SELECT vec_id AS content_hash FROM c ORDER BY last_accessed DESC, vec_id LIMIT 100")
def cache_evict(spark, d):
    return store.evict(vector_cache(spark, d), 100).select("content_hash")


@query(f"WITH {HASHES}, {CACHE} SELECT content_hash FROM cache WHERE content_hash NOT IN (SELECT content_hash FROM h WHERE path::BIGINT % 3 = 0)")
def orphan_hashes(spark, d):
    return store.orphans(half_cache(spark, d), locations(spark, d).filter(F.col("path").cast("long") % 3 == 0))


@query("SELECT o_orderkey AS content_hash, coalesce(n, 0) + 1 AS access_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def fold_access_log(spark, d):
    cache = table(spark, d, "orders").select(F.col("o_orderkey").alias("content_hash"), F.lit(1).cast("long").alias("access_count"), F.timestamp_seconds(F.lit(0)).alias("last_accessed"))
    log = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("content_hash"), F.col("l_shipdate").cast("timestamp").alias("accessed_at"))
    return store.fold_accesses(cache, log).select("content_hash", "access_count")


# Locations

NEW_HASH = "sha256(text || 'x')"


@query(f"WITH {HASHES} SELECT repo_root, path, end_line, CASE WHEN path::BIGINT % 4 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash, CASE WHEN path::BIGINT % 4 = 0 THEN 'new' ELSE 'block' END AS node_type, 0::BIGINT AS created FROM h UNION ALL SELECT repo_root, 'n' || path, end_line, sha256(content_hash), 'new', 9::BIGINT FROM h WHERE path::BIGINT % 4 = 0")
def upsert_locations(spark, d):
    old = locations(spark, d)
    some = old.filter(F.col("path").cast("long") % 4 == 0).withColumn("content_hash", X.content_hash("content_hash")).withColumn("node_type", F.lit("new")).withColumn("created_at", F.timestamp_seconds(F.lit(9)))
    out = store.save_locations(old, some.unionByName(some.withColumn("path", F.concat(F.lit("n"), "path"))))
    return out.select("repo_root", "path", "end_line", "content_hash", "node_type", X.to_epoch("created_at").alias("created"))


@query(f"WITH {HASHES} SELECT repo_root, path, content_hash FROM h WHERE path::BIGINT % 5 NOT IN (0, 1) UNION ALL SELECT repo_root, path, sha256(content_hash) FROM h WHERE path::BIGINT % 5 = 0")
def replace_by_file(spark, d):
    old = locations(spark, d)
    new = old.filter(F.col("path").cast("long") % 5 == 0).withColumn("content_hash", X.content_hash("content_hash"))
    return store.replace_files(old, new, old.filter(F.col("path").cast("long") % 5 < 2)).select("repo_root", "path", "content_hash")


@query(f"WITH {HASHES} SELECT repo_root, count(*)::BIGINT AS locations, count(DISTINCT content_hash)::BIGINT AS hashes, count(DISTINCT path)::BIGINT AS paths FROM h GROUP BY 1")
def location_stats(spark, d):
    return stats.location_stats(locations(spark, d))


@query("SELECT coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE event_type END, 'unknown') AS value, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stats_by_type(spark, d):
    return stats.counts_by(table(spark, d, "events").select(F.nullif("event_type", F.lit("click")).alias("t")), "t")


@query("SELECT lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def stats_by_language(spark, d):
    return stats.counts_by(locations(spark, d), "language")


@query(f"""WITH {HASHES}, {CACHE} SELECT 'total' AS metric, 'chunks' AS value, count(*)::BIGINT AS n FROM h UNION ALL SELECT 'total', 'hashes', count(DISTINCT content_hash) FROM h UNION ALL SELECT 'total', 'files', count(DISTINCT repo_root || '/' || path) FROM h
UNION ALL SELECT 'total', 'cached', count(*) FROM cache UNION ALL SELECT 'type', 'block', count(*) FROM h UNION ALL SELECT 'language', language, count(*) FROM h GROUP BY language""")
def index_stats(spark, d):
    return stats.index_stats(locations(spark, d), half_cache(spark, d))


@query(f"WITH {HASHES} SELECT count(*) FILTER (WHERE true)::BIGINT AS total, count(*) FILTER (WHERE path::BIGINT % 2 = 0)::BIGINT AS existing, count(*) FILTER (WHERE path::BIGINT % 2 = 1)::BIGINT AS to_copy FROM h")
def migration_plan(spark, d):
    rows = locations(spark, d)
    return store.migration_plan(rows, rows.filter(F.col("path").cast("long") % 2 == 0), ("repo_root", "path"))


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id % 10 = 3 OR vec_id % 10 = 7")
def migration_check(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    spoilt = rows.filter("id % 10 <> 7").withColumn("embedding", F.when(F.col("id") % 10 == 3, F.transform("embedding", lambda x: x + F.lit(0.01).cast("float"))).otherwise(F.col("embedding")))
    return store.migration_errors(rows, spoilt, ("id",))


# Search with fusion

LOC_EMB = "loc AS (SELECT label::VARCHAR AS repo_root, 'f' || (vec_id % 40) AS path, (vec_id % 3 * 10 + 1)::INT AS start_line, (vec_id % 3 * 10 + 10)::INT AS end_line, vec_id AS content_hash FROM embeddings)"


def vector_locations(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("label").cast("string").alias("repo_root"), F.concat(F.lit("f"), (F.col("vec_id") % 40).cast("string")).alias("path"), (F.col("vec_id") % 3 * 10 + 1).cast("int").alias("start_line"), (F.col("vec_id") % 3 * 10 + 10).cast("int").alias("end_line"), F.col("vec_id").alias("content_hash"))


SEMANTIC = f"""{QVEC}, {LOC_EMB}, sc AS (SELECT vec_id AS content_hash, 1 - ({_distance_sql('cosine')}) AS score FROM embeddings, q), best AS (SELECT * FROM sc ORDER BY round(score, 12) DESC, content_hash LIMIT 40),
placed AS (SELECT repo_root, path, start_line, end_line, max(score) AS score FROM loc JOIN best USING (content_hash) GROUP BY ALL), sem AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, path, start_line, repo_root) AS rank FROM placed)"""


@query(f"WITH {SEMANTIC} SELECT repo_root, path, start_line, end_line, round(score, 6) AS score FROM sem WHERE rank <= 20")
def semantic_v2(spark, d):
    cache = table(spark, d, "embeddings").select(F.col("vec_id").alias("content_hash"), "embedding")
    return search.semantic_search_by_hash(cache, vector_locations(spark, d), vector(spark, d), 20).select("repo_root", "path", "start_line", "end_line", F.round("score", 6).alias("score"))


LISTS = """a AS (SELECT doc_id::VARCHAR AS id, n_chars::DOUBLE AS score, 'size' AS source, row_number() OVER (ORDER BY n_chars DESC, doc_id::VARCHAR) AS rank FROM documents), b AS (SELECT vec_id::VARCHAR AS id, (vec_id % 17)::DOUBLE AS score, 'vector' AS source, row_number() OVER (ORDER BY vec_id % 17 DESC, vec_id::VARCHAR) AS rank FROM embeddings),
c AS (SELECT doc_id::VARCHAR AS id, quality::DOUBLE AS score, 'label' AS source, row_number() OVER (ORDER BY quality DESC, doc_id::VARCHAR) AS rank FROM labels), al AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)"""
FUSED = LISTS + ", f AS (SELECT id, sum(1.0 / (60 + rank)) AS rrf, max(score) AS score, count(*) AS k FROM al GROUP BY id)"


def scored_lists(spark, d) -> dict[str, DataFrame]:
    docs, vecs, marks = (table(spark, d, t) for t in ("documents", "embeddings", "labels"))
    return {
        "size": docs.select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("double").alias("score")),
        "vector": vecs.select(F.col("vec_id").cast("string").alias("id"), (F.col("vec_id") % 17).cast("double").alias("score")),
        "label": marks.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("double").alias("score")),
    }


def three_lists(spark, d) -> list[DataFrame]:
    return [fusion.ranked(hits, source) for source, hits in scored_lists(spark, d).items()]


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.round("rrf_score", 9).alias("rrf_score"), "score", F.size("sources").cast("long").alias("n_sources"))


@query(f"WITH {FUSED} SELECT id, round(rrf, 9) AS rrf_score, score, k::BIGINT AS n_sources FROM f")
def rrf(spark, d):
    return _rounded(fusion.rrf(*three_lists(spark, d)))


@query(f"WITH {LISTS}, f AS (SELECT id, sum(CASE source WHEN 'size' THEN 0.3 WHEN 'vector' THEN 0.7 ELSE 1.0 END::DOUBLE / (60 + rank)) AS rrf, max(score) AS score, count(*) AS k FROM al GROUP BY id) SELECT id, round(rrf, 9) AS rrf_score, score, k::BIGINT AS n_sources FROM f")
def weighted_rrf(spark, d):
    return _rounded(fusion.weighted_rrf({"size": 0.3, "vector": 0.7}, *three_lists(spark, d)))


@query(f"WITH {FUSED} SELECT id, round(rrf, 9) AS rrf_score, score, k::BIGINT AS n_sources FROM f WHERE k >= 2 AND rrf >= 0.006")
def rrf_min_sources(spark, d):
    return _rounded(fusion.at_least(fusion.min_sources(fusion.rrf(*three_lists(spark, d)), 2), 0.006))


@query(f"WITH {FUSED} SELECT id, round(rrf, 9) AS rrf_score, score, k::BIGINT AS n_sources FROM f ORDER BY round(rrf, 12) DESC, score DESC, k DESC, id LIMIT 25")
def rrf_topn(spark, d):
    return _rounded(fusion.top_n(fusion.rrf(*three_lists(spark, d)), 25))


@query(f"WITH {FUSED} SELECT id, round(rrf, 9) AS rrf_score, score, k::BIGINT AS n_sources FROM f ORDER BY round(rrf, 12) DESC, score DESC, k DESC, id LIMIT 25")
def rrf_topn_threshold(spark, d):
    return _rounded(threshold.top_n_by_threshold(scored_lists(spark, d), 25))


@query()
def rrf_depth_read(spark, d):
    """How far each list was read in order for the 25 best of all, and how long the lists are."""
    lists = scored_lists(spark, d)
    depth = threshold.top_n_by_threshold(lists, 25).first()["depth"]
    sizes = reduce(DataFrame.unionByName, [hits.agg(F.count("*").alias("rows")).withColumn("list", F.lit(s)) for s, hits in lists.items()])
    return sizes.select("list", "rows", F.lit(depth).alias("depth"))


KW = KEYWORD.replace("WITH ", "", 1)
KW_CTE = KW[: KW.index("SELECT repo_root, path, n::INT AS line_start")].rstrip()


@query(f"""WITH {KW_CTE}, {QVEC}, {LOC_EMB}, sc AS (SELECT repo_root, path, start_line, end_line, content_hash, 1 - ({_distance_sql('cosine')}) AS score FROM loc JOIN embeddings ON content_hash = vec_id, q), top AS (SELECT * FROM sc ORDER BY round(score, 12) DESC, path, start_line, repo_root LIMIT 10),
al AS (SELECT path || ':' || n || '-' || n AS key, 0.6::DOUBLE AS part, 'keyword' AS signal FROM r WHERE rank <= 20 UNION ALL SELECT path || ':' || start_line || '-' || end_line, 0.4 * score, 'semantic' FROM top WHERE score > 0),
s AS (SELECT key, sum(part) AS score, CASE WHEN count(DISTINCT signal) > 1 THEN 'both' ELSE min(signal) END AS source FROM al GROUP BY key) SELECT key, round(score, 6) AS score, source FROM s ORDER BY round(score, 12) DESC, key LIMIT 30""")
def hybrid_weighted_sum(spark, d):
    records = vector_locations(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("content_hash"), "embedding"), "content_hash")
    return plans.hybrid_by_sum(files(spark, d), records, PATTERN, vector(spark, d)).select("key", F.round("score", 6).alias("score"), "source")


RETRIEVE = f"""WITH {KW_CTE.replace('row_number() OVER (ORDER BY path, n, repo_root) AS rank FROM m WHERE i <= 40', 'row_number() OVER (ORDER BY path, n, repo_root) AS rank FROM m WHERE i <= 60')}, hit AS (SELECT repo_root, path, n::INT AS line, CASE WHEN regexp_matches(line, '^(\\w+) (?:the|of) ') THEN 'function' WHEN regexp_matches(line, '^(\\w+) and ') THEN 'class' WHEN regexp_matches(line, '^(\\w+)[.,] ') THEN 'constant' END AS kind, regexp_extract(line, '^(\\w+)', 1) AS name FROM lines WHERE lang = 'en'),
sy AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN lower(name) = 'the' THEN 0 WHEN lower(name) LIKE 'the%' THEN 1 ELSE 2 END, encode(name), path, line) AS rank FROM hit WHERE kind IS NOT NULL AND lower(name) LIKE '%the%'),
{QVEC}, {LOC_EMB}, sc AS (SELECT repo_root, path, start_line, end_line, 1 - ({_distance_sql('cosine')}) AS score FROM loc JOIN embeddings ON content_hash = vec_id, q), top AS (SELECT * FROM sc ORDER BY round(score, 12) DESC, path, start_line, repo_root LIMIT 20),
se AS (SELECT *, path || ':' || start_line || ':' || end_line AS id FROM top), al AS (SELECT path || ':' || n AS id, 0.3 / (60 + rank) AS part, (101 - rank)::DOUBLE AS score FROM r WHERE rank <= 30 UNION ALL SELECT path || ':' || line || ':' || name, 0.2 / (60 + rank), (11 - rank)::DOUBLE FROM sy WHERE rank <= 10
UNION ALL SELECT id, 0.5 / (60 + row_number() OVER (ORDER BY round(score, 12) DESC, id)), score FROM se), f AS (SELECT id, sum(part) AS rrf, max(score) AS score, count(*) AS k FROM al GROUP BY id) SELECT id, round(rrf, 9) AS rrf_score, round(score, 6) AS score, k::BIGINT AS n_sources FROM f ORDER BY round(rrf, 12) DESC, f.score DESC, k DESC, id LIMIT 40"""


@query(RETRIEVE)
def retriever_three_signals(spark, d):
    records = vector_locations(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("content_hash"), "embedding"), "content_hash")
    out = plans.retrieve(files(spark, d), records, english_symbols(spark, d), PATTERN, vector(spark, d), "the", SearchConfig(), 40)
    return _rounded(out.withColumn("score", F.round("score", 6)))


def flagship(spark, d) -> DataFrame:
    """Keyword and semantic search over documents and vectors, fused and reranked."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("content_hash"), "embedding")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    fused = plans.hybrid(files(spark, d), e, vector_locations(spark, d), PATTERN, vector(spark, d), 40)
    contents = fused.select("id", "path").join(docs, "path").select("id", "content")
    return rerank.rerank(fused, contents, rerank.overlap_scores("released under the license"), 20, most=40).orderBy("position").limit(20)


HYBRID = f"""WITH {KW_CTE.replace('i <= 40', 'i <= 80')}, {SEMANTIC.replace('LIMIT 40)', 'LIMIT 80)')},
al AS (SELECT path || ':' || n AS id, path, 0.3 / (60 + rank) AS part, (101 - rank)::DOUBLE AS score FROM r WHERE rank <= 40 UNION ALL SELECT path || ':' || start_line || ':' || end_line, path, 0.5 / (60 + row_number() OVER (ORDER BY round(score, 12) DESC, path || ':' || start_line || ':' || end_line)), score FROM sem WHERE rank <= 40),
f AS (SELECT id, min(path) AS path, sum(part) AS rrf, max(score) AS score, count(*) AS k FROM al GROUP BY id), p AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, score DESC, k DESC, id) AS old FROM f),
ct AS (SELECT doc_id::VARCHAR AS path, len(list_intersect(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')), ['released', 'under', 'the', 'license'])) / 4.0 AS s FROM documents),
j AS (SELECT p.id, rrf, old, CASE WHEN old <= 20 THEN ct.s::DOUBLE END AS s, old <= 20 AS head FROM p LEFT JOIN ct ON p.path = ct.path WHERE old <= 40),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN s IS NOT NULL THEN 0 WHEN head THEN 1 ELSE 2 END, s DESC NULLS LAST, old) AS position FROM j)
SELECT id, position::INT AS position, round(rrf, 9) AS rrf_score, round(s, 6) AS rerank_score, s IS NOT NULL AS reranked FROM o WHERE position <= 20"""


@query(HYBRID)
def hybrid_v2_rerank(spark, d):
    return flagship(spark, d).select("id", "position", F.round("rrf_score", 9).alias("rrf_score"), F.round("rerank_score", 6).alias("rerank_score"), "reranked")


RERANK = f"""WITH {FUSED}, p AS (SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, score DESC, k DESC, id) AS old FROM f), ct AS (SELECT doc_id::VARCHAR AS id, (n_chars % 100) / 100.0 AS s FROM documents),
j AS (SELECT p.id, old, CASE WHEN old <= 50 THEN ct.s::DOUBLE END AS s, old <= 50 AS head FROM p LEFT JOIN ct ON p.id = ct.id), k AS (SELECT * FROM j WHERE s IS NULL OR s >= 0.3),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN s IS NOT NULL THEN 0 WHEN head THEN 1 ELSE 2 END, s DESC NULLS LAST, old) AS position FROM k) SELECT id, position::INT AS position, round(s, 6) AS rerank_score, s IS NOT NULL AS reranked FROM o"""


@query(RERANK)
def rerank_threshold(spark, d):
    fused = fusion.rrf(*three_lists(spark, d))
    contents = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), ((F.col("n_chars") % 100) / 100.0).cast("string").alias("content"))
    out = rerank.rerank(fused, contents, lambda c: c.cast("double"), 50, 0.3)
    return out.select("id", "position", F.round("rerank_score", 6).alias("rerank_score"), "reranked")


@query(RERANK.replace("AS s FROM documents)", "AS s FROM documents WHERE doc_id % 2 = 0)").replace("s >= 0.3", "s >= 0.0"))
def rerank_missing_content(spark, d):
    fused = fusion.rrf(*three_lists(spark, d))
    contents = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").cast("string").alias("id"), ((F.col("n_chars") % 100) / 100.0).cast("string").alias("content"))
    out = rerank.rerank(fused, contents, lambda c: c.cast("double"), 50)
    return out.select("id", "position", F.round("rerank_score", 6).alias("rerank_score"), "reranked")


# Trees and changes

TREE = "n AS (SELECT source || '/' || doc_id AS path, source AS parent, sha256(text) AS hash, strlen(text)::BIGINT AS size FROM documents), s AS (SELECT parent AS path, sha256(string_agg(hash, '' ORDER BY encode(path))) AS hash, sum(size)::BIGINT AS size FROM n GROUP BY parent), r AS (SELECT '' AS path, sha256(string_agg(hash, '' ORDER BY encode(path))) AS hash, sum(size)::BIGINT AS size FROM s)"


def tree_files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "text")


@query(f"WITH {TREE} SELECT path, parent, 2::INT AS depth, false AS is_dir, hash, size FROM n UNION ALL SELECT path, '' AS parent, 1, true, hash, size FROM s UNION ALL SELECT path, '', 0, true, hash, size FROM r")
def merkle_rollup(spark, d):
    return merkle.rollup(merkle.file_nodes(tree_files(spark, d)))


@query(f"WITH {TREE}, o AS (SELECT path, hash FROM n WHERE hash[1] <> '0'), w AS (SELECT path, CASE WHEN hash[2] = '1' THEN sha256(hash) ELSE hash END AS hash FROM n WHERE hash[1] <> '1') SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN w ON o.path = w.path WHERE o.hash IS DISTINCT FROM w.hash")
def merkle_diff(spark, d):
    nodes = merkle.file_nodes(tree_files(spark, d))
    new = nodes.filter("hash not like '1%'").withColumn("hash", F.when(F.col("hash").like("_1%"), X.content_hash("hash")).otherwise(F.col("hash")))
    return merkle.diff(nodes.filter("hash not like '0%'"), new)


DEEP = "n AS (SELECT source AS top, source || '/d' || (doc_id % 50) AS dir, source || '/d' || (doc_id % 50) || '/' || doc_id AS path FROM documents), m AS (SELECT min(path) AS gone, max(path) AS other FROM n), t AS (SELECT n.* FROM n, m WHERE path IN (gone, other))"


@query(f"""WITH {DEEP}, c AS (SELECT 1 + (SELECT count(DISTINCT top) FROM n) + (SELECT count(DISTINCT dir) FROM n WHERE top IN (SELECT top FROM t)) + (SELECT count(*) FROM n WHERE dir IN (SELECT dir FROM t)) AS compared)
SELECT gone AS path, 'deleted' AS change, compared::BIGINT AS compared FROM m, c UNION ALL SELECT other, 'modified', compared::BIGINT FROM m, c""")
def merkle_pruned_diff(spark, d):
    """One file gone and one changed: the changes, and how many rows of the two trees were compared to find them."""
    names = F.concat_ws("/", "source", F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")), F.col("doc_id").cast("string"))
    nodes = scratch.settle(merkle.file_nodes(table(spark, d, "documents").select(names.alias("path"), "text")), "nodes")
    gone, other = nodes.agg(F.min("path"), F.max("path")).first()
    after = nodes.filter(F.col("path") != gone).withColumn("hash", F.when(F.col("path") == other, X.content_hash("hash")).otherwise(F.col("hash")))
    old, new = (merkle.save_tree(merkle.rollup(t, names=True), scratch.folder(spark, "tree")) for t in (nodes, after))
    changes, compared = merkle.pruned_diff(old, new)
    return changes.withColumn("compared", F.lit(compared).cast("long"))


@query(f"WITH {TREE} SELECT parent AS path, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM n GROUP BY 1 UNION ALL SELECT '', count(*), sum(size)::BIGINT FROM n")
def dir_sizes(spark, d):
    return merkle.directory_sizes(merkle.file_nodes(tree_files(spark, d)))


@query(f"WITH {HASHES} SELECT repo_root, path FROM h WHERE path::BIGINT % 6 IN (0, 1)")
def incremental_changed_files(spark, d):
    new = locations(spark, d)
    old = new.filter(F.col("path").cast("long") % 6 != 0).withColumn("content_hash", F.when(F.col("path").cast("long") % 6 == 1, X.content_hash("content_hash")).otherwise(F.col("content_hash")))
    return merkle.changed_hash_sets(old.unionByName(old), new)


# Events

SESSIONS = """e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)"""


@query(f"WITH {SESSIONS} SELECT user_id AS key, epoch_us(min(ts))::BIGINT AS first, epoch_us(max(ts))::BIGINT AS last, epoch_us(max(ts) + INTERVAL 30 MINUTE)::BIGINT AS fires_at, count(*)::BIGINT AS events FROM g GROUP BY user_id, s")
def debounce_sessions(spark, d):
    out = watch.debounced(table(spark, d, "events"), F.col("user_id"), quiet="30 minutes")
    return out.select("key", *[F.unix_micros(c).alias(c) for c in ("first", "last", "fires_at")], "events")


EVENT_PATH = "'/p' || (user_id % 7) || CASE WHEN event_id % 5 = 0 THEN '/.git' ELSE '/src' END || '/f' || event_id || '.go'"


def event_paths(spark, d) -> DataFrame:
    path = F.concat(F.lit("/p"), (F.col("user_id") % 7).cast("string"), F.when(F.col("event_id") % 5 == 0, "/.git").otherwise("/src"), F.lit("/f"), F.col("event_id").cast("string"), F.lit(".go"))
    return table(spark, d, "events").select("event_id", "ts", path.alias("path"))


def five_projects(spark) -> DataFrame:
    return spark.createDataFrame([(f"/p{i}",) for i in range(5)], "path string")


@query(f"WITH e AS (SELECT event_id, user_id, {EVENT_PATH} AS path FROM events) SELECT event_id, path, CASE WHEN user_id % 7 < 5 AND event_id % 5 <> 0 THEN '/p' || (user_id % 7) END AS project FROM e")
def events_to_project(spark, d):
    return project_of(event_paths(spark, d).drop("ts"), five_projects(spark))


@query("WITH e AS (SELECT '/p' || (user_id % 7) AS p, ts FROM events WHERE user_id % 7 < 5 AND event_id % 5 <> 0), l AS (SELECT p, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY p ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT p AS key, epoch_us(max(ts) + INTERVAL 10 MINUTE)::BIGINT AS fires_at, count(*)::BIGINT AS events FROM g GROUP BY p, s")
def reindex_queue(spark, d):
    events = project_of(watch.relevant(event_paths(spark, d).withColumn("op", F.lit("write"))), five_projects(spark)).filter("project is not null")
    return watch.debounced(events, F.col("project"), quiet="10 minutes").select("key", F.unix_micros("fires_at").alias("fires_at"), "events")


# Evaluation: a benchmark item is a case that expects its first words, a conversation is a run.


def eval_cases(spark, d) -> DataFrame:
    words = F.filter(F.split("text", r"[\s.,]+"), lambda w: w != "")
    truth = F.struct(F.transform(F.slice(words, 1, 2), lambda w: F.concat(F.lit("src/"), w, F.lit(".py"))).alias("files"), F.slice(words, 3, 3).alias("symbols"), F.lit(None).cast("map<string,array<int>>").alias("lines"), F.lit(None).cast("array<string>").alias("content"))
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 2 == 0, "search").otherwise("navigate").alias("category"), F.lit("").alias("description"), F.col("text").alias("prompt"), truth.alias("ground_truth"), F.lit("easy").alias("difficulty"))


def eval_runs(spark, d) -> DataFrame:
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    c = table(spark, d, "conversations").filter("role = 'assistant'").groupBy("conv_id").agg(F.array_join(said, " ").alias("text"))
    b = table(spark, d, "benchmark").select((F.col("item_id") * 2).alias("conv_id"), F.col("text").alias("hint"))
    words = F.filter(F.split("hint", r"[\s.,]+"), lambda w: w != "")
    output = F.concat(F.coalesce("text", F.lit("")), F.lit(" see "), F.coalesce(F.concat(F.lit("lib/SRC/"), F.get(words, F.lit(0)), F.lit(".py and "), F.upper(F.get(words, F.lit(2)))), F.lit("nothing")))
    rows = c.join(b, "conv_id", "left")
    return rows.select(F.floor(F.col("conv_id") / 2).cast("string").alias("test_case_id"), F.when(F.col("conv_id") % 2 == 0, evals.WITH).otherwise(evals.WITHOUT).alias("mode"), (F.col("conv_id") % 9 != 0).alias("success"), output.alias("output"), F.lit("").alias("session_id"), *[(F.col("conv_id") * k).cast("long").alias(n) for k, n in ((1000000, "duration_ns"), (30, "tokens_used"), (10, "input_tokens"), (20, "output_tokens"), (0, "cache_read_tokens"), (1, "cache_create_tokens"))], (F.col("conv_id") / 100.0).alias("cost_usd"), F.lit(3).cast("long").alias("num_turns"), F.lit(2).cast("long").alias("tool_call_count"), F.lit("").alias("error"))


EVAL = r"""b AS (SELECT item_id, list_filter(regexp_split_to_array(text, '[\s.,]+'), lambda w: w <> '') AS ws FROM benchmark), cs AS (SELECT item_id::VARCHAR AS id, ['src/' || w || '.py' for w in ws[1:2]] AS files, ws[3:5] AS symbols FROM b),
c AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn, text), '') AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
rn AS (SELECT conv_id, (conv_id // 2)::VARCHAR AS test_case_id, CASE WHEN conv_id % 2 = 0 THEN 'with_mcp' ELSE 'without_mcp' END AS mode, conv_id % 9 <> 0 AS ok, coalesce(text, '') || ' see ' || coalesce('lib/SRC/' || ws[1] || '.py and ' || upper(ws[3]), 'nothing') AS output FROM c LEFT JOIN b ON b.item_id * 2 = conv_id),
nm AS (SELECT rn.*, files, symbols, lower(output) AS low, list_distinct(list_concat(regexp_extract_all(output, '[\w\-./]+\.(?:go|py|js|ts|tsx|jsx|java|rb|rs|c|cpp|h|hpp|sql|sh)'), regexp_extract_all(output, '[\w\-]+/[\w\-./]+'))) AS named FROM rn JOIN cs ON rn.test_case_id = cs.id),
v AS (SELECT test_case_id, mode, ok, CASE WHEN ok THEN list_filter(files, lambda f: contains(low, lower(f)) OR len(list_filter(named, lambda p: contains(lower(p), lower(f)) OR contains(lower(f), lower(p)))) > 0) ELSE [] END AS ff, CASE WHEN ok THEN list_filter(symbols, lambda s: contains(low, lower(s))) ELSE [] END AS sf, len(files) + len(symbols) AS expected FROM nm),
w AS (SELECT test_case_id, mode, len(ff) AS files_found, len(sf) AS symbols_found, (len(ff) + len(sf))::DOUBLE / expected AS recall FROM v)"""


@query(f"WITH {EVAL} SELECT test_case_id, mode, files_found::BIGINT AS files_found, symbols_found::BIGINT AS symbols_found, round(recall, 9) AS recall, round(recall, 9) AS f1 FROM w")
def eval_validate(spark, d):
    out = evals.validate(eval_cases(spark, d), eval_runs(spark, d))
    return out.select("test_case_id", "mode", F.size("files_found").cast("long").alias("files_found"), F.size("symbols_found").cast("long").alias("symbols_found"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


COMPARE = EVAL + ", cmp AS (SELECT test_case_id, coalesce(max(recall) FILTER (WHERE mode = 'with_mcp'), 0) AS a, coalesce(max(recall) FILTER (WHERE mode = 'without_mcp'), 0) AS b FROM w GROUP BY 1)"


@query(f"WITH {COMPARE} SELECT test_case_id, CASE WHEN test_case_id::INT % 2 = 0 THEN 'search' ELSE 'navigate' END AS category, round(a, 9) AS with_f1, round(b, 9) AS without_f1, round(a - b, 9) AS accuracy_diff, CASE WHEN a > b THEN 'with_mcp' WHEN a < b THEN 'without_mcp' END AS winner FROM cmp")
def eval_compare(spark, d):
    cases = eval_cases(spark, d)
    out = evals.compare(cases, evals.validate(cases, eval_runs(spark, d)))
    return out.select("test_case_id", "category", *[F.round(c, 9).alias(c) for c in ("with_f1", "without_f1", "accuracy_diff")], "winner")


@query(f"""WITH {COMPARE}, acc AS (SELECT 'with_mcp' AS mode, coalesce(avg(a) FILTER (WHERE a > 0), 0) AS ref_accuracy, avg(a) AS accuracy FROM cmp UNION ALL SELECT 'without_mcp', coalesce(avg(b) FILTER (WHERE b > 0), 0), avg(b) FROM cmp),
k AS (SELECT mode, count(*)::BIGINT AS runs, avg(ok::INT) AS success_rate, avg(conv_id * 1000000) AS dur, avg(conv_id * 30) AS tok, sum(conv_id / 100.0) AS cost, (2 * count(*))::BIGINT AS calls FROM rn GROUP BY mode)
SELECT mode, runs, round(success_rate, 6) AS success_rate, round(dur, 3) AS avg_duration_ns, round(tok, 6) AS avg_tokens_used, round(cost::DOUBLE, 6) AS total_cost_usd, calls AS total_tool_calls, round(ref_accuracy, 6) AS ref_accuracy, round(accuracy, 6) AS accuracy FROM k JOIN acc USING (mode)""")
def eval_summary(spark, d):
    cases, runs = eval_cases(spark, d), eval_runs(spark, d)
    out = evals.summarize(runs, evals.compare(cases, evals.validate(cases, runs)))
    return out.select("mode", "runs", F.round("success_rate", 6).alias("success_rate"), F.round("avg_duration_ns", 3).alias("avg_duration_ns"), F.round("avg_tokens_used", 6).alias("avg_tokens_used"), F.round("total_cost_usd", 6).alias("total_cost_usd"), "total_tool_calls", F.round("ref_accuracy", 6).alias("ref_accuracy"), F.round("accuracy", 6).alias("accuracy"))


# Lookups


@query(f"WITH {HASHES} SELECT repo_root, path, content_hash FROM h WHERE content_hash IN (SELECT content_hash FROM h WHERE path::BIGINT % 50 = 0) AND repo_root IN ('src0', 'src1', 'src2')")
def hash_lookup(spark, d):
    rows = locations(spark, d)
    return lookup.by_hashes(rows, rows.filter(F.col("path").cast("long") % 50 == 0), ["src0", "src1", "src2"]).select("repo_root", "path", "content_hash")


@query("SELECT doc_id::VARCHAR AS path, lang AS language FROM documents WHERE source = 'src3' AND lang = 'en'")
def attribute_filter(spark, d):
    return lookup.by_attribute(lookup.by_repo(locations(spark, d), "src3"), language="en", node_type="block").select("path", "language")


@query(f"WITH {HASHES}, {CACHE} SELECT path, content_hash IN (SELECT content_hash FROM cache) AS exists FROM h")
def existing_hashes(spark, d):
    return lookup.existing(locations(spark, d), half_cache(spark, d), ("content_hash",)).select("path", "exists")


@query(f"WITH {HASHES}, l AS (SELECT content_hash, max(path) AS path FROM h GROUP BY 1) SELECT h.path AS hit, l.path FROM h JOIN l USING (content_hash)")
def attach_records(spark, d):
    rows = locations(spark, d)
    return lookup.attach_locations(rows.select("content_hash", F.col("path").alias("hit")), rows).select("hit", "path")


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey")
def counts_by_key(spark, d):
    return lookup.count_rows(table(spark, d, "orders"), ("o_custkey",))


@query("SELECT vec_id, true AS blob_ok, true AS json_ok FROM embeddings")
def vector_codecs(spark, d):
    e = F.col("embedding")
    near = lambda x: F.forall(F.zip_with(x, e, lambda a, b: F.abs(a - b)), lambda t: t < 1e-6) & (F.size(x) == F.size(e))
    return table(spark, d, "embeddings").select("vec_id", near(blobs.from_blob(blobs.to_blob(e))).alias("blob_ok"), near(V.from_json(V.to_json(e))).alias("json_ok"))


@query("SELECT count(*)::BIGINT AS projects, count(*) FILTER (WHERE n_nationkey % 2 = 0)::BIGINT AS watched, sum(n_nationkey)::BIGINT AS symbols, sum(n_regionkey)::BIGINT AS embeddings, 0::BIGINT AS db_bytes FROM nation")
def registry_totals(spark, d):
    rows = table(spark, d, "nation").select((F.col("n_nationkey") % 2 == 0).alias("watch_enabled"), F.col("n_nationkey").cast("long").alias("symbols"), F.col("n_regionkey").cast("long").alias("embeddings"), F.lit(0).cast("long").alias("db_bytes"))
    return stats.registry_stats(rows)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, count(*) OVER () AS total FROM orders) WHERE n % greatest(1, total // 100) = 1 % greatest(1, total // 100) AND n <= greatest(1, total // 100) * 100")
def sample_every_nth(spark, d):
    return store.every_nth(table(spark, d, "orders"), ("o_orderkey",), 100).select("o_orderkey")


@query(f"""WITH {FILES}, {EVERY_LINE}, b AS (SELECT repo_root, path, 'c' || st AS id, st, least(st + 9, n) AS en FROM (SELECT repo_root, path, unnest(range(1, n + 1, 10)) AS st, n FROM (SELECT repo_root, path, max(n) AS n FROM l GROUP BY ALL))),
m AS (SELECT repo_root, path, n FROM l WHERE regexp_matches(line, '(?i)license')) SELECT DISTINCT m.path || ':' || m.n AS hit, m.path || ':' || st || ':' || en AS id FROM m JOIN b ON m.repo_root = b.repo_root AND m.path = b.path AND m.n BETWEEN st AND en""")
def lines_into_chunks(spark, d):
    hits = search.matching_lines(files(spark, d), "(?i)license").select(X.keyword_id("path", "line").alias("id"), "path", "line", X.keyword_id("path", "line").alias("hit"))
    n = F.size(X.lines_of("text"))
    chunks = files(spark, d).select("path", n.alias("n"), F.explode(F.sequence(F.lit(1), n, F.lit(10))).alias("start_line")).select("path", "start_line", F.least(F.col("start_line") + 9, F.col("n")).alias("end_line"))
    return search.into_chunks(hits, chunks).select("hit", "id")


# Generic queries


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45")
def query_builder_select(spark, d):
    return store.select_rows(table(spark, d, "lineitem"), ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), [F.col("l_returnflag") == "R", F.col("l_quantity") >= 45])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    return store.select_rows(table(spark, d, "orders"), ("o_orderkey", "o_totalprice"), [F.col("o_orderstatus") == "F"], [F.col("o_totalprice").desc(), "o_orderkey"], 20, 40)


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, sum(l_quantity)::DOUBLE AS quantity, round(avg(l_discount), 9) AS discount FROM lineitem GROUP BY 1, 2")
def grouped_totals(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 9).alias("discount"))


@query("SELECT r_name, count(*)::BIGINT AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def joined_totals(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09 AND l_suppkey IS NOT NULL)")
def anti_join_keys(spark, d):
    busy = table(spark, d, "lineitem").filter("l_quantity > 49 and l_discount > 0.09").select(F.col("l_suppkey").alias("s_suppkey"))
    return store.delete_keys(table(spark, d, "supplier"), busy, ("s_suppkey",)).select("s_suppkey")


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0) ELSE printf('%.1f MiB', n / 1048576.0) END AS size, CASE WHEN n < 1000 THEN n || 'ms' ELSE printf('%.1fs', n * 1000003 / 1e9) END AS time FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def readable_sizes(spark, d):
    n = F.octet_length("text")
    return table(spark, d, "documents").select("doc_id", formats.byte_size(n).alias("size"), formats.duration(n.cast("long") * 1_000_003).alias("time"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS snippet, '[' || doc_id || ':1-' || n || '] (' || n || ' lines)' AS label FROM (SELECT doc_id, text, len(string_split(text, chr(10))) AS n FROM documents)")
def snippets(spark, d):
    n = F.size(X.lines_of("text"))
    return table(spark, d, "documents").select("doc_id", X.hard_truncated("text").alias("snippet"), X.snippet_label(F.col("doc_id").cast("string"), F.lit(1), n).alias("label"))


@query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents), c AS (SELECT doc_id, text, a, (SELECT max(k) FROM (SELECT unnest(range(0, len(a) + 1)) AS k) WHERE length(array_to_string(a[1:k], chr(10))) + CASE WHEN k < 2 THEN 1 ELSE 0 END <= 800) AS k FROM l)
SELECT doc_id, CASE WHEN length(text) <= 800 THEN text WHEN array_to_string(a[1:k], chr(10)) = '' THEN substr(text, 1, 800) || '...' ELSE array_to_string(a[1:k], chr(10)) || chr(10) || '...' END AS snippet FROM c""")
def soft_snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", X.soft_truncated("text", 800).alias("snippet"))


# Importers, registries, changes: tables of the test data in the place of files, written to the shared folder where a file is read


def numbered_lines(spark, d) -> DataFrame:
    rows = files(spark, d).select("path", F.posexplode(X.lines_of("text")).alias("i", "text"))
    return rows.select("path", (F.col("i") + 1).alias("line"), "text").filter(F.col("text") != "")


IMPORTED = f"WITH {FILES}, {EVERY_LINE} SELECT path, n::INT AS line, line AS text FROM l WHERE line <> ''"


@query(IMPORTED)
def import_match_lines(spark, d):
    lines = numbered_lines(spark, d).select(F.concat(F.lit("/r/"), "path", F.lit(":"), "line", F.lit(":"), "text").alias("value"))
    return sources.parse_match_lines(lines.unionByName(lines.limit(1).select(F.lit("--").alias("value"))), "/r")


@query(IMPORTED)
def import_match_events(spark, d):
    own = lambda c: F.struct(F.col(c).alias("text"))
    data = F.struct(own("path").alias("path"), own("text").alias("lines"), F.col("line").alias("line_number"))
    lines = numbered_lines(spark, d).withColumn("text", F.concat("text", F.lit("\n"))).select(F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("value"))
    return sources.parse_match_events(lines.unionByName(lines.limit(1).select(F.lit('{"type":"summary"}').alias("value"))))


@query("SELECT '/parts' AS repo_root, p_name AS name, 'type' AS kind, p_brand || '/' || p_partkey AS path, p_size AS line, 'go' AS language, CASE WHEN p_size % 2 = 0 THEN 'struct:' || p_type END AS scope FROM part")
def tag_symbols(spark, d):
    at = scratch.folder(spark, "tags")
    rows = table(spark, d, "part").select(F.lit("tag").alias("_type"), F.col("p_name").alias("name"), F.concat_ws("/", F.lit("/parts"), "p_brand", "p_partkey").alias("path"), F.col("p_size").alias("line"), F.lit("typedef").alias("kind"), F.lit("Go").alias("language"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("scope"), F.lit("struct").alias("scopeKind"))
    rows.unionByName(rows.limit(1).withColumn("_type", F.lit("ptag"))).write.json(at)
    return symbols.from_tags(sources.read_tags(spark, at), "/parts").select("repo_root", "name", "kind", "path", "line", "language", "scope")


def nations_as_projects(spark, d) -> DataFrame:
    return table(spark, d, "nation").select(F.concat(F.lit("/p/"), "n_name").alias("path"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("watch_enabled"), F.timestamp_seconds(F.lit(0)).alias("added_at"), F.col("n_nationkey").cast("long").alias("symbols"))


@query("SELECT '/p/' || n_name AS path, n_name AS name, CASE WHEN n_nationkey = 4 THEN 99 ELSE n_nationkey END::BIGINT AS symbols FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <> 6 UNION ALL SELECT '/p/new', 'new', -1")
def registry_edits(spark, d):
    at = scratch.folder(spark, "registry")
    projects = nations_as_projects(spark, d)
    name = {r["n_nationkey"]: r["n_name"] for r in table(spark, d, "nation").collect()}
    projects = sources.remove_project(sources.set_project(sources.add_project(projects, "/p/new"), f"/p/{name[4]}", symbols=99), f"/p/{name[6]}")
    sinks.write_registry(projects, at)
    return sources.watched(sources.read_registry(spark, at)).select("path", "name", F.coalesce("symbols", F.lit(-1).cast("long")).alias("symbols"))


@query("SELECT item_id::VARCHAR AS id, 'search' AS category, text AS prompt FROM benchmark WHERE item_id % 2 = 0")
def eval_cases_read(spark, d):
    at = scratch.folder(spark, "cases")
    cases = eval_cases(spark, d).select(F.to_json(F.struct("*")).alias("value"))
    cases.unionByName(cases.limit(1).select(F.lit("// a comment").alias("value"))).write.format("text").save(at + "/given")
    found = [f for f in spark.read.text(at + "/given").inputFiles()]
    fs, path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for i, f in enumerate(found):
        fs.rename(path(f), path(f"{at}/given/{i}.jsonl"))
    return sources.read_cases(spark, at, categories=["search"]).select("id", "category", "prompt")


@query("SELECT text AS output, conv_id % 9 <> 0 AS success, conv_id::VARCHAR AS session_id, turn * 1000000 AS duration_ns, (conv_id * 3)::BIGINT AS input_tokens FROM conversations WHERE role = 'assistant'")
def recorded_runs(spark, d):
    c = table(spark, d, "conversations")
    usage = F.struct((F.col("conv_id") * 3).alias("input_tokens"), F.lit(1).alias("output_tokens"))
    events = c.select(F.to_json(F.struct(F.when(F.col("role") == "assistant", "result").otherwise("user").alias("type"), (F.col("conv_id") % 9 == 0).alias("is_error"), F.col("text").alias("result"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("duration_ms"), usage.alias("usage"))).alias("value"))
    return sources.run_results(events).select("output", "success", "session_id", "duration_ns", "input_tokens")


@query(f"WITH {FILES}, {EVERY_LINE}, f AS (SELECT repo_root, path FROM files ORDER BY repo_root, path LIMIT 1) SELECT path, n::INT AS line FROM l JOIN f USING (repo_root, path) WHERE line <> ''")
def lines_of_a_file(spark, d):
    rows = numbered_lines(spark, d).join(files(spark, d).select("repo_root", "path"), "path")
    first = files(spark, d).orderBy("repo_root", "path").select("repo_root", "path").first()
    return lookup.by_path(rows, first[0], first[1]).select("path", F.col("line").cast("int").alias("line"))


@query(f"WITH {SYMBOLS_CTE} SELECT (SELECT count(*) FROM symbols)::BIGINT AS symbols, (SELECT count(*) FROM documents)::BIGINT AS files")
def symbol_and_file_counts(spark, d):
    return stats.symbol_stats(english_symbols(spark, d), files(spark, d))


@query("SELECT * FROM (VALUES ('same', false), ('one text changed', true), ('one file gone', true)) AS t(tree, changed)")
def any_change(spark, d):
    nodes = merkle.file_nodes(tree_files(spark, d))
    last = nodes.agg(F.max("path")).first()[0]
    other = nodes.withColumn("hash", F.when(F.col("path") == last, F.lit("0")).otherwise(F.col("hash")))
    root = {name: merkle.root_hash(merkle.rollup(rows)) for name, rows in (("first", nodes), ("same", nodes), ("one text changed", other), ("one file gone", nodes.filter(F.col("path") != last)))}
    return spark.createDataFrame([(name, h != root["first"]) for name, h in root.items() if name != "first"], "tree string, changed boolean")


@query("WITH c AS (SELECT doc_id, source FROM documents) SELECT source AS repo_root, doc_id::VARCHAR AS path, 'old' AS node_type FROM c WHERE source <> 'src1' AND doc_id % 10 <> 3 UNION ALL SELECT 'src1', 'x' || doc_id, 'new' FROM c WHERE source = 'src2' AND doc_id % 10 <> 3")
def full_reindex(spark, d):
    old = locations(spark, d).withColumn("node_type", F.lit("old"))
    new = old.filter("repo_root = 'src2'").select(*[F.lit("src1").alias(c) if c == "repo_root" else F.concat(F.lit("x"), c).alias(c) if c == "path" else F.lit("new").alias(c) if c == "node_type" else F.col(c) for c in old.columns])
    rows = store.replace_repo(old, new, "src1")
    return store.delete_where(rows, F.regexp_extract("path", r"(\d+)$", 1).cast("long") % 10 == 3).select("repo_root", "path", "node_type")


@query(f"WITH {SYMBOLS_CTE} SELECT repo_root, path, line, name FROM symbols WHERE repo_root <> 'src0' UNION ALL SELECT repo_root, path, line + 1000, 'again' FROM symbols WHERE repo_root = 'src0'")
def batch_symbol_insert(spark, d):
    old = english_symbols(spark, d)
    mine = old.filter("repo_root = 'src0'")
    new = mine.withColumn("line", (F.col("line") + 1000).cast("int")).withColumn("name", F.lit("again"))
    return store.replace_files(old, new, mine).select("repo_root", "path", "line", "name")


@query("SELECT 'vector' AS kind, vec_id, label::VARCHAR AS repo_root, 64 AS dimensions FROM embeddings WHERE label <> 1 UNION ALL SELECT 'config', -1, r, CASE WHEN r = '1' THEN 128 ELSE 64 END FROM (SELECT DISTINCT label::VARCHAR AS r FROM embeddings)")
def switch_dimensions(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("repo_root"), F.lit(64).alias("dimensions"))
    config = vectors.select("repo_root").distinct().select("repo_root", F.lit("m").alias("model"), F.lit(64).alias("dimensions"), F.timestamp_seconds(F.lit(0)).alias("updated_at"))
    kept, new = store.switch_dimensions(vectors, config, "1", "m", 128)
    return kept.select(F.lit("vector").alias("kind"), "vec_id", "repo_root", "dimensions").unionByName(lookup.config_of(new).select(F.lit("config").alias("kind"), F.lit(-1).cast("long").alias("vec_id"), "repo_root", "dimensions"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN event_type ELSE 'class:' || event_type END AS scope, event_id % 100 >= 52 OR event_id % 200 >= 100 AS recent FROM events")
def scopes_epochs_versions(spark, d):
    e = table(spark, d, "events")
    scope = X.scope_of(F.when(F.col("user_id") % 3 == 2, "class").otherwise(""), F.when(F.col("user_id") % 3 == 0, "").otherwise(F.col("event_type")))
    version = F.concat(F.when(F.col("event_id") % 200 >= 100, "2").otherwise("1"), F.lit("."), (F.col("event_id") % 100).cast("string"), F.lit(".x"))
    return e.select("event_id", X.to_epoch("ts").alias("seconds"), scope.alias("scope"), X.version_at_least(version, "1.52").alias("recent"))


@query("SELECT conv_id, 'case-' || conv_id AS test_case, CASE WHEN conv_id % 2 = 0 THEN 'with_mcp' ELSE 'without_mcp' END AS mode, 1704067200 + conv_id AS at FROM conversations WHERE conv_id % 5 <> 0")
def log_names(spark, d):
    c = table(spark, d, "conversations")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")), "yyyy-MM-dd-HHmmss")
    name = F.concat(F.lit("logs/"), stamp, F.lit("-case-"), "conv_id", F.when(F.col("conv_id") % 5 == 0, "-other").when(F.col("conv_id") % 2 == 0, "-with_mcp").otherwise("-without_mcp"), F.lit(".log"))
    return c.select("conv_id", evals.parse_log_name(name).alias("x")).filter("x is not null").select("conv_id", "x.test_case", "x.mode", X.to_epoch("x.timestamp").alias("at"))


@query(f"WITH {HASHES} SELECT path, 'changed' AS state FROM h WHERE path::BIGINT % 4 IN (0, 1) UNION ALL SELECT 'gone' || path, 'deleted' FROM h WHERE path::BIGINT % 4 = 2")
def file_changes(spark, d):
    now = locations(spark, d).select("repo_root", "path", F.timestamp_seconds(F.lit(0)).alias("mtime"), F.col("end_line").cast("long").alias("size"))
    four = F.col("path").cast("long") % 4
    before = now.filter(four != 0).withColumn("size", F.when(four == 1, F.col("size") + 1).otherwise(F.col("size"))).unionByName(now.filter(four == 2).withColumn("path", F.concat(F.lit("gone"), "path")))
    return sources.changed_files(now, before).select("path", F.lit("changed").alias("state")).unionByName(sources.deleted_files(now, before).select("path", F.lit("deleted").alias("state")))


KNOWN_CHUNKS = ", ".join(f"('{path}', {first}, {last}, '{kind}', '{name}')" for path, chunks in samples.CHUNKS.items() for first, last, kind, name in chunks)


@query(f"SELECT * FROM (VALUES {KNOWN_CHUNKS}) AS t(path, start_line, end_line, node_type, node_name)")
def structural_chunks_known(spark, d):
    given = spark.createDataFrame([("r", p, t) for p, t in samples.SOURCES.items()], "repo_root string, path string, text string")
    found = chunking.structural_chunks(given, ChunkConfig(max_bytes=30)).filter("node_type <> 'gap'")
    return found.select("path", "start_line", "end_line", "node_type", "node_name")
