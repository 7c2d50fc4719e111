"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm.conversation_repair import damaged, repair_report
from quarryloom.llm.decontaminate import decontaminate
from quarryloom.llm.jaccard_join import jaccard_components
from quarryloom.llm.license_scan import license_scan
from quarryloom.llm.line_dedup import line_dedup
from quarryloom.llm.mixing import mix_sources
from quarryloom.llm.quality_classifier import quality_classifier
from quarryloom.llm.quality_rules import quality_rules
from quarryloom.llm.sharding import shard_documents
from quarryloom.llm.substring_dedup import substring_dedup
from quarryloom.llm.toxicity import held_out, toxicity
from quarryloom.llm.url_filter import url_filter
from quarryloom.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "worst_sentence", "worst_score", "n_sentences")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(_table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_mix_sources, op2_url_filter, op3_quality_rules, op4_decontaminate, op5_license_scan, op6_quality_classifier, op7_line_dedup, op8_toxicity, op9_jaccard_join, op10_substring_dedup,
        op11_sharding, op12_embedding_whitening, op13_conversation_repair, pipeline,
    )
    return {f.__name__: f for f in own}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix-1' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0]::DOUBLE[] AS ws, row_number() OVER (ORDER BY (source IS NULL), encode(source)) AS i FROM d GROUP BY source),
r AS (SELECT source, source_size, ws[(i - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM r) - coalesce(sum(most) OVER o, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER o, 0)) AS level
      FROM r WINDOW o AS (ORDER BY most / w, (source IS NULL), encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, w * (SELECT max(level) FROM l)) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p
"""

def _op2_sql(order: int = 5) -> str:
    """The models by orders, each from the one below it."""
    out = [r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, f, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT url, arg_max(h || f, len(h || f)) AS rule, arg_max(v, len(h || f)) AS said FROM (SELECT DISTINCT url, host, path FROM q) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY url),
u AS (SELECT q.url, fit.said, count(*) AS n, ('0x' || substr(md5(q.url), 1, 8))::BIGINT % 5 = 0 AS told FROM q LEFT JOIN fit USING (url) GROUP BY q.url, fit.said),
ch AS (SELECT url, CASE WHEN told OR said IS NULL THEN 0 WHEN said = 'allow' THEN n ELSE 0 END AS good, CASE WHEN told OR said IS NULL THEN 0 WHEN said = 'block' THEN n ELSE 0 END AS bad,
       repeat(chr(2), 5) || url || chr(3) AS t, unnest(range(1, length(url) + 2)) AS i FROM u),
gr AS (SELECT url, good, bad, substring(t, i, 5) AS c, substring(t, i + 5, 1) AS x FROM ch)"""]
    for k in range(order + 1):
        out.append(f"""pair{k} AS (SELECT {f"right(c, {k})" if k else "''"} AS c, x, sum(good) AS good, sum(bad) AS bad FROM gr GROUP BY ALL),
whole{k} AS (SELECT c, sum(good) AS gn, count(*) FILTER (WHERE good > 0) AS gt, sum(bad) AS bn, count(*) FILTER (WHERE bad > 0) AS bt FROM pair{k} GROUP BY c),
prob{k} AS (SELECT pair{k}.c, pair{k}.x, {", ".join(f"CASE WHEN {m}n > 0 THEN ({a} + {m}t * {below}) / ({m}n + {m}t) ELSE {below} END AS {m}p" for m, a in (("g", "good"), ("b", "bad")) for below in [f"s.{m}p" if k else "(1.0 / 256)::DOUBLE"])}
       FROM pair{k} JOIN whole{k} ON pair{k}.c = whole{k}.c {f"JOIN prob{k - 1} s ON s.c = {f'right(pair{k}.c, {k - 1})' if k > 1 else repr('')} AND s.x = pair{k}.x" if k else ""})""")
    out.append(f"""sc AS (SELECT url, round(sum((times * (ln(gp) - ln(bp)) * 1000000000000)::DECIMAL(38, 0))::DOUBLE / 1000000000000 / sum(times), 6) AS score
       FROM (SELECT url, c, x, count(*) AS times FROM gr GROUP BY ALL) JOIN prob{order} USING (c, x) GROUP BY url),
hist AS (SELECT floor(greatest(-10.0, least(10.0, score)) / 0.02)::BIGINT AS b, sum(CASE WHEN said = 'allow' THEN n ELSE 0 END)::DOUBLE AS g, sum(CASE WHEN said = 'block' THEN n ELSE 0 END)::DOUBLE AS d FROM u JOIN sc USING (url) WHERE told AND said IS NOT NULL GROUP BY 1),
tot AS (SELECT sum(g) AS g, sum(d) AS d FROM hist),
cuts AS (SELECT hist.b, (tot.g - coalesce(sum(hist.g) OVER w, 0)) / tot.g / 2 + coalesce(sum(hist.d) OVER w, 0) / tot.d / 2 AS worth FROM hist, tot WHERE tot.g > 0 AND tot.d > 0 WINDOW w AS (ORDER BY hist.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT coalesce((SELECT b * 0.02::DOUBLE FROM cuts WHERE worth > 0.5 ORDER BY worth DESC, b LIMIT 1), 0.0) AS level)
SELECT page_id, host, path, fit.rule, coalesce(fit.said, CASE WHEN score >= level THEN 'allow' ELSE 'block' END) AS verdict, score
FROM q JOIN sc USING (url) LEFT JOIN fit USING (url) CROSS JOIN lev""")
    return ",\n".join(out)


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS t FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
size AS (SELECT DISTINCT n FROM win),
g AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, size)),
hit AS (SELECT g.doc_id, g.n, g.i, win.item_id FROM g JOIN win ON g.t = win.t AND g.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items.items, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words ON w.doc_id = words.doc_id LEFT JOIN items ON w.doc_id = items.doc_id
"""

_BARE = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def line_dedup_sql(min_sites: int = 10, min_texts: int = 1) -> str:
    """Lines on so many sites and in so many distinct texts go."""
    return f"""
WITH d AS (SELECT doc_id, text, coalesce('=' || source, '?') AS site FROM documents),
t AS (SELECT DISTINCT text FROM d WHERE text IS NOT NULL),
l AS (SELECT DISTINCT text, {_BARE.format("line")} AS line FROM (SELECT text, unnest(string_split(text, chr(10))) AS line FROM t)),
b AS (SELECT line FROM l JOIN (SELECT DISTINCT text, site FROM d) USING (text) WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites} AND count(DISTINCT text) >= {min_texts}),
x AS (SELECT text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
k AS (SELECT text, count(*) AS n, count(*) FILTER (WHERE b.line IS NOT NULL) AS gone, coalesce(string_agg(x.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS kept
      FROM x LEFT JOIN b ON {_BARE.format("x.line")} = b.line GROUP BY text)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(k.kept) AS kept_sha256
FROM d LEFT JOIN k ON d.text = k.text
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS t
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT s.doc_id, s.t FROM s JOIN (SELECT t FROM s GROUP BY t HAVING count(*) > 1) USING (t)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, b AS other FROM edge UNION SELECT r.node, e.b FROM reach r JOIN edge e ON r.other = e.a),
least AS (SELECT node, min(other) AS m FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(least.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN least ON w.doc_id = least.node
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
hit AS (SELECT g.doc_id, list(g.i) AS found FROM g JOIN m USING (s) WHERE m.least < g.doc_id GROUP BY g.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, a + 13)) AS i FROM (SELECT doc_id, unnest(found) AS a FROM hit)),
gl AS (SELECT doc_id, list(i) AS cut, count(*) AS k FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(gl.k, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN gl ON w.doc_id = gl.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def _op13_sql() -> str:
    """The program by turns: for each of the four states a string of nine digits of cost and the letters, so that the smallest string is the cheapest and least in ASCII."""

    def more(state: str, cost: str, letter: str) -> str:
        return f"(CASE WHEN {state} = '~' THEN '~' ELSE lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{letter}' END)"

    kept = lambda q, initial: f"(CASE WHEN stays AND initial = '{initial}' THEN {more(f'a{q}', 'extra', 'K')} ELSE '~' END)"
    other = lambda q: f"(CASE WHEN stays THEN {more(f'a{q}', 'extra + 3', 'R')} ELSE '~' END)"
    gone = lambda q: more(f"a{q}", "4", "D")
    into2, into3 = ", ".join(f"{kept(q, 'u')}, {other(q)}" for q in (0, 1, 3)), f"{kept(2, 'a')}, {other(2)}"
    ins = lambda q: more(q, "3", "I")
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT k, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS f FROM (SELECT DISTINCT k FROM c)),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c JOIN crc USING (k), range(2) t(again) WHERE f <> 0 AND (again = 0 OR f = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS i, left(role, 1) AS initial FROM d),
g AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' END AS fault,
      lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM o),
s AS (SELECT conv_id, i, initial, coalesce(fault, '') NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM g),
st AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
       count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
r AS (SELECT conv_id, 0::BIGINT AS i, '000000000' AS a0, '~' AS a1, '000000003I' AS a2, '000000006II' AS a3 FROM st
      UNION ALL
      SELECT conv_id, i, p0, p1, least(p2, {ins("p0")}, {ins("p1")}, {ins("p3")}), least(p3, {ins("p2")}, {ins(ins("p0"))}, {ins(ins("p1"))})
      FROM (SELECT r.conv_id, s.i, {gone(0)} AS p0, least({gone(1)}, {kept(0, "s")}) AS p1, least({gone(2)}, {into2}) AS p2, least({gone(3)}, {into3}) AS p3
            FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = r.i + 1)),
best AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, left(b, 9)::BIGINT AS cost, substr(b, 10) AS audit
         FROM (SELECT st.*, least(a0, a3) AS b FROM st JOIN r ON st.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = st.n)),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS pos FROM best WHERE audit <> ''),
e AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS i, count(*) FILTER (WHERE letter <> 'D') OVER w AS k FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
x AS (SELECT e.conv_id, pos, letter, k, g.role, g.text, max(CASE WHEN k = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
      FROM e LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id AND e.i = g.i AND letter <> 'I' WHERE letter <> 'D'),
y AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY pos) AS t FROM x GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(y.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN y ON a.conv_id IS NOT DISTINCT FROM y.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_url_filter": _op2_sql(), "op4_decontaminate": OP4_SQL, "op7_line_dedup": line_dedup_sql(), "op9_jaccard_join": OP9_SQL, "op10_substring_dedup": OP10_SQL, "op13_conversation_repair": _op13_sql()}
