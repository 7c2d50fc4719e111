"""Quality rules: learned decision lists, in DataFrame operations only.

Sequential covering: a rule is a conjunction of thresholds on statistics of
the text, grown on one part of the labelled documents for information gain
and pruned on the other part; documents that it covers are set aside and the
next rule is grown on the rest. All that the learner sees are histograms,
aggregated by Spark, of as many rows as there are features and bins. The
list becomes one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.storage import settle

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
#: A list has at most so many rules of so many conditions.
MOST_RULES, MOST_CONDITIONS = 8, 3
#: A rule has to be right for this share of what it covers, on both parts, and to cover so many junk documents of the growing part.
LEAST_PRECISION, LEAST_COVER = 0.95, 3
BINS = 24

FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / n_words",
    "symbol_rate": "n_symbols / n_words",
    "dup_line_rate": "n_dup_lines / n_lines",
    "repeat_rate": "n_repeat_words / n_words",
    "upper_rate": "n_upper / word_chars",
    "mark_rate": "n_marks / n_words",
    "digit_rate": "n_digits / word_chars",
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")


def let(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """How many words lie in windows of three words that the text holds twice or more."""

    def of(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return let(starts, lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return let(words, lambda ws: F.when(F.size(ws) < 3, F.lit(0)).otherwise(of(ws)))


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of each whole text; a null text counts as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    filled = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = let(filled, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    two = let(words, lambda ws: F.struct(F.size(ws).alias("n"), _repeat_words(ws).alias("r")))
    once = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), two.alias("w"), lines.alias("l"), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).alias("word_chars"),
        *[F.regexp_count(text, F.lit(p)).alias(n) for n, p in (("n_symbols", f"[{SYMBOLS}]"), ("n_upper", "[A-Z]"), ("n_marks", "[!?]"), ("n_digits", "[0-9]"))],
    )
    found = {"n_words": "w.n", "n_repeat_words": "w.r", "n_lines": "l.n", "n_dup_lines": "l.n - l.d"}
    return once.select("doc_id", *[F.expr(found.get(c, c)).cast("long").alias(c) for c in STATS])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"

    def column(self) -> Column:
        value = _value(self.feature)
        return value > self.threshold if self.above else value <= self.threshold


def covers(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _value(name: str) -> Column:
    e = FEATURES[name]
    if "/" in e:
        a, b = e.split(" / ")
        return F.coalesce(F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.expr(e)


def _counts(rows: DataFrame) -> tuple[int, int]:
    """(junk, good)"""
    r = rows.agg(F.coalesce(F.sum(F.col("junk").cast("long")), F.lit(0)), F.count("*")).first()
    return int(r[0]), int(r[1]) - int(r[0])


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Of each feature the quantiles among junk and among good documents."""
    steps = [(i + 1) / (BINS // 2 + 1) for i in range(BINS // 2)]
    asked = [F.percentile_approx(F.when(F.col("junk") == j, _value(f)), steps, 10000).alias(f"{f}:{int(j)}") for f in FEATURES for j in (True, False)]
    r = rows.agg(*asked).first()
    return {f: sorted({float(x) for j in (0, 1) for x in (r[f"{f}:{j}"] or ())}) for f in FEATURES}


def _best(rows: DataFrame, cuts: dict[str, list[float]], junk: int, good: int) -> Condition | None:
    """The condition with the highest information gain, from one histogram of all features."""
    bins = [F.struct(F.lit(f).alias("f"), sum((F.when(_value(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("b")) for f in FEATURES if cuts[f]]
    if not bins:
        return None
    hist: dict[str, dict[int, tuple[int, int]]] = {}
    for r in rows.select("junk", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(F.sum(F.col("junk").cast("long")).alias("j"), F.count("*").alias("n")).collect():
        hist.setdefault(r["f"], {})[r["b"]] = (r["j"], r["n"] - r["j"])
    base = math.log2(junk / (junk + good))
    best = (1e-9, "", False, 0.0)
    for f in sorted(hist):
        low_j = low_g = 0
        for b, cut in enumerate(cuts[f]):
            j, g = hist[f].get(b, (0, 0))
            low_j, low_g = low_j + j, low_g + g
            for above, p, n in ((False, low_j, low_g), (True, junk - low_j, good - low_g)):
                if p >= LEAST_COVER:
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, above, cut)
    return Condition(*best[1:]) if best[1] else None


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """A decision list from rows of doc_id, STATS and junk (boolean); each rule is a list of conditions, junk if all hold."""
    rules: list[list[Condition]] = []
    pruning = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 0
    left = labelled
    while len(rules) < MOST_RULES:
        grow, prune = left.filter(~pruning), left.filter(pruning)
        junk, good = _counts(grow)
        if junk < LEAST_COVER:
            break
        rule: list[Condition] = []
        inside = grow
        cuts = _thresholds(grow)
        while len(rule) < MOST_CONDITIONS and good:
            c = _best(inside, cuts, junk, good)
            if c is None:
                break
            rule.append(c)
            inside = inside.filter(c.column())
            junk, good = _counts(inside)
        if not rule:
            break
        rule = _pruned(rule, prune)
        sure = [_counts(part.filter(covers(rule))) for part in (grow, prune)]
        if sure[0][0] < LEAST_COVER or any(j < LEAST_PRECISION * (j + g) for j, g in sure):
            break
        rules.append(rule)
        left = left.filter(~covers(rule))
    return rules


def _pruned(rule: list[Condition], prune: DataFrame) -> list[Condition]:
    """The shortest beginning of the rule that is worth as much on the pruning part as any."""
    worth = []
    for n in range(1, len(rule) + 1):
        j, g = _counts(prune.filter(covers(rule[:n])))
        worth.append((j - g) / (j + g) if j + g else -1.0)
    return rule[: worth.index(max(worth)) + 1]


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Which documents the base rules and a learned decision list keep.

    Returns a row for each row of docs: doc_id, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed (fewer than 50 words, or
    more than half of them in repeated three-word windows), kept, and rule, the
    text of the learned rule that rejects the document, else null.

    The list is learned from the rows that labels mark (quality 0 is junk) and
    the base rules pass; a doc_id with several labels counts as junk if one
    says so, null ids and labels aren't used. Without junk labels the list is
    empty and all that pass the base rules are kept. A null or empty text has
    no words and fails. Repeated rows are judged alike.
    """
    stats = settle(text_stats(docs), "stats")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marks = labels.select(labels["doc_id"].cast("long").alias("id"), labels["quality"].cast("int").alias("quality")).filter("id is not null and quality in (0, 1)")
    marks = marks.groupBy("id").agg((F.min("quality") == 0).alias("junk"))
    labelled = settle(stats.filter(~failed).join(marks, F.col("doc_id") == F.col("id")).select("doc_id", "junk", *STATS), "labelled")
    verdict = F.lit(None).cast("string")
    for rule in reversed(learn(labelled)):
        verdict = F.when(covers(rule), F.lit(" and ".join(map(str, rule)))).otherwise(verdict)
    verdict = F.when(failed, F.lit(None)).otherwise(verdict)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict.isNull()).alias("kept"), verdict.alias("rule"))
