"""URL filters by a character language-model ratio, in DataFrame operations only.

Two variable-order Markov models, one of accepted and one of rejected URLs,
give each character its probability after up to ORDER characters before it.
Orders are interpolated by Witten and Bell's rule: a context counts for as
much as it was seen, and for the number of different characters seen after
it the next shorter context is asked; a context never seen is skipped. A
URL's score is the difference of its log-likelihoods under the two models
over its length; the cut is calibrated on labelled URLs that the models
haven't seen.

The labels are the verdicts of the host rules; the models read the whole
URL, scheme, query and fragment included. They are tables of grams, as large
as the corpus makes them; every gram is weighed once and the URLs are joined
with the weights. A URL is cut into characters once, and what goes on from
there carries its 128-bit key, so work grows with the sum of the lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryloom.llm.storage import drop_settled, settle

# Fixed values: (host, path, verdict); a rule fits its host and all subdomains.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDER = 5
ALPHABET = 256
#: One of so many labelled URLs is kept for calibration.
FOLDS = 5
#: Rows of one URL meet its score in so many tasks.
SALTS = 8
HEAVY = 1 << 15
SCALE = 10**12
#: Scores are counted in steps of this size when the cut is chosen, up to SPAN on either side.
STEP, SPAN = 0.02, 10.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PAD, _END = "\x02", "\x03"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def rule_of(host: Column, path: Column, rules: tuple, give) -> Column:
    """give(rule) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        out = F.when(_fits(host, path, rule), F.lit(give(rule))).otherwise(out)
    return out


def _key(url: Column) -> Column:
    return F.unhex(F.md5(url.cast("binary")))


def _grams(urls: DataFrame, order: int) -> DataFrame:
    """The columns of urls but text, for each character of text, and its end, after the order characters before it."""

    def windows(chars: Column) -> Column:
        one = lambda i: F.struct(F.array_join(F.slice(chars, i + 1, F.lit(order)), "").alias("context"), F.get(chars, i + order).alias("next"))
        return F.transform(F.sequence(F.lit(0), F.size(chars) - (order + 1)), one)

    # Cut once for the whole URL: a substring would be counted out from its beginning each time.
    cut = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "", -1))
    padded = F.concat(F.array_repeat(F.lit(_PAD), order), cut, F.array(F.lit(_END)))
    each = F.explode(F.get(F.transform(F.array(padded), windows), F.lit(0)))
    return urls.select(*[c for c in urls.columns if c != "text"], each.alias("gram")).select(*[c for c in urls.columns if c != "text"], "gram.context", "gram.next")


def gram_weights(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(context, next, weight): log P(next | context) of accepted minus rejected, from (context, next, good, bad)."""
    models = (("good", "g"), ("bad", "b"))
    below = None
    for k in range(order + 1):
        context = F.right("context", F.lit(k)) if k else F.lit("")
        pair = counts.groupBy(context.alias("c"), "next").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        whole = pair.groupBy("c").agg(*[f(m, p) for m, p in models for f in (lambda m, p: F.sum(m).alias(p + "n"), lambda m, p: F.sum(F.when(F.col(m) > 0, 1).otherwise(0)).alias(p + "t"))])
        rows = pair.join(whole, "c")
        if below is None:
            rows = rows.withColumns({p + "p": F.lit(1.0 / ALPHABET) for _, p in models})
        else:
            shorter = below.select(F.col("c").alias("s"), F.col("next").alias("s_next"), "gp", "bp")
            rows = rows.join(shorter, (F.right("c", F.lit(k - 1)) == F.col("s") if k > 1 else F.lit("") == F.col("s")) & (F.col("next") == F.col("s_next")))
        new = {p + "p": F.when(F.col(p + "n") > 0, (F.col(m) + F.col(p + "t") * F.col(p + "p")) / (F.col(p + "n") + F.col(p + "t"))).otherwise(F.col(p + "p")) for m, p in models}
        below = rows.select("c", "next", *[v.alias(n) for n, v in new.items()])
    return below.select(F.col("c").alias("context"), "next", (F.log("gp") - F.log("bp")).alias("weight"))


def url_filter(pages: DataFrame, rules: tuple = RULES, order: int = ORDER) -> DataFrame:
    """Allows or blocks every url, by the longest rule that fits, else by the models.

    Returns a row for each row of pages: page_id, host, path, rule (host and
    path of the rule, else null), verdict (allow or block) and score, the
    length-normalised log-likelihood difference, larger for accepted ones.

    A null url counts as the empty one; it and one without :// have an empty
    host and path, so no rule, and are judged by their score. Repeated URLs
    count as often as they occur and are judged alike. Without labelled URLs of both kinds all
    scores are compared with 0. Other columns are neither read nor returned.
    """
    url = F.coalesce(pages["url"].cast("string"), F.lit(""))
    cut = pages.select(pages["page_id"].cast("long").alias("page_id"), url.alias("text"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = cut.withColumns({"rule": rule_of(host, path, rules, lambda r: r[0] + r[1]), "said": rule_of(host, path, rules, lambda r: r[2])})
    # A fold that SQL can make too: of the first hex digits of an MD5.
    told = F.pmod(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(FOLDS)) == 0
    # Equal URLs are one row with a count from here on; a URL has one verdict of the rules.
    urls = judged.groupBy("text", "said").agg(F.count("*").alias("n")).withColumn("told", told).withColumn("url", _key(F.col("text")))
    # Written by as many tasks as there are partitions: each URL becomes a row for each character later on.
    urls = settle(urls.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "url"), "urls")
    seen = F.when(F.col("told"), 0).otherwise(F.col("n"))
    good, bad = F.when(F.col("said") == "allow", seen).otherwise(0), F.when(F.col("said") == "block", seen).otherwise(0)
    marked = urls.select("text", good.cast("long").alias("good"), bad.cast("long").alias("bad"))
    gram = ["context", "next"]
    counts = settle(_grams(marked, order).groupBy(*gram).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count("*").alias("seen")), "grams")
    weights = settle(gram_weights(counts, order), "weights")
    total = counts.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    # Grams that nearly every URL has would meet in one task: there are HEAVY at most that take a HEAVY-th of all characters.
    heavy = F.broadcast(weights.join(F.broadcast(counts.filter(F.col("seen") * HEAVY >= total).select(*gram)), gram, "left_semi"))
    own = _grams(urls.select("text", "url"), order).groupBy("url", *gram).agg(F.count("*").alias("times")).join(heavy, gram, "left")
    rest = own.filter("weight is null").drop("weight").join(weights, gram)
    weighed = own.filter("weight is not null").select("url", "times", "weight").unionByName(rest.select("url", "times", "weight"))
    # In whole steps, so that the sum doesn't depend on the order of its parts.
    parts = F.sum((F.col("times") * F.col("weight") * SCALE).cast("decimal(38,0)")).cast("double") / SCALE
    scores = weighed.groupBy("url").agg(F.round(parts / F.sum("times"), 6).alias("score"))
    scores = settle(scores, "scores")
    level = _calibrated(urls.join(scores, "url").filter("told and said is not null"))
    drop_settled(urls, counts, weights)
    verdict = F.coalesce("said", F.when(F.col("score") >= level, "allow").otherwise("block"))
    spread = scores.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("url", "of")
    asked = judged.withColumn("of", _key(F.col("text"))).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).drop("text")
    return asked.join(spread, ["of", "salt"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def _calibrated(rows: DataFrame) -> float:
    """The score that parts accepted from rejected with the highest mean of both recalls, from a histogram of fixed size."""
    step = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), "score")) / STEP)
    is_good = F.col("said") == "allow"
    hist = {r["b"]: (r["g"], r["n"] - r["g"]) for r in rows.groupBy(step.cast("long").alias("b")).agg(F.sum(F.when(is_good, F.col("n")).otherwise(0)).alias("g"), F.sum("n").alias("n")).collect()}
    good, bad = sum(g for g, _ in hist.values()), sum(b for _, b in hist.values())
    if not good or not bad:
        return 0.0
    best, low_good, low_bad = (0.5, 0.0), 0, 0
    for b in sorted(hist):
        best = max(best, ((good - low_good) / good / 2 + low_bad / bad / 2, b * STEP), key=lambda x: x[0])
        low_good, low_bad = low_good + hist[b][0], low_bad + hist[b][1]
    return best[1]
