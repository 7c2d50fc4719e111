"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.llm import decontaminate as D
from quarryloom.llm import license_scan as LS
from quarryloom.llm import quality_classifier as QC
from quarryloom.llm import quality_rules as QR
from quarryloom.llm import substring_dedup as substring
from quarryloom.llm import textnum as T
from quarryloom.llm import toxicity as TX
from quarryloom.llm.decontaminate import decontaminate
from quarryloom.llm.exchange import CHUNK_BYTES, PART_BYTES, Layout, gathered, send
from quarryloom.llm.graph import connected_components
from quarryloom.llm.jaccard_join import jaccard_components
from quarryloom.llm.license_scan import license_scan
from quarryloom.llm.line_dedup import boilerplate_lines, line_dedup
from quarryloom.llm.mixing import mix_sources
from quarryloom.llm.quality_classifier import ROUNDS, SHARE, CoTrained, passed_on, quality_classifier
from quarryloom.llm.quality_rules import quality_rules, text_stats
from quarryloom.llm.substring_dedup import substring_dedup
from quarryloom.llm.toxicity import toxicity
from quarryloom.llm.url_filter import url_filter

# Columns beyond those that are read have names that the operators use inside.
DOC = "doc_id long, text string, lang string, source string, n_chars long, chunk int, row string, line string, score double, sig string, kept string"
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def table(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), 0, "r", "l", 0.5, "s", "k") for i, t, s in rows]
    return spark.createDataFrame(full, DOC).repartition(3)


def prose(rng, n, words=60):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, 90, 4000) for _ in range(6)]
    out = []
    for i in range(60):
        t = base[i % 6].split()
        for _ in range(rng.choice((0, 0, 1, 2, 6, 20))):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        out.append((1000 - i, " ".join(t), f"s{i % 4}"))
    out += [(2000 + i, prose(rng, rng.randrange(1, 30), 12), "s1") for i in range(20)]
    out += [(1, None, "s0"), (2, "", "s0"), (3, " \t\n ", None), (4, "One", None), (5, "one", "s1"), (6, "ein\u00a0wort Ä ä \x1f", "s2"), (7, "y" * 5000, "s2"), (8, "a b c d", "s2"), (9, "A B C D", "s2")]
    out += [(1000, base[0], "s0"), (4, "One", None), (4, "Two", None), (None, base[1], "s3"), (None, "alone here", "s3"), (None, None, None)]
    out += [(3000, prose(rng, 30000, 50000), "s0"), (3001, "Lorem " + base[2] + " ipsum", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return table(spark, rows).cache()


def multiset(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# 1


def brute_mix(rows):
    size = lambda t: len(PLAIN.findall(t or ""))
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(total.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        free -= over
    return total, target


def test_mixing(docs, rows):
    out = mix_sources(docs, keep=("source",)).collect()
    total, target = brute_mix(rows)
    assert len(out) == len(rows)
    for s in total:
        mine = [r for r in out if r["source"] == s]
        assert all(r["source_size"] == total[s] and r["target"] == pytest.approx(target[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) < 1
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    again = mix_sources(docs.repartition(7), keep=("source",)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_mixing_of_repeated_rows(spark):
    """Rows that are there a hundred times are dealt out one by one; a kept column of an output's name is replaced."""
    rows = [(None, "a b c", "x")] * 100 + [(1, "a b c", "x")] * 50 + [(2, "d " * 40, "y"), (None, None, None), (None, None, None)]
    out = mix_sources(table(spark, rows), keep=("source", "doc_id", "row")).collect()
    total, target = brute_mix(rows)
    assert len(out) == len(rows) and out[0].asDict().keys() == {"source", "row", "doc_id", "size", "source_size", "target", "taken"}
    for s in total:
        assert abs(sum(r["taken"] for r in out if r["source"] == s) - target[s]) < 1
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == total[r["source"]] for r in out)


def test_mixing_of_nothing(spark, docs):
    assert mix_sources(docs.limit(0)).count() == 0
    empty = table(spark, [(1, None, "a"), (2, "", None)])
    assert multiset(mix_sources(empty), "doc_id", "size", "source_size", "target", "taken") == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# 2


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def pages(spark, n=400):
    rng = random.Random(2)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'B.c', 'news'])}.example.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['en', 'fr', 'de', 'es'])}/{rng.randrange(300)}{rng.choice(['', '?q=1', '#t', '.html'])}" for _ in range(n)]
    urls += [None, "", "no scheme", "x://", "http://ORG", "http://org/", "http://myorg/", "ftp://a.com/de/x://y", "http://h?p=/fr/", urls[0], "http://a.com/fr/\u00e9\u4e2d"]
    return [(i, u, "<p>", "k") for i, u in enumerate(urls)], spark.createDataFrame([(i, u, "<p>", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, host string").repartition(3)


def brute_scores(urls, order=5):
    """Scores by the definition, from all whole urls and the verdicts of the rules."""
    told = {}
    n = {"allow": {}, "block": {}}
    for u in urls:
        said, text = brute_url(u)[3], u or ""
        told[text] = said
        if said and int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % 5:
            padded = "\x02" * order + text + "\x03"
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    key = (padded[i - k : i], padded[i])
                    n[said][key] = n[said].get(key, 0) + 1
    after = {m: {} for m in n}
    for m, grams in n.items():
        for (c, x), times in grams.items():
            after[m].setdefault(c, {})[x] = times

    def p(m, context, x):
        value = 1 / 256
        for k in range(order + 1):
            seen = after[m].get(context[len(context) - k :], {})
            if seen:
                value = (seen.get(x, 0) + len(seen) * value) / (sum(seen.values()) + len(seen))
        return value

    out = {}
    for text in told:
        padded = "\x02" * order + text + "\x03"
        parts = [math.log(p("allow", padded[i - order : i], padded[i])) - math.log(p("block", padded[i - order : i], padded[i])) for i in range(order, len(padded))]
        out[text] = sum(parts) / len(parts)
    return out


def test_urls(spark):
    rows, df = pages(spark)
    out = url_filter(df).collect()
    assert sorted(r["page_id"] for r in out) == list(range(len(rows)))
    want = brute_scores([u for _, u, *_ in rows])
    free = []
    for r in out:
        host, path, rule, verdict = brute_url(rows[r["page_id"]][1])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["score"] == pytest.approx(want[rows[r["page_id"]][1] or ""], abs=2e-6)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
        if not verdict:
            free.append((r["score"], r["verdict"]))
    assert max((s for s, v in free if v == "block"), default=-99) < min((s for s, v in free if v == "allow"), default=99)


def test_urls_long_and_repeated(spark):
    """Work goes with the sum of the lengths: a URL of 100 KB, and very many rows without one."""
    rng = random.Random(4)
    long = "http://x.example.net/" + "".join(rng.choice("abcdef/é😀") for _ in range(100_000))
    urls = [f"http://a.example.org/{i}" for i in range(40)] + [f"http://b.com/de/{i}" for i in range(40)] + [long, long + "?q", "x://😀y", "x://y?a", "x://y?b"] + [None] * 20_000
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(4)
    begun = time.time()
    out = {r["page_id"]: r["score"] for r in url_filter(df).collect()}
    assert time.time() - begun < 60
    want = brute_scores(urls)
    assert len(out) == len(urls) and all(out[i] == pytest.approx(want[u or ""], abs=2e-6) for i, u in enumerate(urls))
    assert out[83] != out[84]  # the query is read too


def test_urls_without_labels(spark):
    df = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert multiset(url_filter(df), "page_id", "rule", "verdict", "score") == [(1, None, "allow", 0.0), (2, None, "allow", 0.0)]
    assert url_filter(df.limit(0)).count() == 0


# 3


def brute_stats(t):
    words = PLAIN.findall(t or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (t or "").split("\n") if PLAIN.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_stats(spark):
    rng = random.Random(9)
    texts = [None, "", "a", "a b", "a a a", "a a a a", "x y z x y z", "p q r s p q r t p q r", "l\nl\n \nm\nl", "#1 $<> é|é 中文 中文 中文 中文", prose(rng, 400, 8), prose(rng, 3000, 40), "tab\tsep\x0bvt\x0cff\r\nend\u2003em"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in text_stats(df).collect()}
    assert got == {i: brute_stats(t) for i, t in enumerate(texts)}


def labelled(spark, n=300):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(n):
        junk = i % 4 == 0
        words = [f"w{rng.randrange(3000)}" + ("***" if junk else "") for _ in range(80)]
        rows.append((i, " ".join(words), f"s{i % 3}"))
        if i % 2 == 0:
            marks.append((i, 0 if junk else 1, 1 if i % 6 == 0 else 0))
    return rows, spark.createDataFrame([*marks, (None, 0, 1), (5, None, None), (10**6, 0, 1)], "doc_id long, quality int, toxic int")


def test_rules_are_learned(spark):
    rows, marks = labelled(spark)
    out = {r["doc_id"]: r for r in quality_rules(table(spark, rows), marks).collect()}
    assert all(out[i]["kept"] == (i % 4 != 0) and not out[i]["base_failed"] for i, *_ in rows)
    assert {r["rule"] for r in out.values() if not r["kept"]} == {next(r["rule"] for r in out.values() if not r["kept"])}
    none = quality_rules(table(spark, rows), marks.filter("quality = 1"))
    assert none.filter("kept").count() == len(rows)


def test_rule_text():
    assert str(QR.Condition("words", True, 3.5)) == "words > 3.5" and str(QR.Condition("symbol_rate", False, 0.25)) == "symbol_rate <= 0.25"


def test_rules_on_awkward_rows(docs, rows, spark):
    _, marks = labelled(spark, 8)
    out = quality_rules(docs, marks)
    want = sorted(((i, *brute_stats(t)) for i, t, _ in rows), key=repr)
    assert multiset(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in out.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    assert quality_rules(docs.limit(0), marks).count() == 0


# 4


def brute_hits(text, items, width=10):
    words = ALNUM.findall(lower(text))
    hit, names = set(), set()
    for item, t in items:
        ws = ALNUM.findall(lower(t))
        n = min(len(ws), width)
        for k in range(len(ws) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == ws[k : k + n]:
                    hit.update(range(i, i + n))
                    names.add(str(item) if item is not None else "null")
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def long_text(rng):
    """Over 20,000 characters, with pieces of the benchmark far in."""
    return prose(rng, 6000, 900)


@pytest.mark.parametrize("bound", [1 << 24, 200])
def test_decontamination(spark, rows, bound):
    rng = random.Random(1)
    short = [r for r in rows if len(r[1] or "") < 20000]
    far = long_text(rng)
    items = [(10, " ".join(short[0][1].split()[20:45])), (9, "ONE"), (8, None), (7, ""), (6, "a-b. C"), (None, "ein wort Ä"), (11, prose(rng, 30, 9)), (10, "alone here"), (12, short[0][1][:200]), (13, "w1 w2"), (14, " ".join(far.split()[5000:5025]))]
    short += [(4000, far, "s"), (4001, far + " " + far[::-1], "s"), (4002, far, "s")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, kept string")
    got = multiset(decontaminate(table(spark, short), bench, broadcast_bytes=bound), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(((i, *brute_hits(t, items)) for i, t, _ in short), key=repr)


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_decontamination_by_a_window_of_many_items(spark, bound):
    """3,000 items share a beginning that a document repeats: work goes with the document and the items, not with their product."""
    head = " ".join(f"h{i}" for i in range(10))
    items = [(i, f"{head} tail {i}") for i in range(3000)]
    text = " ".join(f"{head} x{i}" for i in range(400))
    bench = spark.createDataFrame(items, "item_id long, text string")
    r = decontaminate(table(spark, [(1, text, "s"), (2, "h0 h1", "s")]), bench, broadcast_bytes=bound).orderBy("doc_id").collect()
    names = hashlib.sha256(",".join(sorted(str(i) for i, _ in items)).encode()).hexdigest()
    assert [(x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) for x in r] == [(4400, 4000, 3000, True), (2, 0, 0, False)] and r[0]["items_sha256"] == names


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_decontamination_by_long_windows(spark, bound):
    rng = random.Random(3)
    text = prose(rng, 400, 5000)
    ws = text.split()
    items = [(1, " ".join(ws[100:230])), (2, " ".join(ws[10:60])), (3, " ".join([*ws[300:364], "other", *ws[364:390]]))]
    got = decontaminate(table(spark, [(5, text, "s")]), spark.createDataFrame(items, "item_id long, text string"), window=80, broadcast_bytes=bound).first()
    assert (got["n_words"], got["n_hit"], got["n_items"]) == brute_hits(text, items, 80)[:3] == (400, 180, 2)


def test_decontamination_compares_words(spark, monkeypatch):
    """Windows that agree in their hash but not in their words aren't hits."""
    marks = D.Fingerprints([("a", b"one two three"), ("b", b"one two four")], 3)
    h, off = T.hash_words([b"x one two three", b"one two five"], T.ALNUM)
    prints, low, places, sets = marks.windows[3]
    odd = T.grams_at(h, np.array([4]), 3)
    order = np.argsort(np.concatenate((low, odd)), kind="stable")
    marks.windows[3] = (np.unique(np.concatenate((prints, D.Windows(h, off, 3).by_size[3][1]))), np.concatenate((low, odd))[order], np.concatenate((places, places[:1]))[order], np.concatenate((sets, sets[:1]))[order])
    hit, pairs = marks.hits(h, off)
    assert hit.tolist() == [False, True, True, True, False, False, False] and [p[0] for p in pairs.tolist()] == [0]


def test_decontamination_keeps_columns(spark):
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d", "mine", 9)], "doc_id long, text string, n_items string, row long")
    for bound in (1 << 24, 0):
        out = decontaminate(docs, bench, broadcast_bytes=bound, keep=("doc_id", "text", "n_items", "row"))
        assert out.columns == ["doc_id", "text", "row", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert out.select("text", "row", "n_items", "n_hit").collect() == [("a b c d", 9, 1, 3)]


def test_decontamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none, broadcast_bytes=-1).filter("contaminated or n_items > 0").count() == 0
    assert decontaminate(docs, none).filter("contaminated or n_items > 0").count() == 0
    assert decontaminate(docs.limit(0), none).count() == 0


# 5


def test_expressions():
    parse = LS.parse_expression
    assert parse("MIT OR Apache-2.0 AND (GPL-2.0 WITH X)") == ["MIT", "Apache-2.0", "GPL-2.0", "X", "with", "and", "or"]
    assert LS.evaluate(parse("mit or gpl-3.0"))[1] and not LS.evaluate(parse("MIT and GPL-3.0"))[1]
    assert LS.evaluate(parse("(MIT OR BSD-3-Clause) AND CC-BY-NC-4.0")) == ({"mit", "bsd-3", "cc-by-nc"}, False)
    assert LS.evaluate(parse("Apache-2.0 WITH LLVM-exception")) == ({"apache-2"}, True)
    for bad in ("", "MIT OR", "AND MIT", "(MIT", "MIT)", "MIT BSD", "MIT (BSD)"):
        with pytest.raises(LS.ExpressionError):
            parse(bad)


def brute_base(text):
    words = ALNUM.findall(lower(text))
    found = [(i, label) for phrase, label in LS.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [
    None, "", "Released under the MIT License. Under the mit-license!", "Apache License, Version 2.0 ... licensed under CC BY-NC 4.0", "under the mit  license under the mit license", "underthe mit license", "x GNU General Public License, version 3 y", "SPDX-License-Identifier: MIT OR GPL-3.0-only\ncode",
    "// spdx-license-identifier: (Apache-2.0 AND BSD-3-Clause)\n# SPDX-License-Identifier: broken AND\n", "é under the mit license é cc by nc", "All rights reserved", "apache license version 2 apache license version 2", "the mit license under",
]


def test_licenses(spark, docs, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    out = {r["doc_id"]: r for r in license_scan(df).collect()}
    for i, t in enumerate(TEXTS):
        assert tuple(out[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute_base(t)
        assert set(filter(None, out[i]["base_labels"].split(","))) <= set(out[i]["labels"].split(",")) and 0 <= out[i]["score"] <= 1
        assert (out[i]["score"] > 0) == bool(out[i]["labels"])
    assert out[6]["labels"] == "gpl-3" and out[7]["labels"] == "gpl-3,mit" and out[7]["permitted"] is True and out[8]["labels"] == "apache-2,bsd-3" and out[8]["n_tags"] == 1 and out[10]["labels"] == "all-rights-reserved"
    assert multiset(license_scan(docs), "doc_id", "n_words", "n_base") == sorted(((i, *brute_base(t)[:2]) for i, t, _ in rows), key=repr)
    assert license_scan(docs.limit(0)).count() == 0


# 6 and 8


def test_quality_is_learned(spark, docs):
    rows, marks = labelled(spark)
    out = {r["doc_id"]: r for r in quality_classifier(table(spark, rows), marks).collect()}
    unseen = [i for i, *_ in rows if i % 2]
    assert all(out[i]["kept"] for i in unseen) and sum(not out[i]["kept"] for i, *_ in rows if i % 4 == 0) >= 70
    assert all(0 <= r[c] <= 1 for r in out.values() for c in ("score", "text_score", "meta_score"))
    odd = quality_classifier(docs, marks).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert quality_classifier(docs.limit(0), marks).count() == 0
    alone = quality_classifier(table(spark, rows), marks.filter("quality = 1")).select("score").distinct().collect()
    assert [r[0] for r in alone] == [1.0]


def test_every_unlabelled_document_can_be_passed_on():
    """More documents than any pool: each round's share is of all of them, and all are sums of their parts."""
    rng = np.random.default_rng(2)
    n = 20000
    y = np.arange(400) % 2.0
    truth = rng.integers(0, 2, n)
    x = tuple(rng.normal(size=(400, k)) + 2 * y[:, None] for k in (3, 2))
    free = tuple(rng.normal(size=(n, k)) + 2 * truth[:, None] for k in (3, 2))
    ids = np.arange(n)

    def over(f):
        return sum(f(tuple(a[i : i + 1700] for a in free), ids[i : i + 1700]) for i in range(0, n, 1700))

    model = CoTrained(x, y, np.arange(400) % 5 == 0, over)
    to, mark = passed_on(model.rounds, free, ids)
    assert abs((to >= 0).sum() - 2 * ROUNDS * SHARE * n) <= 0.02 * n
    assert (mark == truth)[to >= 0].mean() > 0.95 and ((model.score(free)[0] >= 0.5) == truth).mean() > 0.95


def brute_co_training(x, y, fresh, free, ids, weight):
    """Co-training by the definition, on explicit lists of what was passed on. Returns the score of rows of both views."""
    weight = weight * len(y) / weight.sum()
    own = weight[~fresh].sum()
    stats = []
    for a, f in zip(x, free, strict=True):
        w = np.concatenate([weight[~fresh], np.ones(len(f))])
        every = np.concatenate([a[~fresh], f])
        mean = (w[:, None] * every).sum(0) / w.sum()
        stats.append((mean, np.sqrt((w[:, None] * every**2).sum(0) / w.sum() - mean**2) + 1e-9))

    def design(a, mean, scale):
        return np.hstack([np.clip((a - mean) / scale, -8, 8), np.ones((len(a), 1))])

    def newton(z, y, w, ridge):
        b = np.zeros(z.shape[1])
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            push = z.T @ (w * (y - p)) - ridge * np.append(b[:-1], 0)
            b = b + np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge * np.eye(len(b)), push)
        return b

    to, mark = np.full(len(ids), -1), np.zeros(len(ids))
    chance = (T.mix(ids.astype(np.uint64)) >> np.uint64(11)).astype(float) / 2.0**53

    def fitted(v):
        mine = to == v
        each = QC.PASSED * min(1, own / max(1, mine.sum()))
        z = np.vstack([design(x[v][~fresh], *stats[v]), design(free[v][mine], *stats[v])])
        return newton(z, np.append(y[~fresh], mark[mine]), np.append(weight[~fresh], np.full(mine.sum(), each)), QC.RIDGE * (own + mine.sum() * each / QC.PASSED))

    b = [fitted(0), fitted(1)]
    for _ in range(ROUNDS):
        for v in (0, 1):
            z = np.clip(design(free[v], *stats[v]) @ b[v], -30, 30)
            level = np.minimum((np.abs(z) * QC.BINS / 30).astype(int), QC.BINS - 1)
            can = [i for i in range(len(ids)) if to[i] < 0 and abs(z[i]) >= math.log(QC.SURE / (1 - QC.SURE))]
            most = max(1, int(SHARE * len(ids)))
            bound = min((k for k in range(QC.BINS) if sum(level[i] > k for i in can) <= most), default=0) if can else 0
            left = most - sum(level[i] > bound for i in can)
            at = [i for i in can if level[i] == bound]
            for i in [i for i in can if level[i] > bound] + [i for i in at if chance[i] < left / max(1, len(at))]:
                to[i], mark[i] = 1 - v, z[i] >= 0
        b = [fitted(0), fitted(1)]

    def logistic(a, y, w):
        mean, scale = a.mean(0), a.std(0) + 1e-9
        c = newton(design(a, mean, scale), y, w, QC.RIDGE * w.sum())
        return lambda a: np.clip(design(a, mean, scale) @ c, -30, 30)

    raw = lambda x: [np.clip(design(a, *s) @ c, -30, 30)[:, None] for a, s, c in zip(x, stats, b, strict=True)]
    judge = raw([a[fresh] for a in x])
    scale = [logistic(z, y[fresh], weight[fresh]) for z in judge]
    both = logistic(np.stack([f(z) for f, z in zip(scale, judge, strict=True)], 1), y[fresh], weight[fresh])
    return lambda x: 1 / (1 + np.exp(-both(np.stack([f(z) for f, z in zip(scale, raw(x), strict=True)], 1)))), to


def test_co_training_by_the_definition():
    rng = np.random.default_rng(7)
    n = 500
    y = (np.arange(120) % 3 > 0).astype(float)
    truth = rng.integers(0, 2, n)
    x = tuple(rng.normal(size=(120, k)) + 1.2 * y[:, None] for k in (3, 2))
    free = tuple(rng.normal(size=(n, k)) + 1.2 * truth[:, None] for k in (3, 2))
    ids, fresh, weight = np.arange(n) * 7, np.arange(120) % 5 == 0, np.where(y == 1, 4.0, 1.0)

    def over(f):
        return sum(f(tuple(a[i : i + 90] for a in free), ids[i : i + 90]) for i in range(0, n, 90))

    model = CoTrained(x, y, fresh, over, weight)
    score, to = brute_co_training(x, y, fresh, free, ids, weight)
    assert (passed_on(model.rounds, free, ids)[0] == to).mean() > 0.99 and (to >= 0).sum() > 100
    assert np.abs(model.score(free)[0] - score(free)).max() < 0.01


def test_quality_scores_dont_move_with_the_bound(spark):
    """One label in seven is junk, told by noisy signs: however many of both labels the sample holds, scores are chances under all labels."""
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(1400):
        junk = i % 7 == 0
        marked = rng.random() < (0.6 if junk else 0.15)
        rows.append((i, " ".join(f"w{rng.randrange(3000)}" + ("***" if marked else "") for _ in range(30)), f"s{rng.randrange(3)}"))
        marks.append((i, 0 if junk else 1))
    docs, labels = table(spark, rows).cache(), spark.createDataFrame(marks, "doc_id long, quality int")
    mean = {n: quality_classifier(docs, labels, sample=n).agg(F.avg("score")).first()[0] for n in (300, 10_000)}
    assert all(abs(m - 6 / 7) < 0.05 for m in mean.values()) and abs(mean[300] - mean[10_000]) < 0.03, mean  # 0.5 where both labels weigh alike
    again = labels.unionByName(labels)  # labels said twice are one
    assert quality_classifier(docs, again, sample=10_000).agg(F.avg("score")).first()[0] == pytest.approx(mean[10_000])


def test_quality_of_several_labels_and_long_texts(spark):
    rows, marks = labelled(spark)
    rows += [(5000 + i, " ".join(f"w{j}" + ("***" if i < 2 else "") for j in range(40_000)), "s0") for i in range(4)]
    kinds = "doc_id long, quality int, toxic int"
    twice = marks.unionByName(spark.createDataFrame([(5000, 0, 0), (5000, 1, 0), (5003, 1, 0), (5003, 1, 0)], kinds))
    once = marks.unionByName(spark.createDataFrame([(5000, 0, 0), (5003, 1, 0)], kinds))
    df = table(spark, rows).cache()
    for judge in (lambda m: quality_classifier(df, m, sample=60), lambda m: quality_rules(df, m)):  # one 0 makes a document junk
        out = {r["doc_id"]: r for r in judge(twice).collect()}
        assert out == {r["doc_id"]: r for r in judge(once).collect()} and len(out) == len(rows)
        assert all(isinstance(out[5000 + i]["kept"], bool) for i in range(4))


def toxic_rows(n=500):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        sentences = [prose(rng, 9, 500) for _ in range(6)]
        if bad:
            sentences[i % 6] += f" blarg{rng.choice('abcde')} {rng.choice(['vile', 'nasty'])}"
        rows.append((i, ". ".join(sentences), f"s{i % 3}"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity(spark, docs):
    rows, marks = toxic_rows()
    labels = spark.createDataFrame([*marks, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity(table(spark, rows), labels).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [i for i in held if out[i]["predicted"] != (i % 5 == 0)]
    assert len(held) > 50 and len(wrong) <= 2
    assert sum(out[i]["worst_sentence"] == i % 6 for i, *_ in rows if i % 5 == 0) >= 95
    assert all(r["n_sentences"] >= 1 and (r["predicted"] == 1) == (r["score"] >= 0.5) for r in out.values())
    changed = {r["doc_id"]: r["score"] for r in toxicity(table(spark, rows), labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))).collect()}
    assert all(changed[i] == pytest.approx(out[i]["score"]) for i in changed)  # held-out labels aren't read
    odd = toxicity(docs, labels).collect()
    assert len(odd) == docs.count() and len({r["score"] for r in odd if not (r["text"] or "")}) == 1
    assert toxicity(docs.limit(0), labels).count() == 0
    assert 0 <= toxicity(docs, labels.filter("toxic = 0")).agg(F.max("score")).first()[0] < 0.5


def test_noisy_or_and_its_gradient():
    """Against the definition: a sentence's logistic score, 1 - prod(1 - p) for the document, finite differences for the slope."""
    rng = np.random.default_rng(3)
    docs = [[sorted(set(rng.integers(0, 4, rng.integers(0, 3)).tolist())) for _ in range(rng.integers(1, 6))] for _ in range(12)]
    toxic, weight = np.arange(12) % 3 == 0, rng.uniform(0.5, 2, 12)
    rows = [(np.array([(s, f) for s, fs in enumerate(d) for f in fs], np.int64).reshape(-1, 2).tobytes(), len(d), bool(t), w) for d, t, w in zip(docs, toxic, weight, strict=True)]
    bags, w, scale = TX.Bags.of(rows), rng.normal(size=5), weight / weight.sum()

    def likely(w):
        out = 0.0
        for d, t, x in zip(docs, toxic, scale, strict=True):
            stays = math.prod(1 - 1 / (1 + math.exp(-(w[4] + sum(w[f] for f in fs)))) for fs in d)
            out += x * math.log(1 - stays if t else stays)
        return out

    value, grad = bags.gradient(w, scale)
    assert value == pytest.approx(likely(w))
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        assert grad[k] == pytest.approx((likely(w + step) - likely(w - step)) / 2e-6, abs=1e-6)


def test_toxicity_scores_by_the_definition():
    text = "A b! c\nd. e vile"
    x, sentence, doc = TX.sentence_features([text.encode()])
    assert sentence.tolist() == [0, 0, 1, 2, 3, 3] and doc.tolist() == [0] * 4
    model = TX.Model(x[[1, 5], 0], np.array([1.5, 3.0]), -2.0)
    p = [1 / (1 + math.exp(-z)) for z in (-0.5, -2.0, -2.0, 1.0)]
    score, worst, top, count = model.score([text.encode(), b""])
    assert score[0] == pytest.approx(1 - math.prod(1 - y for y in p)) and (worst[0], count[0]) == (3, 4) and top[0] == pytest.approx(p[3])
    assert score[1] == pytest.approx(1 / (1 + math.exp(2))) and (worst[1], count[1]) == (0, 1)
    marks = [text.replace("!", "!!! ... ??\n\n").encode(), b"?! ... !!", b"", b"!" * 40_000 + b" a"]
    score, worst, top, count = model.score(marks)  # runs of marks add sentences, but no chances
    assert score[0] == pytest.approx(1 - math.prod(1 - y for y in p)) and count[0] == 13 and worst[0] == 12
    assert score[1:] == pytest.approx([1 / (1 + math.exp(2))] * 3) and count[3] == 40_001


def test_toxicity_learns_from_long_texts_and_a_bounded_sample(spark):
    """Toxic words that only stand in labelled texts of over 64 KB are learned; a sample smaller than the labels still learns; the last of several labels doesn't count, the toxic one does."""
    rng = random.Random(5)
    rows = [(i, ". ".join(prose(rng, 9, 20) for _ in range(6)), "s") for i in range(120)]
    rows += [(200 + i, ". ".join([*(prose(rng, 9, 20) for _ in range(2600)), f"w1 {'grudz' if i < 24 else 'plain'}{'abc'[i % 3]} w2"]), "s") for i in range(48)]
    rows += [(300, "w3 grudza w4", "s"), (301, "w3 w5 w4", "s"), (None, "grudza", "s")]
    assert all(len(t) > 1 << 16 for i, t, _ in rows if i is not None and 200 <= i < 300)
    labels = spark.createDataFrame([(i, int(200 <= i < 224)) for i, *_ in rows[:168]] + [(210, 0), (210, 1), (210, 0)], "doc_id long, toxic int")
    for sample in (4000, 20):
        out = {r["doc_id"]: r["score"] for r in toxicity(table(spark, rows), labels, sample=sample).collect()}
        assert out[300] > out[301] + 0.2 and out[None] > out[301], sample


# 7


def brute_lines(rows, least, least_texts=1):
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    spread, texts = {}, {}
    for _, t, s in rows:
        for x in set(map(bare, t.split("\n"))) if t is not None else ():
            spread.setdefault(x, set()).add(s)
            texts.setdefault(x, set()).add(t)
    gone = {x for x, s in spread.items() if x and len(s) >= least and len(texts[x]) >= least_texts}
    out = []
    for i, t, s in rows:
        lines = t.split("\n") if t is not None else []
        left = [x for x in lines if bare(x) not in gone]
        out.append((i, s, None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr), gone


@pytest.mark.parametrize("listed", [1 << 16, 0])
@pytest.mark.parametrize("texts", [1, 4])
def test_lines(spark, listed, texts):
    rng = random.Random(8)
    common = ["Footer © all", "  cookie notice\t", "three sites"]
    rows = []
    for i in range(80):
        lines = [prose(rng, 6, 3000) for _ in range(4)] + ["", "  "]
        lines += [common[0]] * (i % 2) + [common[1]] * (i % 3 == 0) + ([common[2]] if i < 9 and i % 12 < 3 else [])
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{i % 12}"))
    copied = rows[1][1]
    rows += [(100 + i, copied, f"s{i % 12}") for i in range(30)] + [(200, None, "s1"), (201, "", None), (202, "Footer © all", None), (202, "Footer © all", None), (None, "x\n", "s3"), (203, "é" * 20000 + "\nFooter © all", "s3")]
    want, gone = brute_lines(rows, 4, texts)
    assert len(gone) == (2 if texts == 4 else 7) and {"Footer © all", "cookie notice"} <= gone
    df = table(spark, rows).withColumn("n_lines", F.lit("clash")).withColumn("text_key", F.lit(1))
    out = line_dedup(df, min_sites=4, min_texts=texts, listed=listed)
    assert set(out.columns) == set(df.columns) | {"n_removed"}
    assert multiset(out, "doc_id", "source", "text", "n_lines", "n_removed") == want
    assert boilerplate_lines(df, min_sites=4, min_texts=texts).count() == len(gone) and line_dedup(df.limit(0), listed=listed).count() == 0


def test_lines_on_every_site_of_copies(spark):
    """Texts that all stand on one hot site too: each has its other site counted; with min_texts a text that was only copied keeps its lines."""
    rows = [(2 * i + k, f"own {i}\nfooter\nedge {i < 9}", s) for i in range(12) for k, s in enumerate(("a", f"b{i}"))]
    rows += [(100 + i, "copied\npage", f"c{i}") for i in range(30)]
    df = table(spark, rows)
    assert sorted(r["sites"] for r in boilerplate_lines(df).collect()) == [10, 13, 30, 30]
    assert [r["sites"] for r in boilerplate_lines(df, min_texts=10).collect()] == [13]
    out = {r["doc_id"]: r["text"] for r in line_dedup(df, min_texts=10).collect()}
    assert out == {i: t.replace("\nfooter", "") for i, t, _ in rows}


def test_pipeline_counts_every_site(spark):
    import corpus_pipeline

    df = table(spark, [(2 * i + k, f"own {i}\nfooter", s) for i in range(12) for k, s in enumerate(("a", f"b{i}"))])
    assert not [r for r in corpus_pipeline.remove_boilerplate(spark, df, "").collect() if "footer" in r["text"]]


# 9


def shingles(t, k=5):
    ws = [w.lower() if w.isascii() else lower(w) for w in PLAIN.findall(t or "")]
    return frozenset(tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) if ws else frozenset()


def brute_components(rows):
    """By the definition; rows of one id are one node, ids of null stand for nothing of their own."""
    sets = [(i, shingles(t)) for i, t, _ in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_set = {}
    for i, s in sets:
        if i is not None and s:
            by_set.setdefault(s, set()).add(i)
    reps = list(by_set.items())
    rep_of = {s: min(ids) for s, ids in reps}
    for (s, _), (t, _) in itertools.combinations(reps, 2):
        if 100 * len(s & t) >= 80 * len(s | t):
            a, b = find(rep_of[s]), find(rep_of[t])
            root[max(a, b)] = min(a, b)
    return sorted(((i, len(s), find(rep_of[s]) if s in rep_of else i) for i, s in sets), key=repr)


def test_components(docs, rows):
    assert multiset(jaccard_components(docs), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_components_of_many_near_copies(spark):
    """One big group with every degree of change: links must be found between all kinds of groups."""
    rng = random.Random(11)
    base = prose(rng, 120, 9000).split()
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(rng.randrange(0, 9)):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**7)}"
        rows.append((i, " ".join(t), "s"))
    assert multiset(jaccard_components(table(spark, rows)), "doc_id", "n_shingles", "component_id") == brute_components(rows)


def test_components_of_nothing(spark, docs):
    assert jaccard_components(docs.limit(0)).count() == 0
    assert multiset(jaccard_components(table(spark, [(1, None, "s"), (2, "", "s")])), "doc_id", "n_shingles", "component_id") == [(1, 0, 1), (2, 0, 2)]


def test_graph(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (3, 2), (3, 2), (None, 4)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["label"] for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


# 10


def brute_substrings(rows, width=13):
    first = {}
    big = 1 << 63
    for i, t, _ in rows:
        ws = PLAIN.findall(t or "")
        for k in range(len(ws) - width + 1):
            key = tuple(ws[k : k + width])
            first[key] = min(first.get(key, big), big - 1 if i is None else i)
    out = []
    for i, t, _ in rows:
        ws = PLAIN.findall(t or "")
        gone = set()
        for k in range(len(ws) - width + 1):
            if first[tuple(ws[k : k + width])] < (big - 1 if i is None else i):
                gone.update(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(docs, rows):
    assert multiset(substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows)


def test_substrings_of_few_words(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randrange(0, 80), 3), "s") for i in range(60)]
    for width in (13, 2, 5):
        assert multiset(substring_dedup(table(spark, rows), width), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(rows, width)


def test_substring_spans(spark):
    a = " ".join(f"a{i}" for i in range(20))
    df = table(spark, [(1, a, "s"), (2, f"x {a} y {a} z", "s")])
    r = substring_dedup(df, with_text=True).filter("doc_id = 2").first()
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(1, 21), (22, 42)] and r["kept"] == "x y z"
    assert substring_dedup(df.limit(0)).count() == 0


def test_substrings_and_components_of_repeated_rows(spark, rows):
    """A row that is there very often is looked at once and returned each time."""
    text = " ".join(f"r{i}" for i in range(40))
    many = [(70, text, "s0")] * 150 + [(None, text + " x", "s1")] * 90 + [(71, "y " + text, "s2"), (None, None, None), (72, " ", "s")]
    some = many + rows[:40]
    df = table(spark, some)
    once, layout = gathered(df.select("doc_id", "text"))
    assert sorted(r["copies"] for r in once.collect())[-2:] == [90, 150] and layout.chunks >= layout.parts >= 1
    assert multiset(substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(some)
    assert multiset(jaccard_components(df), "doc_id", "n_shingles", "component_id") == brute_components(some)
    texts = substring_dedup(df, with_text=True).filter("n_words = 0").collect()
    assert len(texts) == 2 and all(r["kept"] == "" and r["spans"] == [] for r in texts)


def test_cells_keep_their_size():
    """With a hundred thousand chunks a chunk still sends many keys in a cell, and no more cells than there are partitions."""
    rng = np.random.default_rng(1)
    layout = Layout.of(100_000 * CHUNK_BYTES, 200)
    assert layout.chunks == 100_000 and layout.parts == math.ceil(layout.chunks * CHUNK_BYTES / PART_BYTES)
    n_keys = CHUNK_BYTES // 6  # a word has about so many bytes
    cells = send(7, rng.integers(0, 1 << 64, size=n_keys, dtype=np.uint64), layout.parts)
    assert cells.num_rows <= layout.parts and cells["keys"].nbytes >= 16 * cells.num_rows * 4
    assert Layout.of(0, 4) == Layout(4, 4)


def test_runs_of_equal_half_values():
    """Values that agree in 64 of their 128 bits are told apart."""
    low, high = np.array([5, 5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    order, first = substring._grouped(low, high)
    assert [sorted(x.tolist()) for x in np.split(order, first[1:])] == [[0, 2], [1, 4], [3]]
    h = np.arange(100, 190, dtype=np.uint64)
    for k in (3, 70):
        assert (T.grams(h, k) != T.grams(h, k, salt=1)).all() and (T.grams_at(h, np.array([4, 7]), k, 1) == T.grams(h, k, salt=1)[[4, 7]]).all()
    swapped = h.copy()
    swapped[[66, 68]] = swapped[[68, 66]]
    assert T.grams(h, 80)[0] != T.grams(swapped, 80)[0]


# Words and hashes


@pytest.mark.parametrize(("table_", "form", "low"), [(T.PLAIN, PLAIN, False), (T.LOWER, PLAIN, True), (T.ALNUM, ALNUM, True)])
def test_words(table_, form, low):
    texts = ["", "a", "  A b\x0bc\x1f ", "é\u00a0ü Ä", "x" * 500 + " " + "x" * 501, "a-b_c1", "\n\n"]
    h, off = T.hash_words([t.encode() for t in texts], table_)
    words = [form.findall(lower(t) if low else t) for t in texts]
    assert [b - a for a, b in itertools.pairwise(off.tolist())] == list(map(len, words))
    flat = [w for ws in words for w in ws]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def test_winnowing_keeps_shared_runs():
    rng = random.Random(1)
    shared = [f"s{i}" for i in range(13)]
    for _ in range(50):
        anchors = []
        for _ in range(2):
            t = [f"{rng.random()}" for _ in range(rng.randrange(5, 40))]
            at = rng.randrange(len(t))
            h, off = T.hash_words([" ".join(t[:at] + shared + t[at:]).encode()], T.PLAIN)
            g = T.grams(h, 6)
            anchors.append(set(g[T.winnow(g, 8)].tolist()))
        assert anchors[0] & anchors[1]
