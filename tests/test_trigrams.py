"""What a pattern's trigrams promise, and searches through the table against searches through all files."""

import re

import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryloom.operators import search
from quarryloom.operators import trigrams as T
from quarryloom.operators.trigrams import ANYTHING, TrigramIndex, leaves, needed
from quarryloom.queries import files as documents

WORDS = st.text("abcABC", min_size=1, max_size=5)
ATOMS = st.one_of(WORDS, st.sampled_from(["[ab]", ".", r"\b", "^", "$", "x?", "(?:abc)*", r"\w", "(?=ab)", "[^c]"]))


def grown(inner):
    return st.one_of(
        st.lists(inner, min_size=1, max_size=3).map("".join), st.lists(inner, min_size=2, max_size=3).map(lambda x: f"({'|'.join(x)})"),
        inner.map(lambda x: f"(?:{x})+"), inner.map(lambda x: f"(?:{x}){{0,2}}"), inner.map(lambda x: f"(?:{x}){{2}}"), inner.map(lambda x: f"(?i:{x})"),
    )


PATTERNS = st.recursive(ATOMS, grown, max_leaves=6)


def true_of(tree, text):
    if isinstance(tree, str):
        return tree in text.lower()
    return (all if tree[0] == "all" else any)(true_of(p, text) for p in tree[1])


@settings(max_examples=1500, deadline=None)
@given(PATTERNS, st.text("abcABC x\n", max_size=25))
def test_no_text_that_matches_is_left_out(pattern, text):
    if re.search(pattern, text):
        assert true_of(needed(pattern), text)


def test_what_patterns_need():
    assert needed("License") == ("all", ("lic", "ice", "cen", "ens", "nse")) and needed("(?i)MIT") == "mit"
    assert needed("abcd|xyz") == ("any", (("all", ("abc", "bcd")), "xyz")) and needed("(abc|[xy]+)d") == ANYTHING
    assert needed(r"ab(?:c)de") == ("all", ("abc", "bcd", "cde")) and needed("(?:abc)+") == "abc" and needed("(?:abc)*") == ANYTHING
    # What the JVM reads in another way, or this can't read at all, asks for nothing.
    assert {needed(p) for p in (r"[a-z&&[^b]]abc", r"\p{L}abc", r"\Qabc\E", r"\0101bc", "(?<n>abc", "[[abc]]def")} == {ANYTHING}
    assert leaves(needed("éabc")) == ["abc"]


FILES = "repo_root string, path string, text string"


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["alpha beta\nGamma LICENSE\n", "no such thing", None, "", "ab", "licens\ne", "Λicense license\n" * 60, "x" * 70_000 + "needle", "the licence", "same", "same"]
    return spark.createDataFrame([(f"r{i % 2}", f"f{i:02}", t) for i, t in enumerate(texts)], FILES).repartition(3)


@pytest.mark.parametrize("pattern", ["(?i)license", "needle", "licen[cs]e", "same|ab$", r"\w+", "^$", "licens\ne", "nothing at all"])
def test_same_as_without(spark, tmp_path, rows, pattern):
    index = TrigramIndex(spark, f"file://{tmp_path}/t", 4)
    index.put(rows)
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(index.matching_lines(rows, pattern)) == plain(search.matching_lines(rows, pattern))
    assert plain(index.keyword_search(rows, pattern, 5, per_file=2)) == plain(search.keyword_search(rows, pattern, 5, per_file=2))


def test_changes(spark, tmp_path, rows):
    index = TrigramIndex(spark, f"file://{tmp_path}/t", 4)
    index.put(rows)
    new = spark.createDataFrame([("r1", "f01", "now with a needle"), ("r9", "new", "needle")], FILES)
    index.put(new, spark.createDataFrame([("r1", "f01"), ("r1", "f07")], "repo_root string, path string"))
    at = lambda p: sorted(r["path"] for r in index.candidates(p).collect())
    assert at("needle") == ["f01", "new"] and at("such") == [] and "f07" not in at(".")
    index.compact(0)
    assert at("needle") == ["f01", "new"] and at("such") == []


def test_few_texts_and_row_groups_are_opened(spark, tmp_path):
    own = documents(spark, SMALL)
    index = TrigramIndex(spark, f"file://{tmp_path}/t", 4)
    index.put(own)
    assert 0 < index.candidates("(?i)license").count() < own.count() / 3
    assert "In(trigram" in index.candidates("license")._jdf.queryExecution().executedPlan().toString()


def test_postings_are_a_row_for_a_block(spark, tmp_path, rows, monkeypatch):
    """Not one for each file: the rows of an index don't grow with its files' trigrams. Trigrams stay within a text, and windows don't cut them."""
    import pyarrow as pa

    monkeypatch.setattr(T, "WINDOW", 5)
    texts = ["abcdefgh", "", "ab", "c", "ÿabc\tdef", "x" * 40, "abc"]
    n = len(texts)
    got = {(k % n, "".join(chr(32 + k // n // 95**e % 95) for e in (2, 1, 0))) for k in T.trigrams_of(pa.array(texts)).tolist()}
    assert got == {(i, t[j : j + 3]) for i, t in enumerate(texts) for j in range(len(t) - 2) if re.fullmatch("[ -~]{3}", t[j : j + 3])}
    monkeypatch.undo()
    index = TrigramIndex(spark, f"file://{tmp_path}/t", 4)
    index.put(rows.coalesce(1))
    postings = index.tables.read("postings")
    assert postings.select("block").distinct().count() == 1 and postings.count() == postings.select("trigram").distinct().count()
    index.put(rows.limit(0), rows.filter("path <> 'f07'").select("repo_root", "path"))
    index.compact()
    assert {r["trigram"] for r in index.tables.read("postings").collect()} == {"", "xxx", "xxn", "xne", "nee", "eed", "edl", "dle"}
    assert [r["path"] for r in index.candidates("needle").collect()] == ["f07"]
