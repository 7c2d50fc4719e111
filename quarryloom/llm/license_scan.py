"""License scans: identifier tags and notice phrases.

One Aho-Corasick automaton finds all notice phrases and tag markers in a
text's words. What follows a tag is a licence expression; a shunting-yard
parser brings it into postfix order, from which its licences are read and
whether the expression can be met by permitted licences alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from quarryloom.llm import textnum as T
from quarryloom.llm.exchange import bytes_of, pieces
from quarryloom.llm.storage import prepare_workers

# The phrases that every scan counts, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices, with their labels. Of notices that begin at one word the longest counts.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache-2",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1",
    "isc license": "isc",
    "released into the public domain": "public-domain",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "all rights reserved": "all-rights-reserved",
    "permission to use copy modify and or distribute this software for any purpose with or without fee": "isc",
    "licensed under the mit license": "mit",
    "the mit license mit": "mit",
    "apache license version 2 0": "apache-2",
    "this software is provided as is without any express or implied warranty": "zlib",
    "zlib license": "zlib",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3",
    "mozilla public license version 2 0": "mpl-2",
    "gnu general public license as published by the free software foundation": "gpl",
    "either version 2 of the license or at your option any later version": "gpl-2-plus",
    "either version 3 of the license or at your option any later version": "gpl-3-plus",
    "gnu lesser general public license version 2 1": "lgpl-2-1",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "gnu free documentation license": "gfdl",
    "eclipse public license version 2 0": "epl-2",
    "european union public licence": "eupl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "server side public license": "sspl",
    "business source license": "busl",
    "creative commons attribution 4 0 international": "cc-by",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by 4 0": "cc-by",
    "open database license": "odbl",
    "sil open font license": "ofl",
    "artistic license": "artistic",
    "proprietary and confidential": "proprietary",
}
# Identifiers whose label isn't the identifier itself in lower case.
IDENTIFIERS = {
    "apache-2.0": "apache-2",
    "bsd-2-clause": "bsd-2",
    "bsd-3-clause": "bsd-3",
    "bsl-1.0": "bsl-1",
    "cc-by-nc-4.0": "cc-by-nc",
    "cc-by-sa-4.0": "cc-by-sa",
    "cc0-1.0": "cc0",
    "gpl-2.0-only": "gpl-2",
    "gpl-2.0-or-later": "gpl-2-plus",
    "gpl-2.0": "gpl-2",
    "gpl-3.0-only": "gpl-3",
    "gpl-3.0-or-later": "gpl-3-plus",
    "gpl-3.0": "gpl-3",
    "mpl-2.0": "mpl-2",
    "agpl-3.0": "agpl-3",
    "agpl-3.0-only": "agpl-3",
    "agpl-3.0-or-later": "agpl-3-plus",
    "lgpl-2.1": "lgpl-2-1",
    "lgpl-2.1-only": "lgpl-2-1",
    "lgpl-2.1-or-later": "lgpl-2-1-plus",
    "lgpl-3.0": "lgpl-3",
    "lgpl-3.0-only": "lgpl-3",
    "lgpl-3.0-or-later": "lgpl-3-plus",
    "epl-2.0": "epl-2",
    "eupl-1.2": "eupl",
    "cc-by-4.0": "cc-by",
    "cc-by-nd-4.0": "cc-by-nd",
    "cc-by-nc-sa-4.0": "cc-by-nc-sa",
    "cc-by-nc-nd-4.0": "cc-by-nc-nd",
    "odbl-1.0": "odbl",
    "ofl-1.1": "ofl",
    "artistic-2.0": "artistic",
    "sspl-1.0": "sspl",
    "busl-1.1": "busl",
    "gfdl-1.3-or-later": "gfdl",
}
# Labels that an expression may rest on.
PERMITTED = frozenset(("mit", "apache-2", "bsd", "bsd-2", "bsd-3", "bsl-1", "isc", "cc0", "public-domain", "unlicense", "zlib", "wtfpl", "cc-by", "artistic", "ofl"))

TAG = "spdx license identifier"
_TAG_LINE = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:_-]+")
_RANK = {"or": 1, "and": 2, "with": 3}
#: How much each kind of evidence is worth by itself; kinds are joined by noisy-or.
SURE = {"tag": 0.98, "base": 0.9, "notice": 0.7}

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, permitted boolean"


class ExpressionError(ValueError):
    """A licence expression that can't be parsed."""


def parse_expression(text: str) -> list[str]:
    """A licence expression in postfix order, operators in lower case. with binds tightest, then and, then or; all from left to right."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        word = token.lower()
        if word == "(":
            if not operand_next:
                raise ExpressionError(text)
            waiting.append(word)
        elif word == ")":
            if operand_next:
                raise ExpressionError(text)
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ExpressionError(text)
            waiting.pop()
        elif word in _RANK:
            if operand_next:
                raise ExpressionError(text)
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        else:
            if not operand_next:
                raise ExpressionError(text)
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise ExpressionError(text)
    return out + waiting[::-1]


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    return IDENTIFIERS.get(name, name)


def evaluate(postfix: list[str], permitted: frozenset = PERMITTED) -> tuple[set[str], bool]:
    """(labels of the expression's licences, whether permitted ones alone can meet it). What follows with is an exception, not a licence."""
    stack: list[tuple[set[str], bool]] = []
    for x in postfix:
        if x not in _RANK:
            stack.append(({label_of(x)}, label_of(x) in permitted))
            continue
        (b, b_ok), (a, a_ok) = stack.pop(), stack.pop()
        stack.append((a, a_ok) if x == "with" else (a | b, a_ok or b_ok) if x == "or" else (a | b, a_ok and b_ok))
    return stack.pop()


def automaton():
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: bytes, found) -> tuple:
    """The columns of OUT after doc_id for one text."""
    words = text.translate(T.ALNUM).split()
    line = " " + b" ".join(words).decode("latin-1") + " "
    base: list[tuple[int, str]] = []
    longest: dict[int, str] = {}
    tagged = False
    for end, phrase in found.iter(line):
        start = end - len(phrase) - 1
        if phrase in BASE:
            base.append((start, phrase))
        if phrase == TAG:
            tagged = True
        elif len(phrase) > len(longest.get(start, "")):
            longest[start] = phrase
    base_labels = {BASE[p] for _, p in base}
    labels = base_labels | {NOTICES[p] for p in longest.values() if p in NOTICES}
    kinds = {"base"} if base else set()
    kinds |= {"notice"} if labels - base_labels else set()
    n_tags, permitted = 0, None
    for m in _TAG_LINE.finditer(text) if tagged else ():
        try:
            some, ok = evaluate(parse_expression(m[1].decode("utf-8", "replace").strip(" \t*/#<>!-;\"'")))
        except ExpressionError:
            continue
        n_tags += 1
        labels |= some
        permitted = ok if permitted is None else permitted and ok
        kinds.add("tag")
    doubt = 1.0
    for k in sorted(kinds):
        doubt *= 1 - SURE[k]
    at = [line.count(" ", 0, s) for s in (min(s for s, _ in base), max(s for s, _ in base))] if base else [None, None]
    return len(words), len(base), at[0], at[1], ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - doubt, n_tags, permitted


def license_scan(docs: DataFrame) -> DataFrame:
    """Licences named in each whole text.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z lower-cased. Returns
    a row for each row of docs: doc_id, n_words, n_base (places where a BASE
    phrase's words stand consecutively), first_word and last_word (their
    smallest and largest start, null without any), base_labels and labels
    (with those of notices and tags; distinct, sorted, joined by commas), score
    (0 without labels; rises with the kinds of evidence), n_tags (expressions
    that parse) and permitted (whether all of those can be met by PERMITTED
    licences, null without any).

    A null or empty text has no words and no labels. Expressions that can't
    be parsed are passed over. Repeated rows are scanned alike; other columns
    are neither read nor returned.
    """
    prepare_workers(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in OUT.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in pieces(batches):
            rows = [scan_text(t, found) for t in bytes_of(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"]] + [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.mapInArrow(scan, OUT)
