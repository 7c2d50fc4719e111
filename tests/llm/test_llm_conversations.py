"""Repair of conversations against a search over all edits, on awkward tables and in segments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryloom.llm import conversation_repair as C
from quarryloom.llm.conversation_repair import AFTER_ALL, SYMBOLS, Trie, damaged, repair_report, repaired_turns

CONV = "conv_id long, turn long, role string, text string, segment int, number string, symbol string, answer string, kind int"
LEGAL = re.compile(r"(s?(ua)+)?")


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "n", "s", "a", 9) for r in rows], CONV).repartition(parts)


def cheapest(symbols):
    """(cost, letters) by a search that goes through partial edits in the order of cost and letters, with the roles written out."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, letters, i, roles = heapq.heappop(heap)
        tail = "" if not roles else roles if roles == "s" else roles[-1]
        if (i, tail) in seen:
            continue
        seen.add((i, tail))
        if i == len(symbols) and LEGAL.fullmatch(roles):
            return cost, letters
        may = lambda r: LEGAL.fullmatch(roles + r) or LEGAL.fullmatch(roles + r + "a") or LEGAL.fullmatch(roles + r + "ua")
        for r in "ua":
            if may(r):
                heapq.heappush(heap, (cost + 3, letters + "I", i, roles + r))
        if i < len(symbols):
            x = symbols[i]
            heapq.heappush(heap, (cost + 4, letters + "D", i + 1, roles))
            if x != "x":
                more = 3 if x.isupper() else 0
                if x.lower() != "o" and may(x.lower()):
                    heapq.heappush(heap, (cost + more, letters + "K", i + 1, roles + x.lower()))
                for r in "ua":
                    if may(r):
                        heapq.heappush(heap, (cost + more + 3, letters + "R", i + 1, roles + r))
    return None


def brute(rows):
    """conv_id -> what is told of it, by the definition."""
    said = lambda x: " " if x is None else str(x)
    found = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text, fault = said(role), said(text), zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        found[c] += [(t, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for c, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            bare = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
            if fault:
                n[fault] += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        turns = {t for t, *_ in own if t is not None}
        cost, audit = cheapest(symbols)
        lines, roles, i = [], "", 0
        for x in audit:
            wanted = "assistant" if roles[-1:] == "u" else "user"
            _, role, text = own[i] if x != "I" else (None, None, "")
            i += x != "I"
            if x != "D":
                role = role if x == "K" else wanted
                lines.append(f"{role}:{text}")
                roles += role[0]
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def told(out):
    return {r["conv_id"]: tuple(r)[1:] for r in out.collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys"]) if t else rng.choice(["system", "user"])
            text = rng.choice(["Yes.", "No!", "cut off", "", " \t", None, f"word {rng.randrange(4)}?", "end. \n", "x" * rng.choice([1, 40]), "odd ", " "])
            out.append((c, rng.choice([t, t, t + 1, None, t * 3]), role, text))
    out += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Hi."), (None, None, "user", "Hello.")]
    out += [(70, 1, "user", "Same.")] * 9 + [(71, t, "user" if t % 2 else "assistant", f"Turn {t}.") for t in range(40)]
    out += [(-5, -3, "user", "Minus."), (-5, 4, "assistant", "Plus."), (72, None, None, None)]
    out += [(73, t, r, "long " * 20_000 + ".") for t, r in ((1, "user"), (2, "assistant"))]
    return out


@pytest.mark.parametrize("segment", [C.SEGMENT, 3, 1])
def test_by_the_definition(spark, rows, segment):
    got, want = told(repair_report(damaged(table(spark, rows)), segment)), brute(rows)
    assert got.keys() == want.keys() and [(c, got[c], want[c]) for c in got if got[c] != want[c]] == []


def test_conversation_that_loses_all_rows(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    got = told(repair_report(damaged(table(spark, [(1, gone, "user", "Hello.")]))))
    assert got == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_no_rows(spark):
    out = repair_report(damaged(table(spark, [])))
    assert out.count() == 0 and out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment", [C.SEGMENT, 2])
def test_repaired_turns_make_the_checksum(spark, rows, segment):
    whole = damaged(table(spark, rows))
    turns = {}
    for r in sorted(repaired_turns(whole, segment).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["place"])):
        turns.setdefault(r["conv_id"], []).append(r)
    for c, own in told(repair_report(whole, segment)).items():
        mine = turns.get(c, [])
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == own[-1]
        assert LEGAL.fullmatch("".join(r["role"][0] for r in mine)) and "".join(r["edit"] for r in mine) == own[-2].replace("D", "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(SYMBOLS, max_size=9), min_size=1, max_size=5))
def test_answers_from_a_shared_trie(signatures):
    trie = Trie()
    for s in sorted(signatures):
        trie.walk(s)
        letters, cost, _ = trie.answer(C.START, AFTER_ALL, True)
        assert (cost, letters) == cheapest(s)


def test_shared_prefixes_are_computed_once(monkeypatch):
    made, times = [], C._times
    monkeypatch.setattr(C, "_times", lambda a, b: made.append(1) or times(a, b))
    trie = Trie()
    for s in ("ua" * 50 + x for x in ("", "s", "u", "ua")):
        trie.walk(s)
    assert len(made) == 100 + 1 + 1 + 1 and len(trie.layers) == 103
