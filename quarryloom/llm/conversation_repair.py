"""Repair of the structure of conversations, by a dynamic program over a trie.

What an edit costs depends on the roles and faults of a conversation's turns
alone. These are written as signatures, a character a turn. Distinct
signatures are dealt to tasks by ranges in sorted order, so that a task walks
a prefix trie of them: the layers of the program are kept for the path to the
current node and shared by all signatures below it, and each end of a
signature gives its answer.

Long conversations are cut into segments of SEGMENT turns. A segment's layers
start from each of the four states that a conversation can be in; what the
segments after it cost from each state is handed back from segment to segment,
so the pieces' answers join to that of the whole. No task holds more than one
segment's signature and a batch of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryloom.llm.storage import prepare_workers, settle

SEGMENT = 1_024
#: A signature with more than this share of all segments is one of so few that their answers are broadcast.
OFTEN = 1 / 1_024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
HAS_WORDS, SPACES = r"[^\x20\x09-\x0D]", " \t\n\v\f\r"

#: What a conversation is in: nothing yet, after a system turn, after a user's, after an assistant's. It may end in the first and the last.
STATES, START, ENDS = 4, 0, (0, 3)
USER, ASSISTANT = 2, 3
#: The state after an s, u or a; and the role that an inserted or renamed turn has to have.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: USER, 1: USER, 2: ASSISTANT, 3: USER}
#: Signature: x has to be deleted; else the role's initial (o for all others), upper case if the turn is truncated.
SYMBOLS = "xsuaoSUAO"
NONE = 1 << 40

ANSWER = "array<struct<audit:string,cost:bigint,exit:int>>"


def _steps(symbol: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, after) -> (cost, letter) of the edits that use up a turn with this symbol, the cheapest for each pair."""
    out = {(q, q): (DELETE, "D") for q in range(STATES)}
    if symbol == "x":
        return out
    more = TRUNCATED * symbol.isupper()
    for q in range(STATES):
        kept = NEXT.get((q, symbol.lower()))
        if kept is not None:
            out[q, kept] = (KEEP + more, "K")
        if kept != WANTED[q]:
            out[q, WANTED[q]] = (REROLE + more, "R")
    return out


STEPS = {x: _steps(x) for x in SYMBOLS}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cheapest way by a and then b."""
    return np.minimum(NONE, (a[:, :, None] + b[None, :, :]).min(axis=1))


def _inserts() -> np.ndarray:
    """What inserted turns alone cost from state to state."""
    one = np.full((STATES, STATES), NONE)
    np.fill_diagonal(one, 0)
    for q, to in WANTED.items():
        one[q, to] = INSERT
    return _times(_times(one, one), one)


INSERTS = _inserts()
EDITS = {x: np.array([[STEPS[x].get((p, q), (NONE, ""))[0] for q in range(STATES)] for p in range(STATES)]) for x in SYMBOLS}
#: Inserts, then the edit of a turn: the step from layer to layer.
LAYER = {x: _times(INSERTS, m) for x, m in EDITS.items()}
END = np.array([0 if q in ENDS else NONE for q in range(STATES)])


class Trie:
    """The path to the current node of a trie of signatures: a layer for each turn, costs from every state to every state."""

    def __init__(self):
        self.signature, self.layers = "", [np.where(np.eye(STATES, dtype=bool), 0, NONE)]

    def walk(self, signature: str) -> None:
        """Goes up to where the signature branches off and down to its end; layers of the shared prefix stay as they are."""
        n = 0
        for a, b in zip(self.signature, signature, strict=False):
            if a != b:
                break
            n += 1
        del self.layers[n + 1 :]
        for x in signature[n:]:
            self.layers.append(_times(self.layers[-1], LAYER[x]))
        self.signature = signature

    def costs(self) -> np.ndarray:
        return self.layers[-1]

    def answer(self, entry: int, after: np.ndarray, last: bool) -> tuple[str, int, int] | None:
        """(letters, cost, state at the end) of the cheapest edits from state entry, the least in ASCII among equals; None if there are none.

        after is what the rest costs from each state at the end of the signature, inserts before its first turn
        included. Only the last segment of a conversation writes the inserts after its last turn itself.
        """
        ends = self.layers[-1][entry] + after
        best = int(ends.min())
        if best >= NONE:
            return None
        # Backwards, the states that lie on a cheapest path: before each turn, and between its inserts and its edit.
        good = ends == best
        on = []
        for i in range(len(self.signature), 0, -1):
            x, before = self.signature[i - 1], self.layers[i - 1][entry]
            inserted = (before[:, None] + INSERTS).min(axis=0)
            here = self.layers[i][entry]
            mid = np.array([any(good[q] and inserted[p] + c == here[q] for (a, q), (c, _) in STEPS[x].items() if a == p) for p in range(STATES)])
            on.append((mid, good, inserted, here))
            good = np.array([any(mid[p] and before[q] + INSERTS[q, p] == inserted[p] for p in range(STATES)) for q in range(STATES)])
        letters, q, cost = [], entry, 0
        for x, (mid, good, inserted, here) in zip(self.signature, reversed(on), strict=True):
            while True:
                steps = [(letter, to, c) for (p, to), (c, letter) in STEPS[x].items() if p == q and mid[q] and good[to] and cost == inserted[q] and cost + c == here[to]]
                to = WANTED[q]
                if any(mid[p] and cost + INSERT + INSERTS[to, p] == inserted[p] for p in range(STATES)):
                    steps.append(("I", to, INSERT))
                letter, to, c = min(steps)
                letters.append(letter)
                q, cost = to, cost + c
                if letter != "I":
                    break
        if last:
            while cost < best:
                letters.append("I")
                q, cost = WANTED[q], cost + INSERT
        return "".join(letters), cost, q


def _asked(ask: str) -> tuple[bool, bool, np.ndarray]:
    """Whether the segment is its conversation's first, whether its last, and what the rest costs."""
    first, last, *after = map(int, ask.split(","))
    return bool(first), bool(last), np.array(after)


def answers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rows of (signature, ask, n) the answers from each state; where a conversation begins, from the start only."""
    trie, kind = Trie(), pa.list_(pa.struct([("audit", pa.string()), ("cost", pa.int64()), ("exit", pa.int32())]))
    for batch in batches:
        out = []
        for signature, ask in zip(batch["signature"].to_pylist(), batch["ask"].to_pylist(), strict=True):
            trie.walk(signature)
            first, last, after = _asked(ask)
            got = [trie.answer(q, after, last) if q == START or not first else None for q in range(STATES)]
            out.append([None if x is None else {"audit": x[0], "cost": x[1], "exit": x[2]} for x in got])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "answer"])


def costs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rows of (signature) what the turns cost from state to state, as 16 numbers."""
    trie = Trie()
    for batch in batches:
        out = []
        for signature in batch["signature"].to_pylist():
            trie.walk(signature)
            out.append(trie.costs().ravel().tolist())
        yield pa.RecordBatch.from_arrays([batch["signature"], pa.array(out, pa.list_(pa.int64()))], ["signature", "costs"])


def _level(after: np.ndarray) -> str:
    """The same costs with 0 as the smallest, so that segments before like ends ask alike."""
    return ",".join(str(NONE if x >= NONE else int(x - after.min())) for x in after)


AFTER_ALL = np.minimum(NONE, (INSERTS + END).min(axis=1))


def handed_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of (conv, segment, last, costs) by conversation and falling segment what the segments after each cost from every state."""
    after = AFTER_ALL
    for batch in batches:
        out = []
        for last, costs in zip(batch["last"].to_pylist(), batch["costs"].to_pylist(), strict=True):
            after = AFTER_ALL if last else after
            out.append(_level(after))
            after = np.minimum(NONE, (np.array(costs).reshape(STATES, STATES) + after).min(axis=1))
            after = np.minimum(NONE, after - after.min())
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["segment"], pa.array(out, pa.string())], ["conv", "segment", "after"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with faults put in by a checksum of conversation and turn; a null is one space. Of twenty rows one is dropped, one emptied, one loses its full stops, one comes twice, and one becomes the user's.

    A dropped row stays, with gone set and nothing said, for the sake of its conversation.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") < 2, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 0, F.lit("")).when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """conversations without damage, in the same columns; a null role or text is one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"), F.lit(False).alias("gone"), F.lit(1).alias("times"))


def read_turns(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Turns (conv, turn, role, text, gone, times) in order, with what the program has to know of each.

    One row for each (conversation, turn, role, text), with the number of its
    copies. The symbol is that of the first; the others are blank as it is, or
    duplicates, and always deleted, so the program needn't see them. By conversation all
    of it is one exchange.
    """
    rows = rows.groupBy("conv", "turn", "role", "text", "gone").agg(F.sum("times").alias("copies")).repartition("conv")
    # The order within a turn isn't given: by role and text. Dropped rows come last.
    order = [F.col("gone"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    seen = Window.partitionBy("conv", "role", "text").orderBy("gone", F.col("turn").asc_nulls_first())
    by = Window.partitionBy("conv").orderBy(*order)
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("again", F.row_number().over(seen) > 1).withColumn("blank", ~F.col("text").rlike(HAS_WORDS))
    end = F.substring(F.rtrim("text", F.lit(SPACES)), -1, 1)
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("again") & ~end.isin(".", "!", "?"))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    symbol = F.when(F.col("blank") | F.col("again"), F.lit("x")).when(F.col("truncated"), F.upper(known)).otherwise(known)
    pair = F.concat(F.lag(initial).over(by), initial)
    illegal = F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).cast("long") + F.col("copies") - 1
    fresh = F.col("turn").isNotNull() & ~F.coalesce(F.lag("turn").over(by) == F.col("turn"), F.lit(False))
    number = (F.row_number().over(by) - 1).cast("long")
    return rows.select(
        "conv", "turn", "role", F.col("text"), "gone", "copies", number.alias("number"), F.floor(number / segment).cast("long").alias("segment"), symbol.alias("symbol"),
        F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"), F.when(F.col("blank"), 0).otherwise(F.col("copies") - 1 + F.col("again").cast("long")).alias("duplicate"),
        F.col("truncated").cast("long").alias("truncated"), illegal.alias("illegal"), fresh.cast("long").alias("fresh"),
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal", "fresh")


def segments_of(turns: DataFrame) -> DataFrame:
    """(conv, segment, signature, first, last, the first and last turn, counts) of turns that are there."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "symbol"))), lambda x: x["symbol"]), "")
    rows = turns.filter("not gone").groupBy("conv", "segment").agg(letters.alias("signature"), F.min("turn").alias("low"), F.max("turn").alias("high"), *[F.sum(c).alias(c) for c in COUNTS])
    after = F.lead("segment").over(Window.partitionBy("conv").orderBy("segment"))
    return rows.withColumn("first", F.col("segment") == 0).withColumn("last", after.isNull())


def _by_signature(rows: DataFrame, *order: str) -> DataFrame:
    """Ranges of signatures in order, so that shared prefixes meet in a task."""
    return rows.repartitionByRange("signature", *order).sortWithinPartitions("signature", *order)


def _with_after(segments: DataFrame) -> DataFrame:
    """segments with what comes after each; conversations of one segment need no passing on."""
    one = segments.filter("first and last").withColumn("after", F.lit(_level(AFTER_ALL)))
    long = segments.filter("not (first and last)")
    if long.isEmpty():
        return one
    costs = _by_signature(long.select("signature").distinct()).mapInArrow(costs_of, "signature string, costs array<bigint>")
    back = long.select("conv", "segment", "last", "signature").join(costs, "signature").drop("signature")
    back = back.repartition("conv").sortWithinPartitions("conv", F.desc("segment")).mapInArrow(handed_back, "conv bigint, segment bigint, after string")
    back = back.select(F.col("conv").alias("b_conv"), F.col("segment").alias("b_segment"), "after")
    return one.unionByName(long.join(back, F.col("conv").eqNullSafe(F.col("b_conv")) & (F.col("segment") == F.col("b_segment"))).drop("b_conv", "b_segment"))


def answered(segments: DataFrame) -> DataFrame:
    """segments with answer: for each state at its begin (letters, cost, state at the end). Every distinct question is answered once."""
    asking = _with_after(segments).withColumn("ask", F.concat_ws(",", F.col("first").cast("int"), F.col("last").cast("int"), "after")).drop("after")
    asking = settle(asking, "asking")
    questions = asking.groupBy("signature", "ask").agg(F.count("*").alias("n"))
    answers = settle(_by_signature(questions, "ask").mapInArrow(answers_of, f"signature string, ask string, n bigint, answer {ANSWER}"), "answers")
    often = (answers.agg(F.sum("n")).first()[0] or 0) * OFTEN
    key = ["signature", "ask"]
    # No more than 1 / OFTEN questions are so frequent, and each is of one segment: their answers go to all tasks. The others are joined.
    common = asking.join(F.broadcast(answers.filter(F.col("n") > often).drop("n")), key, "left")
    rare = common.filter("answer is null").drop("answer").join(answers.filter(F.col("n") <= often).drop("n"), key)
    return common.filter("answer is not null").unionByName(rare)


class Repairs:
    """Reads a sorted stream of segments and turns and says what becomes of each conversation."""

    def __init__(self):
        self.state, self.letters, self.at = START, "", 0

    def begin(self, answer: list[dict | None], entry: int) -> dict:
        got = answer[entry]
        self.letters, self.at = got["audit"], 0
        return got

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the turns to insert here."""
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.at += 1
            self.state = WANTED[self.state]
            yield "I", ROLES[self.state], ""

    def turn(self, role: str, text: str) -> tuple[str, str | None, str]:
        """(letter, role, text) of a turn; a deleted one's role is None."""
        letter = self.letters[self.at]
        self.at += 1
        if letter == "D":
            return letter, None, text
        self.state = WANTED[self.state] if letter == "R" else NEXT[self.state, role[:1]]
        return letter, ROLES[self.state] if letter == "R" else role, text


ROLES = {USER: "user", ASSISTANT: "assistant"}


def edits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From the merged stream: ("conv", conv) as one begins, ("segment", row, cost) and ("edit", letter, role, text, copies)."""
    now, repairs, entry = None, Repairs(), START
    for batch in batches:
        for row in batch.to_pylist():
            if now != (row["conv"],):
                for e in repairs.inserted():
                    yield "edit", *e, 1
                now, repairs, entry = (row["conv"],), Repairs(), START
                yield "conv", row["conv"]
            if row["kind"] == 0:
                got = repairs.begin(row["answer"], entry)
                entry = got["exit"]
                yield "segment", row, got["cost"]
            elif row["kind"] == 1:
                for e in repairs.inserted():
                    yield "edit", *e, 1
                yield "edit", *repairs.turn(row["role"], row["text"]), row["copies"]
    if now is not None:
        for e in repairs.inserted():
            yield "edit", *e, 1


class Report:
    """What is told of a conversation."""

    def __init__(self, conv: int | None):
        self.conv, self.counts, self.low, self.high = conv, dict.fromkeys(COUNTS, 0), None, None
        self.cost, self.audit, self.hash, self.lines = 0, [], hashlib.sha256(), 0

    def segment(self, row: dict, cost: int) -> None:
        for c in COUNTS:
            self.counts[c] += row[c]
        self.low = min((x for x in (self.low, row["low"]) if x is not None), default=None)
        self.high = max((x for x in (self.high, row["high"]) if x is not None), default=None)
        self.cost += cost

    def edit(self, letter: str, role: str | None, text: str, copies: int) -> None:
        self.audit.append(letter + "D" * (copies - 1))
        self.cost += DELETE * (copies - 1)
        if role is not None:
            self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
            self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["fresh"]
        gaps = gaps if gaps < 1 << 63 else None
        return (self.conv, gaps, *[self.counts[c] for c in COUNTS[:-1]], self.cost, "".join(self.audit), self.hash.hexdigest())


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, edit string, role string, text string"
#: Rows that a task gives back at a time, and the bytes of text in them.
GIVE_ROWS, GIVE_BYTES = 4_096, 8 << 20


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    report, out = None, []
    for what, *rest in edits_of(batches):
        if what == "conv":
            if report:
                out.append(report.row())
            report = Report(*rest)
            if len(out) >= GIVE_ROWS:
                yield _batch(out, names, kinds)
                out = []
        else:
            getattr(report, what)(*rest)
    if report:
        out.append(report.row())
        yield _batch(out, names, kinds)


def new_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = [x.split()[0] for x in TURNS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    conv, place, out, held = None, 0, [], 0
    for what, *rest in edits_of(batches):
        if what == "conv":
            conv, place = rest[0], 0
        elif what == "edit" and rest[1] is not None:
            letter, role, text, _ = rest
            out.append((conv, place, letter, role, text))
            place, held = place + 1, held + len(text)
            if len(out) >= GIVE_ROWS or held >= GIVE_BYTES:
                yield _batch(out, names, kinds)
                out, held = [], 0
    if out:
        yield _batch(out, names, kinds)


def merged(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Segments with their answers before their turns, by conversation and in order: one exchange, sorted outside memory."""
    prepare_workers(rows.sparkSession)
    turns = settle(read_turns(rows, segment), "turns")
    segments = answered(segments_of(turns))
    none = lambda *kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds]
    said = (("role", "string"), ("text", "string"), ("copies", "bigint"))
    told = (("low", "bigint"), ("high", "bigint"), *[(c, "bigint") for c in COUNTS], ("answer", ANSWER))
    heads = segments.select("conv", "segment", F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("number"), *none(*said), *[c for c, _ in told])
    kind = F.when(F.col("gone"), 2).otherwise(1)
    bodies = turns.select("conv", F.when(F.col("gone"), F.lit(-1)).otherwise(F.col("segment")).cast("bigint").alias("segment"), kind.alias("kind"), "number", *[c for c, _ in said], *none(*told))
    return heads.unionByName(bodies).repartition("conv").sortWithinPartitions("conv", "segment", "kind", "number")


def repair_report(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """For each conversation its faults, the cheapest repair and the checksum of what it leaves.

    rows come from damaged() or as_they_are(). Returns conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit (a letter for each edit: K keep, R
    another role, D delete, I insert) and repaired_sha256 of the lines role:text.

    A null conversation is one of its own. Null roles and texts are one space.
    Turns with one number stand in the order of role and text. Repeated rows are
    duplicates but for the first. A role counts by its first letter, so an empty or
    unknown one can't be kept. A conversation without rows has zeros, an empty audit
    and the checksum of nothing; no rows give no conversations. gaps are null beyond a long. The checksum
    runs over a conversation's lines in order, so a conversation's turns
    pass through one task, in batches and sorted on disk, however many they are.
    """
    return merged(rows, segment).mapInArrow(reports, REPORT)


def repaired_turns(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text."""
    return merged(rows, segment).mapInArrow(new_turns, TURNS)
