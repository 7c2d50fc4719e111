"""N-gram Jaccard join with a token-group matrix.

Similar documents are put into groups of bounded size; the matrix holds, for
each group, the union of its documents' tokens (word shingles). A query's
overlap with that union bounds its overlap with every member, so only groups
whose bound reaches the threshold are opened and their members compared.

1. Documents with equal token sets form a class; one of each goes on.
2. Chunks of documents learn by an exchange of packed hashes how many
   documents have each of their tokens. Tokens are ordered by that number,
   rare ones first. Two sets that are similar enough share a token among the
   first few of this order; a document whose first few are all its own is
   similar to none and leaves here.
3. Groups: documents that agree on min-hashes are linked to the most central
   of them if they are similar enough. Linked documents make a group; others
   that met in the same buckets make one as well, though they aren't linked.
   Groups are split into blocks of bounded size.
4. The matrix, stored sparsely as (token, block), names for each query the
   blocks that could hold a partner of another component. Blocks whose token
   union is too far from the query stay shut; the rest are opened, and the
   query is compared with all members at once.

The result is exact: step 3 only saves work, step 4 misses no link between
documents of different groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryloom.llm import textnum as T
from quarryloom.llm.exchange import HAS_WORDS, SENT, Layout, Shared, bytes_of, chunk_of, dealt, gathered, ids_of, pieces, send, shared_keys
from quarryloom.llm.graph import connected_components
from quarryloom.llm.storage import drop_settled, prepare_workers, settle

BANDS, ROWS = 6, 2
#: A block of a group has about so many documents and tokens at most; so many queries meet it at a time.
BLOCK_DOCS, BLOCK_TOKENS, BLOCK_QUERIES = 128, 1 << 17, 256

_MINHASH = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def token_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; the whole text as one if it has fewer words; none without words."""
    h, off = T.hash_words(texts, T.LOWER)
    g = T.grams(h, k)
    out = []
    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        out.append(np.unique(g[i : j - k + 1]) if j - i >= k else T.grams(h[i:j], j - i) if j > i else np.empty(0, np.uint64))
    return out


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.md5(tokens.tobytes()).digest()


def _bands(tokens: np.ndarray) -> list[int]:
    least = [int(T.mix(tokens * m).min()) for m in _MINHASH]
    rows = np.array(least, np.uint64).reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        keys = T.mix(keys + rows[:, r] * _MINHASH[r])
    return keys.view(np.int64).tolist()


def jaccard_classes(docs: DataFrame, k: int, n_chunks: int) -> DataFrame:
    """doc_id, chunk, n_shingles and the signature of the token set (null if it is empty), for each row of docs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = token_sets(bytes_of(batch["text"]), k)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["chunk"], pa.array([len(x) for x in found], pa.int64()), pa.array([signature(x) if len(x) else None for x in found], pa.binary())],
                ["doc_id", "chunk", "n_shingles", "sig"],
            )

    return docs.withColumn("chunk", chunk_of(n_chunks, "doc_id", "text")).mapInArrow(sets, "doc_id long, chunk int, n_shingles long, sig binary")


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Component of each document under links of Jaccard similarity num / den or more.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set is its
    distinct shingles of that many words, the whole sequence if it has fewer.

    Returns a row for each row of docs: doc_id, n_shingles, component_id, the
    smallest doc_id that links lead to, the row's own included.

    A null or empty text has no shingles and is linked with nothing. Equal
    texts are one class and so one component. Rows with one doc_id and
    different texts are one node. A null doc_id takes no part unless an equal
    text has an id; its component_id is then that one's, else null. Other
    columns of docs are neither read nor returned.
    """
    prepare_workers(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    once, layout = gathered(docs)
    rows = settle(jaccard_classes(docs, shingle, layout.chunks), "sets")
    classes = rows.filter("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "chunk")).alias("r")).select("sig", F.col("r.doc_id").alias("rep"), F.col("r.chunk").alias("chunk"))
    classes = settle(classes, "classes")

    active = settle(_active(once.drop("copies"), classes, shingle, num, den, layout), "active")
    groups = settle(_groups(active, num, den), "groups")
    links = _open(active, groups, num, den)
    far = connected_components(links, "a", "b")
    drop_settled(active)
    label = groups.join(far, groups["grp"] == far["node"], "left").select("rep", F.coalesce("label", "grp").alias("component"))
    label = classes.join(label.groupBy("rep").agg(F.min("component").alias("component")), "rep", "left").select(F.col("sig").alias("class_sig"), F.coalesce("component", "rep").alias("component"))
    return rows.join(label, rows["sig"] == label["class_sig"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _active(docs: DataFrame, classes: DataFrame, shingle: int, num: int, den: int, layout: Layout) -> DataFrame:
    """Of each class that may have a partner: rep, n, tokens, how many of them it has alone, the shared tokens of its prefix and how many of them it is indexed by, min-hash bands."""
    chunks = dealt(docs, layout, "doc_id", "text")
    n = layout.parts

    def own(table: pa.Table, reps: dict):
        """(rep, token set) of the classes that this chunk stands for"""
        ids = ids_of(table["doc_id"])
        wanted = np.flatnonzero(np.isin(ids, np.fromiter({d for d, _ in reps}, np.int64, -1)))
        texts = table["text"].take(pa.array(wanted)) if len(wanted) else table["text"].slice(0, 0)
        for d, tokens in zip(ids[wanted].tolist(), token_sets(bytes_of(texts), shingle), strict=True):
            if len(tokens) and reps.pop((d, signature(tokens)), False):
                yield d, tokens

    def tokens_out(key: tuple, table: pa.Table, reps: pa.Table) -> pa.Table:
        sets = [t for _, t in own(table, dict.fromkeys(zip(reps["rep"].to_pylist(), reps["sig"].to_pylist(), strict=True), True))]
        return send(key[0].as_py(), np.concatenate(sets) if sets else np.empty(0, np.uint64), n)

    def prefixes(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        is_rep = told["sig"].is_valid()
        reps = told.filter(is_rep)
        shared = Shared(told.filter(told["keys"].is_valid()), n)
        out = {k: [] for k in ("rep", "n", "tokens", "alone", "prefix", "indexed", "bands")}
        for d, tokens in own(table, dict.fromkeys(zip(reps["rep"].to_pylist(), reps["sig"].to_pylist(), strict=True), True)):
            size = len(tokens)
            probe = size + (-num * size // den) + 1
            index = size + (-2 * num * size // (num + den)) + 1
            count = shared.count(tokens)
            alone = int((count <= 1).sum())
            if alone >= probe:
                continue
            some = np.flatnonzero(count > 1)
            some = some[np.lexsort((tokens[some], count[some]))][: probe - alone]
            out["rep"].append(d)
            out["n"].append(size)
            out["tokens"].append(tokens.tobytes())
            out["alone"].append(alone)
            out["prefix"].append(tokens[some].view(np.int64))
            out["indexed"].append(max(0, index - alone))
            out["bands"].append(_bands(tokens))
        kinds = {"rep": pa.int64(), "n": pa.int64(), "tokens": pa.binary(), "alone": pa.int32(), "prefix": pa.list_(pa.int64()), "indexed": pa.int32(), "bands": pa.list_(pa.int64())}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in out.items()})

    sent = chunks.groupBy("chunk").cogroup(classes.groupBy("chunk")).applyInArrow(tokens_out, SENT)
    told = shared_keys(sent).unionByName(classes, allowMissingColumns=True)
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(prefixes, "rep long, n long, tokens binary, alone int, prefix array<long>, indexed int, bands array<long>")


def _groups(active: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, n, grp, linked, clu, part): grp is the component by verified links to the most central document of each min-hash bucket; clu and part name the block."""
    buckets = active.select("rep", "n", F.explode("bands").alias("band"))
    sizes = buckets.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1")
    met = buckets.join(sizes, "band")
    central = met.join(met.groupBy("rep").agg(F.sum("c").alias("met")), "rep")
    leaders = central.groupBy("band").agg(F.max(F.struct("met", -F.col("rep"), "n")).alias("l")).select("band", (-F.col("l.col2")).alias("leader"), F.col("l.n").alias("leader_n"))
    pairs = met.join(leaders, "band").filter(f"rep <> leader and {den} * least(n, leader_n) >= {num} * greatest(n, leader_n)").select("rep", "leader").distinct()
    a = active.select("rep", F.col("tokens").alias("a"))
    b = active.select(F.col("rep").alias("leader"), F.col("tokens").alias("b"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["a"], batch["b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append((num + den) * len(np.intersect1d(x, y, assume_unique=True)) >= num * (len(x) + len(y)))
            yield batch.select(["rep", "leader"]).filter(pa.array(keep, pa.bool_()))

    links = pairs.join(a, "rep").join(b, "leader").select("rep", "leader", "a", "b").mapInArrow(similar, "rep long, leader long")
    near = connected_components(links, "rep", "leader")
    # Those without a link go with others of their kind, by the most central leader of their buckets.
    kind = met.select("rep", "band").join(central.groupBy("band").agg(F.max(F.struct("met", -F.col("rep"))).alias("l")), "band").groupBy("rep").agg((-F.max("l").getField("col2")).alias("kind"))
    members = active.select("rep", "n").join(near, F.col("rep") == F.col("node"), "left").join(kind, "rep", "left")
    members = members.select("rep", "n", F.coalesce("label", "rep").alias("grp"), F.col("label").isNotNull().alias("linked"), F.coalesce("label", "kind", "rep").alias("clu"))
    size = members.groupBy("linked", "clu").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    return members.join(size, ["linked", "clu"]).select("rep", "n", "grp", "linked", "clu", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("part"))


BLOCK = ("linked", "clu", "part")


def _open(active: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between components, one at least for each two that have any."""
    prefix = active.select("rep", "alone", "indexed", F.posexplode("prefix").alias("pos", "token")).join(groups, "rep")
    prefix = prefix.withColumn("rest", F.col("n") - F.col("alone") - F.col("pos"))  # tokens from this one on
    matrix = prefix.filter("pos < indexed").groupBy("token", *BLOCK).agg(F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.min("rep").alias("first"), F.max("rep").alias("last"), F.max("rest").alias("most"))
    queries = prefix.select("token", F.col("rep").alias("q"), "n", "grp", "rest")
    # Sizes that can go together, and as many tokens left on both sides of the first common token as the overlap needs.
    fits = f"most_n >= min_n and {num} * n <= {den} * max_n and {num + den} * least(rest, most) >= {num} * (n + greatest(min_n, ceil({num} * n / {den})))"
    queries = queries.withColumn("most_n", F.col("n"))
    # Blocks of linked documents hold one component: for these a token first joins components, so that none meets itself.
    whole = matrix.filter("linked").withColumn("to", F.col("clu"))
    goals = whole.groupBy("token", "to").agg(F.min("min_n").alias("min_n"), F.max("max_n").alias("max_n"), F.max("most").alias("most"))
    sides = queries.groupBy("token", "grp").agg(F.min("n").alias("n"), F.max("n").alias("most_n"), F.max("rest").alias("rest"))
    reached = goals.join(sides, "token").filter("grp <> to").filter(fits).select("token", "to", "grp")
    found = queries.join(reached, ["token", "grp"]).join(whole, ["token", "to"]).filter(fits).select("q", *BLOCK)
    mixed = queries.join(matrix.filter("not linked"), "token").filter(fits).filter("first <> q or last <> q").select("q", *BLOCK)
    found = settle(found.unionByName(mixed).distinct(), "candidates")

    turns = found.groupBy(*BLOCK).agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("turns"))
    asked = found.join(turns, list(BLOCK)).withColumn("turn", F.pmod(F.xxhash64("q"), F.col("turns")).cast("int"))
    asked = asked.join(groups.select(F.col("rep").alias("q"), "grp"), "q").join(active.select(F.col("rep").alias("q"), "tokens"), "q")
    shown = groups.join(turns, list(BLOCK)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).join(active.select("rep", "tokens"), "rep")
    keys = (*BLOCK, "turn")
    asked, shown = (df.select(*[F.col(c).alias(c) for c in (*keys, "grp", "tokens")]) for df in (asked, shown))  # both come from active: columns of their own

    def opened(key: tuple, asked: pa.Table, shown: pa.Table) -> pa.Table:
        if not asked.num_rows or not shown.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        members = [np.frombuffer(x, np.uint64) for x in shown["tokens"].to_pylist()]
        grps, sizes = shown["grp"].to_numpy(), np.array([len(m) for m in members])
        union = np.unique(np.concatenate(members))
        holds = np.zeros((len(members), len(union)), bool)
        for i, m in enumerate(members):
            holds[i, np.searchsorted(union, m)] = True
        linked: set[tuple[int, int]] = set()
        for grp, x in zip(asked["grp"].to_pylist(), asked["tokens"].to_pylist(), strict=True):
            q = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(union, q), len(union) - 1)
            at = at[union[at] == q]
            floor = max(int(sizes.min()), -(-num * len(q) // den))
            if (num + den) * len(at) < num * (len(q) + floor):
                continue
            enough = (num + den) * holds[:, at].sum(1) >= num * (len(q) + sizes)
            linked.update((grp, int(g)) for g in grps[enough] if g != grp)
        return pa.table({"a": pa.array([a for a, _ in linked], pa.int64()), "b": pa.array([b for _, b in linked], pa.int64())})

    return asked.groupBy(*keys).cogroup(shown.groupBy(*keys)).applyInArrow(opened, "a long, b long")
