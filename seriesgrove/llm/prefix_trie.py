"""Operator 11: conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of first turns; its members are the conversations
that start with it and its owner is the smallest of them.  A member that is
smallest stays so in every deeper node of its path, so a conversation owns a
suffix of its path, from its ``start`` on, or nothing if another one equals it.
That makes every subtree sum a plain sum over members: of the words below a node
each member counts its whole path from there (its occurrences) and subtracts the
part that it owns; a leaf counts with the one conversation that owns it; a child
with the one that owns the child.  One group-by over (conversation, depth) rows
gives all of them, for all nodes, without walking the trie.

1. Rows are ordered by (conversation, turn) over ranges, so a conversation of
   any length is spread; positions follow from the ranges' counts.
2. Rebuilding joins at most three head turns to each conversation.
3. Windows over blocks of ``BLOCK`` turns give running word counts and the
   node's key, the running XOR of 128-bit hashes of (position, turn); blocks
   before it add theirs.  Two different prefixes of one depth share a key with a
   chance of about 2 ** -128 a pair.
4. Owners by a group-by of the nodes, pre-aggregated, since the root holds every
   conversation: a window over a node's members would gather them in one task.
   The suffixes follow by a group-by of the owners.
5. The group-by of the nodes, pre-aggregated.
6. Only the first node that a conversation owns has another owner above it.
   Nodes with more than one ``HEAVY``-th of all nodes as children are at most
   ``HEAVY`` and broadcast; the others are joined by shuffling.
7. Digests of ending members: ids are ordered by ranges, joined into texts of
   ``CHUNK`` ids, and the texts of a node hashed one after another, so that any
   number of equal conversations takes a bounded memory.

Defined cases: rows without conv_id belong to no conversation; turns of equal
number stand by role, then by the SHA-256 of role and text, and equal rows are
turns of their own; null role or text is empty; a negative conv_id takes its
remainder with its sign; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import row_offsets
from .common import WS, small, stored, table, with_row_id

GROUP, HEADS = 20, 4
BLOCK, HEAVY, CHUNK = 16, 1024, 1 << 15  # BLOCK as a power of two
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, digest, words): every turn at its place in the order of all turns, from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = with_row_id(conversations.select("conv_id", "turn", "role", "text")).where("conv_id is not null")
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = rows.select("conv_id", "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(f"[^{WS}]+")).cast("long").alias("words"), "_row")
    return row_offsets(rows, [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("_row")], "at").select("conv_id", "at", "digest", "words")


def rebuilt(spark: SparkSession, conversations: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(conv_id, size) of every conversation and (conv_id, size, depth, k1, k2, words) of its turns after its head is replaced."""
    rows = stored(spark, turns(conversations), "turns").withColumn("part", F.shiftright("at", block))
    parts = stored(spark, rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "parts")
    convs = parts.groupBy("conv_id").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
    convs = convs.withColumn("cut", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    convs = stored(spark, convs, "conversations")
    bases = convs.where("conv_id = base").select("base", F.col("n").alias("base_n"), F.col("first").alias("base_first"))
    taken = F.least("cut", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(bases, "base", "left").withColumn("taken", taken).withColumn("size", F.col("taken") + F.greatest(F.col("n") - F.col("cut"), F.lit(0)))
    convs = stored(spark, convs.select("conv_id", "first", "cut", "base", "taken", "size"), "sizes")

    # A conversation's facts go to its parts, so that a long one's rows don't meet under one key.
    facts = parts.select("conv_id", "part").join(convs, "conv_id")
    rows = rows.join(facts, ["conv_id", "part"]).withColumn("p", F.col("at") - F.col("first") + 1)
    head = rows.where("conv_id = base and p < " + str(HEADS)).select(F.col("conv_id").alias("base"), "p", "digest", "words")
    lent = convs.where("taken > 0").select("conv_id", "base", "taken", "size").join(head, "base").where("p <= taken").select("conv_id", "size", F.col("p").alias("depth"), "digest", "words")
    own = rows.where("p > cut").select("conv_id", "size", (F.col("taken") + F.col("p") - F.col("cut")).alias("depth"), "digest", "words")
    key = lambda k: F.xxhash64(F.lit(k), "depth", "digest").alias(f"k{k}")
    return convs.select("conv_id", "size"), stored(spark, lent.unionByName(own).select("conv_id", "size", "depth", key(1), key(2), "words"), "rebuilt")


def paths(spark: SparkSession, conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation and depth: size, the node's key (depth, k1, k2) and its parent's (p1, p2), the words of the last turn and of those before it."""
    convs, steps = rebuilt(spark, conversations, block)
    steps = steps.withColumn("part", F.shiftright("depth", block))
    sums = {"k1": F.bit_xor("k1"), "k2": F.bit_xor("k2"), "words": F.sum("words")}
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.where(F.col("size") >= 1 << block).groupBy("conv_id", "part").agg(*[f.alias(c) for c, f in sums.items()])
    carried = stored(spark, totals.select("conv_id", "part", *[f.over(before).alias("c_" + c) for c, f in sums.items()]), "carried")
    run = steps.select("conv_id", "part", "size", "depth", "words", "k1", "k2", *[f.over(upto).alias("r_" + c) for c, f in sums.items()])
    run = run.join(small(carried), ["conv_id", "part"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    key = lambda c: F.col("r_" + c).bitwiseXOR(zero("c_" + c))
    turn = run.select("conv_id", "size", "depth", key("k1").alias("h1"), key("k2").alias("h2"), key("k1").bitwiseXOR(F.col("k1")).alias("p1"), key("k2").bitwiseXOR(F.col("k2")).alias("p2"),
                      "words", (F.col("r_words") + zero("c_words") - F.col("words")).alias("before"))
    turn = turn.withColumnRenamed("h1", "k1").withColumnRenamed("h2", "k2")
    none = F.lit(0).cast("long")
    top = convs.select("conv_id", "size", none.alias("depth"), *[none.alias(c) for c in ("k1", "k2", "p1", "p2", "words", "before")])
    return stored(spark, turn.unionByName(top), "paths")


def owned(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """conv_id, size, start (depth of the first node it owns, null for none), upto (words before that, or all) and leaf (0 or 1) of every conversation."""
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("size").alias("longest"), F.min("before").alias("before"))
    owners = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("s"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    ends = rows.where("depth = size").select("conv_id", "size", (F.col("before") + F.col("words")).alias("total"))
    found = ends.join(owners, "conv_id", "left")
    return stored(spark, found.select("conv_id", "size", F.col("s.depth").alias("start"), F.coalesce("s.before", "total").alias("upto"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "owned")


def ends(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of every node where a member ends."""
    order = [*NODE, "conv_id"]
    last = rows.where("depth = size").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            new = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0))) if len(cols[0]) else []
            starts = np.unique(np.concatenate([new, np.arange(0, len(cols[0]), chunk)])).astype(np.int64)
            ids = cols[3].tolist()
            texts = [",".join(map(str, ids[i:j])) for i, j in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[starts]) for c in cols], pa.array(texts, pa.string())], names=[*order, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            keys, out = list(zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)), []
            for k, text in zip(keys, b.column(4).to_pylist(), strict=True):
                if k == at:
                    state.update(b"," + text.encode())
                    continue
                if at:
                    out.append((*at, state.hexdigest()))
                at, state = k, hashlib.sha256(text.encode())
            yield named(out)
        if at:
            yield named([(*at, state.hexdigest())])

    def named(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])

    texts = last.mapInArrow(joined, ", ".join(f"{c} long" for c in order) + ", ids string")
    return texts.repartition(*NODE).sortWithinPartitions(*order).mapInArrow(hashed, ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string")


def trie(spark: SparkSession, conversations: DataFrame, block: int = BLOCK, heavy: int = HEAVY, chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id (owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; ``conversations`` must be a file scan."""
    rows = paths(spark, conversations, block)
    own = owned(spark, rows).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("size", block)))).drop("size")
    members = rows.withColumn("part", F.shiftright("depth", block)).join(own, ["conv_id", "part"])
    below = (F.col("depth") + 1 >= F.col("start")) & (F.col("depth") < F.col("size"))
    saved = F.when(F.coalesce(F.col("depth") < F.col("start"), F.lit(True)), F.col("upto") - F.col("before")).otherwise(0)
    nodes = members.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "start")).alias("owner"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(F.coalesce(below.cast("long"), F.lit(0))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
    )
    nodes = stored(spark, nodes, "nodes").withColumn("conv_id", F.col("owner.conv_id"))
    n = nodes.count()
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") > n // heavy  # no more than ``heavy`` nodes
    firsts = nodes.where("depth > 0 and depth = owner.start").select(*NODE, "p1", "p2")
    link = ["depth", "p1", "p2"]
    top = firsts.join(F.broadcast(above.where(many).drop("n_children")), link).select(*NODE, "parent_conv_id")
    rest = firsts.join(F.broadcast(above.where(many).select(*link)), link, "left_anti").join(above.where(~many).drop("n_children").hint("shuffle_merge"), link).select(*NODE, "parent_conv_id")
    parents = top.unionByName(rest)
    whole = nodes.join(parents, NODE, "left").join(ends(rows, chunk), NODE, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    return whole.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark, table(spark, sf_dir, "conversations"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE = {
    "op11_prefix_trie": r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS t),
o AS (SELECT conv_id AS c, words, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest) AS p FROM (
  SELECT conv_id, turn, coalesce(role, '') AS role, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n, c - c % 20 AS base,
  xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda s: ord(s)::BIGINT)),
    lambda x, s: xor(x // 256, t[xor(x % 256, s) + 1])), 4294967295) % 4 AS h FROM o, crc GROUP BY c, t),
k AS (SELECT n.c, n.h, n.base, n.n, least(n.h, coalesce(b.n, 0)) AS k FROM n LEFT JOIN n b ON b.c = n.base),
r AS (SELECT k.c, o.p AS d, digest, words FROM k JOIN o ON o.c = k.base WHERE o.p <= k.k
  UNION ALL SELECT k.c, k.k + o.p - k.h, digest, words FROM k JOIN o ON o.c = k.c WHERE o.p > k.h),
p AS (SELECT c, d, words, string_agg(digest, '') OVER (PARTITION BY c ORDER BY d) AS key FROM r UNION ALL SELECT c, 0, 0, '' FROM k),
m AS (SELECT c, d, words, sha256(key) AS key, max(d) OVER (PARTITION BY c) AS size FROM p),
x AS (SELECT d, key, min(c) AS c, count(*) AS n_convs, min(words) AS words, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = size) AS ends FROM m GROUP BY d, key),
a AS (SELECT x.c, x.d, m.key AS above FROM x JOIN m ON m.c = x.c AND m.d = x.d - 1),
kids AS (SELECT a.d - 1 AS d, above AS key, count(*) AS n_children FROM a GROUP BY ALL),
y AS (SELECT x.*, coalesce(n_children, 0) AS n_children FROM x LEFT JOIN kids USING (d, key)),
s AS (SELECT m.d, m.key, sum((y.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((y.n_convs - 1) * y.words)::BIGINT AS saved_tokens FROM y JOIN m ON m.c = y.c AND m.d <= y.d GROUP BY ALL)
SELECT y.c AS conv_id, y.d::BIGINT AS depth, u.c AS parent_conv_id, y.n_convs::BIGINT AS n_convs, y.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(y.ends, '')) AS ends_sha256
FROM y JOIN s USING (d, key) LEFT JOIN a ON a.c = y.c AND a.d = y.d LEFT JOIN x u ON u.d = y.d - 1 AND u.key = a.above""",
}
