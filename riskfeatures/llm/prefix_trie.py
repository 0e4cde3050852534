"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; conversations that start with it are its
members.  The plan:

1. Places.  One range-partitioned sort by (conversation, turn, hash of role and text)
   numbers all turns; a turn's place is its number less its conversation's first.  A
   conversation of any length spreads over many tasks.
2. Nodes.  A turn's contribution is two 64-bit hashes of its depth, role and text; the
   sum of those up to a turn (in halves, so it is exact) names the prefix.  Sums run
   over blocks of 1,024 turns, then inside them.  Grouping by the name, pre-aggregated,
   gives members, smallest member and parent's name.
3. Arcs.  Another range-partitioned sort by parent numbers the nodes, so siblings
   are consecutive and the children of a node of any degree spread over many tasks.  A
   node's enter arc leads to its first child's enter arc, or to its own exit arc; its
   exit arc to the next sibling's enter arc, or to the parent's exit arc.
4. List ranking.  Arcs know both neighbours.  Every round takes out the arcs whose
   hash is less than both neighbours' (a third of them, never two in a row) and hands
   their weights on, until at most ``FEW`` arcs are left, which one task sums up; then
   the rounds are undone in reverse, each removed arc adding its successor's sum.
   All rounds together move a constant times the arcs.
5. Sums.  The weights are one per leaf and the saved tokens per node, on enter arcs:
   a subtree's total is the difference of the sums at a node's two arcs.

Digests of the conversations that end at a node stream their sorted ids in packed
pieces, so that a node where very many end needs no list of them.

Defined results: rows without a conversation id take no part; turns are ordered null
first, equal turn numbers by a hash of role and text, and repeated rows are turns of
their own; a null role or text is empty; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, map_arrow, stored

BLOCK = 10       # 1024 consecutive turns are a block
FEW = 1 << 16    # arcs that one task ranks (a few megabytes)
PIECE = 12       # 4096 consecutive ids are packed into one piece
NAME = ["s1", "s2", "s3", "s4"]


def _numbered(df: DataFrame, *keys: Column, name: str) -> DataFrame:
    """``df`` stored with ``part`` and ``at``: the range partition of the order by ``keys`` and the row's place in it."""
    parts = max(2, df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    number = F.monotonically_increasing_id()
    return stored(out.select("*", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), name)


def _ranked(numbered: DataFrame) -> DataFrame:
    """``rank`` over all partitions from the partitions' row counts (one row a partition)."""
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    offsets = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return numbered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("at")).drop("part", "at", "offset")


def places(turns: DataFrame) -> DataFrame:
    """``conv``, ``place`` (from 1), ``h1``, ``h2`` (hashes of role and text) and ``bytes`` of the text, per turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashed = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("turn"), text, role).alias("h2"), F.octet_length(text).cast("long").alias("bytes"))
    # equal rows are interchangeable; the input row number only spreads them
    hashed = hashed.withColumn("row", F.monotonically_increasing_id())
    numbered = _numbered(hashed, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("row"), name="trie-turns")
    ranked = _ranked(numbered)
    first = ranked.groupBy("conv").agg(F.min("rank").alias("first"))
    out = stored(ranked.join(first, "conv").select("conv", (F.col("rank") - F.col("first") + 1).alias("place"), "h1", "h2", "bytes"), "trie-places")
    forget(numbered)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first ``h`` turns of conversation ``c - c % 5``, then
    ``c``'s own after its first ``h``.  Returns turns by ``place`` and conversations with their ``length``."""
    convs = turns.groupBy("conv").agg(F.count("*").alias("n")).select(
        "conv", "n", (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv") - F.pmod("conv", F.lit(5))).alias("base"))
    of_base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(of_base, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head"), F.greatest(F.lit(0), F.col("n") - F.col("h")).alias("tail")), "trie-convs")
    heads = turns.where("place <= 8").withColumnRenamed("conv", "base")
    heads = heads.join(convs, "base").where("place <= head").select("conv", "place", "h1", "h2", "bytes")
    tails = turns.join(convs.select("conv", "h", "head"), "conv").where("place > h").select(
        "conv", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "h1", "h2", "bytes")
    return heads.union(tails), convs.select("conv", (F.col("head") + F.col("tail")).alias("length"))


def _names(turns: DataFrame) -> DataFrame:
    """Per turn the name of the prefix that it ends (``s1``..``s4``) and of the one before it (``p1``..``p4``)."""
    low = F.lit((1 << 32) - 1)
    x, y = F.xxhash64("place", "h1", "h2"), F.xxhash64("h2", "place", "h1")
    halves = [F.shiftrightunsigned(x, 32), x.bitwiseAND(low), F.shiftrightunsigned(y, 32), y.bitwiseAND(low)]
    own = turns.select("conv", "place", "bytes", F.shiftright("place", BLOCK).alias("block"), *[h.alias(f"x{i}") for i, h in enumerate(halves)])
    sums = own.groupBy("conv", "block").agg(*[F.sum(f"x{i}").alias(f"b{i}") for i in range(4)])
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "block", *[F.coalesce(F.sum(f"b{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(4)])
    upto = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = own.select("conv", "block", "place", "bytes", *[f"x{i}" for i in range(4)], *[F.sum(f"x{i}").over(upto).alias(f"r{i}") for i in range(4)])
    run = run.join(sums, ["conv", "block"])
    return run.select("conv", F.col("place").alias("depth"), "bytes", *[(F.col(f"b{i}") + F.col(f"r{i}")).alias(NAME[i]) for i in range(4)],
                      *[(F.col(f"b{i}") + F.col(f"r{i}") - F.col(f"x{i}")).alias(f"p{i + 1}") for i in range(4)])


def _last(arcs: DataFrame) -> DataFrame:
    """Sums from every arc to the end of the tour, of at most ``FEW`` arcs, in one task."""
    def ranked(batches):
        if not (got := list(batches)):
            return
        got = pa.Table.from_batches(got)
        ids, after, *weights = (got[c].to_numpy() for c in ("arc", "next", "w1", "w2"))
        row, sums = {a: i for i, a in enumerate(ids.tolist())}, np.zeros((2, len(ids)), np.int64)
        before = {a: i for i, a in enumerate(after.tolist())}
        i, total = before.get(-1), [0, 0]
        while i is not None:
            for k in range(2):
                total[k] += int(weights[k][i])
                sums[k, i] = total[k]
            i = before.get(int(ids[i]))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums[0]), pa.array(sums[1])], names=["arc", "t1", "t2"])
    return stored(map_arrow(arcs.select("arc", "next", "w1", "w2").coalesce(1), ranked, "arc long, t1 long, t2 long"), "trie-sums")


def list_rank(arcs: DataFrame) -> DataFrame:
    """``arcs``: a stored list of ``arc``, ``prev``, ``next`` (-1: none) with weights ``w1``, ``w2``.
    Returns ``arc``, ``t1``, ``t2``: the weights' sums from the arc to the end of the list."""
    undo, n, k = [], arcs.count(), 0
    while n > FEW:
        key = lambda c, k=k: F.xxhash64(F.lit(k), F.col(c))
        out = (F.col("prev") >= 0) & (F.col("next") >= 0) & (key("arc") < key("prev")) & (key("arc") < key("next"))
        marked = arcs.withColumn("out", out)
        # a removed arc tells its neighbours what they have next to them now
        told = marked.where("out").select(F.explode(F.array(
            F.struct(F.col("prev").alias("arc"), F.lit(None).cast("long").alias("prev"), F.col("next").alias("next"), "w1", "w2"),
            F.struct(F.col("next").alias("arc"), F.col("prev").alias("prev"), F.lit(None).cast("long").alias("next"),
                     F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2")))).alias("m")).select("m.*", F.lit(True).alias("told"))
        stay = marked.where("not out").select("arc", "prev", "next", "w1", "w2", F.lit(False).alias("told"))
        now = lambda c: F.coalesce(F.max(F.when(F.col("told"), F.col(c))), F.max(F.when(~F.col("told"), F.col(c)))).alias(c)
        less = stored(stay.union(told).groupBy("arc").agg(now("prev"), now("next"), F.sum("w1").alias("w1"), F.sum("w2").alias("w2")), "trie-arcs")
        undo.append(stored(marked.where("out").select("arc", "next", "w1", "w2"), "trie-removed"))
        forget(arcs)
        arcs, n, k = less, less.count(), k + 1
    sums = _last(arcs)
    forget(arcs)
    while undo:
        gone = undo.pop()
        back = gone.join(sums.select(F.col("arc").alias("next"), "t1", "t2"), "next").select(
            "arc", (F.col("w1") + F.col("t1")).alias("t1"), (F.col("w2") + F.col("t2")).alias("t2"))
        more = stored(sums.union(back), "trie-sums")
        forget(gone, sums)
        sums = more
    return sums


def _digested(batches):
    """Rows come sorted by node and piece; per node the SHA-256 of its pieces, joined by commas."""
    now, sha = None, None
    for b in batches:
        nodes, digests = [], []
        for node, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if node != now:
                if now is not None:
                    nodes.append(now)
                    digests.append(sha.hexdigest())
                now, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(body.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` from rows ``node``, ``conv``."""
    numbered = _numbered(ends, F.col("node"), F.col("conv"), name="trie-ends")
    pieces = numbered.groupBy("node", "part", F.shiftright("at", PIECE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("body"))
    ordered = pieces.repartition("node").sortWithinPartitions("node", "part", "piece").select("node", "body")
    return map_arrow(ordered, _digested, "node long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (``conv``, ``place`` from 1 without gaps, ``h1``, ``h2``, ``bytes``)
    of the conversations ``convs`` (``conv``, ``length``; those of length 0 are members of the root)."""
    named = stored(_names(turns), "trie-prefixes")
    convs = stored(convs, "trie-lengths")
    nodes = named.groupBy("depth", *NAME).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"),
                                              *[F.first(f"p{i}").alias(f"p{i}") for i in range(1, 5)])
    zero = [F.lit(0).cast("long").alias(c) for c in NAME]
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), *zero, "conv", "n_convs", F.lit(0).cast("long").alias("bytes"),
        *[F.lit(-1).cast("long").alias(f"p{i}") for i in range(1, 5)])
    up = [f"p{i}" for i in range(1, 5)]
    by_parent = _numbered(nodes.select("depth", *NAME, "conv", "n_convs", "bytes", *up).union(root), F.col("depth"), *[F.col(c) for c in up + NAME],
                          name="trie-nodes")
    ranked = stored(_ranked(by_parent).withColumnRenamed("rank", "node"), "trie-ranked")
    forget(by_parent)
    kids = ranked.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(p).alias(s) for p, s in zip(up, NAME)]).agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n_children"))
    parents = stored(ranked.join(kids, ["depth", *NAME], "left"), "trie-children")
    forget(ranked)
    above = parents.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(p) for p, s in zip(up, NAME)], F.col("node").alias("parent"),
                        F.col("conv").alias("parent_conv_id"), F.col("first").alias("oldest"), F.col("last").alias("youngest"))
    full = stored(parents.join(above, ["depth", *up], "left").select(
        "node", "depth", *NAME, "conv", "parent_conv_id", "parent", "oldest", "youngest", "first", "last", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie-full")
    forget(parents)

    enter, exit_ = lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    none, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    leaf, top = F.col("first").isNull(), F.col("parent").isNull()
    enters = F.struct(enter("node").alias("arc"),
                      F.when(top, none).when(F.col("node") == F.col("oldest"), enter("parent")).otherwise(enter("node") - 1).alias("prev"),
                      F.when(leaf, exit_("node")).otherwise(enter("first")).alias("next"), leaf.cast("long").alias("w1"), F.col("saved").alias("w2"))
    exits = F.struct(exit_("node").alias("arc"), F.when(leaf, enter("node")).otherwise(exit_("last")).alias("prev"),
                     F.when(top, none).when(F.col("node") == F.col("youngest"), exit_("parent")).otherwise(exit_("node") + 1).alias("next"),
                     zero.alias("w1"), zero.alias("w2"))
    sums = list_rank(stored(full.select(F.explode(F.array(enters, exits)).alias("a")).select("a.*"), "trie-arcs"))
    sign = F.when(F.col("arc") % 2 == 0, 1).otherwise(-1)
    totals = sums.groupBy(F.shiftright("arc", 1).alias("node")).agg(F.sum(sign * F.col("t1")).alias("n_leaves"), F.sum(sign * F.col("t2")).alias("saved_tokens"))

    last = named.join(convs, "conv").where("depth = length").select("depth", *NAME, F.col("conv").alias("member"))
    last = last.union(convs.where("length = 0").select(F.lit(0).cast("long"), *[F.lit(0).cast("long")] * 4, "conv"))
    ends = _ends(last.join(full.select("depth", *NAME, "node"), ["depth", *NAME]).select("node", F.col("member").alias("conv")))
    out = full.select("node", "conv", "depth", "parent_conv_id", "n_convs", "n_children").join(totals, "node").join(ends, "node", "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = places(conversations)
    return trie(turns, turns.groupBy("conv").agg(F.count("*").alias("length")))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the contract's rebuilt conversations."""
    return trie(*rebuilt(places(conversations)))


_CRC = """list_reduce(list_concat([4294967295], [ord(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor({_CRC}, 4294967295) % 9 AS h, count(*) AS n FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, t.place AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.place <= k.head
      UNION ALL SELECT k.conv_id, t.place - k.h + k.head, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.place > k.h),
s AS (SELECT conv_id, d, text, list(sha256(concat(length(role), ':', role, text))) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM r),
p AS (SELECT conv_id, d, text, sha256(array_to_string(path, '')) AS me, CASE WHEN d = 1 THEN '' ELSE sha256(array_to_string(path[:-2], '')) END AS up FROM s
      UNION ALL SELECT conv_id, 0, '', '', NULL FROM k),
n AS (SELECT me, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(text)) AS saved FROM p GROUP BY me, d),
kids AS (SELECT up, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.me),
-- every node with the nodes above it, by way of its smallest member's prefixes
anc AS (SELECT p.me AS top, f.n_children, f.saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d),
sub AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM anc GROUP BY top),
len AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
ends AS (SELECT p.me, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids FROM p JOIN len USING (conv_id, d) GROUP BY p.me)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM f JOIN sub ON sub.top = f.me LEFT JOIN f u ON u.me = f.up LEFT JOIN ends ON ends.me = f.me
"""
