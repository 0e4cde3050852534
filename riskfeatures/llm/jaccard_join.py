"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of word shingles (64-bit hashes).  A global order of shingles,
rarest first, makes similar documents share rare shingles early: two sets with
the wanted similarity share at least ``l`` of the first ``n - need(n) + l``
shingles for every ``l``.  The plan:

1. Rarity.  ``order = (class, frequency, hash)``.  Class 0 is the part of the
   hash space that nearly every prefix lies in; its frequencies are exact counts
   over all documents.  (Small documents count their class 1 shingles too.)
   Blocks of documents send their distinct shingles, packed by hash range, and
   get back those that occur in several documents, with their frequency.
2. Prefixes.  Each block orders its documents' shingles and emits the prefix
   shingles that another document asked for as well.  Equal sets become one
   node (its copies are never paired).
3. Adaptive length.  Per node the estimated candidate cost (sum of posting-list
   lengths for scanning, divided by ``l`` for verification) picks ``l`` in 1..4:
   a longer prefix, that many more shared shingles before a pair is verified.
4. Hubs first.  Every node is verified against the hub of its size that it shares
   most prefix shingles with, and once more those left over among themselves; linked
   nodes form components.  Then all remaining candidates
   in different components are paired by prefix, size and position filters and
   verified.  Pairs inside a component are never enumerated, so a group of near
   copies costs its size, not its square; no link between components is lost.

A document's ``component`` is exact.  Texts, sets, postings, links and labels
stay distributed; written tables cut the lineage.  Hot shingles are joined as
sort-merge joins that adaptive execution splits; nothing is broadcast by hand.

Defined results: a null or empty text has the empty set and links with nothing;
ids may be null or repeated (rows are told apart by a row number of their own;
a component's id is its smallest non-null id); an empty table gives an empty
result; other columns take no part, and ``drop_near_copies`` keeps them all.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, key_column, map_arrow, stored
from .components import components
from .wordhash import parts, shingle_sets

MAX_L = 4        # longest extension of a prefix
SMALL = 64       # sets up to this size count all their shingles
VERIFY = 8       # cost of verifying a candidate, in scanned postings
FLUSH = 4 << 20  # shingles that a task gathers before it sends them
BITS = [f"bits{i}" for i in range(4)]
BLOCK_BITS = 11  # 2048 consecutive rows of a task are a block


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any similar set."""
    return -(-percent * n // 100)


def _longest(n: int, percent: int) -> int:
    """Length of the longest prefix."""
    return n - _need(n, percent) + min(MAX_L, _need(n, percent))


def _common(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Class 0: the share of the hash space that prefixes are sought in first."""
    share = min(256, int(256 * 2.5 * (100 - percent) / 100) + 1)
    return (tokens & np.uint64(255)) < share


def _asked(s: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles whose frequency a document needs, and what it adds to each."""
    low = _common(s, percent)
    if len(s) <= SMALL:
        return s, np.ones(len(s), np.int32)
    if low.sum() >= _longest(len(s), percent):
        return s[low], np.ones(int(low.sum()), np.int32)
    return s, low.astype(np.int32)


def _requests(batches, size: int, percent: int, bits: int):
    block, toks, adds, held = None, [], [], 0

    def flush():
        t, a = np.concatenate(toks), np.concatenate(adds)
        by = np.argsort(t, kind="stable")
        t, a = t[by], a[by]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        u, seen, add = t[head], np.diff(np.append(head, len(t))).astype(np.int32), np.add.reduceat(a, head).astype(np.int32)
        bucket = (u >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        offs = pa.array(np.append(cut, len(u)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), block, np.int64)),
             pa.ListArray.from_arrays(offs, pa.array(u.view(np.int64))), pa.ListArray.from_arrays(offs, pa.array(seen)),
             pa.ListArray.from_arrays(offs, pa.array(add))], names=["bucket", "block", "tokens", "seen", "adds"])

    for b in batches:
        blocks, text = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        for start, stop in parts(text):
            for i, s in enumerate(shingle_sets(text.slice(start, stop - start), size), start):
                if toks and (blocks[i] != block or held > FLUSH):
                    yield flush()
                    toks, adds, held = [], [], 0
                block = blocks[i]
                if len(s):
                    t, a = _asked(s, percent)
                    toks.append(t)
                    adds.append(a)
                    held += len(t)
    if toks:
        yield flush()


def _lists(column: pa.Array, kind) -> list[np.ndarray]:
    offs = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return [values[s:e] for s, e in zip(offs[:-1], offs[1:])]


def _replies(batches):
    """Rows come sorted by bucket; per bucket, every block gets its shingles that
    several documents asked for, with their frequency."""
    now, rows = None, []

    def reply():
        t = np.concatenate([r[1] for r in rows])
        u, inv = np.unique(t, return_inverse=True)
        seen = np.bincount(inv, np.concatenate([r[2] for r in rows])) >= 2
        freq = np.bincount(inv, np.concatenate([r[3] for r in rows])).astype(np.int32)
        at, blocks, out, f = 0, [], [], []
        for block, own, *_ in rows:
            k = inv[at:at + len(own)]
            at += len(own)
            m = seen[k]
            if m.any():
                blocks.append(block)
                out.append(own[m].view(np.int64))
                f.append(freq[k[m]])
        offs = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
        flat = lambda xs, kind: pa.array(np.concatenate(xs) if xs else np.zeros(0, kind))
        return pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.ListArray.from_arrays(offs, flat(out, np.int64)), pa.ListArray.from_arrays(offs, flat(f, np.int32))],
            names=["block", "tokens", "freq"])

    for b in batches:
        for bucket, block, t, seen, adds in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _lists(b.column(2), np.int64),
                                                _lists(b.column(3), np.int32), _lists(b.column(4), np.int32)):
            if rows and bucket != now:
                yield reply()
                rows = []
            now = bucket
            rows.append((block, t.view(np.uint64), seen, adds))
    if rows:
        yield reply()


def _prefixes(batches, size: int, percent: int):
    """Rows come sorted by block, a block's replies before its documents."""
    now, got, table, freq = None, [], np.zeros(0, np.uint64), np.zeros(0, np.int32)
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        blocks, kinds = col["block"].to_numpy(zero_copy_only=False), col["kind"].to_numpy(zero_copy_only=False)
        toks, freqs = _lists(col["tokens"], np.int64), _lists(col["freq"], np.int32)
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])]))
        for s, e in zip(edges, np.append(edges[1:], len(blocks))):
            if blocks[s] != now:
                now, got, table, freq = blocks[s], [], np.zeros(0, np.uint64), np.zeros(0, np.int32)
            if kinds[s] == 0:
                got += list(zip(toks[s:e], freqs[s:e]))
                continue
            if got:
                table, freq = np.concatenate([x[0] for x in got]).view(np.uint64), np.concatenate([x[1] for x in got])
                by = np.argsort(table, kind="stable")
                table, freq, got = table[by], freq[by], []
            text = col["text"].slice(s, e - s)
            for start, stop in parts(text):
                sets = shingle_sets(text.slice(start, stop - start), size)
                posts = [_posting(x, table, freq, percent) for x in sets]
                rows = slice(s + start, s + stop)
                yield pa.RecordBatch.from_arrays([
                    col["rid"].slice(rows.start, len(sets)), col["doc_id"].slice(rows.start, len(sets)),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    pa.array([p[0].view(np.int64) for p in posts], pa.list_(pa.int64())),
                    pa.array([p[1] for p in posts], pa.list_(pa.int32())),
                    pa.array([_parities(x) if len(p[0]) else None for x, p in zip(sets, posts)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if len(p[0]) else None for x, p in zip(sets, posts)], pa.binary())],
                    names=["rid", "doc_id", "n", "fp", "tokens", "places", "parities", "members"])


def _parities(s: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the number of members that fall on it: two sets
    differ in at least as many members as their bits differ."""
    return np.packbits(np.bincount((s >> np.uint64(8) & np.uint64(255)).astype(np.int64), minlength=256) & 1).view(np.int64)


def _posting(s: np.ndarray, table: np.ndarray, freq: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix shingles that some other document asked for, and their places in the order."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if not len(s) or not len(table):
        return none
    t, own = _asked(s, percent)
    at = np.minimum(np.searchsorted(table, t), len(table) - 1)
    shared = table[at] == t
    if not shared.any():
        return none
    f = np.where(shared, freq[at], own).astype(np.int64)
    order = np.argsort(f + (np.int64(1) << 40) * ~_common(t, percent), kind="stable")[:_longest(len(s), percent)]
    places = np.flatnonzero(shared[order]).astype(np.int32)
    return t[order[places]], places


def _verified(batches, percent: int):
    for b in batches:
        x, y = b.column(2), b.column(3)
        keep = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
            n = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * n >= percent * (len(p) + len(q) - n))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are similar."""
    x = members.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = members.select(F.col("node").alias("b"), F.col("members").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return stored(map_arrow(both, partial(_verified, percent=percent), "a long, b long"), "links")


def _sets(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Steps 1 and 2 on ``rows`` (``rid``, ``doc_id``, ``block``, ``text``)."""
    bits = max(2, (4 * rows.rdd.getNumPartitions() - 1).bit_length())
    asked = map_arrow(
        rows.select("block", "text"), partial(_requests, size=size, percent=percent, bits=bits),
        "bucket int, block long, tokens array<long>, seen array<int>, adds array<int>")
    replies = map_arrow(
        asked.repartition("bucket").sortWithinPartitions("bucket"), _replies, "block long, tokens array<long>, freq array<int>")
    none = lambda kind: F.lit(None).cast(kind)
    kind = rows.schema["doc_id"].dataType.simpleString()
    empty = F.array().cast("array<long>"), F.array().cast("array<int>")
    mixed = replies.select("block", F.lit(0).alias("kind"), "tokens", "freq", none("long").alias("rid"),
                           none(kind).alias("doc_id"), none("string").alias("text")).union(
        rows.select("block", F.lit(1).alias("kind"), empty[0].alias("tokens"), empty[1].alias("freq"), "rid", "doc_id", "text"))
    out = map_arrow(
        mixed.repartition("block").sortWithinPartitions("block", "kind"), partial(_prefixes, size=size, percent=percent),
        f"rid long, doc_id {kind}, n long, fp binary, tokens array<long>, places array<int>, parities array<long>, members binary")
    return stored(out, "sets")


def _stars(posts: DataFrame) -> DataFrame:
    """Every node with the hub it shares most prefix shingles with; a shingle's hub in
    a size class is the node whose prefix is the most common there."""
    hubs = posts.groupBy("token", "size").agg(F.max(F.struct("score", -F.col("node"))).alias("h")).select(
        "token", "size", (-F.col("h.col2")).alias("b"))
    near = posts.join(hubs, ["token", "size"]).where("node <> b").groupBy("node", "b").agg(F.count("*").alias("c"))
    return near.groupBy("node").agg(F.max(F.struct("c", -F.col("b"))).alias("h")).select(
        F.col("node").alias("a"), (-F.col("h.col2")).alias("b"))


def _candidates(posts: DataFrame, prefixes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Step 4: pairs of nodes in different components that pass every filter.

    The first shingle that two similar sets share lies in both shortest prefixes and
    leaves enough of either set behind it, and their parity bits differ in no more
    places than the sets may; pairs that share such a shingle must then
    share ``l`` shingles of their longer prefixes, and one more for each by which
    the overlap they need exceeds the one their prefixes were made for."""
    posts = posts.where("level = 1").select("token", "node", "n", "place", *BITS).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = posts.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("k")).where("k > 1").select("token", F.col("m.comp").alias("major"))
    posts = posts.join(groups, "token").withColumn("minor", F.col("comp") != F.col("major"))
    x, y = posts.where("minor").alias("x"), posts.alias("y")
    overlap = f"({percent} * (a_.n + b_.n) + {99 + percent}) div {100 + percent}"
    differ = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in BITS)
    rest = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp"))
                   & (~F.col("y.minor") | (F.col("x.node") < F.col("y.node")))
                   & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
                   & ((100 + percent) * rest >= percent * (F.col("x.n") + F.col("y.n")))
                   & (F.expr(differ) <= F.col("x.n") + F.col("y.n") - 2 * F.expr(overlap.replace("a_", "x").replace("b_", "y"))))
    pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    side = lambda v: prefixes.select(F.col("node").alias(v), F.struct("n", "need", "l", "prefix").alias(f"{v}_"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("l", F.least("a_.l", "b_.l"))
    within = lambda v: F.transform(F.filter(F.col(f"{v}_.prefix"), lambda t: t["level"] <= F.col("l")), lambda t: t["token"])
    enough = F.col("l") + F.greatest(F.lit(0), F.expr(overlap) - F.greatest("a_.need", "b_.need"))
    return both.where(F.size(F.array_intersect(within("a"), within("b"))) >= enough).select("a", "b")


def _choose(costs: list[Column]) -> Column:
    best, at = costs[0], F.lit(1)
    for i, c in enumerate(costs[1:], 2):
        at, best = F.when(c < best, i).otherwise(at), F.least(best, c)
    return at


def similar(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(rows, result)``: ``rows`` is the stored input with its row number ``rid``
    (and ``block``); ``result`` has ``rid``, ``doc_id``, ``n_shingles`` and ``comp``,
    the component's smallest ``rid``, for every row."""
    rid, block = key_column(docs, "rid"), key_column(docs, "block")
    number = F.monotonically_increasing_id()
    rows = stored(docs.select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(rid),
                              F.shiftright(number, BLOCK_BITS).alias(block)), "rows")
    sets = _sets(rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id"), F.col(block).alias("block"),
                             F.col(text_col).alias("text")), size, percent)
    shared = sets.where(F.size("tokens") > 0)
    nodes = stored(shared.groupBy("fp", "n").agg(F.min("rid").alias("node")), "nodes")
    own = shared.join(nodes.select("node"), F.col("rid") == F.col("node"))
    bits = [F.col("parities")[i].alias(f"bits{i}") for i in range(4)]
    posts = own.select("node", "n", *bits, F.explode(F.arrays_zip(F.col("tokens"), F.col("places"))).alias("p")).select(
        "node", "n", *BITS, F.col("p.tokens").alias("token"), F.col("p.places").cast("long").alias("place"))
    # sets of one size class are near enough in size to be similar
    posts = posts.withColumn("size", F.floor(F.log("n") / math.log(100 / percent)))
    near = posts.groupBy("token", "size").agg(F.count("*").alias("near"))
    lists = near.groupBy("token").agg(F.sum("near").alias("df")).where("df > 1")
    need = F.expr(f"(n * {percent} + 99) div 100")
    posts = posts.join(lists, "token").join(near, ["token", "size"]).withColumn("need", need)
    posts = posts.withColumn("level", F.greatest(F.lit(1), F.col("place") - (F.col("n") - F.col("need") + 1) + 2))
    node = Window.partitionBy("node")
    sums = [F.sum(F.when(F.col("level") <= i, F.col("df") - 1).otherwise(0)).over(node) for i in range(1, MAX_L + 1)]
    far = F.lit(1e30)
    costs = [F.when(F.col("need") >= i, F.col(f"s{i}") * (1 + VERIFY / i)).otherwise(far) for i in range(1, MAX_L + 1)]
    posts = posts.select("*", *[c.alias(f"s{i}") for i, c in enumerate(sums, 1)], F.sum("near").over(node).alias("score"))
    posts = posts.withColumn("l", _choose(costs).cast("long")).where("level <= l")
    posts = stored(posts.select("node", "n", "need", "size", *BITS, "token", "place", "level", "l", "score"), "postings")
    members = shared.select(F.col("rid").alias("node"), "members")

    links = _verify(_stars(posts), members, percent)
    linked = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    again = _verify(_stars(posts.join(linked, "node", "left_anti")), members, percent)
    comps = components(links.union(again))
    prefixes = stored(posts.groupBy("node").agg(F.first("n").alias("n"), F.first("need").alias("need"), F.first("l").alias("l"),
                                                F.collect_list(F.struct("level", "token")).alias("prefix")), "prefixes")
    more = _verify(_candidates(posts, prefixes, comps, percent), members, percent)
    comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    of_set = nodes.join(comps, "node", "left").select("fp", "n", F.coalesce("comp", "node").alias("comp"))
    alone = sets.where(F.size("tokens") == 0).select("rid", "doc_id", F.col("n").alias("n_shingles"), F.col("rid").alias("comp"))
    linked = shared.select("rid", "doc_id", "n", "fp").join(of_set, ["fp", "n"]).select(
        "rid", "doc_id", F.col("n").alias("n_shingles"), "comp")
    result = stored(alone.union(linked), "similar")
    forget(sets, nodes, posts, prefixes, links, again, more)
    return rows, result


def similar_documents(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, ``n_shingles`` and ``component_id``: the smallest id
    reachable over links (``100 * intersection >= percent * union``)."""
    rows, result = similar(docs.select(id_col, text_col), size, percent, id_col, text_col)
    forget(rows)
    ids = result.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return result.join(ids, "comp").select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id."""
    rows, result = similar(docs, size, percent, id_col, text_col)
    rid = rows.columns[len(docs.columns)]
    keep = key_column(rows, "keep")
    first = result.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("f")).select(F.col("f.rid").alias(keep))
    return rows.join(first, F.col(rid) == F.col(keep), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
