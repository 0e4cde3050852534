"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector falls on every filter whose cosine with it exceeds
``cap``.  Vectors with a high cosine fall on common filters far more often than others.
The plan:

1. Filters.  ``codes`` structured random product codes: after a random rotation the
   space is cut into ``blocks`` equal blocks with ``size`` random unit words each; a
   filter is one word per block, so ``size ** blocks`` directions of a code come from
   ``size * blocks`` stored words.  All codes follow from a seed and the dimension.
2. List decoding.  A vector's scores against the words of every block give all
   filters beyond the cap: block by block, those partial sums go on that the best
   words of the blocks left could still lift over it.
3. Joining.  Rows with the same label and the same components are one node.  Nodes
   that share (label, filter) form a bucket; buckets of one node end there.  A bucket is
   cut into pieces of about ``PIECE`` nodes by a hash, and every two pieces (and each
   piece with itself) are compared in one task's matrix product, so no task holds a
   large bucket and no pair becomes a row.
4. Verification.  Cosines are exact, in double precision.  A pair that shares several
   filters counts in the bucket of the least one only.  A comparison returns per
   node the number of rows linked to it and the smallest node it is connected to there;
   those edges span all links, and contraction gives the components.

The number of filters a vector falls on hardly depends on the dimension: ``cap`` is that for
64 dimensions; with more of them the cap of equal share of the sphere is taken, with
fewer the codes get fewer words.

Recall: a pair that shares no filter is missed, nothing else; links found are exact.
With the default parameters random unit vectors of 64 dimensions at a cosine of exactly
0.93 share a filter in 98 % of cases (measured in the tests; more at higher cosines), for
about 30 filters a vector.

Defined results: a null label or embedding, one without components, with null or
non-finite components, or of norm 0 links with nothing; vectors of different lengths do
not link; ids may be null or repeated (rows are told apart by a number of their own; a
component's id is its smallest non-null id); an empty table gives an empty result;
other columns take no part.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, map_arrow, stored
from .components import components

BLOCKS, SIZE, CODES, CAP = 2, 256, 8, 0.46
DIM = 64          # dimension that the cap is given for
PIECE = 1024      # nodes of a piece
ROWS = 512        # vectors decoded at a time


def _share(dim: int, cap: float) -> float:
    """Share of the unit sphere within ``cap`` of a direction."""
    if dim == 1:
        return 0.5
    angle = (np.arange(200_000) + 0.5) * np.pi / 200_000
    weight = np.sin(angle) ** (dim - 2)
    return float(weight[angle <= np.arccos(cap)].sum() / weight.sum())


@lru_cache(maxsize=64)
def _sized(dim: int, blocks: int, size: int, cap: float) -> tuple[int, int, float]:
    """Blocks, words and cap for vectors of ``dim`` components."""
    share, blocks = _share(DIM, cap), min(blocks, dim)
    if dim <= DIM:
        return blocks, min(size, max(1, int(np.ceil(size * (share / _share(dim, cap)) ** (1 / blocks))))), cap
    low, high = 0.0, cap
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (mid, high) if _share(dim, mid) > share else (low, mid)
    return blocks, size, low


@lru_cache(maxsize=8)
def _codes(dim: int, blocks: int, size: int, codes: int, seed: int):
    """Per code its rotation and the words of its blocks (over the square root of their number)."""
    rng = np.random.default_rng([seed, dim])
    cut = [dim * i // blocks for i in range(blocks + 1)]
    out = []
    for _ in range(codes):
        rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        words = [rng.normal(size=(size, e - s)) for s, e in zip(cut, cut[1:])]
        out.append((rotation, [w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300) / np.sqrt(blocks) for w in words]))
    return cut, out


def exceeding(x: np.ndarray, blocks: int = BLOCKS, size: int = SIZE, codes: int = CODES, cap: float = CAP, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` for all filters beyond the cap of the unit vectors ``x``."""
    blocks, size, cap = _sized(x.shape[1], blocks, size, cap)
    cut, all_codes = _codes(x.shape[1], blocks, size, codes, seed)
    rows, filters = [], []
    for c, (rotation, words) in enumerate(all_codes):
        turned = x @ rotation
        scores = [turned[:, s:e] @ w.T for s, e, w in zip(cut, cut[1:], words)]
        best = np.zeros((blocks + 1, len(x)))
        for i in range(blocks - 1, -1, -1):
            best[i] = best[i + 1] + scores[i].max(1)
        row, code, total = np.flatnonzero(best[0] >= cap), None, None
        code, total = np.full(len(row), c), np.zeros(len(row))
        for i, s in enumerate(scores):
            sums = total[:, None] + s[row]
            at, word = np.nonzero(sums + best[i + 1][row][:, None] >= cap)
            row, code, total = row[at], code[at] * size + word, sums[at, word]
        rows.append(row)
        filters.append(code)
    row, code = np.concatenate(rows), np.concatenate(filters)
    by = np.lexsort((code, row))
    return row[by], code[by]


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    """Unit vectors, in double precision, of lists of one length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(batches, **code):
    for b in batches:
        dims = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            of_dim = np.flatnonzero(dims == dim)
            for lo in range(0, len(of_dim), ROWS):
                some = b.take(pa.array(of_dim[lo:lo + ROWS]))
                row, found = exceeding(_matrix(some.column(1), len(some)), **code)
                at = np.append(0, np.cumsum(np.bincount(row, minlength=len(some)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(found))], names=["node", "filters"])


def _side(piece: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, row counts, unit vectors, and the filters with their nodes' places, of one piece."""
    node, copies = (piece.field(n).to_numpy(zero_copy_only=False) for n in ("node", "copies"))
    filters = piece.field("filters")
    return (node, copies, _matrix(piece.field("vector"), len(node)), filters.flatten().to_numpy(),
            np.repeat(np.arange(len(node)), filters.value_lengths().to_numpy()))


def _spread(links: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node connected to every row and column of a table of links."""
    low, high = low.copy(), high.copy()
    far = np.iinfo(np.int64).max
    while True:
        a = np.minimum(low, np.where(links, high[None], far).min(1))
        b = np.minimum(high, np.where(links, a[:, None], far).min(0))
        if (a == low).all() and (b == high).all():
            return a, b
        low, high = a, b


def _compared(batches, least: float):
    """Rows are two pieces of a bucket (or one twice): per node its links there that no
    smaller common filter has, and the smallest node connected to it there."""
    for b in batches:
        ours, left, right = b.column(0).to_numpy(), b.column(1), b.column(2)
        for i, f in enumerate(ours):
            x, y = left[i].values, right[i].values
            (n, c, v, fs, at), (m, d, w, gs, to) = _side(x), _side(y)
            links = v @ w.T >= least
            same = n[:, None] == m[None]
            links &= ~same
            if not links.any():
                continue
            p, q = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
            links = links[np.ix_(p, q)]
            own = np.zeros(len(n), np.int64)
            own[p] = np.arange(len(p)) + 1
            its = np.zeros(len(m), np.int64)
            its[q] = np.arange(len(q)) + 1
            a, e = (own[at] > 0) & (fs < f), (its[to] > 0) & (gs < f)
            # the smaller filters that both sides have: pairs that share one were counted there
            common = np.intersect1d(fs[a], gs[e])
            first = np.ones(links.shape, bool)
            for lo in range(0, len(common), 2048):
                some = common[lo:lo + 2048]
                k, l = np.zeros((len(p), len(some)), np.float32), np.zeros((len(q), len(some)), np.float32)  # noqa: E741
                z, u = a & np.isin(fs, some), e & np.isin(gs, some)
                k[own[at[z]] - 1, np.searchsorted(some, fs[z])] = 1
                l[its[to[u]] - 1, np.searchsorted(some, gs[u])] = 1
                first &= k @ l.T < 0.5
            new = links & first
            of_n, of_m = new @ d[q], c[p] @ new
            low, high = _spread(links, n[p], m[q])
            if n[0] == m[0] and len(n) == len(m) and (n == m).all():
                of_m, high, q, m = of_m[:0], high[:0], q[:0], m
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([n[p], m[q]])), pa.array(np.concatenate([of_n, of_m]).astype(np.int64)),
                 pa.array(np.concatenate([low, high]))], names=["node", "links", "to"])


def near_vectors(vectors: DataFrame, cosine: float = 0.93, blocks: int = BLOCKS, size: int = SIZE, codes: int = CODES, cap: float = CAP, seed: int = 1,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row its id, ``n_links`` (other rows linked directly), ``component_id`` and ``kept``."""
    vector = F.col(vector_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce(F.col(label_col).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                                 vector.alias("vector"), sound.alias("sound")), "vectors")
    nodes = stored(rows.where("sound").groupBy("label", "vector").agg(F.min("rid").alias("node"), F.count("*").alias("copies")), "vector-nodes")
    lists = stored(map_arrow(nodes.select("node", "vector"), partial(_decoded, blocks=blocks, size=size, codes=codes, cap=cap, seed=seed),
                             "node long, filters array<long>"), "vector-filters")
    whole = nodes.join(lists, "node").withColumn("dim", F.size("vector"))
    posts = whole.select("label", "dim", "node", F.explode("filters").alias("filter"))
    key = ["label", "dim", "filter"]
    buckets = stored(posts.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")),
                     "vector-buckets")
    # vectors go only where a bucket has another node
    met = posts.join(buckets, key).select(*key, "node", "pieces", F.pmod(F.xxhash64("node"), "pieces").cast("int").alias("piece"))
    pieces = met.join(whole.select("node", "copies", "vector", "filters"), "node").groupBy(*key, "pieces", "piece").agg(
        F.collect_list(F.struct("node", "copies", "vector", "filters")).alias("held"))
    pieces = stored(pieces, "vector-pieces")
    x = pieces.select(*key, "piece", F.col("held").alias("x"), F.explode(F.sequence(F.col("piece"), F.col("pieces") - 1)).alias("other"))
    y = pieces.select(*key, F.col("piece").alias("other"), F.col("held").alias("y"))
    units = x.where("piece < other").join(y, [*key, "other"]).select("filter", "x", "y").union(
        pieces.select("filter", F.col("held").alias("x"), F.col("held").alias("y")))
    found = stored(map_arrow(units, partial(_compared, least=cosine), "node long, links long, to long"), "vector-links")
    forget(buckets, pieces, lists)
    comps = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    of_node = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(comps, "node", "left")
    of_node = of_node.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp"))
    linked = rows.where("sound").join(of_node, ["label", "vector"]).select("rid", "vec_id", "n_links", "comp")
    alone = rows.where("not sound").select("rid", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("rid").alias("comp"))
    out = stored(linked.union(alone), "vector-result")
    forget(rows, nodes, found)
    ids = out.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    return out.join(ids, "comp").select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
