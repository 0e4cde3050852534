"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical), of at least ``max(least, 2 q)`` words, that no neighbouring
word extends with the same period.  Texts are independent, so the plan is one pass
without a shuffle; inside an Arrow batch, for all its texts at once:

1. Words are numbered exactly (dictionary of their bytes).  Two positions a period
   apart inside a run start with the same ``least / 2`` words, so only stretches
   covered by word windows that occur twice in the same stretch can hold runs;
   narrowing the texts to them, until nothing changes, loses none.
2. Suffix array of the stretches by prefix doubling, every doubling's ranks kept;
   a stretch's symbols are its own, so suffixes of two stretches share no prefix.
   The ranks give the LCP table by halving steps.
3. LCP intervals come from one scan of the LCP table with a stack of open
   intervals.  For an interval of depth ``d`` every suffix ``i`` of all children but
   the largest looks up the ranks of ``i + d`` and ``i - d``: inside the interval, and
   followed by another word, it is a branching square of root length ``d``.  Smaller
   children hold ``n log n`` suffixes in all.
4. The right end of a run is the end of one branching square; rotating the square
   left as long as the words agree gives the run's start (halving steps over the
   kept ranks).  Squares with the same ends are one run, of the least root.

Memory is bounded by a batch's texts (``wordhash.PART`` bytes at a time, or one longer
text).  Defined results: a null or empty text has no words and no runs, and collapses
to the empty text; ids may be null or repeated (one result per row); an empty table
gives an empty result; other columns take no part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, words
from .wordhash import _BLANK, mix, parts

LEAST = 12  # words of the shortest run


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(data, starts, ends, at)``: the bytes, the words' byte ranges, and row ``i``'s words ``at[i]:at[i + 1]``."""
    column = column.fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0]:offs[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    full = ~_BLANK[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    heads = offs[(offs > 0) & (offs < len(data))]
    first[heads] = full[heads]
    last[heads - 1] = full[heads - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, starts, ends, np.searchsorted(starts, offs)


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers, different words different ones."""
    if not len(starts):
        return np.zeros(0, np.int64)
    offs = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(data[~_BLANK[data]])])
    return held.dictionary_encode().indices.to_numpy().astype(np.int64)


def _covered(word: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Positions inside windows of ``width`` words that occur twice in the same group.
    Windows are compared by hashes: a collision covers too much, never too little."""
    n = len(word) - width + 1
    out = np.zeros(len(word) + 1, np.int64)
    if n <= 1:
        return out[:-1] > 0
    factors = mix(np.arange(1, width + 2, dtype=np.uint64)) | np.uint64(1)
    h = group[:n].astype(np.uint64) * factors[width]
    for j in range(width):
        h += mix(word[j:n + j].astype(np.uint64) + np.uint64(1)) * factors[j]
    h = mix(h)
    inside = np.flatnonzero(group[:n] == group[width - 1:])
    slot = (h[inside] >> np.uint64(40)).astype(np.int64)
    often = np.bincount(slot, minlength=1 << 24)[slot] > 1 if len(inside) > (1 << 18) else np.ones(len(inside), bool)
    inside = inside[often]
    by = np.argsort(h[inside], kind="stable")
    s = h[inside][by]
    same = s[1:] == s[:-1]
    twice = inside[by[np.append(False, same) | np.append(same, False)]] if len(s) else inside
    np.add.at(out, twice, 1)
    np.add.at(out, twice + width, -1)
    return np.cumsum(out)[:-1] > 0


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(key, kind="stable")
    s = key[by]
    r = np.empty(len(key), np.int64)
    r[by] = np.append(0, np.cumsum(s[1:] != s[:-1]))
    return r, by


def _ranks(symbols: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the prefixes of 1, 2, 4... symbols of every suffix, each with one more
    entry for the end, until all differ; and the suffix array."""
    m = len(symbols)
    r, by = _rank(symbols)
    levels, width = [np.append(r, -1)], 1
    while r[by[-1]] < m - 1:
        after = np.zeros(m, np.int64)
        after[:max(0, m - width)] = r[width:] + 1
        r, by = _rank(r * (m + 1) + after)
        levels.append(np.append(r, -1))
        width *= 2
    return levels, by


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Length of the common prefix of the suffixes ``a`` and ``b`` (``a != b``), or of the common stretch before them."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = (a - n - (1 << k), b - n - (1 << k)) if back else (a + n, b + n)
        ok = np.minimum(x, y) >= 0
        same = np.zeros(len(a), bool)
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        n[same] += 1 << k
    return n


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(left, right, depth)`` of every LCP interval deeper than 0, and the interval
    that each entry of the table bounds children of (-1: none)."""
    left, right, depth, own, open_ = [], [], [], [-1] * len(lcp), []
    for k, d in enumerate(lcp.tolist()):
        start = k - 1
        while open_ and depth[open_[-1]] > d:
            top = open_.pop()
            right[top] = k - 1
            start = left[top]
        if d:
            if not open_ or depth[open_[-1]] < d:
                open_.append(len(left))
                left.append(start)
                right.append(len(lcp) - 1)
                depth.append(d)
            own[k] = open_[-1]
    return tuple(np.array(x, np.int64) for x in (left, right, depth, own))


def _squares(symbols: np.ndarray, levels: list[np.ndarray], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and root lengths of the branching squares."""
    m = len(symbols)
    lcp = np.append(0, _common(levels, order[:-1], order[1:]))
    left, right, depth, own = _intervals(lcp)
    bound = np.flatnonzero(own >= 0)
    bound = bound[np.argsort(own[bound], kind="stable")]
    of = own[bound]
    last = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
    first = np.append(True, of[1:] != of[:-1]) if len(of) else last
    of_child = np.concatenate([of, of[first]])
    start = np.concatenate([bound, left[of[first]]])
    stop = np.concatenate([np.where(last, right[of] + 1, np.append(bound[1:], 0)), bound[first]])
    by = np.lexsort((start - stop, of_child))
    smaller = np.append(False, of_child[by][1:] == of_child[by][:-1]) if len(by) else np.zeros(0, bool)
    by = by[smaller]
    size = (stop - start)[by]
    at = np.repeat(start[by] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum())) if len(by) else by
    i, iv = order[at], np.repeat(of_child[by], size)
    d, lo, hi = depth[iv], left[iv], right[iv]
    rank, sym = levels[-1], np.append(symbols, -1)
    j = np.minimum(i + d, m)
    ahead = (rank[j] >= lo) & (rank[j] <= hi)
    ahead[ahead] = sym[(i + d)[ahead]] != sym[(i + 2 * d)[ahead]]
    j = np.maximum(i - d, -1)
    behind = (rank[j] >= lo) & (rank[j] <= hi) & (j >= 0)
    behind[behind] = sym[i[behind]] != sym[(i + d)[behind]]
    code = np.unique(np.concatenate([i[ahead] * (m + 1) + d[ahead], j[behind] * (m + 1) + d[behind]]))
    return code // (m + 1), code % (m + 1)


def _runs(word: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, ends (exclusive) and periods of the runs, by first word, then period."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, group, sym = np.arange(len(word)), doc, word
    while True:
        keep = _covered(sym, group, least // 2)
        whole = keep.all()
        pos, group, sym = pos[keep], group[keep], sym[keep]
        if not len(pos):
            return none
        cut = np.append(False, (pos[1:] != pos[:-1] + 1) | (group[1:] != group[:-1]))
        stretch = np.cumsum(cut)
        if whole and stretch[-1] == len(np.unique(group)) - 1:
            break
        group = stretch
    symbols, _ = _rank(group * (int(sym.max()) + 1) + sym)
    levels, order = _ranks(symbols)
    at, root = _squares(symbols, levels, order)
    start, end = at - _common(levels, at, at + root, back=True), at + 2 * root
    long = end - start >= np.maximum(least, 2 * root)
    start, end, root = start[long], end[long], root[long]
    by = np.lexsort((root, end, start))
    start, end, root = start[by], end[by], root[by]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.zeros(0, bool)
    start, end, root = pos[start[new]], pos[end[new] - 1] + 1, root[new]
    by = np.lexsort((root, start))
    return start[by], end[by], root[by]


def _batches(batches, least: int):
    for b in batches:
        for lo, hi in parts(b.column(1)):
            data, starts, ends, at = _split(b.column(1).slice(lo, hi - lo))
            doc = np.repeat(np.arange(hi - lo), np.diff(at))
            start, end, root = _runs(_numbers(data, starts, ends), doc, least)
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, start + root, 1)
            np.add.at(gone, end, -1)
            kept = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            of = doc[kept]
            blank = np.append(of[1:] == of[:-1], False).astype(np.int64) if len(of) else of
            size = (ends - starts)[kept] + blank
            to = np.cumsum(size)
            out = np.repeat(starts[kept] - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)
            text = data[np.minimum(out, len(data) - 1)] if len(out) else data[:0]
            text[to[blank == 1] - 1] = 32
            text_at = np.append(0, np.cumsum(np.bincount(of, size, hi - lo))).astype(np.int32)
            run_at = np.append(0, np.cumsum(np.bincount(doc[start], minlength=hi - lo))).astype(np.int32)
            runs = pa.StructArray.from_arrays([pa.array(start - at[doc[start]]), pa.array(end - start), pa.array(root)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(run_at), runs),
                 pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(text_at), pa.py_buffer(text)])],
                names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ``n_words``, ``runs`` (start, length and period in words, by start, then
    period) and ``collapsed``: the words joined by one blank, without those that a run
    holds after its first period.  ``least`` is an even number of words, 4 or more."""
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), partial(_batches, least=least),
                    f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("doc_id", id_col)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The contract's texts: where crc32 of the id ends in 0, the words from one place on
    repeat with a period.  A null id counts as the empty id."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g, w = F.floor(h / 10), words(text)
    n = F.size(w)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " ")).otherwise(text)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, over the texts that ``made_periodic`` gives."""
    texts = docs.select(F.col(id_col).alias("doc_id"), made_periodic(F.col(id_col), F.col(text_col)).alias("text"))
    found = periodic_runs(texts).withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        F.col("doc_id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
