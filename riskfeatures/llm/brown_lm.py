"""Brown class-based bigram language model, trained and applied on the corpus.

``P(text) = prod P(class_i | class_{i-1}) P(word_i | class_i)`` with add-0.1
smoothing, over the words and one end mark per text.

Counts.  Blocks of documents send their distinct words (64-bit hashes) with
their training counts, packed by hash range, and get back the corpus count of
every word but those counted once; so each document sees the exact count of each
of its words, and neither the vocabulary nor the counts are ever gathered.

Classes.  A word counted ``least`` times or more in training is a symbol of its
own, whatever the corpus; every rarer word is a symbol of its spelling (last two
characters).  Blocks send the bigram counts of their symbols once to the symbols' hash
ranges, which keep the corpus's sums (a symbol's neighbours with their counts, on
either side): rounds read only those.  Exchange clustering: the most frequent symbols
start a class each, all others one; in every round the ranges ask each other for the
classes of their symbols' neighbours (in packed requests), the class bigrams are summed, and the symbols of
one of ``PARTS`` parts of the hash space move each to the class that raises the bigram
likelihood most.  Symbols that move at the same time do not see each other's moves,
which is why a round moves a part only.  ``SWEEPS`` sweeps move every symbol as many
times, whatever the corpus.  Assignments stay distributed; the driver holds class
tables and the symbols that start a class.

Defined results: a null or empty text is the end mark alone; a null id counts as
the empty id (held out); repeated rows each get a row; without training texts
all counts are 0; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, forget, map_arrow, stored, stored_buckets
from .jaccard_join import BLOCK_BITS, _lists
from .wordhash import mix, parts, word_hashes

SMOOTH = 0.1
SPELLINGS = 1024          # symbols of rare words
FLUSH = 4 << 20           # words that a task gathers before it sends them
LEAST = 5                 # training count from which a word is a symbol of its own
PARTS, SWEEPS = 4, 3      # a round moves one part of the symbols; a sweep moves all
RANGE = 1 << 21           # training tokens to a range of symbols
PIECE = 1 << 20           # bigrams, or keys asked for, that a task works on at a time
BEFORE = np.uint32(1 << 31)  # marks a neighbour before the symbol, not after it


_SPELLED = mix(np.arange(SPELLINGS, dtype=np.uint64) + np.uint64(0x5BD1E995))  # keys of the spellings' symbols, among the words' hashes
_BY_KEY = np.argsort(_SPELLED)


def _requests(batches, bits: int):
    """Per block and hash range its distinct words, training counts and spellings;
    range -1 has the block's number of training tokens and texts."""
    block, hs, ws, ss, held_back, n_docs = None, [], [], [], 0, 0

    def flush():
        h, w, s = np.concatenate(hs), np.concatenate(ws), np.concatenate(ss)
        by = np.argsort(h, kind="stable")
        h, w, s = h[by], w[by], s[by]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        u, s = h[head], s[head].astype(np.int32)
        c = np.add.reduceat(w, head).astype(np.int64) if len(h) else np.zeros(0, np.int64)
        bucket = (u >> np.uint64(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(u) else np.zeros(0, np.int64)
        buckets = np.append(bucket[cut], -1).astype(np.int32)
        u, s, c = np.append(u, np.uint64(0)), np.append(s, np.int32(n_docs)), np.append(c, c.sum() + n_docs)
        offs = pa.array(np.append(cut, [len(u) - 1, len(u)]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets), pa.array(np.full(len(buckets), block, np.int64)), pa.ListArray.from_arrays(offs, pa.array(u.view(np.int64))),
             pa.ListArray.from_arrays(offs, pa.array(c)), pa.ListArray.from_arrays(offs, pa.array(s))],
            names=["bucket", "block", "words", "counts", "spelling"])

    for b in batches:
        blocks, train = b.column(0).to_numpy(zero_copy_only=False), ~b.column(1).to_numpy(zero_copy_only=False)
        for start, stop in parts(b.column(2)):
            h, at, tail = word_hashes(b.column(2).slice(start, stop - start), tails=True)
            spell = _spelling(tail)
            edges = np.flatnonzero(np.concatenate([[True], blocks[start + 1:stop] != blocks[start:stop - 1]]))
            for s, e in zip(edges, np.append(edges[1:], stop - start)):
                if block is not None and (blocks[start + s] != block or held_back > FLUSH):
                    yield flush()
                    hs, ws, ss, held_back, n_docs = [], [], [], 0, 0
                block = blocks[start + s]
                t = train[start + s:start + e]
                hs.append(h[at[s]:at[e]])
                ws.append(np.repeat(t, np.diff(at[s:e + 1])).astype(np.int64))
                ss.append(spell[at[s]:at[e]])
                held_back += int(at[e] - at[s])
                n_docs += int(t.sum())
    if block is not None:
        yield flush()


def _spelling(tail: np.ndarray) -> np.ndarray:
    return (mix(tail.astype(np.uint64) + np.uint64(1)) % np.uint64(SPELLINGS)).astype(np.int64)


def _counts(batches, least: float, classes: int):
    """Rows come sorted by range.  Kind 0: a block's words with their corpus counts
    (words counted once are left out); kind 1: the most frequent words of the range,
    after the number of its symbols; kind 2: types by spelling of its other words."""
    now, rows = None, []

    def reply():
        h = np.concatenate([r[1] for r in rows])
        u, first, inv = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(inv, np.concatenate([r[2] for r in rows])).astype(np.int64)
        spell = np.concatenate([r[3] for r in rows])[first]
        often = (c >= least) & (c > 1)
        types = np.bincount(spell[(c > 0) & ~often], minlength=SPELLINGS)
        kinds, blocks = [1, 2], [0, 0]
        top = np.flatnonzero(often)
        top = top[np.lexsort((u[top], -c[top]))[:classes]]
        out, n = [np.append(np.uint64(0), u[top]).view(np.int64), np.arange(SPELLINGS)], [np.append(often.sum(), c[top]), types]
        at = 0
        for block, own, *_ in rows:
            k = inv[at:at + len(own)]
            at += len(own)
            m = c[k] != 1
            kinds.append(0)
            blocks.append(block)
            out.append(own[m].view(np.int64))
            n.append(c[k[m]])
        offs = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(blocks, pa.int64()), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(out))),
             pa.ListArray.from_arrays(offs, pa.array(np.concatenate(n).astype(np.int64)))], names=["kind", "block", "words", "counts"])

    for b in batches:
        for bucket, block, h, c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _lists(b.column(2), np.int64),
                                          _lists(b.column(3), np.int64), _lists(b.column(4), np.int32)):
            if rows and bucket != now:
                yield reply()
                rows = []
            now = bucket
            rows.append((block, h.view(np.uint64), c, s))
    if rows:
        yield reply()


def _keys(words: np.ndarray) -> np.ndarray:
    """Keys of a block's symbols, in order; symbol ``i + 1`` has key ``i``."""
    return np.unique(np.concatenate([words, _SPELLED]))


def _symbols(batches, least: float, n_docs: int):
    """Rows come sorted by block, a block's counts before its documents.  Per
    document: tokens, known tokens, sum of log10(count + 0.1) and its symbols,
    numbered within the block."""
    now, got, table, count, keys = None, [], np.zeros(0, np.uint64), np.zeros(0), None
    for b in batches:
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        blocks, kinds = col["block"].to_numpy(zero_copy_only=False), col["kind"].to_numpy(zero_copy_only=False)
        hs, cs = _lists(col["words"], np.int64), _lists(col["counts"], np.int64)
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])]))
        for s, e in zip(edges, np.append(edges[1:], len(blocks))):
            if blocks[s] != now:
                now, got, table, count, keys = blocks[s], [], np.zeros(0, np.uint64), np.zeros(0), None
            if kinds[s] == 0:
                got += list(zip(hs[s:e], cs[s:e]))
                continue
            if keys is None:
                if got:
                    table, count = np.concatenate([x[0] for x in got]).view(np.uint64), np.concatenate([x[1] for x in got])
                    table, first = np.unique(table, return_index=True)
                    count, got = count[first], []
                often = (count >= least) & (count > 1)
                keys = _keys(table[often])
                symbol = np.where(often, 1 + np.searchsorted(keys, table), 0).astype(np.int32)
                spelled = (1 + np.searchsorted(keys, _SPELLED)).astype(np.int32)
            text = col["text"].slice(s, e - s)
            for start, stop in parts(text):
                h, at, tail = word_hashes(text.slice(start, stop - start), tails=True)
                sym = spelled[_spelling(tail)]
                c = np.ones(len(h))
                if len(table):
                    k = np.minimum(np.searchsorted(table, h), len(table) - 1)
                    there = table[k] == h
                    c[there] = count[k[there]]
                    own = there & (symbol[k] > 0)
                    sym[own] = symbol[k[own]]
                row = np.repeat(np.arange(stop - start), np.diff(at))
                logs = np.bincount(row, np.log10(c + SMOOTH), stop - start) + np.log10(n_docs + SMOOTH)
                known = np.bincount(row, c > 0, stop - start).astype(np.int64) + (n_docs > 0)
                lo = s + start
                yield pa.RecordBatch.from_arrays(
                    [col["doc_id"].slice(lo, stop - start), col["held"].slice(lo, stop - start), pa.array(np.diff(at) + 1), pa.array(known),
                     pa.array(logs), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sym)),
                     col["block"].slice(lo, stop - start)],
                    names=["doc_id", "held", "n_tokens", "n_known", "logs", "symbols", "block"])


def _pairs(b: pa.RecordBatch):
    """``(before, now)`` over the batch's texts, each opened and closed by symbol 0,
    and the number of pairs of each text."""
    lists = b.column(b.schema.names.index("symbols"))
    lens = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens + 1)
    now = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
    keep = np.ones(len(now), bool)
    keep[ends - 1] = False
    now[keep] = flat
    before = np.concatenate([[0], now[:-1]]) if len(now) else now
    return before, now, lens + 1


def _block_keys(batches, least: float, bits: int):
    """A block's words that are symbols, by range."""
    for b in batches:
        rows = []
        for block, h, c in zip(b.column(0).to_pylist(), _lists(b.column(1), np.int64), _lists(b.column(2), np.int64)):
            h = np.sort(h[(c >= least) & (c > 1)].view(np.uint64))
            rows += [(g, block, some.tobytes(), np.ones(len(some), np.uint16).tobytes()) for g, some in _by_range(h, bits)]
        yield _packed(rows, ("bucket", "block", "keys", "classes"))


def _packed(rows: list[tuple], names: tuple) -> pa.RecordBatch:
    kinds = [pa.int32() if n == "bucket" else pa.int64() if n == "block" else pa.binary() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))


def _with_classes(batches, spelled: np.ndarray | None = None):
    """Rows come sorted by block, its replies before its documents: per run of
    documents its block, the block's keys, the classes of its symbols and the rows."""
    spelled = np.ones(SPELLINGS, np.uint16) if spelled is None else spelled
    now, got, keys, cls = None, [], None, None
    for b in batches:
        names = b.schema.names
        blocks, kinds = b.column(names.index("block")).to_numpy(zero_copy_only=False), b.column(names.index("kind")).to_numpy(zero_copy_only=False)
        ks, cs = b.column(names.index("keys")), b.column(names.index("classes"))
        edges = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])]))
        for s, e in zip(edges, np.append(edges[1:], len(blocks))):
            if blocks[s] != now:
                now, got, keys = blocks[s], [], None
            if kinds[s] == 0:
                got += [(np.frombuffer(ks[i].as_buffer(), np.uint64), np.frombuffer(cs[i].as_buffer(), np.uint16)) for i in range(s, e)]
                continue
            if keys is None:
                keys, first = np.unique(np.concatenate([x[0] for x in got] + [_SPELLED]), return_index=True)
                cls = np.concatenate([x[1] for x in got] + [spelled])[first]
                cls, got = np.append(0, cls).astype(np.int64), []
            yield int(now), keys, cls, b.slice(s, e - s)


def _by_range(keys: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """Sorted keys, by range."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else of
    return [(int(of[s]), keys[s:e]) for s, e in zip(edges, np.append(edges[1:], len(of)))]


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, in order, and their sums."""
    by = np.argsort(code, kind="stable")
    code, n = code[by], n[by]
    head = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[head], np.add.reduceat(n, head) if len(head) else n


BIGRAMS = ("bucket", "keys", "others", "own", "other", "counts")
BIGRAM_ROWS = "bucket int, keys binary, others binary, own binary, other binary, counts binary"


def _bigrams(batches, bits: int):
    """Per block and range the keys of the range's symbols there and of their neighbours, and
    per pair the symbol, the neighbour (from 1; 0 is the end mark; ``BEFORE`` set on those before) and the count."""
    held = []

    def flush():
        keys = held[0][1]
        k = len(keys) + 1
        code, n = _summed(np.concatenate([x[2][0] * k + x[2][1] for x in held]), np.ones(sum(len(x[2][0]) for x in held), np.int64))
        p, q = code // k, code % k
        own, other, n = np.concatenate([p, q]), np.concatenate([q, p + (k << 1)]), np.concatenate([n, n])
        by = np.argsort(own, kind="stable")
        own, other, n = own[by], other[by], n[by]
        cut = np.searchsorted(own, np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) + 1)
        cut = np.concatenate([[np.searchsorted(own, 1)], cut, [len(own)]])
        rows = []
        for g in np.flatnonzero(np.diff(cut)):
            x, y = cut[g], cut[g + 1]
            mine, at = np.unique(own[x:y], return_inverse=True)
            before = other[x:y] >= k << 1
            o = np.where(before, other[x:y] - (k << 1), other[x:y])
            theirs = np.unique(o[o > 0])
            to = np.where(o > 0, np.searchsorted(theirs, o) + 1, 0).astype(np.uint32) | np.where(before, BEFORE, np.uint32(0))
            rows.append((int(g), keys[mine - 1].tobytes(), keys[theirs - 1].tobytes(), at.astype(np.uint32).tobytes(), to.tobytes(),
                         n[x:y].astype(np.uint32).tobytes()))
        held.clear()
        return _packed(rows, BIGRAMS)

    for block, keys, _, b in _with_classes(batches):
        if held and (held[0][0] != block or sum(len(x[2][0]) for x in held) > FLUSH):
            yield flush()
        held.append((block, keys, _pairs(b)[:2]))
    if held:
        yield flush()


def _blobs(b: pa.RecordBatch, i: int, **kinds) -> list[np.ndarray]:
    """Row ``i``'s packed columns as arrays."""
    return [np.frombuffer(b.column(b.schema.names.index(c))[i].as_buffer(), k) for c, k in kinds.items()]


_PAYLOAD = {"keys": np.uint64, "others": np.uint64, "own": np.uint32, "other": np.uint32, "counts": np.int64}


def _sums(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """Rows of one range as one: keys, neighbours and the distinct pairs with their sums."""
    keys, others = (np.unique(np.concatenate([r[i] for r in parts])) for i in (0, 1))
    width = np.int64(2 * (len(others) + 1))
    codes = np.empty(sum(len(r[2]) for r in parts), np.int64)
    at = 0
    for k, o, own, other, _ in parts:
        place = np.append(0, np.searchsorted(others, o) + 1)[other & ~BEFORE]
        place[other & BEFORE > 0] += width // 2
        codes[at:at + len(own)] = np.searchsorted(keys, k)[own] * width + place
        at += len(own)
    code, n = _summed(codes, np.concatenate([r[4] for r in parts]).astype(np.int64))
    own, code = (code // width).astype(np.uint32), code % width
    return keys, others, own, (code % (width // 2)).astype(np.uint32) | np.where(code >= width // 2, BEFORE, np.uint32(0)), n


def _merged(batches):
    """Rows come sorted by range: one row per range with the sums over all blocks.  Rows are
    summed as they come, so a task never holds more than twice a range's distinct pairs, or ``PIECE`` more."""
    now, held, more = None, [], 0

    def reply():
        return _packed([(now, *(x.tobytes() for x in _sums(held)))], BIGRAMS)

    for b in batches:
        for i, bucket in enumerate(b.column(0).to_pylist()):
            if held and bucket != now:
                yield reply()
                held, more = [], 0
            now = bucket
            held.append(tuple(x.copy() for x in _blobs(b, i, **(_PAYLOAD | {"counts": np.uint32}))))
            more += len(held[-1][2])
            if more > max(PIECE, len(held[0][2])):
                held, more = [_sums(held)], 0
    if held:
        yield reply()


def _neighbours(batches, bits: int):
    """Which keys every range asks every other one for."""
    for b in batches:
        rows = []
        for i, frm in enumerate(b.column(0).to_pylist()):
            (keys,) = _blobs(b, i, others=np.uint64)
            rows += [(h, frm, some.tobytes()) for h, some in _by_range(keys, bits)]
        yield _packed(rows, ("bucket", "block", "keys"))


REQUESTS = "bucket int, blocks binary, sizes binary, keys binary"


def _requested(batches):
    """Rows come sorted by range: a range's requests in rows of about ``PIECE`` keys, so that its
    symbols stand beside few rows and not beside every request."""
    now, blocks, keys, n = None, [], [], 0

    def row():
        return _packed([(now, np.array(blocks, np.int64).tobytes(), np.array([len(k) // 8 for k in keys], np.int64).tobytes(), b"".join(keys))],
                       ("bucket", "blocks", "sizes", "keys"))

    for b in batches:
        asked = b.column(b.schema.names.index("keys"))
        for i, (bucket, block) in enumerate(zip(b.column(b.schema.names.index("bucket")).to_pylist(), b.column(b.schema.names.index("block")).to_pylist())):
            if blocks and (bucket != now or n >= PIECE):
                yield row()
                blocks, keys, n = [], [], 0
            now = bucket
            blocks.append(block)
            keys.append(asked[i].as_py())
            n += len(keys[-1]) // 8
    if blocks:
        yield row()


def _answers(batches, out: tuple):
    """Requests beside their range's symbols: the classes of the keys asked for (1: not a symbol)."""
    for b in batches:
        for i, bucket in enumerate(b.column(b.schema.names.index("bucket")).to_pylist()):
            blocks, sizes, asked, keys, cls = _blobs(b, i, blocks=np.int64, sizes=np.int64, keys=np.uint64, symbols=np.uint64, classes=np.uint16)
            k = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
            got = np.where(keys[k] == asked, cls[k], 1).astype(np.uint16) if len(keys) else np.ones(len(asked), np.uint16)
            rows, at = [], 0
            for to, n in zip(blocks.tolist(), sizes.tolist()):
                row = {"block": to, "bucket": bucket, "keys": asked[at:at + n].tobytes(), "classes": got[at:at + n].tobytes()}
                rows.append(tuple(row[c] for c in out))
                at += n
            yield _packed(rows, out)


def _tables(batches, classes: int):
    """Ranges beside the answers to them: the classes of all neighbours (first the end
    mark's) and the range's share of the class bigrams."""
    for b in batches:
        rows = []
        for i, bucket in enumerate(b.column(0).to_pylist()):
            own, other, n, mine = _blobs(b, i, own=np.uint32, other=np.uint32, counts=np.int64, classes=np.uint16)
            told = sorted((k["part"], k["classes"]) for k in b.column(b.schema.names.index("told"))[i].as_py() or ())
            theirs = np.concatenate([np.zeros(1, np.uint16), *(np.frombuffer(c, np.uint16) for _, c in told)])
            table = np.zeros(classes * classes)
            for at in range(0, len(own), PIECE):
                some, m = slice(at, at + PIECE), n[at:at + PIECE]
                after, place, c = other[some] & BEFORE == 0, other[some] & ~BEFORE, mine[own[some]]
                code = c.astype(np.int64) * classes + theirs[place]
                table += np.bincount(code[after], m[after], classes * classes)
                first = ~after & (place == 0)  # what follows the end mark is counted here, the end mark having no range
                table[:classes] += np.bincount(c[first], m[first], classes)
            rows.append((bucket, theirs.tobytes(), np.rint(table).astype(np.int64).tobytes()))
        yield _packed(rows, ("bucket", "theirs", "table"))


def _gains(own: np.ndarray, sym: np.ndarray, col: np.ndarray, v: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Likelihood of every symbol (of class ``own``) in every class, but for a term
    that is the same for all; entries ``(sym, col, v)`` sorted by symbol.  The
    symbol's own counts are taken out of ``table`` first."""
    classes = len(table)
    phi = lambda x: x * np.log(np.maximum(x, 1))
    n, after, k = len(own), col >= classes, col % classes
    side = np.zeros((2, n, classes))
    side[after.astype(np.int64), sym, k] = v
    base = np.where(after[:, None], table.T[k], table[k]).astype(np.float64)
    base[np.arange(len(sym)), own[sym]] -= v
    same = np.flatnonzero(k == own[sym])  # cells that the other side's counts are in, too
    base[same] -= side[1 - after[same].astype(np.int64), sym[same]]
    base = np.maximum(base, 0)
    delta = phi(base + v[:, None]) - phi(base)
    gain = np.zeros((n, classes))
    head = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
    gain[sym[head]] = np.add.reduceat(delta, head, 0)
    for s, margin in ((1, table.sum(1)), (0, table.sum(0))):
        size = side[s].sum(1)
        m = np.repeat(margin[None].astype(np.float64), n, 0)
        m[np.arange(n), own] -= size
        gain -= phi(m + size[:, None]) - phi(m)
    return gain


def _moves(batches, table: np.ndarray, part: int, of: int):
    """Ranges beside their own and their neighbours' classes: the classes after one part's moves."""
    classes = len(table)
    for b in batches:
        rows = []
        for i, bucket in enumerate(b.column(0).to_pylist()):
            keys, own, other, n, cls, theirs = _blobs(b, i, keys=np.uint64, own=np.uint32, other=np.uint32, counts=np.int64, classes=np.uint16,
                                                      theirs=np.uint16)
            moving, moved, sums = mix(keys) & np.uint64(of - 1) == part, cls.astype(np.int64), []
            for at in range(0, len(own), PIECE):  # a symbol's neighbours, by class
                o, x, m = own[at:at + PIECE], other[at:at + PIECE], n[at:at + PIECE]
                may = moving[o]
                o, x, m = o[may].astype(np.int64), x[may], m[may]
                sums.append(_summed(o * 2 * classes + theirs[x & ~BEFORE] + np.where(x & BEFORE == 0, classes, 0), m))
            code, n = _summed(*(np.concatenate(x) for x in zip(*sums))) if sums else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            sym, col = code // (2 * classes), code % (2 * classes)
            at = 0
            while at < len(sym):
                end = int(np.searchsorted(sym, sym[min(at + (1 << 14), len(sym) - 1)], "right"))
                some, k = np.unique(sym[at:end], return_inverse=True)
                gain = _gains(moved[some], k, col[at:end], n[at:end], table)
                gain[:, 0] = -np.inf  # the end mark's own class
                best = gain.argmax(1)
                better = gain[np.arange(len(some)), best] > gain[np.arange(len(some)), moved[some]] + 1e-6
                moved[some[better]] = best[better]
                at = end
            rows.append((bucket, keys.tobytes(), moved.astype(np.uint16).tobytes()))
        yield _packed(rows, ("bucket", "symbols", "classes"))


def _started(batches, start: dict):
    top = np.array(sorted(start), np.uint64)
    to = np.array([start[int(x)] for x in top], np.uint16)
    for b in batches:
        rows = []
        for i, bucket in enumerate(b.column(0).to_pylist()):
            (keys,) = _blobs(b, i, keys=np.uint64)
            cls = np.ones(len(keys), np.uint16)
            if len(top):
                k = np.minimum(np.searchsorted(top, keys), len(top) - 1)
                cls = np.where(top[k] == keys, to[k], cls)
            rows.append((bucket, keys.tobytes(), cls.astype(np.uint16).tobytes()))
        yield _packed(rows, ("bucket", "symbols", "classes"))


def _types(batches, classes: int, rare: np.ndarray):
    """Word types by class, and the classes of the spellings' symbols (0: none)."""
    of_class, spelled = np.zeros(classes, np.int64), np.zeros(SPELLINGS, np.int64)
    for b in batches:
        for i in range(len(b)):
            keys, cls = _blobs(b, i, symbols=np.uint64, classes=np.uint16)
            k = np.minimum(np.searchsorted(_SPELLED[_BY_KEY], keys), SPELLINGS - 1)
            is_spelled = _SPELLED[_BY_KEY[k]] == keys
            types = np.ones(len(keys), np.int64)
            types[is_spelled] = rare[_BY_KEY[k[is_spelled]]]
            np.add.at(of_class, cls, types)
            spelled[_BY_KEY[k[is_spelled]]] = cls[is_spelled]
    yield pa.RecordBatch.from_arrays([pa.array([np.append(of_class, spelled).tobytes()], pa.binary())], names=["counts"])


def _total(df: DataFrame, name: str, size: int, rows: int) -> np.ndarray:
    """Sum of a column of packed counts."""
    def added(batches):
        out = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                out += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])
    got = map_arrow(df.select(name).repartition(max(1, min(16, rows // 8))), added, "counts binary").collect()
    return sum((np.frombuffer(bytes(c), np.int64) for (c,) in got), np.zeros(size, np.int64))


def _scores(batches, step: np.ndarray, emit: np.ndarray, base: float, classes: int, spelled: np.ndarray):
    for _, _, cls, b in _with_classes(batches, spelled):
        p, q, lens = _pairs(b)
        row = np.repeat(np.arange(len(lens)), lens)
        a, c = cls[p], cls[q]
        trans = np.bincount(row, step[a * classes + c] - emit[c], len(lens))
        col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        logs = col["logs"].to_numpy(zero_copy_only=False)
        names = ["doc_id", "held", "n_tokens", "n_known"]
        yield pa.RecordBatch.from_arrays([*(col[n] for n in names), pa.array(logs - base * lens), pa.array(logs + trans)],
                                         names=[*names, "base_score", "score"])


def _by_block(rows: DataFrame, replies: DataFrame, *cols: str) -> DataFrame:
    """Documents behind the replies of their block."""
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in cols]
    both = replies.where("block >= 0").select("block", F.lit(0).alias("kind"), "keys", "classes", *none).union(
        rows.select("block", F.lit(1).alias("kind"), F.lit(b"").alias("keys"), F.lit(b"").alias("classes"), *cols))
    return both.repartition("block").sortWithinPartitions("block", "kind")


class BrownModel:
    """Fitted classes and probabilities; ``rows`` are the scored documents' symbols,
    ``replies`` the classes of every block's words, ``spelled`` those of the spellings,
    ``likelihoods`` the training log-likelihood of the classes a token, at the start and after every round."""

    def __init__(self, rows, replies, spelled, step, emit, total, types, likelihoods):
        self.rows, self.replies, self.spelled, self.step, self.emit, self.total, self.types = rows, replies, spelled, step, emit, total, types
        self.likelihoods = likelihoods


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = 64, least: int = LEAST,
        sweeps: int = SWEEPS, parts: int = PARTS) -> BrownModel:
    """Train on the documents whose ``crc32(id) mod 10`` is not 0."""
    number = F.monotonically_increasing_id()
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    texts = stored(docs.select(F.shiftright(number, BLOCK_BITS).alias("block"), held.alias("held"),
                               F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")), "rows")
    bits = max(2, (4 * texts.rdd.getNumPartitions() - 1).bit_length())
    sent = stored(map_arrow(texts.select("block", "held", "text"), partial(_requests, bits=bits),
                            "bucket int, block long, words array<long>, counts array<long>, spelling array<int>"), "word-counts")
    total, n_docs = sent.where("bucket = -1").agg(F.coalesce(F.sum(F.col("counts")[0]), F.lit(0)),
                                                  F.coalesce(F.sum(F.col("spelling")[0]), F.lit(0))).first()
    counts = stored(map_arrow(sent.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket"),
                              partial(_counts, least=least, classes=classes),
                              "kind int, block long, words array<long>, counts array<long>"), "word-totals")
    forget(sent)
    drop_shuffles(docs.sparkSession)
    n_words = counts.where("kind = 1").agg(F.coalesce(F.sum(F.col("counts")[0]), F.lit(0))).first()[0]
    top = (counts.where("kind = 1").select(F.explode(F.slice(F.arrays_zip("words", "counts"), 2, classes)).alias("x"))
           .orderBy(F.desc("x.counts"), "x.words").limit(max(0, classes - 2)).select("x.words").collect())
    start = {int(np.int64(w).view(np.uint64)): 2 + i for i, (w,) in enumerate(top)}
    rare = np.zeros(SPELLINGS, np.int64)
    for i, c in counts.where("kind = 2").select(F.posexplode("counts").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("c")).collect():
        rare[i] = c
    types = n_words + int(rare.sum()) + (n_docs > 0)

    none = lambda kind: F.lit(None).cast(kind)
    id_kind = texts.schema["doc_id"].dataType.simpleString()
    empty = F.array().cast("array<long>")
    mixed = counts.where("kind = 0").select("block", "kind", "words", "counts", none("boolean").alias("held"), none(id_kind).alias("doc_id"),
                                            none("string").alias("text")).union(
        texts.select("block", F.lit(1).alias("kind"), empty.alias("words"), empty.alias("counts"), "held", "doc_id", "text"))
    rows = stored(map_arrow(mixed.repartition("block").sortWithinPartitions("block", "kind"), partial(_symbols, least=least, n_docs=n_docs),
                            f"doc_id {id_kind}, held boolean, n_tokens long, n_known long, logs double, symbols array<int>, block long"), "symbols")
    bits = max(1, (total // RANGE).bit_length())  # ranges of symbols follow the tokens: a task holds one
    asked = stored(map_arrow(counts.where("kind = 0").select("block", "words", "counts"), partial(_block_keys, least=least, bits=bits),
                             "bucket int, block long, keys binary, classes binary"), "block-keys")
    forget(texts, counts)
    drop_shuffles(docs.sparkSession)
    cls, table, of_class, spelled, seen = _clustered(rows, asked, classes, bits, start, rare, total, sweeps, parts)
    replies = stored(map_arrow(_by_bucket(asked.select("bucket", "block", "keys"), placed(rows, bits)).join(cls, "bucket"),
                               partial(_answers, out=("block", "keys", "classes")), "block long, keys binary, classes binary"), "classes")
    forget(asked, cls)
    of_class[0] += n_docs > 0
    step = np.log10((table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * classes)).ravel()
    emit = np.log10(table.sum(0) + SMOOTH * (of_class + 1))
    return BrownModel(rows, replies, spelled, step, emit, total, types, seen)


def placed(df: DataFrame, bits: int) -> int:
    """Partitions of the ranges: no fewer than a shuffle has, or joins would move the ranges again."""
    return max(1 << bits, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _by_bucket(requests: DataFrame, ranges: int) -> DataFrame:
    return map_arrow(requests.repartition(ranges, "bucket").sortWithinPartitions("bucket"), _requested, REQUESTS)


def _clustered(rows, asked, classes, bits, start, rare, total, sweeps, parts):
    """Exchange clustering: the symbols' classes by range, the class bigrams, types by class,
    the spellings' classes and the likelihoods."""
    ranges = placed(rows, bits)
    # not stored between: Parquet's reader would take thousands of these long rows at a time
    sent = map_arrow(_by_block(rows.where("not held"), asked, "symbols"), partial(_bigrams, bits=bits), BIGRAM_ROWS)
    # read in every round, each range where it lies
    bigrams = stored_buckets(map_arrow(sent.repartition(ranges, "bucket").sortWithinPartitions("bucket"), _merged, BIGRAM_ROWS), "bigrams", "bucket", ranges)
    drop_shuffles(rows.sparkSession)
    wanted = map_arrow(bigrams.select("bucket", "others"), partial(_neighbours, bits=bits), "bucket int, block long, keys binary")
    wanted = stored_buckets(_by_bucket(wanted, ranges), "neighbours", "bucket", ranges)
    drop_shuffles(rows.sparkSession)
    cls = stored(map_arrow(bigrams.select("bucket", "keys"), partial(_started, start=start), "bucket int, symbols binary, classes binary"), "symbol-classes")
    bigrams_ = bigrams.drop("others")
    phi = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    seen, alone = [], rows.where("not held and n_tokens = 1").count()  # texts that are an end mark after the last one's
    for k in range(sweeps * parts + 1 if total else 1):
        told = map_arrow(wanted.join(cls, "bucket"), partial(_answers, out=("block", "bucket", "classes")), "block long, bucket int, classes binary")
        told = told.groupBy(F.col("block").cast("int").alias("to")).agg(
            F.collect_list(F.struct(F.col("bucket").alias("part"), "classes")).alias("told")).withColumnRenamed("to", "bucket")
        both = bigrams_.join(cls.select("bucket", "classes"), "bucket").join(told, "bucket", "left")
        got = stored(map_arrow(both, partial(_tables, classes=classes), "bucket int, theirs binary, table binary"), "neighbour-classes")
        table = _total(got, "table", classes * classes, ranges).reshape(classes, classes)
        table[0, 0] += alone
        seen.append((phi(table) - phi(table.sum(1)) - phi(table.sum(0))) / max(1, total))
        if k == sweeps * parts or not total:
            forget(got)
            break
        both = bigrams_.join(cls.select("bucket", "classes"), "bucket").join(got.select("bucket", "theirs"), "bucket")
        after = stored(map_arrow(both, partial(_moves, table=table, part=k % parts, of=parts), "bucket int, symbols binary, classes binary"), "symbol-classes")
        forget(got, cls)
        cls = after
    sums = _total(map_arrow(cls.select("symbols", "classes"), partial(_types, classes=classes, rare=rare), "counts binary"), "counts", classes + SPELLINGS, ranges)
    of_class, spelled = sums[:classes].copy(), np.maximum(sums[classes:], 1).astype(np.uint16)
    forget(bigrams, wanted)
    return cls, table, of_class, spelled, seen


def score(model: BrownModel, classes: int = 64) -> DataFrame:
    """Per document the unigram base score and the class model's score (log10)."""
    base = float(np.log10(model.total + SMOOTH * (model.types + 1)))
    kind = model.rows.schema["doc_id"].dataType.simpleString()
    cols = ("doc_id", "held", "n_tokens", "n_known", "logs", "symbols")
    out = map_arrow(_by_block(model.rows, model.replies, *cols),
                    partial(_scores, step=model.step, emit=model.emit, base=base, classes=classes, spelled=model.spelled),
                    f"doc_id {kind}, held boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
                      "base_score", "score")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: int = 64, least: int = LEAST,
           sweeps: int = SWEEPS, parts: int = PARTS) -> DataFrame:
    return score(fit(docs, id_col, text_col, classes, least, sweeps, parts), classes).withColumnRenamed("doc_id", id_col)
