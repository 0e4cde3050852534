"""Words and shingles of Arrow text columns as 64-bit hashes, computed in numpy
over the column's own bytes.  Words are the runs of bytes other than 0x20 and
0x09-0x0D with A-Z lower-cased; equal words have equal hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART = 2 << 20  # bytes of text handled at a time; a longer text is handled alone

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[[32, 9, 10, 11, 12, 13]] = 0
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 8
_POWERS = np.cumprod(np.full(256, _RADIX), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    return _POWERS if n <= len(_POWERS) else np.cumprod(np.full(n, _RADIX), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``PART`` bytes of text."""
    ends = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + PART, "right")))
        yield start, stop
        start = stop


def word_hashes(column: pa.Array, tails: bool = False) -> tuple[np.ndarray, ...]:
    """``(hashes, at)``: row ``i`` has the words ``hashes[at[i]:at[i + 1]]``; a null has none.
    With ``tails`` also the last two bytes of every word as one number."""
    column = column.fill_null("")
    offs = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offs[0]:offs[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    n = len(data)
    none = np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int64)
    if n == 0:
        return none if tails else none[:2]
    blank = _BLANK[data]
    first = np.empty(n, bool)
    first[0], first[1:] = True, blank[:-1]
    heads = offs[:-1]
    first[heads[heads < n]] = True
    first &= ~blank
    starts = np.flatnonzero(first)
    if not len(starts):
        return none if tails else none[:2]
    gaps = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, gaps)
    value = _BYTE[data[starts[0]:]]
    value *= _powers(int(gaps.max()))[place]
    h = mix(np.add.reduceat(value, starts - starts[0]))
    if not tails:
        return h, np.searchsorted(starts, offs)
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, blank[1:]
    last[heads[heads > 0] - 1] = True
    ends = np.flatnonzero(last & ~blank)
    low = _LOWER[data]
    return h, np.searchsorted(starts, offs), low[ends].astype(np.int64) * 256 + np.where(ends > starts, low[ends - 1], 0)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles; a row with
    fewer words has its whole sequence as one, a row without words none."""
    words, at = word_hashes(column)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * _RADIX) | np.uint64(1)
    n = len(words)
    if n >= size:
        sh = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            sh += words[j:n - size + 1 + j] * factors[j]
        sh = mix(sh)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= size:
            out.append(np.unique(sh[s:e - size + 1]))
        elif e > s:
            out.append(mix((words[s:e] * factors[:e - s]).sum(keepdims=True) + np.uint64(e - s)))
        else:
            out.append(words[:0])
    return out
