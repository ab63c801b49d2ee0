"""64-bit hashes of words and of runs of words, over whole Arrow batches at once.

A word's hash is its Karp-Rabin polynomial over bytes, modulo 2**64, read off prefix sums; no word
becomes a Python object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that are handled at once; a text longer than this is handled alone.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything ASCII that is no letter or digit.
MARKS = np.ones(256, dtype=bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_TABLE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, CHUNK + (1 << 16))
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("up", BASE), ("down", inverse)):
                x = np.full(size, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_POWERS = _Powers()


def _chunk_words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray):
    """Word hashes and the number of words of each text; ``offsets`` are the texts' ends, from 0."""
    gap = np.empty(len(data) + 1, dtype=bool)
    gap[:-1] = breaks[data]
    gap[-1] = True
    inside = ~gap[:-1]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[0] = True
    first[offsets[:-1]] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = True
    before[1:] = gap[:-2] if len(data) > 1 else True
    starts = np.flatnonzero(inside & (before | first[:-1]))
    if len(starts) == 0:
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    after = np.empty(len(data), dtype=bool)
    after[:] = gap[1:]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    up, down = _POWERS.get(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_TABLE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    cuts = np.searchsorted(starts, offsets)
    return hashes, np.diff(cuts)


def word_hashes(texts: pa.Array, breaks: np.ndarray = SPACES):
    """For pieces of ``texts``: yields (first text, last text + 1, word hashes, words of each text). Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        hashes, counts = _chunk_words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], breaks)
        yield lo, hi, hashes, counts
        lo = hi


def gram_hashes(words: np.ndarray, counts: np.ndarray, n: int):
    """Hashes of runs of ``n`` words, and the number of runs of each text; a shorter text with words has one run, the whole."""
    ends = np.cumsum(counts)
    starts = ends - counts
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    total = int(runs.sum())
    first = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(total)
    limit = np.repeat(ends, runs)
    h = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        at = first + k
        here = at < limit
        h = h * BASE + np.where(here, words[np.minimum(at, max(len(words) - 1, 0))], np.uint64(k + 1)) if total else h
    return mix(h), runs
