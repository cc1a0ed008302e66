"""Words, word hashes and window hashes of many texts at once, on bytes with numpy.

A text's words are its runs of bytes outside a separator set. A word's hash is a polynomial over a
table of random values, read off a running sum, then mixed; a window's hash is the same over the
word hashes. Texts are cut into blocks of bounded size, so memory does not follow the batch or the
longest text (only the longest word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; temporaries take about 60 bytes for each.
BLOCK = 1 << 20
#: Bytes whose hashes come from one running sum; powers are kept up to about as many.
SPAN_BLOCK = 1 << 17

_WHITE = [0x20, *range(0x09, 0x0E)]
SPACES = np.isin(np.arange(256), _WHITE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as they are asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, self.base, np.uint64)], dtype=np.uint64)
                inverse = pow(self.base, -1, 1 << 64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, np.uint64)], dtype=np.uint64)
        return self.up[:n], self.down[:n]


_BYTES = [(_table(11), Powers(0x9E3779B97F4A7C15)), (_table(12), Powers(0xC2B2AE3D27D4EB4F))]
_WORDS = [Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Scrambles 64-bit values, so that each bit depends on all."""
    h = h ^ np.uint64(salt) if salt else h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each row's begin (null: empty)."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_blocks(at: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to `limit` bytes; a longer row comes alone."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed hash of each byte span; spans are in order and do not overlap."""
    table, powers = _BYTES[which]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SPAN_BLOCK, "right")))
        size = int(ends[j - 1]) - base
        up, down = powers.upto(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(table[raw[base : base + size]] * up[:size], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


def word_spans(raw: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each row (rows + 1 values)."""
    starts, ends = [], []
    for first, last in row_blocks(at, 8 * BLOCK):
        a, b = int(at[first]), int(at[last])
        inside = ~separators[raw[a:b]]
        cut = np.zeros(b - a + 1, bool)
        cut[at[first : last + 1] - a] = True
        starts.append(np.flatnonzero(inside & (cut[:-1] | ~np.r_[False, inside[:-1]])) + a)
        ends.append(np.flatnonzero(inside & (cut[1:] | ~np.r_[inside[1:], False])) + a + 1)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    e = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return s, e, np.searchsorted(s, at)


def windows(words: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes (len(words) - size + 1 values)."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    if size == 1:
        return mix(words, 0x5851F42D4C957F2D + which)
    up, down = _WORDS[which].upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((mix(words, 0x2545F4914F6CDD1D) if which else words) * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])
