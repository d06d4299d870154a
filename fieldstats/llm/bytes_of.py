"""Views of Arrow text columns as numpy bytes, and hashes of their words.

Everything here works on one Arrow batch inside a task. Bytes are hashed with a
polynomial over a table drawn from a rule, so any stretch is the difference of two prefix
sums; a 64-bit finaliser then spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE_BYTES = 500_000
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(seed: int, lower: bool) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2^64, kept as far as they were needed."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) < n:
            more = np.full(max(n, 2 * len(self.values), 1 << 16), self.base, U)
            more[0] = 1
            self.values = np.multiply.accumulate(more)
        return self.values[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def text_pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and for each text where its words begin in that array.

    Words are what lies between space, tab and the four line and page breaks.
    """
    if not len(data):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    inside = ~_GAP[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_table(seed, lower)[data] * _POWERS.upto(len(data)), out=sums[1:])
    raw = (sums[end] - sums[begin]) * _INVERSES.upto(len(data) + 1)[begin]
    return mixed(raw + (end - begin).astype(U) * U(0xD6E8FEB86659FD93)), np.searchsorted(begin, offsets)


def run_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each position on, as far as k words follow."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    salted = words if not seed else mixed(words ^ U(seed))
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(salted * _POWERS.upto(len(words)), out=sums[1:])
    return mixed((sums[k:] - sums[:n]) * _INVERSES.upto(n) + U(int(k) * 0xD6E8FEB86659FD93 % (1 << 64)))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:])[:n] if rest else x[:n]


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
