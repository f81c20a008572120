"""Some pages one below the other as bits: 64 pixels of a row a word, the lowest bit leftmost.

Shifts, openings and dilations go over whole arrays of words; runs and boxes are read from them and drawn into them.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
ALL = ~U64(0)


class Sheets:
    """Where each page lies: rows of all pages, `edge` blank ones about each, and one more; `edge` blank columns on both sides."""

    def __init__(self, page: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray, edge: int):
        """Boxes come by page (0, 1, ...), and every page has one."""
        first = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        top = np.minimum.reduceat(y0, first)
        block = np.maximum.reduceat(y1, first) - top + 2 * edge + 1
        self.end = block.cumsum()
        self.shift = self.end - block + edge - top  # row less y
        self.left = int(x0.min()) - edge
        self.shape = int(self.end[-1]), (int(x1.max()) - self.left + edge) // 64 + 1

    def drawn(self, page: np.ndarray, y0: np.ndarray, y1: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        return drawn(self.shape, y0 + self.shift[page], y1 + self.shift[page], x0 - self.left, x1 - self.left)

    def page(self, row: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.end, row, "right")

    def marked(self, m: np.ndarray) -> np.ndarray:
        """Of each page whether a bit is set."""
        return np.logical_or.reduceat(m.any(1), np.r_[0, self.end[:-1]])


def _masks(r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Box, place among the words and mask of all words that boxes reach."""
    w0 = c0 >> 6
    k = ((c1 - 1) >> 6) - w0 + 1
    box = np.repeat(np.arange(len(k)), k)
    w = np.arange(len(box)) - np.repeat(k.cumsum() - k, k) + w0[box]
    lo, hi = np.maximum(c0[box] - 64 * w, 0).astype(U64), np.minimum(c1[box] - 64 * w, 64).astype(U64)
    mask = (ALL << lo) & (ALL >> (U64(64) - hi))
    high = (r1 - r0)[box]
    down = np.arange(int(high.sum())) - np.repeat(high.cumsum() - high, high)
    return np.repeat(box, high), np.repeat(w + r0[box] * words, high) + words * down, np.repeat(mask, high)


def drawn(shape: tuple[int, int], r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> np.ndarray:
    """Boxes of rows and columns, ends exclusive, all within the shape and none empty."""
    out = np.zeros(shape[0] * shape[1], U64)
    if len(r0):
        _, at, mask = _masks(r0, r1, c0, c1, shape[1])
        np.bitwise_or.at(out, at, mask)
    return out.reshape(shape)


def counts(layers: list[np.ndarray], r0: np.ndarray, r1: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> list[np.ndarray]:
    """The bits of each layer within each box, none of them empty."""
    if not len(r0):
        return [np.zeros(0, np.int64) for _ in layers]
    box, at, mask = _masks(r0, r1, c0, c1, layers[0].shape[1])
    return [np.bincount(box, np.bitwise_count(m.ravel()[at] & mask), len(r0)).astype(np.int64) for m in layers]


def right(m: np.ndarray, k: int) -> np.ndarray:
    """Bits moved k columns to the right; what leaves a row comes in at the next one, so rows end with blank columns."""
    n, k = divmod(k, 64)
    f, out = m.ravel(), np.zeros(m.size, U64)
    np.left_shift(f[: max(0, len(f) - n)], U64(k), out=out[n:])
    if k:
        out[n + 1 :] |= f[: max(0, len(f) - n - 1)] >> U64(64 - k)
    return out.reshape(m.shape)


def left(m: np.ndarray, k: int) -> np.ndarray:
    """Bits moved k columns to the left; what leaves a row comes in at the one before."""
    n, k = divmod(k, 64)
    f, out = m.ravel(), np.zeros(m.size, U64)
    np.right_shift(f[n:], U64(k), out=out[: max(0, len(f) - n)])
    if k:
        out[: max(0, len(f) - n - 1)] |= f[n + 1 :] << U64(64 - k)
    return out.reshape(m.shape)


def down(m: np.ndarray, k: int) -> np.ndarray:
    """Bits moved k rows down, or up where k is negative."""
    out = np.zeros_like(m)
    if abs(k) < len(m):
        out[max(0, k) : len(m) + min(0, k)] = m[max(0, -k) : len(m) + min(0, -k)]
    return out


def grown(m: np.ndarray, dx: int, dy: int) -> np.ndarray:
    """Ink grown by a rectangle of 2 dx + 1 by 2 dy + 1; dx is no more than the blank columns at the sides."""
    for _ in range(dx):
        m = m | right(m, 1) | left(m, 1)
    out = m.copy()
    for k in range(1, dy + 1):
        out[k:] |= m[:-k]
        out[:-k] |= m[k:]
    return out


def across(m: np.ndarray, length: int) -> np.ndarray:
    """Bits in runs of rows of at least length."""
    n = 1
    while n < length:
        k = min(n, length - n)
        m, n = m & left(m, k), n + k
    n = 1
    while n < length:
        k = min(n, length - n)
        m, n = m | right(m, k), n + k
    return m


def upright(m: np.ndarray, length: int) -> np.ndarray:
    """Bits in runs of columns of at least length."""
    n = 1
    while n < length:
        k = min(n, length - n)
        m, n = m & down(m, -k), n + k
    n = 1
    while n < length:
        k = min(n, length - n)
        m, n = m | down(m, k), n + k
    return m


def _places(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the bits, by rows."""
    flat = m.ravel()
    some = np.flatnonzero(flat)
    at = np.flatnonzero(np.unpackbits(flat[some].view(np.uint8), bitorder="little").view(bool))
    word = some[at >> 6]
    row = word // m.shape[1]
    return row, ((word - row * m.shape[1]) << 6) + (at & 63)


def runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the runs of rows, by rows."""
    row, start = _places(m & ~right(m, 1))
    return row, start, _places(m & ~left(m, 1))[1] + 1


def column_runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, first row and end of the runs of columns, by columns."""
    r0, c = _places(m & ~down(m, 1))
    r1, d = _places(m & ~down(m, -1))
    order = np.lexsort((r0, c))
    return c[order], r0[order], r1[np.lexsort((r1, d))] + 1
