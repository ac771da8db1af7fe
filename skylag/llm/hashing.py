"""Hashes of words straight from the bytes of an Arrow string column, without Python strings.

A word's hash is a polynomial of its bytes modulo 2 ** 61 - 1, read off running sums, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in runs of about this many bytes; one longer text is a run of its own.
RUN_BYTES = 1 << 18
#: Word hashes are polynomials modulo this prime: modulo a power of two, some words of 1,024 letters collide for every base.
_PRIME = (1 << 61) - 1
_BASE = 0x0E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, _PRIME)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for numbers below it."""
    low32, three, five, prime = np.uint64(0xFFFFFFFF), np.uint64(3), np.uint64(29), np.uint64(_PRIME)
    ah, al, bh, bl = a >> np.uint64(32), a & low32, b >> np.uint64(32), b & low32
    middle = ah * bl + al * bh  # below 2 ** 62
    low = al * bl
    # 2 ** 64 = 8 and 2 ** 61 = 1 modulo the prime.
    total = (ah * bh << three) + (middle >> five) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32))
    total = _folded(total) + _folded(low)
    return _folded(total) % prime


def _folded(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(_PRIME)) + (x >> np.uint64(61))


class _Powers:
    """Powers of the base in two halves of 32 bits, and those of its inverse."""

    @staticmethod
    def _table(base: int, size: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < size:  # doubled: the second half is the first times one power
            step = np.full(len(out), pow(base, len(out), _PRIME), np.uint64)
            out = np.concatenate([out, _times(out, step)])
        return out[:size]

    def __init__(self):
        self.high = self.low = self.down = np.empty(0, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.down) < n:
            size = max(n, 2 * RUN_BYTES)
            up = self._table(_BASE, size)
            self.high, self.low, self.down = up >> np.uint64(32), up & np.uint64(0xFFFFFFFF), self._table(_INVERSE, size)
        return self.high, self.low, self.down


_POWERS = _Powers()


def runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text has no bytes."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + RUN_BYTES, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def places(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word. `kinds` maps a byte to 0 (no word) or the kind of word it is part of.

    A word is a longest run of bytes of one kind in one row.
    """
    n = len(data)
    if not n:
        return (np.empty(0, np.int64),) * 3
    kind = kinds[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word; A-Z count as a-z."""
    n = len(data)
    high, low, down = _POWERS.of(n + 1)
    value = LOWER[data].astype(np.uint64) + np.uint64(1)
    sums = []
    for half in (high, low):  # a word of less than 2 ** 23 bytes has a sum below 2 ** 64
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(value * half[:n], out=total[1:])
        sums.append(_folded(total[ends] - total[starts]))  # differences hold though the sums may wrap
    top, rest = (_folded(v) for v in sums)
    h = _times(top % np.uint64(_PRIME), np.uint64(1 << 32)) + rest % np.uint64(_PRIME)
    h = _times(_folded(h) % np.uint64(_PRIME), down[starts])
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `width` words of a row; a shorter row has one, of all its words."""
    n = len(h)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64))
    if n >= width:
        s = np.zeros(n - width + 1, np.uint64)
        for j in range(width):
            s += h[j : n - width + 1 + j] * (factor[j] | np.uint64(1))
        inside = row[: n - width + 1] == row[width - 1 :]
        s, r = mix(s[inside]), row[: n - width + 1][inside]
    else:
        s, r = np.empty(0, np.uint64), np.empty(0, np.int64)
    if n:
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        size = np.diff(np.append(first, n))
        few = size < width
        if few.any():
            extra = []
            for at, k in zip(first[few], size[few], strict=True):
                part = (h[at : at + k] * (factor[:k] | np.uint64(1))).sum(dtype=np.uint64)
                extra.append((int(part) + int(k) * 0xA0761D6478BD642F) % (1 << 64))
            s = np.concatenate([s, mix(np.array(extra, np.uint64))])
            r = np.concatenate([r, row[first[few]]])
            order = np.argsort(r, kind="stable")
            s, r = s[order], r[order]
    return s, r
