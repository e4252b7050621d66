"""Array kernels over the bytes of many texts at once.

A column of texts arrives from Arrow as one byte buffer and row offsets. Words,
lines and shingles are found and hashed there with whole-array operations; no
Python object is made per word. All hashes are 64 bits, the same in every
process. UTF-8 keeps bytes of other scripts above 0x7F, so ASCII separators and
ASCII lower-casing are safe on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's output function on an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + U64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(256, dtype=U64))
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = mix64(np.arange(1000, 1064, dtype=U64)) | U64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup table that is true for the bytes of the inclusive ranges."""
    out = np.zeros(256, bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


#: Separators of words ``[^\x20\x09-\x0D]+``, and of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
SPACES = byte_set((0x20, 0x20), (0x09, 0x0D))
NON_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NEWLINE = byte_set((0x0A, 0x0A))
CONTINUATION = byte_set((0x80, 0xBF))

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 17)
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if size <= 1 << 23:
            _powers[base] = have
    return have


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if n else 0
    return data[lo : int(offsets[-1]) if n else 0], offsets - lo


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``most`` bytes: (first row, end row, bytes, offsets)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Maximal runs of non-separators, none across texts.

    ``starts``/``ends`` are byte positions, ``bounds[d]:bounds[d+1]`` are the
    words of text d and ``hashes`` their 64-bit hashes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = offsets[1:] > offsets[:-1]
            heads, tails = offsets[:-1][full], offsets[1:][full] - 1
            first[heads], last[tails] = inside[heads], inside[tails]
        self.inside = inside
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._hashes = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = range_hashes(self.data, self.starts, self.ends)
        return self._hashes


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: a polynomial modulo 2**64 from prefix sums, mixed with the length."""
    n = len(data)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data] * _power(_BASE, n + 1)[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power(_INVERSE, n + 1)[starts]
        return mix64(h + (ends - starts).astype(U64) * _ODD[0])


def shingles(words: Words, k: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each window of k words; a shorter non-empty text is one window of all its words."""
    h, bounds, counts = words.hashes, words.bounds, words.counts
    windows = np.maximum(counts - k + 1, 0)
    docs = np.repeat(np.arange(len(counts)), windows)
    at = np.arange(len(docs)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(bounds[:-1], windows)
    with np.errstate(over="ignore"):
        out = np.full(len(at), k, U64)
        for j in range(k):
            out += h[at + j] * _ODD[1 + j]
        if whole_if_short:
            short = np.flatnonzero((counts > 0) & (counts < k))
            if len(short):
                tail = counts[short].astype(U64)
                for j in range(k - 1):
                    has = counts[short] > j
                    tail[has] += h[bounds[short][has] + j] * _ODD[1 + j]
                docs, out = np.concatenate([docs, short]), np.concatenate([out, tail])
    return docs, mix64(out)


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte (or per-word) array within each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
