"""Vectorised word work on whole Arrow batches of UTF-8 texts.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  Word hashes are
polynomial hashes modulo 2**64 taken from running sums, then mixed, so no
Python code runs per word.  Hashing goes piece by piece, so its memory is a
small multiple of the text.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

#: The odd base of the polynomial and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (xor-shift and multiply), elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values in ascending order."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Tables of the base's powers, made longer on demand."""

    def __init__(self) -> None:
        self.up = self.down = _powers(1, 1)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(n, BASE), _powers(n, BASE_INVERSE)
        return self.up, self.down


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array and len+1 offsets; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def blocks(column: pa.Array, limit: int = 1 << 20):
    """Yield (first row, end row, bytes, offsets) with about `limit` bytes each;
    a longer text is a block of its own."""
    buf, offs = raw(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of a block: starts and ends in bytes, and where each text's words begin."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = True) -> None:
        self.buf = LOWER[buf] if lower else buf
        full = ~SPACE[buf]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        inner = offs[(offs > 0) & (offs < len(buf))]
        first[inner] = full[inner]
        last[inner - 1] = full[inner - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.starts, offs)  # words before each text, then all
        self.counts = np.diff(self.at)

    def hashes(self, powers: Powers) -> np.ndarray:
        return slice_hashes(self.buf, self.starts, self.ends, powers)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of slices of `buf` with ascending starts and ends."""
    out = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        base = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        hi = min(hi, len(starts))
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        n = int(e[-1])
        up, down = powers.of(n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((buf[base : base + n].astype(U64) + U64(1)) * up[:n], out=sums[1:])
        out[lo:hi] = (sums[e] - sums[s]) * down[s]
        lo = hi
    return mix(out)


def ngram_starts(words: Words, n: int) -> np.ndarray:
    """Indices of words at which n words of one text begin."""
    keep = np.ones(len(words.starts), dtype=bool)
    ends = words.at[1:]
    for k in range(1, n):
        at = ends - k
        keep[at[at >= words.at[:-1]]] = False
    return np.flatnonzero(keep)


def ngram_hashes(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words from each index of `at`; the order of words counts."""
    out = hashes[at].copy()
    for k in range(1, n):
        out = out * U64(BASE) + hashes[at + k]
    return mix(out + U64(n))
