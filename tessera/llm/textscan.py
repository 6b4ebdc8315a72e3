"""Vectorised text scanning: words, hashes and shingles of a whole Arrow batch with numpy.

A batch of texts is one byte buffer with offsets. Separators are found by a 256-entry
table, words are maximal runs between them inside one text, and the hash of a word is a
difference of polynomial prefix sums modulo 2**64 (the multiplier is odd, so powers can be
divided out). No Python loop runs over words or texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is scanned whole, its words hashed as many bytes at a time.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_ALL = np.arange(256)
#: Separators of the contracts' words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13))
#: Everything of ASCII that is neither letter nor digit.
NON_WORD = (_ALL < 128) & ~(
    ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122))
)
_LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        if size > 4 * SLICE_BYTES:
            return tables[0], tables[1]
        _POWERS[:] = tables
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(31))


@dataclass
class Scan:
    """Words of some texts. start/end: byte spans in buf; doc: index of each word's text; first: number of words before each text."""

    lo: int
    n: int
    buf: np.ndarray
    low: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, ASCII letters lower-cased: its bytes' polynomial, wherever it stands."""
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            lo = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, lo + SLICE_BYTES, side="right")))
            n = int(self.end[j - 1]) - lo
            power, inverse = _powers(n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.low[lo : lo + n].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
            a, b = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (total[b] - total[a]) * inverse[a]
            i = j
        return mix(out)


def _chunk(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.cast(pa.large_string()).fill_null("")


def slices(array: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `most` bytes: first, last, bytes, offsets in those bytes."""
    array = _chunk(array)
    n = len(array)
    if not n:
        return
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + n + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def scan(array: pa.Array, separators: np.ndarray = SPACES, most: int = SLICE_BYTES) -> Iterator[Scan]:
    """Scans of the array's texts, slice by slice, in order."""
    for lo, hi, buf, off in slices(array, most):
        word = ~separators[buf]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        begins[inner] |= word[inner]
        ends[inner - 1] |= word[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, off)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Scan(lo, hi - lo, buf, _LOWER[buf], off, start, end, doc, first)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and each text's number of them before it; a text of fewer words (but not none) has one shingle of all its words."""
    counts = np.diff(first)
    n = len(counts)
    out = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(out, out=at[1:])
    doc = np.repeat(np.arange(n), out)
    pos = first[:-1][doc] + (np.arange(at[-1]) - at[:-1][doc])
    value = np.zeros(len(pos), dtype=np.uint64)
    left = first[1:][doc] - pos
    for k in range(width):
        have = left > k
        if k == 0 or have.all():
            value = mix(value * np.uint64(_BASE) + hashes[np.minimum(pos + k, len(hashes) - 1)] + np.uint64(k + 1)) if len(pos) else value
        else:
            step = mix(value * np.uint64(_BASE) + hashes[np.minimum(pos + k, len(hashes) - 1)] + np.uint64(k + 1))
            value = np.where(have, step, value)
    return value, at
