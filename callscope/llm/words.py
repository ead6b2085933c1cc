"""Words of whole texts as numpy arrays, for use inside Arrow tasks.

A word is a run of bytes other than space and 0x09-0x0D.  Hashes are 64 bits wide and depend on
the bytes alone, so that every task and every run agrees on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys over the whole range."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Odd factors, one per position in an n-gram.
FACTORS = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def powers(n: int) -> list[np.ndarray]:
    """The base's first n powers and their inverses modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(max(n, _CHUNK + 1), base, U64)
            steps[0] = 1
            _powers.append(np.cumprod(steps))
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span; spans are in order and don't overlap.  Memory follows the longest span."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _CHUNK, "right")))
        part = data[low : ends[j - 1]]
        power, inverse = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(power[: len(part)] * (part.astype(U64) + U64(1)), out=sums[1:])
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


class Words:
    """Word spans of a list of texts: `doc` is the text's number for each word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.data = _LOWER[data] if lower else data
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.concatenate(([0], np.cumsum(self.lengths + 1)))
        gap = np.ones(len(data) + 2, np.int8)
        gap[1:-1] = _SPACE[data]
        edges = np.flatnonzero(np.diff(gap))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.doc = np.searchsorted(self.first, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.at = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)


def grams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word's number and hash of each run of n words within one text."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    total = hashes[:m] * FACTORS[0]
    for j in range(1, n):
        total = total + hashes[j : m + j] * FACTORS[j]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mix(total[at])


class Column:
    """A text column whose UTF-8 bytes are taken out slice by slice; null is empty."""

    def __init__(self, column: pa.Array):
        self.column = column.cast(pa.large_binary())

    def __len__(self) -> int:
        return len(self.column)

    def __getitem__(self, rows: slice) -> list[bytes]:
        return [x or b"" for x in self.column[rows].to_pylist()]

    def __iter__(self) -> Iterator[bytes]:
        return (x.as_py() or b"" for x in self.column)

    def lengths(self) -> list[int]:
        return pc.fill_null(pc.binary_length(self.column), 0).to_pylist()


def as_bytes(column: pa.Array) -> Column:
    """UTF-8 bytes of each text, none for null."""
    return Column(column)


def sized(texts: Column, limit: int = 512 << 10) -> Iterator[tuple[int, int]]:
    """Ranges of at most `limit` bytes, or of one longer text."""
    low = total = 0
    for i, length in enumerate(texts.lengths()):
        if i > low and total + length > limit:
            yield low, i
            low, total = i, 0
        total += length
    if len(texts):
        yield low, len(texts)
