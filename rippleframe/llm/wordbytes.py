"""Array helpers for the Arrow tasks of this subpackage.

A batch of texts is read as one flat UTF-8 byte array with document offsets, in
pieces of bounded size, so that words, hashes and counts are numpy expressions
over bytes. Every hash here is a fixed function of the bytes: all executors and
all runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    h = h + _STEP
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_CODES = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def byte_table(chars: bytes, inside: bool = True) -> np.ndarray:
    table = np.full(256, not inside)
    table[list(chars)] = inside
    return table


#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Everything in ASCII but letters and digits.
PUNCTUATION = byte_table(bytes(c for c in range(128) if not chr(c).isalnum()))
UPPER = byte_table(bytes(range(65, 91)))
LOWERCASE = byte_table(bytes(range(97, 123)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals of UTF-8 lower-cased."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[capital] += 0x20
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = PIECE_BYTES + 1
    while size < n:
        size *= 2
    return _powers(size)


class Prefix:
    """Hashes of any byte ranges of one array, from a running polynomial sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=self.sums[1:])

    def sum(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What of() is made of: the polynomial value of bytes starts..ends, not mixed and without their number."""
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of bytes starts..ends (end exclusive); ranges of other lengths differ too."""
        return mix(self.sum(starts, ends) ^ mix((ends - starts).astype(np.uint64)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): runs of up to `rows` rows and about `limit` bytes; a longer text is a run of its own."""
    data, offsets = flat(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), at + rows, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_ranges(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of maximal runs of bytes outside `gaps`; runs never cross documents."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~gaps[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def chained(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of k words that lies in one document."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(h) - k + 1
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    out = h[at].copy()
    for i in range(1, k):
        out = mix(out * np.uint64(3) + h[at + i])
    return at, out


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))
