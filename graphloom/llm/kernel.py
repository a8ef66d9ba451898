"""Vectorised text kernels over the byte buffers of Arrow string columns.

A text is a sequence of words. Two splittings are used: `verbatim` words are maximal runs of bytes
other than ASCII white space; `folded` words are maximal runs of ASCII letters, digits and non-ASCII
bytes after lowering ASCII and Latin-1 letters. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xD6E8FEB86659FD93)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_WORD = np.ones(256, bool)
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


_P_INV, _Q_INV = (np.uint64(pow(int(x), -1, 1 << 64)) for x in (_P, _Q))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def _run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, inverse: np.uint64) -> np.ndarray:
    """Polynomial hashes of values[start:end] by differences of one running sum."""
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.multiply(values, _powers(base, len(values)), out=total[1:])
    np.add.accumulate(total, out=total)
    h = total[ends] - total[starts]
    h *= _powers(inverse, len(values) + 1)[starts]
    return h


def prefix_hash(words: np.ndarray) -> np.ndarray:
    """Running sums from which run_hash() takes the hash of any run of words."""
    total = np.empty(len(words) + 1, np.uint64)
    total[0] = 0
    np.multiply(words, _powers(_Q, len(words)), out=total[1:])
    return np.add.accumulate(total, out=total)


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs by their words alone, wherever they stand."""
    return (sums[end] - sums[start]) * _powers(_Q_INV, len(sums))[start]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k words; entry i is of words[i : i + k]."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step, out = 1 << 18, []
    for a in range(0, n, step):
        m = min(step, n - a)
        at = np.arange(m)
        out.append(_run_hashes(words[a : a + m + k - 1], at, at + k, _Q, _Q_INV))
    return mix(out[0] if len(out) == 1 else np.concatenate(out))


@dataclass
class Words:
    """The words of some texts: byte spans within `buf`, hashes, and the first word of each text."""

    buf: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def lowered(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 as small letters."""
    low = _LOWER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) + 1
    if len(lead):
        x = buf[lead]
        low[lead[(x >= 0x80) & (x <= 0x9E) & (x != 0x97)]] += 0x20
    return low


def words_of(buf: np.ndarray, offsets: np.ndarray, folded: bool = False) -> Words:
    """Split texts, which lie one after the other in buf at offsets, into words."""
    if folded:
        buf = lowered(buf)
    inside = ~(_NOT_WORD if folded else _SPACE)[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):  # cut long buffers at word borders: powers stay within a small table
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK_BYTES, "right")))
        low, high = starts[a], ends[b - 1]
        hashes[a:b] = _run_hashes(buf[low:high].astype(np.uint64) + np.uint64(1), starts[a:b] - low, ends[a:b] - low, _P, _P_INV)
        a = b
    return Words(buf, offsets, starts, ends, mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type in (pa.large_string(), pa.large_binary()):
        kind = np.int64
    else:
        if column.type not in (pa.string(), pa.binary()):
            column = column.cast(pa.string())
        kind = np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together; a longer text is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_slices(column: pa.Array, folded: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """(number of the first text, Words) for successive slices of a column."""
    buf, offsets = string_bytes(column)
    for a, b in slices(offsets, most):
        low = offsets[a]
        yield a, words_of(buf[low : offsets[b]], offsets[a : b + 1] - low, folded)
