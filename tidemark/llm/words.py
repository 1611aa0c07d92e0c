"""Words of Arrow string columns, found and hashed with whole-array operations on the UTF-8 bytes.

A word is a run of ASCII letters and digits or of any code points from U+0080; A-Z count as a-z. In UTF-8 every byte
of a code point from U+0080 is 0x80 or more, so bytes are enough. Nothing here runs once for each word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

FOLD = np.zeros(256, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for i, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low and high bits all depend on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Group:
    """Words of rows first..last-1 of a column. Word w is folded[starts[w]:ends[w]]; row r has words at[r]..at[r+1]-1."""

    first: int
    last: int
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    folded: np.ndarray

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.at))

    def word(self, w: int) -> bytes:
        return self.folded[self.starts[w] : self.ends[w]].tobytes()

    def phrase(self, w: int, n: int) -> bytes:
        """Words w..w+n-1 joined by one space."""
        return b" ".join(self.word(i) for i in range(w, w + n))

    def text(self, row: int) -> bytes:
        """All words of a row (counted from first), joined by one space."""
        a, b = self.at[row], self.at[row + 1]
        if a == b:
            return b""
        return b" ".join(self.folded[self.starts[a] : self.ends[b - 1]].tobytes().replace(b"\0", b" ").split())


def _hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # more than one turn only for rows longer than CHUNK
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(folded[a:b] * power[: b - a], out=total[1:])
        out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * inverse[starts[i:j] - a]
        i = j
    return mix(out)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def row_groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last
        first = last


def word_groups(column: pa.Array) -> Iterator[Group]:
    offsets, data = strings(column)
    for first, last in row_groups(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        folded = FOLD[data[lo:hi]]
        bounds = offsets[first : last + 1] - lo
        is_word = np.zeros(hi - lo + 2, bool)
        is_word[1:-1] = folded != 0
        inside = is_word[1:-1]
        opens, closes = inside & ~is_word[:-2], inside & ~is_word[2:]
        heads, tails = bounds[:-1][bounds[:-1] < bounds[1:]], bounds[1:][bounds[:-1] < bounds[1:]] - 1
        opens[heads] = inside[heads]  # a word never goes on into the next row
        closes[tails] = inside[tails]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        yield Group(first, last, np.searchsorted(starts, bounds), starts, ends, _hashes(folded, starts, ends), folded)


def hash_words(words: list[bytes]) -> np.ndarray:
    """Hashes of folded words, as in Group.hashes."""
    folded = np.frombuffer(b"\0".join(words) + b"\0", np.uint8) if words else np.zeros(0, np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = ends - np.array([len(w) for w in words], np.int64)
    return _hashes(folded, starts, ends) if words else np.zeros(0, np.uint64)


def split_words(text: str | None) -> list[bytes]:
    """The words of one text, folded."""
    folded = FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes()
    return [w for w in folded.split(b"\0") if w]


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words (len(hashes) - n + 1 of them), rows not regarded."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:count].copy()
    for k in range(1, n):
        total *= _BASE
        total += hashes[k : k + count]
    return mix(total)
