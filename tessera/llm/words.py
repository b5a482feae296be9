"""Words of many texts at once, on the bytes of an Arrow column.

Words are runs of anything but the six ASCII white-space characters, so splitting bytes
equals splitting characters.  No Python object is made per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.common import large_binary

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20_240_607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step for 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset at which each text starts (one more at the end)."""
    array = large_binary(column)
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    n = len(array)
    start = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8) if n else np.zeros(1, np.int64)
    if data is None or not len(data):
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return (np.frombuffer(data, np.uint8)[start[0]:start[-1]], start - start[0])


@dataclass
class Spans:
    """Spans of bytes, in order; those of text i are ``first[i]:first[i + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Number of the text of each span."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        n = len(self.data)
        if not n or not len(self.start):
            return np.zeros(len(self.start), np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _power(_BASE, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power(_INVERSE, n + 1)[self.start]
        return mix(h ^ (self.end - self.start).astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def words(data: np.ndarray, offsets: np.ndarray) -> Spans:
    n = len(data)
    inside = ~_SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    edges = offsets[:-1]
    before[edges[edges < n]] = True
    edges = offsets[1:]
    after[edges[edges > 0] - 1] = True
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return Spans(data, start, end, np.searchsorted(start, offsets))


def lines(data: np.ndarray, offsets: np.ndarray) -> Spans:
    """Lines between line feeds; every text has one at least."""
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate((offsets[:-1], cut + 1)), kind="stable")
    end = np.sort(np.concatenate((offsets[1:], cut)), kind="stable")
    number = np.searchsorted(cut, offsets) + np.arange(len(offsets))
    return Spans(data, start, end, number)


def grams(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive values of one text, and the place of the first of each."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = h[:n].copy()
    for j in range(1, size):
        acc = acc * _BASE + h[j:j + n]
    place = np.arange(n)
    last = np.repeat(first[1:], np.diff(first))[:n]
    keep = place + size <= last
    return mix(acc[keep]), place[keep]
