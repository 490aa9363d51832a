"""Whole texts as bytes and words inside Arrow tasks.

A chunk is a run of documents of one Arrow batch, a few MB at most unless a single text is longer, so that the
arrays a task holds do not grow with the batch. All hashes are 64-bit and the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE_VALUE = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE), np.full(size, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = _powers(1 << max(20, int(n).bit_length()))
    return up[:n], down[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums over prefixes that turn any range of values into one hash; see ``range_hash``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], dtype=np.uint64, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], the same wherever the range lies."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * _BASE)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


@dataclass
class Chunk:
    """Documents ``first`` to ``first + n - 1`` of a batch as one byte array."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 byte offsets

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Words of a chunk: byte ranges, and the range of words of each document."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # n + 1 word offsets

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks. Null texts count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
        at = to


def words(chunk: Chunk) -> Words:
    """Maximal runs of other characters than space and 0x09 to 0x0D."""
    n = len(chunk.data)
    inside = ~_SPACE[chunk.data]
    edge = np.zeros(n + 1, bool)
    edge[chunk.bounds] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(start, end, np.searchsorted(start, chunk.bounds))


def word_hashes(chunk: Chunk, found: Words, lower: bool = False) -> np.ndarray:
    data = _LOWER[chunk.data] if lower else chunk.data
    return range_hash(prefix_sums(byte_values(data)), found.start, found.end)


def window_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` values that stay inside one document, and the document of each."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][owner]
    return range_hash(prefix_sums(hashes), start, start + size), owner
