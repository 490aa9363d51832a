"""Repeated word windows by recompression.

Words become symbols. In every round runs of a symbol and then pairs of neighbouring symbols become new symbols. A pair
is taken if a hash bit, drawn anew for the round, is 0 for its left and 1 for its right symbol, so neighbouring pairs
never compete. The name of a new symbol is a 64-bit fingerprint of what it replaces and the round: equal runs and pairs have
the same name in every task, with no dictionary to ship.

Every symbol carries the words its parse depends on: itself, and the neighbours that could have merged with it. If a
window holds those words, every other occurrence of the window holds the same symbol at the same place. The window's
anchor is the longest such symbol (of equals the greatest name, then the leftmost); a window with none is its own anchor. The
naming rounds run inside each task, text by text; Spark then counts the names: symbols shared by several places reveal
the repeats. Zones that differ are compared word by word; equality of whole zones, and of the windows of a name with very
many zones, rests on 64-bit digests (``repeats``).

Defined results: null texts have no words; texts with fewer words than a window have no repeats; rows with equal texts
repeat each other; long texts are taken whole, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from nearmark.llm.repeats import Method, Zones, digests, repeated_spans
from nearmark.llm.text import Chunk, mix, prefix_sums, range_hash, word_hashes, words

SIZE = 35
ROUNDS = 12
# Rounds that also name runs. A run depends on both its neighbours, which widens what every symbol depends on.
RUN_ROUNDS = (0, 3, 6, 9)
_FAR = np.int64(1 << 40)


def _round_number(round_no: int) -> np.uint64:
    return mix(np.array([round_no + 1], np.uint64))[0]


class Symbols:
    """A parse: names, word ranges, the words each depends on, and its document."""

    def __init__(self, name, start, end, low, high, owner):
        self.name, self.start, self.end, self.low, self.high, self.owner = name, start, end, low, high, owner

    def __len__(self) -> int:
        return len(self.name)

    def take(self, at: np.ndarray) -> Symbols:
        return Symbols(*(x[at] for x in (self.name, self.start, self.end, self.low, self.high, self.owner)))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether the symbol before and the symbol after is of the same document."""
        same = self.owner[1:] == self.owner[:-1]
        return np.concatenate([[False], same]), np.concatenate([same, [False]])


def name_runs(s: Symbols, round_no: int) -> tuple[Symbols, np.ndarray]:
    """Runs of two and more equal symbols become one; also which symbols are new."""
    before, after = s.neighbours()
    n = len(s)
    head = np.ones(n, bool)
    head[1:] = ~before[1:] | (s.name[1:] != s.name[:-1])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:], [n]]) - 1
    count = (last - first + 1).astype(np.uint64)
    out = s.take(first)
    out.end = s.end[last]
    # Where a run ends is only known with the symbol beyond it, or not at all at the edge of a text.
    prior, next_ = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    edge = ~(before[first] & after[last])
    out.low = np.minimum(np.minimum.reduceat(s.low, first), np.minimum(s.low[prior], s.low[next_]))
    out.high = np.maximum(np.maximum.reduceat(s.high, first), np.maximum(s.high[prior], s.high[next_]))
    out.low[edge], out.high[edge] = -_FAR, _FAR
    many = count > 1
    out.name = np.where(many, mix(out.name * np.uint64(0xD6E8FEB86659FD93) + count * np.uint64(0xA0761D6478BD642F)
                                  + np.uint64(round_no)), out.name)
    return out, many


def name_pairs(s: Symbols, round_no: int) -> tuple[Symbols, np.ndarray]:
    """Pairs of a left and a right symbol become one; also which symbols are new."""
    before, after = s.neighbours()
    n = len(s)
    right = (mix(s.name + _round_number(round_no)) & np.uint64(1)).astype(bool)
    heads = np.zeros(n, bool)
    heads[:-1] = after[:-1] & ~right[:-1] & right[1:]
    tails = np.concatenate([[False], heads[:-1]])
    alone = ~heads & ~tails
    low, high = s.low.copy(), s.high.copy()
    # A left symbol stays alone because of what follows, a right one because of what comes before.
    follows = np.where(after, np.concatenate([s.high[1:], s.high[:1]]), _FAR)
    precedes = np.where(before, np.concatenate([s.low[-1:], s.low[:-1]]), -_FAR)
    # The neighbour's own place must be known too, on both of its sides.
    follows_low = np.where(after, np.concatenate([s.low[1:], s.low[:1]]), -_FAR)
    precedes_high = np.where(before, np.concatenate([s.high[-1:], s.high[:-1]]), _FAR)
    left_alone, right_alone = alone & ~right, alone & right
    high = np.where(left_alone, np.maximum(high, follows), high)
    low = np.where(left_alone & after, np.minimum(low, follows_low), low)
    low = np.where(right_alone, np.minimum(low, precedes), low)
    high = np.where(right_alone & before, np.maximum(high, precedes_high), high)
    pair = np.flatnonzero(heads)
    name, end = s.name.copy(), s.end.copy()
    name[pair] = mix(s.name[pair] * np.uint64(0xE7037ED1A0B428DB) + mix(s.name[pair + 1] + np.uint64(0x8EBC6AF09C88C6E3))
                     + np.uint64(round_no))
    end[pair] = s.end[pair + 1]
    low[pair] = np.minimum(s.low[pair], s.low[pair + 1])
    high[pair] = np.maximum(s.high[pair], s.high[pair + 1])
    kept = np.flatnonzero(~tails)
    return Symbols(name, s.start, end, low, high, s.owner).take(kept), heads[kept]


def _paint(size: int, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """At every place the greatest value of the ranges [low, high] that cover it."""
    width = high - low + 1
    levels = int(width.max()).bit_length() if len(width) else 0
    above = np.zeros(size, np.uint64)
    for level in reversed(range(levels)):
        # Ranges of 2 ** level to 2 ** (level + 1) - 1 places are two overlapping runs of 2 ** level.
        mine = (width >> level) == 1
        span = 1 << level
        np.maximum.at(above, low[mine], value[mine])
        np.maximum.at(above, high[mine] - span + 1, value[mine])
        if level:
            half = span >> 1
            below = above.copy()
            below[half:] = np.maximum(below[half:], above[:-half])
            above = below
    return above


def zones(chunk: Chunk, size: int = SIZE) -> Zones:
    found = words(chunk)
    hashes = word_hashes(chunk, found)
    n = len(hashes)
    counts = found.counts
    windows = np.maximum(counts - size + 1, 0)
    if not windows.sum():
        empty = np.zeros(0, int)
        return Zones(empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    place = np.arange(n)
    s = Symbols(hashes, place, place + 1, place, place + 1, np.repeat(np.arange(chunk.n), counts))
    names, starts, lows, highs, lengths = [hashes], [place], [place], [place + 1], [np.ones(n, int)]
    for round_no in range(ROUNDS):
        steps = (name_runs, name_pairs) if round_no in RUN_ROUNDS else (name_pairs,)
        for step in steps:
            s, new = step(s, round_no)
            new &= s.high - s.low <= size
            for to, x in ((names, s.name), (starts, s.start), (lows, s.low), (highs, s.high), (lengths, s.end - s.start)):
                to.append(x[new])
    # Plain words are anchors only through the symbols they form; a window without such a symbol anchors itself.
    names, starts, lows, highs, lengths = (np.concatenate(x[1:]) for x in (names, starts, lows, highs, lengths))
    # Longest first, then by name, then leftmost: 6, 26 and 32 bits. Symbols at one place differ in length.
    order = np.lexsort((lengths, starts))
    names, starts, lows, highs, lengths = (x[order] for x in (names, starts, lows, highs, lengths))
    rank = np.arange(len(names))
    value = ((np.minimum(lengths, 63).astype(np.uint64) << np.uint64(58))
             | ((names >> np.uint64(38)) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - rank.astype(np.uint64)))
    best = _paint(n, np.maximum(highs - size, 0), lows, value)

    owner = np.repeat(np.arange(chunk.n), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + found.bounds[:-1][owner]
    best = best[start]
    chosen = (np.uint64(0xFFFFFFFF) - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)
    own = best == 0
    sums = prefix_sums(hashes)
    chosen = np.where(own, -1 - start, chosen)
    new = np.ones(len(owner), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(owner)]]) - 1
    owner, first, last, chosen, own = owner[head], start[head], start[tail], chosen[head], own[head]
    anchor = np.where(own, first, starts[np.maximum(chosen, 0)] if len(starts) else first)
    name = np.where(own, range_hash(sums, first, first + size), names[np.maximum(chosen, 0)] if len(names) else np.uint64(0))
    digest = range_hash(sums, first, last + size) ^ ((anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = found.bounds[:-1][owner]
    return Zones(owner, name, digest, first - base, last - base, anchor - base)


def _contents(chunk: Chunk, size: int = SIZE):
    found = words(chunk)
    hashes = word_hashes(chunk, found)

    def take(doc: int, first: int, last: int) -> bytes:
        base = found.bounds[doc]
        return hashes[base + first:base + last + size].tobytes()

    return take


def _window_digests(body: bytes, windows: int, size: int = SIZE) -> np.ndarray:
    start = np.arange(windows)
    return range_hash(prefix_sums(np.frombuffer(body, np.uint64)), start, start + size)


def resolve(group: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, bodies: list[bytes],
            size: int = SIZE) -> list[np.ndarray]:
    """For each zone, whether each of its windows is also in another zone of its group, at the same place of the anchor."""
    counts = last - first + 1
    offset = np.concatenate([[0], np.cumsum(counts)])
    zone = np.repeat(np.arange(len(counts)), counts)
    flat = np.frombuffer(b"".join(bodies), np.uint64)
    base = np.concatenate([[0], np.cumsum(counts + size - 1)])[zone]
    inside = np.arange(offset[-1]) - offset[zone]
    digest = range_hash(prefix_sums(flat), base + inside, base + inside + size)
    place = (anchor - first)[zone] - inside
    order = np.lexsort((place, digest, group[zone]))
    a, b = order[1:], order[:-1]
    same = (digest[a] == digest[b]) & (place[a] == place[b]) & (group[zone[a]] == group[zone[b]])
    # Equal digests are confirmed word by word.
    at = np.flatnonzero(same)
    for low in range(0, len(at), 4096):
        part = at[low:low + 4096]
        x, y = ((base + inside)[order[part + k]][:, None] + np.arange(size) for k in (1, 0))
        same[part] &= (flat[x] == flat[y]).all(axis=1)
    hit = np.zeros(offset[-1], bool)
    hit[a[same]] = True
    hit[b[same]] = True
    return [hit[lo:hi] for lo, hi in zip(offset, offset[1:], strict=False)]


METHOD = Method(SIZE, zones, _contents, resolve, _window_digests)


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with ``spans``: word ranges of each text covered by windows of 35 words that start elsewhere too."""
    return repeated_spans(docs, METHOD, key, text)


def _summary(chunk: Chunk, spans: list[list[tuple[int, int]]]) -> dict:
    found = words(chunk)
    kept, removed = [], []
    for d, x in enumerate(spans):
        low, high = found.bounds[d], found.bounds[d + 1]
        gone = np.zeros(high - low, bool)
        for start, end in x:
            gone[start:end] = True
        stay = np.flatnonzero(~gone) + low
        removed.append(int(gone.sum()))
        body = chunk.data.data
        kept.append(hashlib.sha256(b" ".join([bytes(body[s:e]) for s, e in zip(
            found.start[stay].tolist(), found.end[stay].tolist(), strict=True)])).hexdigest())
    return {"n_words": found.counts.astype(np.int64), "n_removed": np.array(removed, np.int64), "kept_sha256": kept}


def summary(marked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes and a digest of what stays, from ``repeated_words``."""
    return digests(marked, _summary, f"{key} long, n_words long, n_removed long, kept_sha256 string", key, text)
