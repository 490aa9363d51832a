"""Repeated byte strings by suffix arrays, sorted deep-shallow.

A string of ``size`` bytes is anchored at the least hash among its grams of ``GRAM`` bytes, the leftmost of equals, so
suffixes are needed at anchors only. Zones that share an anchor's gram but differ as a whole are compared by two suffix
arrays, one of the bytes from the anchor on and one of the bytes before it, read backwards. A string with l bytes before
the anchor is repeated exactly if another zone has the same l bytes before and the same size - l bytes after it: both
arrays cut into classes by their common prefixes tell that for every l at once.

Deep-shallow sorting: a multikey quicksort on super-characters of eight bytes, all groups in one pass, stops at a shallow
depth; groups that still agree there are ordered by blind tries, which branch on one byte per node and compare each
suffix once.

Defined results: null texts are empty; texts under ``size`` bytes have no repeats; rows with equal texts repeat each
other; long texts are taken whole, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from nearmark.llm.repeats import Method, Zones, digests, repeated_spans
from nearmark.llm.text import Chunk, byte_values, prefix_sums, range_hash

SIZE = 400
GRAM = 100
# Super-characters after which the quicksort hands over to the tries.
SHALLOW = 4


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def zones(chunk: Chunk, size: int = SIZE, gram: int = GRAM) -> Zones:
    empty = np.zeros(0, int)
    none = Zones(empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    lengths = np.diff(chunk.bounds)
    if not (lengths >= size).any():
        return none
    sums = prefix_sums(byte_values(chunk.data))
    at = np.arange(len(chunk.data) - gram + 1)
    hashes = range_hash(sums, at, at + gram)
    # The hash's upper half decides, then the place: the same choice in every chunk.
    best = _window_minimum((hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64), size - gram + 1)
    anchor = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    windows = np.maximum(lengths - size + 1, 0)
    owner = np.repeat(np.arange(chunk.n), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + chunk.bounds[:-1][owner]
    anchor = anchor[start]
    new = np.ones(len(owner), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(owner)]]) - 1
    owner, first, last, anchor = owner[head], start[head], start[tail], anchor[head]
    # Where the anchor lies in the zone belongs to its identity.
    digest = range_hash(sums, first, last + size) ^ ((anchor - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = chunk.bounds[:-1][owner]
    return Zones(owner, hashes[anchor], digest, first - base, last - base, anchor - base)


def _lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, by halving."""
    low, high = known, min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """A trie of strings whose nodes hold a depth and branch on the byte there; -1 stands for the end of a string."""

    def __init__(self, strings: list[bytes], known: int):
        self.strings, self.known = strings, known
        self.root: list | int | None = None

    def insert(self, i: int) -> None:
        """Descend blindly to some leaf, compare with it once, and branch off where they part."""
        if self.root is None:
            self.root = [None, [i]]
            return
        s = self.strings[i]
        node = self.root
        while node[0] is not None:
            depth, kids = node
            byte = s[depth] if depth < len(s) else -1
            node = kids.get(byte) or next(iter(kids.values()))
        other = self.strings[node[1][0]]
        depth = _lcp(s, other, self.known)
        mine = s[depth] if depth < len(s) else -1
        theirs = other[depth] if depth < len(other) else -1
        node = self.root
        while node[0] is not None and (node[0] < depth or (node[0] == depth and mine == theirs)):
            node = node[1][s[node[0]] if node[0] < len(s) else -1]
        if mine == theirs:  # both end here: equal strings share a leaf
            node[1].append(i)
        elif node[0] == depth:
            node[1][mine] = [None, [i]]
        else:
            node[:] = [depth, {theirs: node[:], mine: [None, [i]]}]

    def ordered(self) -> tuple[list[int], list[int]]:
        """Strings in order, and the common prefix of each with the one before; the first has none."""
        order: list[int] = []
        lcp: list[int] = []
        # A node is met with the depth at which its strings part from those before it.
        stack: list[tuple[list, int]] = [(self.root, 0)]
        while stack:
            (depth, below), parted = stack.pop()
            if depth is None:
                order += below
                lcp += [parted] + [len(self.strings[i]) for i in below[1:]]
            else:
                kids = sorted(below)
                stack += [(below[k], depth) for k in reversed(kids[1:])]
                stack.append((below[kids[0]], parted))
        return order, lcp


def _super_characters(strings: list[bytes], at: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from a depth as a number, and how many of them the string has."""
    cut = [strings[i][depth:depth + 8] for i in at]
    value = np.frombuffer(b"".join(c.ljust(8, b"\0") for c in cut), ">u8").astype(np.uint64)
    return value, np.array([len(c) for c in cut])


def _common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that two super-characters share."""
    differ = a ^ b
    same = np.zeros(len(a), int)
    for i in range(1, 9):
        same += (differ >> np.uint64(64 - 8 * i)) == 0
    return same


def sort_suffixes(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings inside their groups, and the common prefix of each with the one before it in the group.

    The common prefix is -1 where a group begins.
    """
    n = len(strings)
    order = np.argsort(group, kind="stable")
    klass = np.concatenate([[0], np.cumsum(np.diff(group[order]) != 0)]) if n else np.zeros(0, int)
    lcp = np.where(np.concatenate([[True], np.diff(klass) != 0]), -1, 0) if n else np.zeros(0, int)
    # klass[j] numbers the set of strings that are still equal at place j; lcp is known where sets begin.
    for word in range(SHALLOW):
        sizes = np.bincount(klass)
        open_at = np.flatnonzero(sizes[klass] > 1)
        if not len(open_at):
            break
        value, length = _super_characters(strings, order[open_at], 8 * word)
        inner = np.lexsort((length, value, klass[open_at]))
        order[open_at] = order[open_at][inner]
        value, length = value[inner], length[inner]
        begins = np.zeros(n, bool)
        begins[1:] = klass[1:] != klass[:-1]
        begins[0] = True
        same_set = ~begins[open_at[1:]] & (np.diff(open_at) == 1)
        parted = same_set & ((value[1:] != value[:-1]) | (length[1:] != length[:-1]) | (length[1:] < 8))
        common = 8 * word + np.minimum(_common_bytes(value[1:], value[:-1]), np.minimum(length[1:], length[:-1]))
        lcp[open_at[1:][parted]] = common[parted]
        begins[open_at[1:][parted]] = True
        klass = np.cumsum(begins) - 1
    sizes = np.bincount(klass) if n else np.zeros(0, int)
    heads = np.concatenate([[0], np.cumsum(sizes)])
    for k in np.flatnonzero(sizes > 1):
        low, high = heads[k], heads[k + 1]
        members = order[low:high]
        trie = BlindTrie([strings[i] for i in members], 8 * SHALLOW)
        for i in range(len(members)):
            trie.insert(i)
        inside, common = trie.ordered()
        order[low:high] = members[inside]
        lcp[low + 1:high] = common[1:]
    return order, lcp


def resolve(group: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, bodies: list[bytes],
            size: int = SIZE) -> list[np.ndarray]:
    """For each zone, whether each of its strings is also in another zone of its group."""
    before = anchor - first
    right = sort_suffixes([b[k:] for b, k in zip(bodies, before, strict=True)], group)
    left = sort_suffixes([b[:k][::-1] for b, k in zip(bodies, before, strict=True)], group)
    flags = [np.zeros(n, bool) for n in last - first + 1]
    offset = np.concatenate([[0], np.cumsum(last - first + 1)])
    flat = np.zeros(offset[-1], bool)

    def classes(ordered: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
        order, lcp = ordered
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(lcp < depth)
        return out

    # l bytes of a string lie before the anchor; a zone has the strings from anchor - last to anchor - first.
    for l in range(int((anchor - last).min()), int(before.max()) + 1):  # noqa: E741
        there = np.flatnonzero((anchor - last <= l) & (l <= before))
        if len(there) < 2:
            continue
        both = classes(right, size - l)[there] * (len(group) + 1) + (classes(left, l)[there] if l else 0)
        # With no byte before the anchor all zones of a group agree on the left; the right side tells groups apart.
        order = np.argsort(both, kind="stable")
        same = np.diff(both[order]) == 0
        hit = np.zeros(len(there), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        zone = there[hit]
        flat[offset[zone] + (before[zone] - l)] = True
    for i in range(len(flags)):
        flags[i] = flat[offset[i]:offset[i + 1]]
    return flags


def _contents(chunk: Chunk, size: int = SIZE):
    def take(doc: int, first: int, last: int) -> bytes:
        base = chunk.bounds[doc]
        return chunk.data[base + first:base + last + size].tobytes()

    return take


def _window_digests(body: bytes, windows: int, size: int = SIZE) -> np.ndarray:
    start = np.arange(windows)
    return range_hash(prefix_sums(byte_values(np.frombuffer(body, np.uint8))), start, start + size)


METHOD = Method(SIZE, zones, _contents, resolve, _window_digests)


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with ``spans``: byte ranges of each text covered by strings of 400 bytes that start elsewhere too."""
    return repeated_spans(docs, METHOD, key, text)


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for start, end in spans:
        out.append(data[at:start])
        at = end
    return b"".join([*out, data[at:]])


def _summary(chunk: Chunk, spans: list[list[tuple[int, int]]]) -> dict:
    lengths = np.diff(chunk.bounds)
    body = [chunk.data[a:b].tobytes() for a, b in zip(chunk.bounds, chunk.bounds[1:], strict=False)]
    return {
        "n_bytes": lengths.astype(np.int64),
        "n_removed": np.array([sum(e - s for s, e in x) for x in spans], np.int64),
        "n_spans": np.array([len(x) for x in spans], np.int64),
        "kept_sha256": [hashlib.sha256(kept_bytes(b, x)).hexdigest() for b, x in zip(body, spans, strict=True)],
    }


def summary(marked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sizes and a digest of what stays, from ``repeated_bytes``."""
    return digests(marked, _summary, f"{key} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", key, text)
