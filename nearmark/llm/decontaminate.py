"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments of at most ``span`` characters. A segment of m characters that occurs in
a text with at most k edits shares at least m + 1 - q - k * q of its q-grams with it, and all of them lie on
diagonals (place in the text minus place in the segment) at most k apart. Shared grams are counted per segment and band
of diagonals; bands overlap by k, so some band holds all of an occurrence's grams. Bands that reach the bound are
verified by an alignment restricted to the band.

Segments start at every ``step``-th place and at the last one, so each passage of at least ``span + step - 1`` characters
of an item holds a whole segment, wherever the passage begins. Such a passage is found if its segment has at most
``edits(span)`` edits, whatever surrounds it. Items of up to ``span`` characters are one segment; those shorter than
``min_chars`` are searched without edits.

Characters are code points, in lower case where that keeps the length; a run of white space is one blank, and items lose it
at both ends. Hits are places in the text as it came.

Defined results: null and empty texts and items match nothing, nor do items of white space; equal items are all reported; repeated rows get equal results; texts are searched whole;
an empty table of either kind gives no match; an input column that has the name of the result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nearmark.llm.text import Chunk, chunks, prefix_sums, range_hash

HITS = "array<struct<item_id:bigint,start:bigint,end:bigint,edits:int>>"
# Bytes of benchmark text whose index one task holds; a larger benchmark is searched slice by slice.
INDEX_BYTES = 7 << 20
# Bands verified together.
ALIGNED = 2048

_FOLD = np.arange(0x600, dtype=np.uint32)
for _c in range(0x600):
    _low = chr(_c).lower()
    _FOLD[_c] = 0x20 if chr(_c).isspace() else ord(_low) if len(_low) == 1 else _c
# White space beyond that table.
_BLANKS = np.array([c for c in range(0x600, 0x10000) if chr(c).isspace()], np.uint32)


@dataclass(frozen=True)
class Settings:
    q: int = 8
    span: int = 50
    step: int = 10
    edit_rate: float = 0.08
    band: int = 32
    min_chars: int = 40

    def edits(self, length: int) -> int:
        return int(self.edit_rate * length) if length >= self.min_chars else 0

    def least_shared(self, length: int) -> int:
        return max(1, length + 1 - self.q - self.edits(length) * self.q)


def characters(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of UTF-8 bytes, the bounds of the texts among them, and the place of each in its text."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    points = np.where(points < 0x600, _FOLD[np.minimum(points, 0x5FF)], points)
    high = np.flatnonzero(points >= 0x600)
    points[high[np.isin(points[high], _BLANKS)]] = 0x20
    blank = points == 0x20
    keep = np.ones(len(points), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[heads[:-1][heads[:-1] < len(points)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[heads]
    return points[keep], kept, np.flatnonzero(keep) - np.repeat(heads[:-1], np.diff(kept))


class Index:
    """q-grams of all segments of some items."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        self.settings = settings
        self.item, self.pattern, gram, segment, place = [], [], [], [], []
        self.brief: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}  # items without a gram: by length, then hash
        q = settings.q
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            points, _, _ = characters(raw, np.array([0, len(raw)]))
            solid = np.flatnonzero(points != 0x20)
            if not len(solid):
                continue
            points = points[solid[0]:solid[-1] + 1]
            n = len(points)
            if n < q:
                own = range_hash(prefix_sums(points.astype(np.uint64)), np.array([0]), np.array([n]))[0]
                self.brief.setdefault(n, {}).setdefault(int(own), []).append((item_id, points))
                continue
            starts = [0] if n <= settings.span else sorted({*range(0, n - settings.span, settings.step), n - settings.span})
            for start in starts:
                pattern = points[start:start + settings.span]
                at = np.arange(len(pattern) - q + 1)
                gram.append(range_hash(prefix_sums(pattern.astype(np.uint64)), at, at + q))
                segment.append(np.full(len(at), len(self.pattern)))
                place.append(at)
                self.item.append(item_id)
                self.pattern.append(pattern)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        gram, segment, place = join(gram, np.uint64), join(segment, np.int64), join(place, np.int64)
        order = np.argsort(gram, kind="stable")
        self.segment, self.place = segment[order], place[order]
        self.gram, self.first, self.times = np.unique(gram[order], return_index=True, return_counts=True)
        self.length = np.array([len(p) for p in self.pattern], np.int64)
        self.edits = np.array([settings.edits(n) for n in self.length], np.int64)
        self.least = np.array([settings.least_shared(n) for n in self.length], np.int64)
        # One bit per bucket of the hash: most grams of a text are ruled out by a single look.
        bits = max(16, int(max(1, len(self.gram)) * 32).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.gram >> self.shift).astype(np.int64)] = True

    def exact(self, points: np.ndarray, owner: np.ndarray) -> list[tuple]:
        """Document, item, start, end and edits, here none, of the items without a gram; places are in the chunk."""
        hits = []
        for n, known in self.brief.items():
            if len(points) < n:
                continue
            at = np.arange(len(points) - n + 1)
            own = range_hash(prefix_sums(points.astype(np.uint64)), at, at + n)
            for p in np.flatnonzero(np.isin(own, np.array(list(known), np.uint64)) & (owner[:len(at)] == owner[n - 1:])).tolist():
                hits += [(int(owner[p]), item, p, p + n, 0) for item, pattern in known[int(own[p])]
                         if np.array_equal(pattern, points[p:p + n])]
        return hits

    def candidates(self, points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, segment and first diagonal of the bands that share enough grams."""
        q, band = self.settings.q, self.settings.band
        none = (np.zeros(0, np.int64),) * 3
        if len(points) < q or not len(self.gram):
            return none
        at = np.arange(len(points) - q + 1)
        gram = range_hash(prefix_sums(points.astype(np.uint64)), at, at + q)
        at = np.flatnonzero(self.seen[(gram >> self.shift).astype(np.int64)] & (owner[:len(at)] == owner[q - 1:]))
        found = np.minimum(np.searchsorted(self.gram, gram[at]), len(self.gram) - 1)
        same = self.gram[found] == gram[at]
        at, found = at[same], found[same]
        if not len(at):
            return none
        times = self.times[found]
        entry = np.repeat(self.first[found] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        at = np.repeat(at, times)
        segment = self.segment[entry]
        diagonal = at - self.place[entry] + self.settings.span
        number = diagonal // band
        doc = owner[at]
        # The first diagonals of a band also belong to the end of the band before it.
        early = (diagonal % band < self.edits[segment]) & (number > 0)
        segment, number, doc = (np.concatenate([x, y[early]]) for x, y in (
            (segment, segment), (number, number - 1), (doc, doc)))
        bands = int(number.max()) + 1
        key, count = np.unique((doc * len(self.item) + segment) * bands + number, return_counts=True)
        key = key[count >= self.least[key // bands % len(self.item)]]
        rest = key // bands
        return rest // len(self.item), rest % len(self.item), key % bands * band - self.settings.span

    def aligned(self, points: np.ndarray, bounds: np.ndarray, doc, segment, diagonal) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each segment inside its band of diagonals, and where that alignment ends."""
        edits, end = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for length in np.unique(self.length[segment]):
            mine = np.flatnonzero(self.length[segment] == length)
            width = self.settings.band + self.settings.edits(int(length))
            for low in range(0, len(mine), ALIGNED):
                part = mine[low:low + ALIGNED]
                pattern = np.stack([self.pattern[s] for s in segment[part]])
                lanes = diagonal[part][:, None] + np.arange(width)
                first, last = bounds[doc[part]][:, None], bounds[doc[part] + 1][:, None]
                cost, ramp = np.zeros((len(part), width), np.int32), np.arange(width, dtype=np.int32)
                for i in range(length):
                    place = lanes + i
                    text = points[np.clip(place, 0, len(points) - 1)]
                    differs = (text != pattern[:, i:i + 1]) | (place < first) | (place >= last)
                    step = cost + differs
                    step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # a pattern character left out
                    cost = np.minimum.accumulate(step - ramp, axis=1) + ramp  # text characters put in
                best = cost.argmin(axis=1)
                edits[part] = cost[np.arange(len(part)), best]
                end[part] = lanes[np.arange(len(part)), best] + length
        return edits, end

    def search(self, chunk: Chunk) -> list[list[dict]]:
        """Hits of each document of a chunk: item, code point range, least edits; ranges of an item that meet are joined."""
        out: list[list[dict]] = [[] for _ in range(chunk.n)]
        points, bounds, place = characters(chunk.data, chunk.bounds)
        owner = np.repeat(np.arange(chunk.n), np.diff(bounds))
        hits = self.exact(points, owner)
        doc, segment, diagonal = self.candidates(points, owner)
        if len(doc):
            edits, end = self.aligned(points, bounds, doc, segment, diagonal)
            good = edits <= self.edits[segment]
            doc, segment, edits, end = doc[good], segment[good], edits[good], end[good]
            start = np.maximum(end - self.length[segment], bounds[doc])
            end = np.minimum(end, bounds[doc + 1])
            hits += zip(doc.tolist(), [self.item[s] for s in segment], start.tolist(), end.tolist(), edits.tolist(), strict=True)
        hits = [(d, item, int(place[lo]), int(place[hi - 1]) + 1, e) for d, item, lo, hi, e in hits]
        hits.sort(key=lambda h: (h[0], h[1] is not None, h[1] or 0, h[2], h[3]))
        for d, item, lo, hi, e in hits:
            last = out[d][-1] if out[d] else None
            if last and last["item_id"] == item and lo <= last["end"]:
                last["end"], last["edits"] = max(last["end"], hi), min(last["edits"], e)
            else:
                out[d].append({"item_id": item, "start": lo, "end": hi, "edits": e})
        return out


def _searched(df: DataFrame, at: int, index: Index) -> DataFrame:
    """Append the hits of the text column at a place to what earlier slices found, in the last column."""
    held = df.sparkSession.sparkContext.broadcast(index)
    names = df.columns
    element = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for chunk in chunks(batch.column(at)) for h in held.value.search(chunk)]
            before = batch.column(len(names) - 1).to_pylist()
            both = pa.array([b + f for b, f in zip(before, found, strict=True)], pa.list_(element))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], names)

    return df.mapInArrow(run, StructType(df.schema.fields))


def contaminations(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                   item_text: str = "text", out: str = "contamination", settings: Settings = Settings()) -> DataFrame:
    """Add the benchmark passages found in each text, as code point ranges; other columns pass through."""
    columns = [c for c in docs.columns if c != out]
    at = columns.index(text)
    found = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.array().cast(HITS).alias("found"))
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("bytes")).first().bytes
    slices = max(1, -(-size // INDEX_BYTES))
    for i in range(slices):
        part = items if slices == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == i)
        rows = [(r.item_id, r.text) for r in part.collect()]  # about INDEX_BYTES at most
        found = _searched(found, at, Index(rows, settings))
    return found.toDF(*columns, out)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows without a benchmark passage, with the columns they came with."""
    mark = "_contamination"
    return contaminations(docs, benchmark, text, out=mark, settings=settings).where(F.size(mark) == 0).drop(mark)
