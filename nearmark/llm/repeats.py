"""Exact removal of long repeats: the Spark plan that the byte and the word operator share.

A window is a run of ``size`` units (bytes or words) of one text. A method gives each window one anchor inside it that
follows from the window's content alone, so equal windows have equal anchors at equal places. The windows of a text that
share an anchor are neighbours and make up a zone.

1. A row per zone goes out: the name of the anchor and a digest of the zone's content.
2. Names are counted. Windows whose anchor's name occurs once are unique; that settles most of a corpus.
3. Zones that occur twice or more are repeats as a whole. If one name has several zones, one occurrence of each zone
   meets the others in the task of the name, where the method finds the equal windows inside (``resolve``). A name with
   very many zones is not brought into one task: the windows themselves are counted by their digest, which a
   map-side combine keeps even. Equality of whole zones and of these windows rests on 64-bit digests alone.
4. Ranges of repeated windows return to their texts and become spans of units to remove.

Only texts with something to resolve or to remove travel; the others are read where they are. Rows are told apart by id
and a content hash, so rows that share an id do not mix; equal rows are each other's copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.llm.tables import few, narrowed, without
from nearmark.llm.text import Chunk, chunks
from nearmark.session import cut

# Distinct zones of one name that one task may hold (700 bytes each for the byte method).
HOT_ZONES = 50_000
# Rows and bytes of complete names that are resolved together.
GROUP_ROWS, GROUP_BYTES = 8192, 8 << 20

ROW = ["doc", "h"]
ZONE = ["first", "last", "anchor"]
_NULL_ID = -(1 << 63)


@dataclass
class Zones:
    """Zones of a chunk, in order of document and place; ``first`` and ``last`` are window starts."""

    owner: np.ndarray
    name: np.ndarray
    digest: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray


@dataclass(frozen=True)
class Method:
    size: int
    # The zones of all documents of a chunk.
    zones: Callable[[Chunk], Zones]
    # A function of (document, first, last) that gives a zone's content, for a chunk.
    contents: Callable[[Chunk], Callable[[int, int, int], bytes]]
    # Whether each window of each zone also starts in another zone of its group: (group, first, last, anchor, contents).
    resolve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], list[np.ndarray]]
    # Digests of the windows of one content: (content, number of windows).
    window_digests: Callable[[bytes, int], np.ndarray]


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.withColumn("doc", F.coalesce(F.col(key).cast("long"), F.lit(_NULL_ID))).withColumn(
        "h", F.hash(F.coalesce(F.col(text), F.lit(""))))


def _mark(method: Method):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                z = method.zones(chunk)
                if not len(z.owner):
                    continue
                at = pa.array(z.owner + chunk.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at),
                     *(pa.array(x.view(np.int64)) for x in (z.name, z.digest)),
                     *(pa.array(x.astype(np.int32)) for x in (z.first, z.last, z.anchor))],
                    [*ROW, "name", "digest", *ZONE])

    return run


def _cut_out(method: Method):
    """One row per zone with its content, from texts with their list of zones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                take = method.contents(chunk)
                rows = batch.slice(chunk.first, chunk.n)
                for at in range(0, chunk.n, 64):
                    part = rows.slice(at, 64)
                    owner = pa.array(np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().to_numpy()))
                    zones = part.column(3).flatten()
                    first, last = (zones.field(f).to_numpy() for f in ("first", "last"))
                    body = [take(at + d, lo, hi) for d, lo, hi in zip(owner.to_numpy(), first, last, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(owner), part.column(1).take(owner),
                         *(zones.field(f) for f in ("name", *ZONE, "times")), pa.array(body, pa.binary())],
                        [*ROW, "name", *ZONE, "times", "body"])

    return run


def _ranges(flags: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zone, first and last window start of each run of set flags."""
    zone, low, high = [], [], []
    for i, f in enumerate(flags):
        if f.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
            zone += [i] * (len(edge) // 2)
            low.append(edge[::2] + first[i])
            high.append(edge[1::2] - 1 + first[i])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, int)
    return np.array(zone, int), join(low), join(high)


def _resolved(method: Method):
    """Ranges of repeated windows of zones that occur once, from rows sorted by name."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        group, first, last, anchor, times = (table.column(c).to_numpy() for c in ("name", *ZONE, "times"))
        flags = method.resolve(group, first, last, anchor, table.column("body").to_pylist())
        zone, low, high = _ranges([f if t == 1 else np.zeros(1, bool) for f, t in zip(flags, times, strict=True)], first)
        rows = table.select(ROW).combine_chunks().take(pa.array(zone))
        return pa.RecordBatch.from_arrays(
            [*(rows.column(c).combine_chunks() for c in ROW), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
            [*ROW, "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                held.append(batch.slice(at, GROUP_ROWS))
                if sum(b.num_rows for b in held) < GROUP_ROWS and sum(b.nbytes for b in held) < GROUP_BYTES:
                    continue
                table = pa.Table.from_batches(held)
                names = table.column("name").to_numpy()
                whole = int(np.searchsorted(names, names[-1], "left"))
                if whole:
                    yield solve(table.slice(0, whole))
                    held = table.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield solve(pa.Table.from_batches(held))

    return run


def _windows(method: Method):
    """A row per window of each zone, with a digest of its content and its place from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                first, last, anchor = (rows.column(c).to_numpy() for c in ZONE)
                n = last - first + 1
                zone = pa.array(np.repeat(np.arange(len(n)), n))
                start = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)]).astype(np.int32)
                digest = np.concatenate([method.window_digests(b, k) for b, k in zip(rows.column("body").to_pylist(), n, strict=True)])
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c).take(zone) for c in (*ROW, "name", "times")),
                     pa.array(np.repeat(anchor, n) - start), pa.array(digest.view(np.int64)), pa.array(start)],
                    [*ROW, "name", "times", "place", "window", "first"])

    return run


def _merged(size: int):
    """Spans of units covered by ranges of windows, one row per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for ranges in batch.column(2).to_pylist():
                out: list[dict[str, int]] = []
                for r in sorted((r["first"], r["last"] + size) for r in ranges):
                    if out and r[0] <= out[-1]["end"]:
                        out[-1]["end"] = max(out[-1]["end"], r[1])
                    else:
                        out.append({"start": r[0], "end": r[1]})
                spans.append(out)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], [*ROW, "spans"])

    return run


def repeated_spans(docs: DataFrame, method: Method, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with ``spans``, an array of the unit ranges that repeated windows cover (end exclusive, disjoint)."""
    columns = [c for c in docs.columns if c != "spans"]
    work = docs.select(*[F.col(c).alias(f"_in_{i}") for i, c in enumerate(columns)])
    key, text = f"_in_{columns.index(key)}", f"_in_{columns.index(text)}"
    rows = _rows(work, key, text)
    body = rows.select(*ROW, F.col(text).alias("text"))

    marks = cut(body.mapInArrow(
        _mark(method), "doc long, h int, name long, digest long, first int, last int, anchor int"), "zones")
    # Written before it meets the zones, so that the join can split a hot name.
    names = cut(marks.groupBy("name").agg(
        F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1").select(
        "name", (F.col("low") != F.col("high")).alias("several")), "shared-names")
    shared = cut(marks.join(names, "name"), "shared-zones")

    plain = shared.where("NOT several").select(*ROW, "first", "last")
    several = shared.where("several")
    zones = cut(several.groupBy("name", "digest").agg(
        F.count("*").alias("times"), F.min(F.struct(*ROW, *ZONE)).alias("one")), "distinct-zones")
    repeated = several.join(zones.where("times > 1").select("name", "digest"), ["name", "digest"]).select(*ROW, "first", "last")

    wanted = zones.select("one.doc", "one.h", F.struct("name", *[f"one.{c}" for c in ZONE], "times").alias("zone"))
    wanted = wanted.groupBy(*ROW).agg(F.collect_list("zone").alias("zones"))  # at most a row for each zone of one text
    # Equal rows come twice, but all their zones occur twice too, so they only serve as partners of others.
    bodies = cut(narrowed(body, wanted, ROW).join(wanted, ROW).select(*ROW, "text", "zones").mapInArrow(
        _cut_out(method), "doc long, h int, name long, first int, last int, anchor int, times long, body binary"), "zone-bodies")

    counts = zones.groupBy("name").count()
    hot = cut(counts.where(F.col("count") > HOT_ZONES).select("name"), "hot-names")  # at most zones / HOT_ZONES rows
    local = without(bodies, hot, ["name"]).repartition("name").sortWithinPartitions("name")
    found = local.mapInArrow(_resolved(method), "doc long, h int, first int, last int")
    if not hot.isEmpty():
        windows = narrowed(bodies, hot, ["name"]).mapInArrow(
            _windows(method), "doc long, h int, name long, times long, place int, window long, first int")
        windows = cut(windows, "hot-windows")
        same = ["name", "place", "window"]
        twice = windows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        found = found.unionByName(windows.where("times = 1").join(twice, same).select(*ROW, "first", F.col("first").alias("last")))

    ranges = plain.unionByName(repeated).unionByName(found)
    spans = cut(ranges.groupBy(*ROW).agg(F.collect_list(F.struct("first", "last")).alias("ranges")).mapInArrow(
        _merged(method.size), "doc long, h int, spans array<struct<start:int,end:int>>"), "spans")

    none = F.array().cast("array<struct<start:int,end:int>>")
    if few(spans):
        touched = narrowed(rows, spans, ROW).join(spans, ROW)
        done = touched.unionByName(without(rows, spans, ROW).withColumn("spans", none))
    else:
        done = rows.join(spans, ROW, "left").withColumn("spans", F.coalesce("spans", none))
    return done.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(columns)], "spans")


def digests(df: DataFrame, one: Callable[[Chunk], Any], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the columns that ``one(chunk, spans)`` gives for texts and their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                rows = batch.slice(chunk.first, chunk.n)
                spans = [[(s["start"], s["end"]) for s in x] for x in rows.column(2).to_pylist()]
                made = one(chunk, spans)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(v) for v in made.values())], [key, *made])

    return df.select(key, text, "spans").mapInArrow(run, schema)
