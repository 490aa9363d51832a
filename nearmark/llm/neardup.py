"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check.

1. Each text becomes its set of word shingles and a MinHash signature. Texts with equal sets form one class, and only
   the document with the least id of a class goes on.
2. Bands of the signature bring classes into buckets. The number of bands follows from the chance, chosen as a
   setting, that a pair at the threshold shares none.
3. Pairs of a bucket are compared by batches of signature values. After each batch the posterior chance that the
   similarity reaches the threshold, under a uniform prior, is bounded: with m of n equal values it is
   P(Binomial(n + 1, t) <= m). A pair below the chosen miss chance is dropped, the rest is checked on the full sets.
4. Pairs inside a component change nothing, so a bucket is never expanded into all its pairs: in each round every class
   is compared with one pivot of its buckets, components are merged, and only pairs of different components go on.
5. The last round takes the classes of the buckets that still hold several components, and of their pairs those that
   share a rare shingle where similar sets must (prefix and place of the shingle in rarest-first order). That rules out
   most of the many classes that share buckets with a large group but are far from each of its members.

Defined results: texts are lower-cased A-Z; a text with fewer words than a shingle is one shingle; a null or wordless
text has no shingles and is linked with nothing; a null id is linked with nothing and has no component; rows that share
an id share a component; an empty table gives an empty table. Sets are compared by 64-bit shingle hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmark.llm.graph import components
from nearmark.llm.tables import narrowed, without
from nearmark.llm.text import chunks, mix, range_hash, prefix_sums, window_hashes, word_hashes, words
from nearmark.session import cut


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80  # a link needs 100 * intersection >= percent * union
    rows: int = 5  # signature values per band
    band_miss: float = 1e-6  # chance that a pair at the threshold meets in no bucket
    batch: int = 20  # signature values compared at a time
    prune_miss: float = 1e-5  # posterior chance of a link below which a pair is dropped
    pivot_rounds: int = 2

    @property
    def threshold(self) -> float:
        return self.percent / 100

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.band_miss) / math.log(1 - min(self.threshold, 0.999) ** self.rows))

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def least_matches(settings: Settings) -> list[tuple[int, int]]:
    """After n compared values, the least number of equal ones with which a pair is not dropped, for each batch."""
    t, out = settings.threshold, []
    for n in [*range(settings.batch, settings.hashes, settings.batch), settings.hashes]:
        chance, m = 0.0, 0
        while m <= n:
            chance += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if chance >= settings.prune_miss:
                break
            m += 1
        out.append((n, min(m, n)))
    return out


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks as ``(first document, distinct shingle hashes, bounds of each document's hashes)``, sorted per document."""
    for chunk in chunks(column):
        found = words(chunk)
        hashes = word_hashes(chunk, found, lower=True)
        shingles, owner = window_hashes(hashes, found.bounds, size)
        short = np.flatnonzero((found.counts > 0) & (found.counts < size))
        if len(short):
            sums = prefix_sums(hashes)
            shingles = np.concatenate([shingles, range_hash(sums, found.bounds[short], found.bounds[short + 1])])
            owner = np.concatenate([owner, short])
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        if len(shingles):
            new = np.ones(len(shingles), bool)
            new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
            shingles, owner = shingles[new], owner[new]
        yield chunk.first, shingles, np.searchsorted(owner, np.arange(chunk.n + 1))


def _sketches(settings: Settings):
    factors = np.random.default_rng(77).integers(1, 2**63, settings.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, packed = [], [], [], []
            for _, shingles, bounds in shingle_sets(batch.column(1), settings.words):
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                signature = np.zeros((len(n), settings.hashes), np.uint32)
                if len(full):
                    at = bounds[:-1][full]
                    sums[0, full] = np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), at)
                    sums[1, full] = np.add.reduceat(mix(shingles ^ np.uint64(0x14057B7EF767814F)), at)
                    for i, f in enumerate(factors):
                        signature[full, i] = np.minimum.reduceat(shingles * f, at) >> np.uint64(32)
                sizes.append(n)
                one.append(sums[0].view(np.int64))
                two.append(sums[1].view(np.int64))
                packed += [s.tobytes() for s in signature]
            if sizes:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (sizes, one, two)),
                     pa.array(packed, pa.binary())], ["doc_id", "n", "k1", "k2", "signature"])

    return run


def _similar(settings: Settings):
    """Keep pairs that no batch of signature values rules out."""
    limits = least_matches(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3)]
            active, equal, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), 0
            for n, least in limits:
                if not len(active):
                    break
                equal = equal + (sides[0][active, done:n] == sides[1][active, done:n]).sum(axis=1)
                kept = equal >= least
                active, equal, done = active[kept], equal[kept], n
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(active)) for i in (0, 1)], ["a", "b"])

    return run


def _linked(settings: Settings):
    """Keep pairs whose full sets are as similar as a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = []
                for side in (2, 3):
                    sets.append([s[lo:hi] for _, s, bounds in shingle_sets(part.column(side), settings.words)
                                 for lo, hi in zip(bounds, bounds[1:], strict=False)])
                keep = []
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= settings.percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], ["a", "b"])

    return run


def _shingle_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, shingles, bounds in shingle_sets(batch.column(1), settings.words):
                owner = pa.array(np.repeat(np.arange(len(bounds) - 1) + first, np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(shingles.view(np.int64))], ["node", "shingle"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The links among pairs ``a, b`` of classes."""
    pairs = cut(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    known = narrowed(classes, ends, ["node"])

    def side(name: str, value: str) -> list[Column]:
        return [F.col("node").alias(name), F.col(value).alias(f"{value}_{name}")]

    sized = pairs.join(known.select(*side("a", "n"), F.col("signature").alias("signature_a")), "a").join(
        known.select(*side("b", "n"), F.col("signature").alias("signature_b")), "b")
    near = sized.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * settings.percent)
    near = near.select("a", "b", "signature_a", "signature_b").mapInArrow(_similar(settings), "a long, b long")
    near = cut(near, "near")
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
    body = narrowed(texts, ends, ["node"])
    full = near.join(body.select(*side("a", "text")), "a").join(body.select(*side("b", "text")), "b")
    return cut(full.select("a", "b", "text_a", "text_b").mapInArrow(_linked(settings), "a long, b long"), "links")


def _open_pairs(nodes: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of classes of different components that may be links, from ``node, part`` of the open buckets.

    The shingles of a class are put in order, the rarest among these classes first. Two classes that are similar enough
    share one of their first n - ceil(t * n) + 1 shingles, and the first one they share leaves enough shingles after it in
    both. Of each shingle's classes only those outside its largest component look for partners.
    """
    t = settings.percent
    nodes = cut(nodes, "open-nodes")
    body = narrowed(texts, nodes, ["node"])
    rows = cut(body.select("node", "text").mapInArrow(_shingle_rows(settings), "node long, shingle long"), "open-shingles")
    often = cut(rows.groupBy("shingle").agg(F.count("*").alias("often")), "shingle-counts")
    ranked = rows.join(often, "shingle").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))).withColumn(
        "n", F.count("*").over(Window.partitionBy("node")))
    # Rows that share an id have several texts under one node; all their shingles count, and no place rules them out.
    texts_of = body.groupBy("node").agg((F.count("*") == 1).alias("single"))
    sizes = nodes.groupBy("part").agg(F.count("*").alias("members"))
    placed = nodes.join(sizes, "part").join(texts_of, "node")
    members = cut(ranked.join(placed, "node").where(
        (F.col("often") > 1) & (~F.col("single") | (F.col("place") <= F.col("n") - F.ceil(F.col("n") * t / 100) + 1))).select(
        "shingle", "node", "part", "members", "place", "n", "single"), "prefixes")
    heads = cut(members.groupBy("shingle").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.max(F.struct("members", "part")).alias("largest")).where(
        "low <> high").select("shingle", F.col("largest.part").alias("largest")), "prefix-heads")
    held = members.join(heads, "shingle")
    other = held.select("shingle", F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("part", "place", "n", "single")])
    after = 1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    enough = ((100 * F.least("n", "n_b") >= t * F.greatest("n", "n_b")) & ((100 + t) * after >= t * (F.col("n") + F.col("n_b"))))
    may = ((F.col("part") != F.col("part_b")) & ((F.col("part_b") == F.col("largest")) | (F.col("part") < F.col("part_b")))
           & (enough | ~F.col("single") | ~F.col("single_b")))
    return held.where("part <> largest").join(other, "shingle").where(may).select(
        F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` for each row; ids of classes and components are least ids."""
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = cut(body.mapInArrow(_sketches(settings), "doc_id long, n long, k1 long, k2 long, signature binary"), "sketches")
    equal = ["n", "k1", "k2"]
    copies = sketches.where("n > 0 AND doc_id IS NOT NULL").groupBy(*equal).agg(
        F.min("doc_id").alias("first"), F.count("*").alias("members")).where("members > 1").drop("members")
    members = cut(sketches.join(copies, equal, "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).alias("node"),
        F.when((F.col("n") > 0) & (F.col("doc_id") == F.coalesce("first", "doc_id")), F.col("signature")).alias("signature"),
    ), "members")
    # Different sets with fewer than t / (1 - t) shingles are never similar enough.
    able = (100 - settings.percent) * F.col("n") >= settings.percent
    classes = members.where(F.col("signature").isNotNull() & able).select("node", "n", "signature")
    width = 4 * settings.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), lambda i: F.xxhash64(
        i, F.substring(F.col("signature"), i * width + 1, F.lit(width))))
    banded = cut(classes.select("node", F.explode(keys).alias("band")), "bands")
    # Tables of few rows per band are written before they meet the bands, so that the join can split a hot band.
    shared = cut(banded.distinct().groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    live = cut(banded.join(shared, "band").distinct(), "live-bands")
    texts = body.withColumnRenamed("doc_id", "node")

    # The class that shares its bands with the most others is the likeliest to be close to them, so it is the pivot
    # first; later rounds shake the order.
    parts = cut(live.groupBy("node").agg(F.sum("n").alias("weight")).withColumn("part", F.col("node")), "parts")
    for round_no in range(settings.pivot_rounds + 1):
        placed = live.drop("n").join(parts, "node")
        chance = F.pmod(F.xxhash64("node", F.lit(round_no)), F.lit(1000)) / 2000
        shaken = F.lit(1.0) if not round_no else F.lit(1.0) - chance
        spread = cut(placed.groupBy("band").agg(
            F.min("part").alias("low"), F.max("part").alias("high"),
            F.min(F.struct((-F.col("weight") * shaken).alias("at"), "node", "part")).alias("pivot"),
        ).where("low <> high").select("band", "pivot"), "open-bands")
        if round_no < settings.pivot_rounds:
            met = placed.join(spread, "band").where(F.col("part") != F.col("pivot.part")).groupBy(
                "node", F.col("pivot.node").alias("pivot")).agg(F.count("*").alias("bands"))
            best = met.groupBy("node").agg(F.max(F.struct("bands", (-F.col("pivot")).alias("pivot"))).alias("best"))
            pairs = best.select(F.col("node").alias("a"), (-F.col("best.pivot")).alias("b"))
        else:
            pairs = _open_pairs(placed.join(spread.select("band"), "band").select("node", "part").distinct(), texts, settings)
        links = _verified(pairs, classes, texts, settings)
        joined = links.join(parts.select(F.col("node").alias("a"), F.col("part").alias("u")), "a").join(
            parts.select(F.col("node").alias("b"), F.col("part").alias("v")), "b").select("u", "v")
        roots = components(joined).withColumnRenamed("node", "part")
        parts = cut(parts.join(roots, "part", "left").select(
            "node", "weight", F.coalesce("root", "part").alias("part")), "parts")

    moved = parts.where("node <> part")
    return members.join(moved, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"),
        F.coalesce("part", "node").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One document of each component, that with the least id; rows with a null id stay. Columns stay as they are."""
    found = cut(cluster(docs, key, text, settings), "clusters")
    gone = found.where("NOT kept").select(F.col("doc_id").alias(key))
    kept = without(docs, gone, [key])
    if found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    # Rows that share an id are one document: the first by content stays.
    twice = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(key))
    order = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    name = "_row_of_id"
    first = narrowed(kept, twice, [key]).withColumn(name, F.row_number().over(order)).where(F.col(name) == 1).drop(name)
    return without(kept, twice, [key]).unionByName(first)
