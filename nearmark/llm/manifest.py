"""A Merkle manifest of a dataset, climbed by a recursive query.

Every row of a table is a leaf, every group (a language, for instance) has a tree, and the trees' tops are the leaves of
one more tree whose top is the root. Levels are built ``TIER_LEVELS`` at a time: one task gets a run of
2 ** TIER_LEVELS neighbouring nodes, and each node is stored with the siblings it meets on its way through these levels
and with its parent, the node at which it arrives. To check a leaf, a recursive query starts from the hash that the leaf has
now, folds it with the siblings stored at its node, and goes on from the parent until the root; the siblings it passed are
the leaf's proof.

Runs are cut by place (``tables.numbered``), so a group of any size is spread over tasks. In the recursion a node with
many leaves below is spread too: it is stored in copies, and a leaf's number says which copy it meets.

Defined results: null fields hash as ``-``; a null group is a group, the first one; rows with equal keys follow each other
by leaf hash, and equal rows have leaves and proofs of their own; an empty table gives an empty result; texts of any length
are hashed whole. The result has the key, under the name ``key``, and ``RESULTS``; other columns of the input do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.llm.tables import few, numbered, setting
from nearmark.session import cut

RESULTS = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
TIER_LEVELS = 8
RUN = 1 << TIER_LEVELS
ABOVE = 100  # tiers of the tree above the groups are numbered from here
# Leaves that one copy of a node serves in the recursion.
LEAVES_PER_COPY = 100_000
# Stored nodes are broadcast up to this many (each holds at most TIER_LEVELS hashes) and shuffled beyond.
BROADCAST_NODES = 100_000
PATHS = "array<array<struct<side: tinyint, hash: binary>>>"


def field(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else the number of its bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def climb_run(hashes: list[bytes], levels: int) -> tuple[bytes, list[list[dict]]]:
    """The node above a run of nodes, and each one's siblings level by level (side -1: left, 1: right, 0: none)."""
    below = hashes
    paths: list[list[dict]] = [[] for _ in hashes]
    for level in range(levels):
        for i, path in enumerate(paths):
            other = (i >> level) ^ 1
            found = other < len(below)
            path.append({"side": (1 if other & 1 else -1) if found else 0, "hash": below[other] if found else None})
        below = [hashlib.sha256(b"".join(h.hex().encode() for h in below[i:i + 2])).digest() for i in range(0, len(below), 2)]
    return below[0], paths


def _climb(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.list_(pa.struct([("side", pa.int8()), ("hash", pa.binary())])))
    for batch in batches:
        tops, paths = [], []
        for size, held in zip(batch.column("size").to_pylist(), batch.column("held"), strict=True):
            hashes = held.values.field("hash").to_pylist()
            top, found = climb_run(hashes, min(most, (size - 1).bit_length()))
            tops.append(top)
            paths.append(found)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(tops, pa.binary()), pa.array(paths, kind)], [*batch.schema.names, "top", "paths"])


def build(nodes: DataFrame, payload: list[str], name: str) -> list[DataFrame]:
    """All tiers of trees over ``tree, place, size, leaves, hash`` rows, written.

    ``size`` is the number of nodes of the tree in its tier, ``leaves`` what is below a node. A row of a tier is a run:
    ``tree, run, size, leaves, held, top, paths``, with its nodes in ``held`` and the node above them in ``top``; runs with
    ``size`` up to ``RUN`` are the last of their tree.
    """
    tiers = []
    climb = partial(_climb, most=TIER_LEVELS)
    while True:
        held = F.sort_array(F.collect_list(F.struct("place", "leaves", *(payload if not tiers else []), "hash")))
        runs = nodes.groupBy("tree", F.shiftright("place", TIER_LEVELS).alias("run"), "size").agg(F.sum("leaves").alias("leaves"), held.alias("held"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
        tiers.append(cut(runs.mapInArrow(climb, f"{schema}, top binary, paths {PATHS}"), f"{name}-{len(tiers)}"))
        if not tiers[-1].where(F.col("size") > RUN).limit(1).count():
            return tiers
        nodes = tiers[-1].where(F.col("size") > RUN).select(
            "tree", F.col("run").alias("place"), F.ceil(F.col("size") / RUN).cast("long").alias("size"), "leaves", F.col("top").alias("hash"))


def _copies(leaves: Column) -> Column:
    return (F.floor(leaves / LEAVES_PER_COPY) + 1).cast("long")


def _nodes(runs: DataFrame, tier: int) -> DataFrame:
    """Each node of a tier with its path and its parent: ``tier, tree, place, node, path, to_*``."""
    last = F.col("size") <= RUN
    top = F.lit(ABOVE if tier < ABOVE else -1)
    return runs.withColumn("node", F.explode(F.arrays_zip("held", "paths"))).select(
        F.lit(tier).alias("tier"), "tree", F.col("node.held.place").alias("place"), F.col("node.held").alias("node"),
        F.col("node.paths").alias("path"), F.when(last, top).otherwise(tier + 1).alias("to_tier"),
        F.col("tree").alias("to_tree"), F.when(last, F.lit(0).cast("long")).otherwise(F.col("run")).alias("to_place"),
        _copies(F.col("leaves")).alias("to_copies"))


@dataclass
class Manifest:
    """Stored levels: ``leaves`` (the lowest tier, with the rows' numbers and keys), ``upper`` nodes, and the root."""

    leaves: DataFrame
    upper: DataFrame
    root: bytes | None


def manifest(docs: DataFrame, key: str, group: str, fields: list[str], current: dict[str, Column] | None = None) -> Manifest:
    """Build the trees over the rows of a table, ordered by ``key`` in each ``group``.

    ``current`` gives fields that read otherwise now; the leaf that results is stored beside the one the trees are
    built on, for ``verify``.
    """
    now = {f: (current or {}).get(f, F.col(f)) for f in fields}
    changed = [~F.col(f).eqNullSafe(now[f]) for f in current or {}]
    differs = F.lit(False)
    for c in changed:
        differs = differs | c
    rows = cut(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),  # null first, then by bytes
        F.col(key).alias("key"), F.monotonically_increasing_id().alias("item"),
        F.when(differs, leaf_hash(list(now.values()))).alias("now"), leaf_hash([F.col(f) for f in fields]).alias("hash")), "manifest-rows")
    sizes = cut(rows.groupBy("tree").agg(F.count("*").alias("size")), "manifest-sizes")
    sizes = F.broadcast(sizes) if few(sizes) else sizes
    placed = numbered(rows, ["tree"], [F.col("key").asc_nulls_first(), F.col("hash").asc(), F.col("item").asc()], "manifest-placed")
    trees = build(placed.join(sizes, "tree").withColumn("leaves", F.lit(1).cast("long")), ["item", "key", "now"], "manifest-tier")

    tops = [t.where(F.col("size") <= RUN).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "leaves", F.col("top").alias("hash")) for t in trees]
    above = tops[0]
    for t in tops[1:]:
        above = above.unionByName(t)
    above = cut(above, "manifest-subroots")
    above = numbered(above, ["tree"], [F.col("name").asc()], "manifest-subroots-placed").withColumn("size", F.lit(above.count()))
    crown = build(above, ["name"], "manifest-above")
    root = crown[-1].where(F.col("size") <= RUN).select("top").first()

    columns = ["tier", "tree", "place", "copies", "hash", "path", "to_tier", "to_tree", "to_place", "to_copies"]
    upper = _nodes(crown[0], ABOVE).withColumn("tree", F.col("node.name")).withColumn("place", F.lit(0).cast("long"))
    upper = upper.withColumn("copies", _copies(F.col("node.leaves"))).withColumn("hash", F.col("node.hash")).select(*columns)
    for first, tiers in ((0, trees), (ABOVE, crown)):
        for t, runs in enumerate(tiers[1:], first + 1):
            upper = upper.unionByName(_nodes(runs, t).withColumn("copies", _copies(F.col("node.leaves"))).withColumn(
                "hash", F.col("node.hash")).select(*columns))
    return Manifest(_nodes(trees[0], 0), upper, bytes(root.top) if root else None)


_FOLD = """aggregate({path}, {start}, (h, s) -> unhex(sha2(CASE WHEN s.side < 0 THEN concat(lower(hex(s.hash)), lower(hex(h)))
  WHEN s.side > 0 THEN concat(lower(hex(h)), lower(hex(s.hash))) ELSE lower(hex(h)) END, 256)))"""
_PROOF = "aggregate({path}, {start}, (p, s) -> CASE WHEN s.side = 0 THEN p ELSE concat(p, s.hash) END)"
_CLIMB = """
WITH RECURSIVE climb(item, key, leaf, subroot, tier, tree, place, copies, folded, proof) AS (
  SELECT node.item, node.key, node.hash, CAST(NULL AS BINARY), to_tier, to_tree, to_place, to_copies,
    {first}, {first_proof} FROM {leaves}
  UNION ALL
  SELECT c.item, c.key, c.leaf, CASE WHEN n.tier = {above} THEN n.hash ELSE c.subroot END, n.to_tier, n.to_tree, n.to_place, n.to_copies,
    {fold}, {proof}
  FROM climb c JOIN {upper} n ON c.tier = n.tier AND c.tree = n.tree AND c.place = n.place AND c.item % c.copies = n.copy)
SELECT key, lower(hex(leaf)) AS leaf, lower(hex(subroot)) AS subroot, sha2(lower(hex(proof)), 256) AS proof_sha256,
  lower(hex(folded)) AS folded_root FROM climb WHERE tier = -1"""


def verify(stored: Manifest) -> DataFrame:
    """``key`` and ``RESULTS`` for each leaf, folded from the hash it has now."""
    spark = stored.leaves.sparkSession
    upper = cut(stored.upper.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies"),
                "manifest-upper")
    upper = F.broadcast(upper) if few(upper, BROADCAST_NODES) else upper
    names = {n: f"manifest_{n}_{uuid.uuid4().hex}" for n in ("leaves", "upper")}
    stored.leaves.createOrReplaceTempView(names["leaves"])
    upper.createOrReplaceTempView(names["upper"])
    query = _CLIMB.format(
        **names, above=ABOVE, first=_FOLD.format(path="path", start="coalesce(node.now, node.hash)"),
        first_proof=_PROOF.format(path="path", start="CAST('' AS BINARY)"), fold=_FOLD.format(path="n.path", start="c.folded"),
        proof=_PROOF.format(path="n.path", start="c.proof"))
    # the limit counts the rows of all rounds, here a few for each leaf
    with setting(spark, "spark.sql.cteRecursionRowLimit", "-1"):
        climbed = cut(spark.sql(query), "manifest-climbed")
    for n in names.values():
        spark.catalog.dropTempView(n)
    root = F.lit(stored.root.hex() if stored.root else None).cast("string")
    return climbed.withColumn("root", root).withColumn("verified", F.col("folded_root") == F.col("root")).select("key", *RESULTS)
