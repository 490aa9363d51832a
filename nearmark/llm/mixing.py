"""Mixing of sources to target weights by a low-discrepancy schedule.

The documents of a source, in a shuffled order, form a stream of tokens that repeats up to ``max_epochs`` times and is
cut into blocks of equal numbers of tokens. Slot k of the mix takes the golden-ratio point frac(k * phi), which falls
into one source's part of the cumulative weights; the rank of the slot among its source's slots is the block it
reads. A source stops at its target, so the last block may be short, and blocks the points have not reached
when the slots end follow in order of source and block. Every prefix of the mix is then near the target weights.

Running sums are made in two steps (inside hash ranges, then over the ranges), so no source is ever in one task.

Defined results: null texts have size 0, and a document of size 0 takes nothing; null is a source of its own, the last
in order; repeated rows are documents of their own; an empty table gives an empty table; ties of the shuffled order
are broken by key, content and, for equal rows only, the row's number in the written table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmark.llm.text import GAP
from nearmark.session import cut

GOLDEN = 0.6180339887498949
# Rows that one window of the first step of a running sum has on average.
RANGE_ROWS = 20_000
# Cells of [0, 1) by which points find their source.
CELLS = 4096


@dataclass(frozen=True)
class Settings:
    weights: Sequence[float] = (5, 2, 1)  # by order of source, repeating
    max_epochs: int = 3
    block: int = 2048
    seed: int = 17


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")).cast("long")


def running_sum(df: DataFrame, group: list[str], order: Column, rank: list[str], value: str, rows: int, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group that come before, for rows ordered by range of ``order``, then ``rank``.

    ``order`` must be a number from 0 to below 1. One task gets a range of rows, then a row for each range of a group.
    """
    ranges = max(1, -(-rows // RANGE_ROWS))
    placed = df.withColumn("_range", F.least(F.floor(order * ranges), F.lit(ranges - 1)))
    inside = Window.partitionBy(*group, "_range").orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_range").agg(F.sum(value).alias("_sum")).withColumn(
        "_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    summed = placed.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(sums.drop("_sum"), [*group, "_range"]).withColumn(
        out, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def targets(sized: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``source_no, source, source_size, target, cum``: one row per source, from rows ``source, size``.

    All sources share the total size by weight; one that would exceed ``max_epochs`` times its size stops there and
    the rest is shared by weight again. In order of size by weight the sources that stop come first, so running sums give
    the final level at once. ``cum`` is where the source's part of [0, 1) begins.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in settings.weights])
    named = sums.withColumn("source_no", F.row_number().over(order) - 1).withColumn(
        "weight", F.get(weights, F.col("source_no") % len(settings.weights))).withColumn(
        "limit", F.col("source_size").cast("double") * settings.max_epochs)
    everything = Window.partitionBy(F.lit(0))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "source_no")
    level = named.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(
        F.sum("limit").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn(
        "share", F.col("weight") / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    stops = level.withColumn("stops", F.col("limit") <= F.col("left") * F.col("share"))
    final = F.first(F.when(~F.col("stops"), F.col("left") * F.col("share") / F.col("weight")), ignorenulls=True).over(everything)
    done = stops.withColumn("level", final).withColumn(
        "target", F.when(F.col("stops"), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight"))))
    total = F.sum("target").over(everything)
    before = F.sum("target").over(Window.partitionBy(F.lit(0)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1))
    return done.select("source_no", "source", "source_size", "target", F.coalesce(before / total, F.lit(0.0)).alias("cum"),
                       F.coalesce((F.coalesce(before, F.lit(0.0)) + F.col("target")) / total, F.lit(0.0)).alias("cum_end"))


def schedule(sources: DataFrame, slots: int, settings: Settings = Settings()) -> DataFrame:
    """``source_no, block, slot``: every block of every source once; ``slot`` is null for blocks left at the end."""
    spark = sources.sparkSession
    budget = sources.select("source_no", "cum", "cum_end", F.ceil(F.round("target") / settings.block).alias("blocks"))
    # A source meets the cells that its part touches; only points in its cells are compared with its part.
    cells = budget.where("blocks > 0").withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("cum") * CELLS), F.least(F.floor(F.col("cum_end") * CELLS), F.lit(CELLS - 1)))))
    point = F.pmod(F.col("id") * F.lit(GOLDEN), F.lit(1.0))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    hits = points.join(cells, "cell").where((F.col("u") >= F.col("cum")) & (F.col("u") < F.col("cum_end")))
    ranked = running_sum(
        hits.select("source_no", "slot", F.lit(1).alias("one")), ["source_no"], F.col("slot") / F.lit(max(slots, 1)), ["slot"],
        "one", slots, "block")
    blocks = budget.where("blocks > 0").select("source_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return blocks.join(ranked.select("source_no", "block", "slot"), ["source_no", "block"], "left")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """The mixed documents and the pieces of the mix.

    First ``row, key, size, source, source_size, target, taken`` for each document, then
    ``slot, source_no, block, row, start, length``: which words of which document each slot reads.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                        F.xxhash64(text).alias("content"))
    rows = cut(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    sources = cut(targets(rows, settings), "mix-sources")
    # One slot per block; a source's last block may be short, hence one more for each of its sources.
    slots = sources.agg(F.coalesce(F.sum(F.ceil(F.round("target") / settings.block)), F.lit(0)).alias("n")).first().n
    plan = schedule(sources, slots, settings)

    shuffled = F.pmod(F.xxhash64("key", "content", F.lit(settings.seed)), F.lit(1 << 40))
    numbered = rows.join(sources.select("source", "source_no", "source_size", "target"),
                         rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    stream = running_sum(
        numbered.withColumn("_at", shuffled), ["source_no"], F.col("_at") / F.lit(float(1 << 40)), ["_at", "key", "content", "row"], "size",
        totals.n, "offset").drop("_at")
    stream = cut(stream, "mix-stream")
    epochs = stream.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(settings.max_epochs - 1))))
    begin = F.col("epoch") * F.col("source_size") + F.col("offset")
    reach = epochs.withColumn("begin", begin).withColumn(
        "until", F.least(F.col("begin") + F.col("size"), F.round("target").cast("long"))).where("begin < until")
    pieces = reach.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("begin") / settings.block), F.floor((F.col("until") - 1) / settings.block))))
    low = F.greatest("begin", F.col("block") * settings.block)
    high = F.least("until", (F.col("block") + 1) * settings.block)
    read = pieces.withColumn("start", low - F.col("begin")).withColumn("length", high - low).join(
        plan, ["source_no", "block"]).select("slot", "source_no", "block", "row", "start", "length")
    taken = read.groupBy("row").agg(F.sum("length").alias("taken"))
    mixed = stream.join(taken, "row", "left").select(
        "row", "key", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return mixed, read
