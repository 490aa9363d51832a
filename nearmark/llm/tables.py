"""Small helpers on tables that the operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearmark.session import cut

# A list of keys is broadcast up to this many rows (some tens of MB), and joined by a shuffle beyond.
BROADCAST_KEYS = 500_000


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def few(keys: DataFrame, limit: int | None = None) -> bool:
    """Whether a table of keys is small enough to broadcast. Runs a job."""
    limit = BROADCAST_KEYS if limit is None else limit
    return keys.limit(limit + 1).count() <= limit


def narrowed(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in a table, without a shuffle of the rows if the table is small."""
    keys = keys.select(*on).distinct()
    return rows.join(F.broadcast(keys) if few(keys) else keys, on, "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not in a table, without a shuffle of the rows if the table is small."""
    keys = keys.select(*on).distinct()
    return rows.join(F.broadcast(keys) if few(keys) else keys, on, "left_anti")


# Rows that one range of ``numbered`` has on average.
RANGE_ROWS = 100_000


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Written rows with ``place``: the row's number, from 0, in the order of its group.

    ``rows`` must be a written table, and ``order`` must not leave ties other than equal rows. Ranges of all rows are
    sorted on their own, so no group ever meets in one task; the starts of the groups in the ranges are a table of at
    most as many rows as there are ranges and groups. Runs jobs.
    """
    ranges = rows.count() // RANGE_ROWS + 1
    by = [F.col(g).asc() for g in group] + order
    at = F.monotonically_increasing_id()  # the number of the range, then 33 bits for the place in it
    held = cut(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_at", at), name)
    held = held.withColumn("_range", F.shiftright("_at", 33))
    starts = held.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    starts = F.broadcast(starts) if few(starts) else starts
    starts = starts.withColumnsRenamed({c: f"_{c}" for c in ["_range", *group]})
    same = held["_range"] == starts["__range"]
    for g in group:
        same &= held[g].eqNullSafe(starts[f"_{g}"])
    return held.join(starts, same).drop("__range", *[f"_{g}" for g in group]).withColumn(
        "place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")
