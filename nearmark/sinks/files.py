"""File and table sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
GROUP_FILES = 8


def write_json_lines(df: DataFrame, path: str, compression: str | None = None) -> None:
    """One JSON text per line, replacing what was there.

    Enriched records repeat the matches of their name, so ``compression="gzip"`` leaves little of them; a gzip file is read by one task.
    """
    df.select("value").write.mode("overwrite").text(path, compression=compression)


def write_match_table(matches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long-form matches as parquet, one folder per group."""
    spark = matches.sparkSession
    before = spark.conf.get(WRITERS)
    # a task keeps a file open for each group it meets, up to this many; beyond that, as without it, it sorts its rows by group
    spark.conf.set(WRITERS, str(max(int(before), GROUP_FILES)))
    try:
        matches.write.mode(mode).partitionBy("group_name").parquet(path)
    finally:
        spark.conf.set(WRITERS, before)


def fan_out(df: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Hand the same result to every sink, computing it once."""
    if len(sinks) == 1:
        sinks[0](df)
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for sink in sinks:
            sink(kept)
    finally:
        kept.unpersist()
