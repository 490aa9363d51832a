"""Option maps for the Kafka source and sink.

The connector is an external package, so these functions build the options and
leave loading to the session that has it.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_PORT = 9092


def _client(options: Mapping[str, str] | None) -> dict[str, str]:
    return {f"kafka.{key}": str(value) for key, value in (options or {}).items()}


def tail_offsets(end_offsets: Mapping[str, Mapping[int, int]], tail: int) -> str:
    """Per-partition start offsets that are ``tail`` records before the end."""
    starts = {t: {str(p): max(0, end - tail) for p, end in sorted(parts.items())}
              for t, parts in sorted(end_offsets.items())}
    return json.dumps(starts)


def starting_offsets(pointer: str | int | None,
                     end_offsets: Mapping[str, Mapping[int, int]] | None = None) -> str | None:
    """Where a first start begins; ``None`` leaves it to the checkpoint."""
    if pointer is None:
        return None
    if isinstance(pointer, int):
        if end_offsets is None:
            raise ValueError("a tail pointer needs the end offsets of the topics")
        return tail_offsets(end_offsets, pointer)
    if pointer in ("now", "end"):
        return "latest"
    if pointer in ("begin", "start"):
        return "earliest"
    warnings.warn(f"unsupported pointer ignored: {pointer}", stacklevel=2)
    return None


def source_options(host: str, topics: list[str], identifier: str, port: int = DEFAULT_PORT,
                   pointer: str | int | None = None, client_options: Mapping[str, str] | None = None,
                   end_offsets: Mapping[str, Mapping[int, int]] | None = None) -> dict[str, str]:
    options = {
        **_client(client_options),
        "kafka.bootstrap.servers": f"{host}:{port}",
        "subscribe": ",".join(topics),
        "groupIdPrefix": identifier,
    }
    start = starting_offsets(pointer, end_offsets)
    if start is not None:
        options["startingOffsets"] = start
    return options


def sink_options(host: str, topic: str, identifier: str, port: int = DEFAULT_PORT,
                 client_options: Mapping[str, str] | None = None) -> dict[str, str]:
    return {
        **_client(client_options),
        "kafka.bootstrap.servers": f"{host}:{port}",
        "kafka.client.id": identifier,
        "topic": topic,
    }


def payload(value: Column) -> Column:
    return value.cast("string").alias("value")


def stream_kafka(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.lit("kafka").alias("input_type"), payload(F.col("value")))


def write_kafka(df: DataFrame, options: Mapping[str, str]) -> None:
    """Send every record to one topic without a key."""
    df.select(payload(F.col("value"))).write.format("kafka").options(**options).save()
