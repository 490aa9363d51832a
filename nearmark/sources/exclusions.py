"""Exclusion lists: one string or pattern per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_exclusion_file(spark: SparkSession, path: str) -> DataFrame:
    """The distinct entries of a file or folder."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", r"\r\z", "").alias("entry")).distinct()
