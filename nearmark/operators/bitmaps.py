"""Bitmaps of letters or tokens that rule out most pairs before an exact comparison.

A join by keys pays per key and per pair that shares one; a look at two bitmaps costs a few machine words. So keys are
only worth their price where they are fewer than the rules they stand for, see ``KEY_COST``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.functions.text import BITMAP_WORDS

# What a key of a part costs, in comparisons of two bitmaps.
KEY_COST = 40


def with_bitmap(rows: DataFrame, bitmap: Column, prefix: str) -> DataFrame:
    """Add the words of a bitmap as the columns :func:`bitmap_columns` names."""
    # what comes out of explode is worked out once
    made = rows.withColumn("bitmap_", F.explode(F.array(bitmap)))
    return made.withColumns({f"{prefix}{w}": F.col(f"bitmap_.word{w}") for w in range(BITMAP_WORDS)}).drop("bitmap_")


def bitmap_columns(*prefixes: str) -> list[str]:
    return [f"{prefix}{w}" for prefix in prefixes for w in range(BITMAP_WORDS)]


def lacking(left: str, right: str) -> Column:
    """How many bits the bitmap ``left`` has that ``right`` lacks."""
    return reduce(Column.__add__, [
        F.bit_count(F.col(f"{left}{w}").bitwiseAND(F.bitwise_not(F.col(f"{right}{w}")))) for w in range(BITMAP_WORDS)])
