"""Join strategies shared by the rule jobs.

Every rule job is an equi-join of part keys with rule keys. The rule side is
broadcast only while an upper bound of its size, computed from the catalog
profile, stays under a limit. Beyond that both sides are shuffled, and a salt
spreads a key that many parts share over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 16
# A value that occurs more often than this is spread over several tasks.
HOT_ROWS = 2_000_000
ROW_OVERHEAD = 160
# A bitmap of 2 to 16 MB with so many bits a string, if that is enough, in the pieces that Spark's bitmap functions use.
LEAST_BITS = 1 << 24
BITMAP_BITS = 1 << 27
BITS_PER_STRING = 32
PIECE_BITS = 1 << 15


def size_bound(profile: Row, keys_per_rule: int = 1) -> int:
    """Upper bound in bytes of a rule-side key table."""
    return profile.n * max(keys_per_rule, 1) * (2 * (profile.text_bytes or 0) + ROW_OVERHEAD)


def table_bytes(df: DataFrame, columns: list[str]) -> int:
    """Measured size of a small table. Runs a job."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(ROW_OVERHEAD))
    return df.agg(F.sum(size).alias("bytes")).first().bytes or 0


def _on(left: DataFrame, right: DataFrame, on: list[str], condition: Column | None) -> DataFrame:
    joined = left.join(right, on)
    return joined if condition is None else joined.where(condition)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str],
                condition: Column | None = None, salts: int = SALTS) -> DataFrame:
    """Shuffled equi-join whose left side may have hot keys; ``by`` names the left columns that spread them."""
    salted = left.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _on(salted, copies, [*on, "salt"], condition).drop("salt")


def key_join(parts: DataFrame, rules: DataFrame, on: list[str], bound: int,
             condition: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Join part keys with rule keys; ``condition`` is the exact check where Spark has a function for it."""
    if bound <= BROADCAST_BYTES:
        return _on(parts, F.broadcast(rules), on, condition)
    return spread_join(parts, rules, on, by or ["part"], condition)


def sliced_join(parts: DataFrame, rules: DataFrame, on: list[str], bound: int,
                condition: Column | None = None) -> DataFrame:
    """For rules that nothing can prune: each part meets every rule of its block.

    The rules are cut into slices that each fit a broadcast, so no task ever holds all of them and
    the parts are not shuffled.
    """
    slices = -(-bound // BROADCAST_BYTES) or 1
    slot = F.pmod(F.xxhash64("set_id", "rule_idx"), F.lit(slices))
    return reduce(DataFrame.unionByName, [
        _on(parts, F.broadcast(rules if slices == 1 else rules.where(slot == s)), on, condition)
        for s in range(slices)
    ])


def hot_keys(counted: DataFrame, keys: list[str], count: str, limit: int = HOT_ROWS) -> DataFrame:
    """Keys that occur more than ``limit`` times, with the number of tasks to spread them over.

    At most ``rows / limit`` keys can be hot, which is what bounds the broadcast of this table.
    """
    salts = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    return counted.where(F.col(count) > limit).select(*keys, salts.alias("salts"))


def hot_join(rows: DataFrame, found: DataFrame, on: list[str], hot: DataFrame, spread: list[str],
             how: str = "inner") -> DataFrame:
    """Join many rows with one side that has few rows per key, spreading the hot keys."""
    marked = rows.join(F.broadcast(hot), on, "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int"))
    ).drop("salts")
    copies = found.join(F.broadcast(hot), on, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    ).drop("salts")
    return marked.join(copies, [*on, "salt"], how).drop("salt")


def possible_rows(rows: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` may be in ``found``: all that are, and few of the others, as long as the bitmap holds ``BITS_PER_STRING``.

    The hashes of ``found``, which is counted first, set bits of a bitmap, which is broadcast and never has more than ``BITMAP_BITS``.
    """
    bits = min(BITMAP_BITS, max(LEAST_BITS, 1 << (BITS_PER_STRING * found.count()).bit_length()))
    bit = F.pmod(F.xxhash64(on), F.lit(bits))
    piece, place = F.floor(bit / PIECE_BITS).cast("int").alias("piece_"), bit % PIECE_BITS
    pieces = found.select(piece, place.alias("place_")).groupBy("piece_").agg(
        F.bitmap_construct_agg("place_").alias("bits_"))
    byte = F.conv(F.hex(F.substring("bits_", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("piece_", piece).join(F.broadcast(pieces), "piece_")
    return marked.where(F.getbit(byte, (place % 8).cast("int")) == 1).drop("piece_", "bits_")
