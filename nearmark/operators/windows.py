"""Substring rules with short parts or targets: distinct windows instead of pairs of parts and targets.

A segment of a short target has one or two bytes, which nearly every part contains, so segments prune nothing there. The
windows of a target's length are few, though, because parts share them: each distinct window is compared once with
the targets of its length, and the close ones are joined back to the places where they occur. A short part has few windows of
any length, fewer than the targets it shares a segment with. What is left to do for a part and a
target is to take the closest window, or, for the sliding scan, to follow it where it does not end at its first window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.functions.text import byte_string, from_byte_string, known
from nearmark.operators.joins import BROADCAST_BYTES, key_join, table_bytes
from nearmark.schemas import result_columns
from nearmark.session import cut

K = F.col
PAIR = ["chain_id", "part_id", "tb", "k"]
# Parts with fewer bytes are short.
PART_BYTES = 64
# So many parts are taken apart by one task.
TASK_PARTS = 20_000
# So many distinct windows are compared by one task.
TASK_WINDOWS = 100_000
PLACES = 1 << 32


def part_id(part: Column) -> Column:
    """Short parts name themselves; long ones are named by a digest, which is longer than any of them."""
    return F.when(F.octet_length(part) < PART_BYTES, part).otherwise(F.sha2(part, 256))


def dealt_parts(named: DataFrame) -> DataFrame:
    """Parts dealt out by their ids, so that what is made of a part can be added up where it is made."""
    spark = named.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-named.count() // TASK_PARTS))
    return named.repartition(tasks, "chain_id", "part_id")


def window_rows(named: DataFrame, lengths: DataFrame) -> DataFrame:
    """``chain_id, part_id, place, pl, pb``: the windows in parts that are longer; of long parts those of ``short`` lengths."""
    texts = named.select("chain_id", "part_id", F.explode(F.array(byte_string(K("part")))).alias("text"))
    room = F.char_length("text") - K("pl")
    return (
        texts.join(F.broadcast(lengths), "chain_id").where((room > 0) & (K("short") | (F.char_length("text") < PART_BYTES)))
        .select("chain_id", "part_id", "pl", "text", F.explode(F.sequence(F.lit(0), room)).alias("place"))
        .select("chain_id", "part_id", "place", "pl", known(F.substring("text", K("place") + 1, K("pl"))).alias("pb"))
    )


def close_windows(windows: DataFrame, targets: DataFrame, near: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``chain_id, pb, pl, tb, k, d``: distinct windows and the targets of their length within the limit.

    ``near(windows, targets)`` gives these pairs with the distance ``d``.
    """
    # small on disk, much work each: dealt out by their number, not by their bytes
    distinct = cut(windows.select("chain_id", "pb", "pl").distinct(), "windows")
    distinct = distinct.repartition(max(distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // TASK_WINDOWS)))
    return cut(near(distinct, targets).select("chain_id", "pb", "pl", "tb", "k", "d"), "close-windows")


def find_short(parts: DataFrame, rules: DataFrame, whole: Callable[[DataFrame, DataFrame], DataFrame],
               near: Callable[[DataFrame, DataFrame], DataFrame], scan: Callable[[DataFrame], DataFrame],
               short: Callable[[Column, Column], Column], bound: int, every_window: bool) -> DataFrame:
    """Matches of substring rules where the part or the target is short.

    ``short(length, limit)`` says of which targets matches in long parts are wanted.
    ``whole(parts, targets)`` gives ``chain_id, part, tb, k, d`` of the pairs within the limit as they are, which need no
    window. ``scan(pairs)`` follows the sliding scan of ``part, target, maximum_distance`` and adds the result columns.
    """
    payload = [c for c in rules.columns if c not in ("chain_id", "target", "maximum_distance")]
    keyed = rules.withColumns({"tb": byte_string(K("target")), "k": K("maximum_distance")})
    # the same target may be in many rule sets
    targets = keyed.select("chain_id", "tb", "k", F.char_length("tb").alias("tl")).distinct().withColumns(
        {"set_id": F.xxhash64("tb"), "rule_idx": K("k")})
    lengths = targets.groupBy("chain_id", K("tl").alias("pl")).agg(F.max(short(K("tl"), K("k"))).alias("short"))
    named = parts.select("chain_id", "part", known(part_id(K("part"))).alias("part_id"))

    equal = whole(parts.select("chain_id", "part"), targets).where(
        (F.octet_length("part") < PART_BYTES) | short(F.char_length("tb"), K("k")))
    equal = cut(equal.select("chain_id", "part", "tb", "k", "d"), "whole-matches")
    close = close_windows(window_rows(named, lengths), targets, near)
    windows = window_rows(dealt_parts(named), lengths)
    small = BROADCAST_BYTES if table_bytes(close, ["pb", "tb"]) <= BROADCAST_BYTES else 2 * BROADCAST_BYTES
    short_part = F.octet_length("part_id") < PART_BYTES
    hits = key_join(windows, close, ["chain_id", "pb", "pl"], small, by=["part_id"]).where(short_part | short(K("pl"), K("k")))
    # distance and place as one number, since structs would be sorted to be added up
    best = hits.groupBy(*PAIR).agg(
        F.min(K("d") * F.lit(PLACES) + K("place")).alias("best"), F.min(F.when(K("place") == 0, K("d"))).alias("at_start"))
    best = cut(best, "window-matches")
    # only parts that are hardly longer than the target can be within the limit as a whole
    hardly = ~short_part | (F.octet_length("part_id") - F.char_length("tb") <= K("k"))
    whole_ids = equal.select("chain_id", known(part_id(K("part"))).alias("part_id"), "tb", "k")
    best = best.where(~hardly).unionByName(best.where(hardly).join(whole_ids, PAIR, "left_anti"))

    def result(rows: DataFrame, distance: Column, place: Column) -> DataFrame:
        window = F.when(place.isNotNull(), from_byte_string(F.substring(byte_string(K("part")), place + 1, F.char_length("tb"))))
        return rows.select("chain_id", "part", "tb", "k", distance.alias("distance"), window.alias("substring"))

    found = equal.select("chain_id", "part", "tb", "k", K("d").alias("distance"), F.lit(None).cast("string").alias("substring"))
    texts = best.where(short_part).withColumn("part", K("part_id")).unionByName(
        best.where(~short_part).join(named.where(F.octet_length("part") >= PART_BYTES), ["chain_id", "part_id"]))
    if every_window:
        found = found.unionByName(result(
            texts, F.shiftright("best", 32).cast("int"), K("best").bitwiseAND(F.lit(PLACES - 1)).cast("int")))
    else:
        # a scan ends where the limit is met, and where the distance leaves no room for a step
        found = found.unionByName(result(texts.where("at_start is not null"), K("at_start"), F.lit(0)))
        start = F.levenshtein(F.substring(byte_string(K("part")), F.lit(1), F.char_length("tb")), K("tb"))
        open_ = texts.where(K("at_start").isNull() & (start >= K("k") + 2))
        pairs = open_.select("chain_id", "part", from_byte_string(K("tb")).alias("target"), K("k").alias("maximum_distance"), K("tb").alias("target_bytes"))
        found = found.unionByName(scan(pairs).where("match").select(
            "chain_id", "part", K("target_bytes").alias("tb"), K("maximum_distance").alias("k"), "distance", "substring"))
    named_rules = keyed.select("chain_id", "tb", "k", "target", "maximum_distance", *payload)
    out = key_join(found.withColumnsRenamed({"distance": "d", "substring": "window"}), named_rules, ["chain_id", "tb", "k"], bound)
    return out.select("chain_id", "part", *payload, *result_columns(match=F.lit(True), distance=K("d"), substring=K("window")))
