"""Counters as tables: per rule, per exclusion step, per input and per output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.functions.text import is_ascii
from nearmark.operators.jobs import Options
from nearmark.operators.joins import spread_join
from nearmark.operators.preprocess import make_parts
from nearmark.plans.match import DEFAULTS, match_values
from nearmark.sources.catalog import Catalog
from nearmark.sources.records import parsed

K = F.col
# Rule types that fail on a part that is not ASCII.
ASCII_ONLY = ["soundex", "metaphone"]
RULE_LABELS = ["group_name", "rule_set", "rule_idx", "rule_type"]


def rule_matches(values: DataFrame, matches: DataFrame) -> DataFrame:
    """Per rule, the number of records in which any part matched.

    ``values`` is ``value, n``; ``matches`` are match rows of these values.
    """
    hits = matches.where("match").select("value", "set_id", "rule_idx").distinct()
    return hits.join(values, "value").groupBy("set_id", "rule_idx").agg(F.sum("n").alias("rule_matches"))


def rule_errors(occurrences: DataFrame, values: DataFrame, matches: DataFrame, catalog: Catalog) -> DataFrame:
    """Per rule, the number of parts it failed on: parts that are not ASCII and that it got to see.

    Counted without pairing parts with rules: all failing parts of a chain, less those for which an
    earlier rule of the set had already stopped the set.
    """
    failing = occurrences.where(~is_ascii(K("part"))).join(values, "value").select("value", "chain_id", "part_ord", "n")
    per_chain = failing.groupBy("chain_id").agg(F.sum("n").alias("all_parts"))
    rules = catalog.rules.where(K("rule_type").isin(ASCII_ONLY)).select("chain_id", "set_id", "rule_idx")
    # one row per chain
    seen = rules.join(F.broadcast(per_chain), "chain_id")
    stops = matches.where("early_match_exit").where(~is_ascii(K("part"))).select(
        "value", "part_ord", "set_id", K("rule_idx").alias("cut"))
    stopped = stops.join(failing.select("value", "part_ord", "n").distinct(), ["value", "part_ord"])
    per_cut = stopped.groupBy("set_id", "cut").agg(F.sum("n").alias("parts"))
    skipped = rules.join(per_cut, "set_id").where("cut < rule_idx").groupBy("set_id", "rule_idx").agg(
        F.sum("parts").alias("skipped"))
    return seen.join(skipped, ["set_id", "rule_idx"], "left").select(
        "set_id", "rule_idx", (K("all_parts") - F.coalesce("skipped", F.lit(0))).alias("rule_errors"))


def rule_counters(values: DataFrame, catalog: Catalog, options: Options = DEFAULTS) -> DataFrame:
    """``rule_matches``, ``rule_misses`` and ``rule_errors`` of every rule.

    A record counts as a miss for every rule none of its parts matched, be it compared or not.
    """
    matches = match_values(values, catalog, options)
    occurrences = make_parts(values, catalog)
    rules = catalog.rules.select(*RULE_LABELS, "set_id", F.lit(1).alias("one"))
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.lit(1).alias("one"))
    counted = (
        rules.join(F.broadcast(total), "one")
        .join(rule_matches(values, matches), ["set_id", "rule_idx"], "left")
        .join(rule_errors(occurrences, values, matches, catalog), ["set_id", "rule_idx"], "left")
    )
    hit = F.coalesce("rule_matches", F.lit(0))
    return counted.select(
        *RULE_LABELS, hit.alias("rule_matches"), (K("total") - hit).alias("rule_misses"),
        F.coalesce("rule_errors", F.lit(0)).alias("rule_errors"))


def exclusion_counters(values: DataFrame, catalog: Catalog) -> DataFrame:
    """Per rule set and exclusion step, the number of parts it dropped."""
    excluded: list[DataFrame] = []
    make_parts(values, catalog, excluded)
    dropped = reduce(DataFrame.unionByName, excluded).join(values, "value")
    per_chain = dropped.groupBy("chain_id", "step").agg(F.sum("n").alias("exclusions"))
    # few rows per chain, spread because many rule sets share a chain
    sets = catalog.sets.select("chain_id", "set_id", "group_name", "rule_set")
    return spread_join(sets, per_chain, ["chain_id"], ["set_id"]).select(
        "group_name", "rule_set", "step", "exclusions")


def any_match(values: DataFrame, matches: DataFrame) -> DataFrame:
    """``value, any_match`` for every value."""
    hit = matches.groupBy("value").agg(F.bool_or("match").alias("hit"))
    return values.join(hit, "value", "left").select("value", F.coalesce("hit", F.lit(False)).alias("any_match"))


def input_counters(records: DataFrame) -> DataFrame:
    """Objects, bytes and parse errors per input; only parsed records count as objects."""
    good = parsed(K("value")).isNotNull()
    return records.groupBy("input_type").agg(
        F.count_if(good).alias("input_objects"),
        F.coalesce(F.sum(F.when(good, F.octet_length("value"))), F.lit(0)).alias("input_bytes"),
        F.count_if(~good).alias("parse_errors"),
    )


def output_counters(records: DataFrame, output_type: str = "file") -> DataFrame:
    """Objects and bytes per output; a file line also has its line break."""
    extra = 1 if output_type == "file" else 0
    return records.agg(
        F.count("*").alias("output_objects"),
        F.coalesce(F.sum(F.octet_length("value") + extra), F.lit(0)).alias("output_bytes"),
    ).select(F.lit(output_type).alias("output_type"), "output_objects", "output_bytes")
