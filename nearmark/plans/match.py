"""The match plan: distinct values, their parts, one job per rule type, early exit, and back to rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearmark.operators import JOBS, Options
from nearmark.operators.control import early_exit, without_exit
from nearmark.operators.joins import (
    BROADCAST_BYTES, hot_join, hot_keys, possible_rows, size_bound, sliced_join, spread_join, table_bytes,
)
from nearmark.operators.preprocess import make_parts, start_parts, whole_value
from nearmark.schemas import PART_METADATA, RESULT_COLUMNS, RESULT_TYPES
from nearmark.session import configure, cut
from nearmark.sources.catalog import Catalog

MATCH_COLUMNS = [
    "group_name", "rule_set", "part_ord", "part", "rule_idx", "rule_type", *RESULT_TYPES,
    "soundex_type", "max_code_length", "metaphone_type", *PART_METADATA, "early_match_exit",
]
DEFAULTS = Options()


def distinct_values(rows: DataFrame, column: str) -> DataFrame:
    """``value, n``: every string once, with the number of rows that have it."""
    return (
        rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    )


def matched_pairs(parts: DataFrame, catalog: Catalog, options: Options = DEFAULTS) -> DataFrame:
    """Matching pairs of distinct parts (``chain_id, part``) and rules, from one job per rule type in use."""
    found = [JOBS[t].matches(parts, catalog.rules, row, options) for t, row in sorted(catalog.profile.items())]
    if not found:
        empty = ", ".join(f"{c} {t}" for c, t in RESULT_SCHEMA.items())
        return parts.sparkSession.createDataFrame([], empty)
    return reduce(DataFrame.unionByName, found)


def scored_pairs(parts: DataFrame, catalog: Catalog, options: Options = DEFAULTS) -> DataFrame:
    """Every part with every rule of its chain, matching or not. As large as its definition says."""
    tables = []
    for rule_type, row in sorted(catalog.profile.items()):
        job = JOBS[rule_type]
        pairs = sliced_join(parts.select("chain_id", "part"), job.slim(catalog.rules), ["chain_id"], size_bound(row))
        tables.append(job.score(pairs, options).select(*RESULT_COLUMNS))
    return reduce(DataFrame.unionByName, tables)


RESULT_SCHEMA = {
    "chain_id": "bigint", "part": "string", "set_id": "bigint", "rule_idx": "int", "rule_type": "string",
    "exit_on_match": "boolean", "soundex_type": "string", "max_code_length": "int", "metaphone_type": "string",
    **RESULT_TYPES,
}


Find = Callable[[DataFrame, Catalog, Options], DataFrame]


def match_values(values: DataFrame, catalog: Catalog, options: Options = DEFAULTS, report_all: bool = False,
                 find: Find | None = None) -> DataFrame:
    """Match rows of distinct values: one row per value, part and rule.

    All rules run on distinct parts: a label that occurs in a million values is compared once. ``find`` gives the
    matching pairs in place of :func:`matched_pairs`, as a :class:`~nearmark.streaming.memory.MatchMemory` does.
    """
    if find is not None and report_all:
        raise ValueError("a report of every comparison cannot use kept matches")
    configure(values.sparkSession)
    occurrences = make_parts(values, catalog)
    # read several times by each job: one written table instead of one copy of the plan in each place
    counted = cut(occurrences.groupBy("chain_id", "part").agg(F.count("*").alias("n")), "parts")
    pairs = scored_pairs if report_all else find or matched_pairs
    found = pairs(counted.select("chain_id", "part"), catalog, options)
    found = early_exit(found) if catalog.has_exits else without_exit(found)
    if not any(catalog.chain_shapes) and counted.where("n > 1").isEmpty():
        # no chain has a step and no value comes twice: each part is its value, and the matches need no join to say so
        return found.where("part is not null").select("*", F.col("part").alias("value"), *whole_value())
    hot = hot_keys(counted, ["chain_id", "part"], "n")
    return hot_join(occurrences, found, ["chain_id", "part"], hot, ["value"])


def with_set_names(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """Add group and rule-set names to rows that carry ``set_id``."""
    sets = catalog.sets.select("set_id", "group_source", "group_ord", "group_name", "rule_set")
    if catalog.set_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sets), "set_id")
    return spread_join(rows, sets, ["set_id"], ["value"])


def match_strings(rows: DataFrame, column: str, catalog: Catalog, options: Options = DEFAULTS,
                  report_all: bool = False, find: Find | None = None) -> DataFrame:
    """Compare the strings of a column with a catalog: the rows that matched, once per match.

    ``report_all`` also returns the comparisons that did not match.
    """
    values = cut(distinct_values(rows, column), "values")
    found = with_set_names(match_values(values, catalog, options, report_all, find), catalog)
    found = found.select(F.col("value").alias(column), *MATCH_COLUMNS)
    clash = [c for c in rows.columns if c in MATCH_COLUMNS]
    if clash:
        raise ValueError(f"rename these columns, the match table has them too: {clash}")
    others = [c for c in rows.columns if c != column]
    if not others:
        rows, others = rows.withColumn("row_number_", F.monotonically_increasing_id()), ["row_number_"]
    if not report_all:
        # written and measured: the rows are shuffled only beyond a broadcast, and then without those that have no match
        found = cut(found, "found")
        if table_bytes(found, found.columns) <= BROADCAST_BYTES:
            return rows.join(F.broadcast(found), column).drop("row_number_")
        if others == ["row_number_"] and values.where("n > 1").isEmpty():
            return found  # a row has nothing but its string and none comes twice: its matches are the result
        rows = possible_rows(rows, cut(found.select(column).distinct(), "matched"), column)
    hot = hot_keys(values.withColumnRenamed("value", column), [column], "n")
    return hot_join(rows, found, [column], hot, others).drop("row_number_")


def match_targets(values: DataFrame, catalog: Catalog, options: Options = DEFAULTS, find: Find | None = None) -> DataFrame:
    """Match rows of a column ``value`` that already is distinct, with set names."""
    values = cut(values, "values")  # what makes them runs once
    found = with_set_names(match_values(values, catalog, options, find=find), catalog)
    return found.select("value", *MATCH_COLUMNS)


def value_sets(values: DataFrame, catalog: Catalog) -> DataFrame:
    """Every value with every rule set it is compared with."""
    chains = [c for ids in catalog.chain_shapes.values() for c in ids]
    starts = start_parts(values, chains).select("value", "chain_id")
    sets = catalog.sets.select("chain_id", "set_id").withColumn("rule_idx", F.lit(0))
    return sliced_join(starts, sets, ["chain_id"], catalog.set_bytes).select("value", "set_id")
