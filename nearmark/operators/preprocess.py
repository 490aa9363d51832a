"""Preprocessor steps: split a value into parts, drop known parts, convert internationalised names.

A parts table has one row per part: ``value, chain_id, part_ord, part`` plus the
metadata columns. ``part_ord`` is an array with a position for each step that makes parts, so it sorts. A step is a DataFrame transform; a chain is a left fold of
steps. Chains with the same kinds of steps run in one plan, because the lists
inside the steps are data that is joined in.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearmark.functions.domains import ascii_form, has_ace_prefix, unicode_form
from nearmark.functions.patterns import portable
from nearmark.functions.text import is_ascii
from nearmark.operators.joins import BROADCAST_BYTES, table_bytes
from nearmark.schemas import PART_METADATA
from nearmark.session import cut
from nearmark.sources.catalog import Catalog
from nearmark.sources.exclusions import read_exclusion_file

PART_COLUMNS = ["value", "chain_id", "part_ord", "part", *PART_METADATA]
# Up to so many patterns are tried on each part as it passes; more are looked up by the texts they need.
FEW_PATTERNS = 32


def start_parts(values: DataFrame, chain_ids: list[int]) -> DataFrame:
    """Every value once per chain, as a single part."""
    if len(chain_ids) <= 100:
        chains = F.explode(F.array(*[F.lit(c).cast("bigint") for c in chain_ids]))
        rows = values.select("value", chains.alias("chain_id"))
    else:
        table = values.sparkSession.createDataFrame([(0, c) for c in chain_ids], "one int, chain_id bigint")
        rows = values.select("value", F.lit(0).alias("one")).join(F.broadcast(table), "one")
    return rows.select("value", "chain_id", F.col("value").alias("part"), *whole_value()).select(*PART_COLUMNS)


def whole_value() -> list[Column]:
    """What a part carries that is the value as it came: no place and no metadata."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in PART_METADATA.items()]
    return [F.array().cast("array<int>").alias("part_ord"), *empty]


def labels(text: Column, ignore_last: bool) -> Column:
    """Non-empty pieces between dots, optionally without the last one."""
    pieces = F.filter(F.split(text, r"\."), lambda p: p != "")
    return F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))) if ignore_last else pieces


def split_step(parts: DataFrame, ignore_tld: bool = False) -> DataFrame:
    """One row per label; the position counts kept labels from 0."""
    rows = parts.select("value", "chain_id", "part_ord", "punycode", F.posexplode(labels(F.col("part"), ignore_tld)))
    return rows.select(
        "value", "chain_id", F.array_append("part_ord", F.col("pos")).alias("part_ord"),
        F.col("col").alias("part"), F.col("col").alias("split_string"), F.col("pos").alias("split_position"), "punycode",
    )


def punycode_step(parts: DataFrame, encode: bool = True, decode: bool = True, keep_both: bool = False) -> DataFrame:
    """Converted forms first, then the original if it is wanted or nothing was converted.

    Only strings that can be converted are sent to Python; all others stay in the JVM.
    """
    part = F.col("part")
    ace = has_ace_prefix(part)
    encodes, decodes = F.lit(encode) & ~is_ascii(part), F.lit(decode) & ace
    converting = encodes | decodes
    base = ["value", "chain_id", "split_string", "split_position"]

    flag = ace if encode else F.col("punycode")
    plain = parts.where(~converting).select(
        *base, F.array_append("part_ord", F.lit(2)).alias("part_ord"), "part", flag.alias("punycode"))

    converted = parts.where(converting).select(
        *base, "part_ord", "part",
        ascii_form(F.when(encodes, part)).alias("ascii"), unicode_form(F.when(decodes, part)).alias("unicode"),
        ace.alias("ace"),
    )
    # decoding speaks last about the original; encoding alone marks it as not encoded
    own_flag = F.when(F.col("ace") & F.lit(decode), F.lit(True)).otherwise(F.lit(False))
    nothing = F.col("ascii").isNull() & F.col("unicode").isNull()

    def item(ord_: int, text: Column, puny: Column, fresh: bool) -> Column:
        keep = F.lit(None) if fresh else F.col("split_string")
        return F.struct(
            F.lit(ord_).alias("i"), text.alias("part"), puny.alias("punycode"),
            keep.cast("string").alias("split_string"),
            (F.lit(None) if fresh else F.col("split_position")).cast("int").alias("split_position"),
        )

    original = F.when(F.lit(keep_both) | nothing, F.col("part"))
    items = F.filter(
        F.array(item(0, F.col("ascii"), F.lit(True), True), item(1, F.col("unicode"), F.lit(False), True),
                item(2, original, own_flag, False)),
        lambda x: x["part"].isNotNull(),
    )
    rows = converted.select("value", "chain_id", "part_ord", F.explode(items).alias("x")).select(
        "value", "chain_id", "x.split_string", "x.split_position",
        F.array_append("part_ord", F.col("x.i")).alias("part_ord"), "x.part", "x.punycode")
    return plain.select(*PART_COLUMNS).unionByName(rows.select(*PART_COLUMNS))


# Makes of a kind of join the parts that stay (``left_anti``) or go (``left_semi``).
Sift = Callable[[str], DataFrame]


def drop_listed(parts: DataFrame, entries: DataFrame, kind: str = "left_anti") -> DataFrame:
    """Drop parts equal to an entry of their chain (``left_semi`` gives the dropped ones)."""
    return sift_listed(parts, entries)(kind)


def sift_listed(parts: DataFrame, entries: DataFrame) -> Sift:
    listed = entries.select("chain_id", F.col("entry").alias("part")).distinct()
    if table_bytes(listed, ["part"]) <= BROADCAST_BYTES:
        return lambda kind: parts.join(F.broadcast(listed), ["chain_id", "part"], kind)
    # a part such as a top-level domain occurs in most values: spread it
    spread = 16
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(spread)))
    copies = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>")))
    return lambda kind: salted.join(copies, ["chain_id", "part", "salt"], kind).drop("salt")


def drop_matching(parts: DataFrame, entries: DataFrame, kind: str = "left_anti") -> DataFrame:
    """Drop parts in which a pattern of their chain is found."""
    return sift_matching(parts, entries)(kind)


def sift_matching(parts: DataFrame, entries: DataFrame) -> Sift:
    """Few patterns are one test of each part as it passes. For more, the distinct parts and those found are written once."""
    from nearmark.operators.exact import regex_hits

    patterns = entries.select("chain_id", F.col("entry").alias("pattern")).where("pattern is not null").distinct()
    few = patterns.limit(FEW_PATTERNS + 1).collect()
    if len(few) <= FEW_PATTERNS:
        tests = [(F.col("chain_id") == row.chain_id) & F.col("part").rlike(portable(row.pattern)) for row in few]
        found = F.coalesce(reduce(or_, tests, F.lit(False)), F.lit(False))
        return lambda kind: parts.where(found if kind == "left_semi" else ~found)
    hits = regex_hits(cut(parts.select("chain_id", "part").distinct(), "parts"), patterns)
    return sift_listed(parts, cut(hits.select("chain_id", F.col("part").alias("entry")).distinct(), "excluded"))


def exclusion_entries(catalog: Catalog, step: int, config, chain_ids: list[int]) -> DataFrame:
    if config["source"] == "file":
        chains = F.explode(F.array(*[F.lit(c).cast("bigint") for c in chain_ids]))
        return read_exclusion_file(catalog.spark, config["path"]).select(chains.alias("chain_id"), "entry")
    return catalog.exclusion_entries.where(F.col("step") == step).select("chain_id", "entry")


def apply_step(parts: DataFrame, catalog: Catalog, index: int, config, chain_ids: list[int],
               excluded: list[DataFrame] | None = None) -> DataFrame:
    kind = config["kind"]
    if kind == "split_target":
        return split_step(parts, config["ignore_tld"])
    if kind == "punycode":
        return punycode_step(parts, config["encode"], config["decode"], config["keep_both"])
    entries = exclusion_entries(catalog, index, config, chain_ids)
    sift = (sift_matching if config["regex"] else sift_listed)(parts, entries)
    if excluded is not None:
        excluded.append(sift("left_semi").select("value", "chain_id", "part").withColumn("step", F.lit(index)))
    return sift("left_anti")


def make_parts(values: DataFrame, catalog: Catalog, excluded: list[DataFrame] | None = None) -> DataFrame:
    """All parts of all distinct values under all chains.

    ``excluded`` collects, when given, one table of dropped parts per exclusion step.
    """
    tables = []
    for shape, chain_ids in sorted(catalog.chain_shapes.items(), key=lambda kv: str(kv[0])):
        parts = start_parts(values, chain_ids)
        for index, config in enumerate(shape):
            parts = apply_step(parts, catalog, index, config, chain_ids, excluded)
        tables.append(parts.select(*PART_COLUMNS))
    if not tables:
        return start_parts(values, [0]).where(F.lit(False)).select(*PART_COLUMNS)
    return reduce(DataFrame.unionByName, tables)
