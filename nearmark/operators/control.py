"""Rule-set control flow on match rows: early exit, metadata as JSON, nesting, record enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearmark.functions.text import once, quoted
from nearmark.schemas import PART_METADATA, RULE_VALUES

K = F.col


def early_exit(rows: DataFrame) -> DataFrame:
    """Within one part and rule set, drop rows behind the first match of an exit rule and mark that match.

    Later parts of the same rule set are not affected.
    """
    group = Window.partitionBy("chain_id", "part", "set_id")
    cut = F.min(F.when(K("match") & K("exit_on_match"), K("rule_idx"))).over(group)
    return (
        rows.withColumn("cut", cut).where("cut is null or rule_idx <= cut")
        .withColumn("early_match_exit", F.when(K("rule_idx") == K("cut"), F.lit(True))).drop("cut")
    )


def without_exit(rows: DataFrame) -> DataFrame:
    """The same columns for a catalog that has no exit rules, without the shuffle."""
    return rows.withColumn("early_match_exit", F.lit(None).cast("boolean"))


# Metadata keys of each rule type; those in the second list are left out when they are NULL.
METADATA_KEYS = {
    "levenshtein": ([], ["distance"]),
    "damerau_levenshtein": ([], ["distance"]),
    "levenshtein_substring": (["distance", "substring"], []),
    "damerau_levenshtein_substring": (["distance", "substring"], []),
    "hamming": (["distance"], []),
    "jaro": (["match_percent"], []),
    "jaro_winkler": (["match_percent"], []),
    "jaccard": (["similarity"], []),
    "soundex": (["similarity", "soundex_type"], []),
    "metaphone": (["max_code_length", "metaphone_type", "primary_code", "alternate_code"], []),
    "nysiis": (["encoded"], []),
}


def _members(columns: list[Column], keep_nulls: bool) -> Column:
    """Members of a JSON object without the braces."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": str(not keep_nulls).lower()})
    return F.substring(text, F.lit(2), F.char_length(text) - 2)


def match_json(custom: bool = True) -> Column:
    """One match row as a JSON object."""
    kept, optional = F.lit(""), F.lit("")
    for rule_type, (always, maybe) in METADATA_KEYS.items():
        here = K("rule_type") == rule_type
        if always:
            columns = [K(c).cast("int").alias(c) if (rule_type, c) == ("soundex", "similarity") else K(c) for c in always]
            kept = F.when(here, _members(columns, True)).otherwise(kept)
        if maybe:
            optional = F.when(here, _members([K(c) for c in maybe], False)).otherwise(optional)
    if custom:
        own = F.substring(F.trim("metadata"), F.lit(2), F.char_length(F.trim("metadata")) - 2)
        kept = F.when(~K("rule_type").isin(list(RULE_VALUES)), F.coalesce(own, F.lit(""))).otherwise(kept)
    part = _members([K(c) for c in (*PART_METADATA, "early_match_exit")], False)
    tail = _members([K("match"), K("rule_type")], True)
    pieces = F.filter(F.array(kept, optional, part, tail), lambda p: F.trim(p) != "")
    return F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))


def nest_sets(rows: DataFrame) -> DataFrame:
    """One row per value and rule set: its matches as a JSON array, part by part and rule by rule."""
    item = F.struct("part_ord", "rule_idx", match_json().alias("json"))
    ordered = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["json"])
    return rows.groupBy("value", "set_id").agg(ordered.alias("matches")).select(
        "value", "set_id", F.concat(F.lit("["), F.array_join("matches", ","), F.lit("]")).alias("matches"))


def nest_groups(sets: DataFrame) -> DataFrame:
    """One row per value: all groups as a JSON array, rule sets in name order inside a group."""
    member = F.concat(quoted(K("rule_set")), F.lit(":"), K("matches"))
    by_name = F.array_sort(F.collect_list(F.struct("rule_set", member.alias("json"))))
    groups = sets.groupBy("value", "group_source", "group_ord", "group_name").agg(by_name.alias("members"))
    group = F.concat(
        F.lit('{"string_group_name":'), quoted(K("group_name")), F.lit(',"rule_sets":{'),
        F.array_join(F.transform("members", lambda m: m["json"]), ","), F.lit("}}"))
    ordered = F.array_sort(F.collect_list(F.struct("group_source", "group_ord", group.alias("json"))))
    return groups.groupBy("value").agg(ordered.alias("g")).select(
        "value", F.concat(F.lit("["), F.array_join(F.transform("g", lambda x: x["json"]), ","), F.lit("]")).alias("groups"))


def add_member(value: Column, key: str, member: Column) -> Column:
    """JSON object text with one more member, all else left as it was written.

    Only an object that already has the key is rewritten, to lose the old member.
    """
    fields = F.try_variant_get(F.try_parse_json(value), "$", "map<string,variant>")
    stripped = F.to_json(F.map_filter(fields, lambda k, _: k != key))
    # a text with neither the key as it is nor any escape cannot have it, and needs no second parse to know it
    mentioned = value.contains(f'"{key}"') | value.contains("\\")
    has_key = mentioned & F.map_contains_key(fields, key)
    trimmed = F.regexp_replace(F.when(has_key, stripped).otherwise(value), r"\A\s+|\s+\z", "")
    name = F.concat(quoted(F.lit(key)), F.lit(":"))

    def extended(text: Column) -> Column:
        comma = F.when(text.rlike(r"\A\{\s*\}\z"), F.lit("")).otherwise(F.lit(","))
        return F.concat(F.left(text, F.char_length(text) - 1), comma, name, member, F.lit("}"))

    # most texts are an object with a member, and neither blanks around it nor the key: no pattern is needed to see that
    plain = ~mentioned & value.startswith('{"') & value.endswith("}")
    short = F.concat(F.left(value, F.char_length(value) - 1), F.lit(","), name, member, F.lit("}"))
    return F.when(plain, short).otherwise(once(trimmed, extended))
