"""Preprocessors: splitting, exclusions, internationalised names, ordered chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmark.operators.counters import exclusion_counters
from nearmark.operators.preprocess import make_parts, punycode_step, start_parts
from nearmark.session import scratch_folder
from nearmark.sources.catalog import catalog_from_targets
from workload import sql
from workload.inputs import catalog, domains, rule, targets, words
from workload.registry import registry

QUERIES, ORACLES, query = registry()

SPLIT = {"preprocessor_type": "split_target"}
SPLIT_NO_TLD = {"preprocessor_type": "split_target", "ignore_tld": True}
COMMON = ["www", "m", "blog", "com", "org", "net", "example", "en", "de", "fr", "es"]
STARTS = ["^th", "^ou.*", "(tion|ment)$"]


def exclude(regex: bool = False, **source) -> dict:
    kind = "file" if "path" in source else "list"
    return {"preprocessor_type": "exclusion_set", "exclusion_set_source": kind, "regex": regex, **source}


def domain_parts(spark, sf_dir, *steps):
    values = domains(spark, sf_dir).select(F.col("domain").alias("value"))
    rules = catalog_from_targets(targets(spark, sf_dir), "target", [rule("confusables")], list(steps))
    return make_parts(values, rules)


def positions(parts):
    return parts.select(F.col("value").alias("domain"), F.col("split_position").alias("pos"), "part")


def _parts_sql(where: str = "true") -> str:
    return f"WITH {sql.DOMAINS}, {sql.LABELS}, {sql.targets()} SELECT domain, pos::INT AS pos, part FROM parts WHERE {where}"


_COMMON = ", ".join(f"'{c}'" for c in COMMON)
_STARTS = "(starts_with(part, 'th') OR starts_with(part, 'ou') OR suffix(part, 'tion') OR suffix(part, 'ment'))"


@query("split_labels", _parts_sql())
def split_labels(spark, sf_dir):
    return positions(domain_parts(spark, sf_dir, SPLIT))


@query("split_labels_without_last", _parts_sql("pos < total - 1"))
def split_labels_without_last(spark, sf_dir):
    return positions(domain_parts(spark, sf_dir, SPLIT_NO_TLD))


@query("exclude_listed", _parts_sql(f"part NOT IN ({_COMMON})"))
def exclude_listed(spark, sf_dir):
    return positions(domain_parts(spark, sf_dir, SPLIT, exclude(list=COMMON)))


@query("exclude_from_file", _parts_sql("part NOT IN (SELECT target FROM t)"))
def exclude_from_file(spark, sf_dir):
    path = scratch_folder(spark, "entries")
    targets(spark, sf_dir).write.text(path)
    return positions(domain_parts(spark, sf_dir, SPLIT, exclude(path=path)))


@query("exclude_matching", _parts_sql(f"NOT {_STARTS}"))
def exclude_matching(spark, sf_dir):
    return positions(domain_parts(spark, sf_dir, SPLIT, exclude(regex=True, list=STARTS)))


@query("exclude_matching_from_file", _parts_sql("part NOT IN (SELECT target FROM t)"))
def exclude_matching_from_file(spark, sf_dir):
    """Every target as a pattern that only matches itself, punctuation escaped."""
    path = scratch_folder(spark, "patterns")
    escaped = F.regexp_replace("target", r"(\p{Punct})", r"\\$1")
    targets(spark, sf_dir).select(F.concat(F.lit("^"), escaped, F.lit("$"))).write.text(path)
    return positions(domain_parts(spark, sf_dir, SPLIT, exclude(regex=True, path=path)))


@query("steps_in_order", _parts_sql(f"part NOT IN ({_COMMON}) AND NOT {_STARTS.replace('part', 'domain')}"))
def steps_in_order(spark, sf_dir):
    """The first exclusion sees whole names, the second one their labels."""
    return positions(domain_parts(spark, sf_dir, exclude(regex=True, list=STARTS), SPLIT, exclude(list=COMMON)))


@query("exclusion_counters", f"""WITH {sql.DOMAINS}, {sql.LABELS}
    SELECT 1 AS step, count(*) AS exclusions FROM parts WHERE part IN ({_COMMON})
    UNION ALL SELECT 2, count(*) FROM parts WHERE part NOT IN ({_COMMON}) AND {_STARTS}""")
def exclusion_counters_query(spark, sf_dir):
    values = domains(spark, sf_dir).select(F.col("domain").alias("value"), F.lit(1).cast("bigint").alias("n"))
    rules = catalog(spark, sf_dir, rule("confusables"), steps=[SPLIT, exclude(list=COMMON), exclude(regex=True, list=STARTS)])
    # every rule set of the catalog has the same chain, so all count the same
    return exclusion_counters(values, rules).select("step", "exclusions").distinct()


# --- internationalised names ----------------------------------------------------------------------------


def _starts(spark, sf_dir):
    return start_parts(words(spark, sf_dir), [0])


@query("ascii_form_round_trip", f"WITH {sql.WORDS} SELECT word, word AS back FROM w WHERE strlen(word) <> length(word)")
def ascii_form_round_trip(spark, sf_dir):
    """Words with accents to their ASCII form, and back from it."""
    ascii_forms = punycode_step(_starts(spark, sf_dir), True, False).where("value <> part and punycode")
    again = punycode_step(ascii_forms, False, True).where("not punycode")
    return again.select(F.col("value").alias("word"), F.col("part").alias("back"))


@query("ascii_form_flags", f"""WITH {sql.WORDS}
    SELECT word, false AS punycode, true AS original FROM w
    UNION ALL SELECT word, true, false FROM w WHERE strlen(word) <> length(word)""")
def ascii_form_flags(spark, sf_dir):
    """Both forms kept: the original is flagged as not encoded, the converted form as encoded."""
    both = punycode_step(_starts(spark, sf_dir), True, True, True)
    return both.select(F.col("value").alias("word"), "punycode", (F.col("value") == F.col("part")).alias("original"))


@query("ascii_form_after_split", f"""WITH {sql.DOMAINS}, {sql.LABELS}
    SELECT domain, part, pos::INT AS pos FROM parts WHERE strlen(part) = length(part)
    UNION ALL SELECT domain, NULL, NULL FROM parts WHERE strlen(part) <> length(part)""")
def ascii_form_after_split(spark, sf_dir):
    """A converted label no longer knows its position."""
    parts = domain_parts(spark, sf_dir, SPLIT, {"preprocessor_type": "punycode"})
    return parts.select(F.col("value").alias("domain"), F.when(F.col("split_position").isNotNull(), F.col("part")).alias("part"),
                        F.col("split_position").alias("pos"))


@query("whole_name_round_trip", f"""WITH {sql.DOMAINS} SELECT domain, lower(domain) AS back FROM d
    WHERE strlen(domain) <> length(domain)""")
def whole_name_round_trip(spark, sf_dir):
    """Dotted names are mapped to lower case and converted label by label."""
    values = domains(spark, sf_dir).select(F.col("domain").alias("value"))
    ascii_forms = punycode_step(start_parts(values, [0]), True, False).where("punycode")
    again = punycode_step(ascii_forms, False, True).where("not punycode")
    return again.select(F.col("value").alias("domain"), F.col("part").alias("back"))


@query("whole_name_round_trip_every_letter", f"""WITH {sql.DOMAINS} SELECT domain, lower(domain) AS back FROM d
    WHERE strlen(domain) <> length(domain)""")
def whole_name_round_trip_every_letter(spark, sf_dir):
    """The same over all names, those with a sharp s too, which the mapping keeps."""
    values = domains(spark, sf_dir).select(F.col("domain").alias("value"))
    ascii_forms = punycode_step(start_parts(values, [0]), True, False).where("punycode")
    again = punycode_step(ascii_forms, False, True).where("not punycode")
    return again.select(F.col("value").alias("domain"), F.col("part").alias("back"))
