"""Sources, sinks, record filters and rule catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearmark import match_strings
from nearmark.functions.text import quoted
from nearmark.operators.counters import input_counters, output_counters
from nearmark.plans.enrich import enrich, serialised
from nearmark.session import scratch_folder
from nearmark.sinks.files import fan_out, write_json_lines, write_match_table
from nearmark.sources import records as R
from nearmark.sources.catalog import build_catalog, read_catalog_files, read_catalog_lines
from nearmark.sources.exclusions import read_exclusion_file
from workload import sql
from workload.inputs import (
    catalog, hosts, mixed_records, page_records, rule, table, targets, word_records, word_rows,
)
from workload.registry import registry

QUERIES, ORACLES, query = registry()

# --- sources --------------------------------------------------------------------------------------------


_STRINGS = """'{"k":"' || event_type || '","event_id":' || event_id || '}'"""
_MIXED = """mixed AS (
      SELECT 'json' AS kind, props AS value FROM events UNION ALL SELECT 'json', {strings} FROM events
      UNION ALL SELECT 'json', '[' || props || ']' FROM events UNION ALL SELECT 'json', user_id::VARCHAR FROM events
      UNION ALL SELECT 'text', 'text ' || {text} FROM conversations)"""


@query("json_lines_source", "WITH " + _MIXED.format(strings=_STRINGS, text="replace(text, chr(10), ' ')") + " SELECT kind, value FROM mixed")
def json_lines_source(spark, sf_dir):
    path = scratch_folder(spark, "lines")
    write_json_lines(mixed_records(spark, sf_dir).withColumn("value", F.regexp_replace("value", "\n", " ")), path)
    lines = R.read_json_lines(spark, path)
    return lines.select(F.when(R.parsed(F.col("value")).isNull(), "text").otherwise("json").alias("kind"), "value")


@query("multi_input_union", """
    SELECT 'pages' AS input_type, count(*) AS records FROM pages
    UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'events', count(*) FROM events""")
def multi_input_union(spark, sf_dir):
    pages = page_records(spark, sf_dir)
    documents = R.records_from(table(spark, sf_dir, "documents"), "documents", "doc_id", "lang")
    events = table(spark, sf_dir, "events").select(F.lit("events").alias("input_type"), F.col("props").alias("value"))
    # the same input given twice counts once
    both = R.union_inputs([pages, documents, events, pages])
    return both.groupBy("input_type").agg(F.count("*").alias("records"))


def _group_texts(spark, sf_dir, extra: str = ""):
    """One JSON text per group: the benchmark words by first letter, each a rule set with two rules."""
    rules = ('[{"rule_type":"levenshtein","exit_on_match":true,"values":{"maximum_distance":1' + extra + '}},'
             '{"rule_type":"jaccard","values":{"minimum_similarity":0.75}}]')
    steps = '[{"preprocessor_type":"split_target","ignore_tld":true}]'
    member = F.concat(F.lit('{"name":'), quoted(F.col("target")), F.lit(',"string_match":'), quoted(F.col("target")),
                      F.lit(f',"preprocessors":{steps},"match_rules":{rules}}}'))
    words = targets(spark, sf_dir).withColumn("letter", F.left("target", F.lit(1)))
    sets = words.groupBy("letter").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("sets"))
    text = F.concat(F.lit('{"name":'), quoted(F.concat(F.lit("letter "), "letter")), F.lit(',"rule_sets":['), "sets", F.lit("]}"))
    return sets.select("letter", text.alias("value"))


def _rule_rows(rules):
    return rules.select("group_name", "rule_set", "target", "rule_idx", "rule_type", "exit_on_match",
                        "maximum_distance", F.col("minimum_similarity").cast("double").alias("minimum_similarity"))


_CATALOG = f"""WITH {sql.targets()}
    SELECT 'letter ' || left(target, 1) AS group_name, target AS rule_set, target, 0 AS rule_idx,
      'levenshtein' AS rule_type, true AS exit_on_match, 1 AS maximum_distance, NULL::DOUBLE AS minimum_similarity FROM t
    UNION ALL SELECT 'letter ' || left(target, 1), target, target, 1, 'jaccard', false, NULL, 0.75 FROM t"""


@query("catalog_json_array", _CATALOG)
def catalog_json_array(spark, sf_dir):
    path = scratch_folder(spark, "rules")
    texts = _group_texts(spark, sf_dir)
    one_file_each = texts.select(F.hex("letter").alias("file"), F.concat(F.lit("["), "value", F.lit("]")).alias("value"))
    one_file_each.repartition("file").write.partitionBy("file").text(path)
    return _rule_rows(build_catalog(read_catalog_files(spark, path)).rules)


@query("catalog_json_lines", _CATALOG)
def catalog_json_lines(spark, sf_dir):
    path = scratch_folder(spark, "rules")
    _group_texts(spark, sf_dir).select("value").write.text(path)
    return _rule_rows(build_catalog(read_catalog_lines(spark, path)).rules)


@query("catalog_folder_rejects", f"""WITH {sql.targets()}
    SELECT upper(hex(encode(left(target, 1)))) AS file, 'unknown values key: max_rule_length' AS problem, count(*) AS rule_sets
    FROM t GROUP BY left(target, 1) HAVING count(*) > 3""")
def catalog_folder_rejects(spark, sf_dir):
    """Groups of more than three words are written with a key no rule has; their files are rejected."""
    path = scratch_folder(spark, "rules")
    sizes = targets(spark, sf_dir).groupBy(F.left("target", F.lit(1)).alias("letter")).agg(F.count("*").alias("rule_sets"))
    good, bad = _group_texts(spark, sf_dir), _group_texts(spark, sf_dir, ',"max_rule_length":3')
    texts = good.join(sizes.where("rule_sets <= 3"), "letter").unionByName(bad.join(sizes.where("rule_sets > 3"), "letter"))
    texts.select(F.hex("letter").alias("file"), "value").repartition("file").write.partitionBy("file").text(path)
    loaded = build_catalog(read_catalog_files(spark, path))
    rejects = loaded.rejects.select(
        F.regexp_extract("group_source", "file=([0-9A-F]+)", 1).alias("file"), F.explode("problems").alias("problem"))
    return rejects.join(sizes.withColumn("file", F.hex("letter")), "file").select("file", "problem", "rule_sets")


@query("exclusion_file_source", f"SELECT DISTINCT word AS entry FROM (SELECT unnest(string_split_regex(text, {sql.BREAK})) AS word FROM conversations) WHERE word <> ''")
def exclusion_file_source(spark, sf_dir):
    path = scratch_folder(spark, "entries")
    word_rows(spark, sf_dir, "conversations").write.text(path)
    return read_exclusion_file(spark, path)


# --- catalog checks -------------------------------------------------------------------------------------


@query("rule_validation", f"""WITH {sql.targets()}
    SELECT target, 0 AS rule_idx, 'soundex needs an ASCII target' AS problem FROM t WHERE strlen(target) <> length(target)
    UNION ALL SELECT target, 1, 'minimum_similarity must be between 0 and 1' FROM t
    UNION ALL SELECT target, 2, 'invalid network address' FROM t""")
def rule_validation(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("soundex", minimum_similarity=2), rule("jaccard", minimum_similarity=1.5),
                    rule("cidr", address="10.0.0.0/33"), rule("levenshtein", maximum_distance=1))
    return rules.problems().select(F.col("rule_set").alias("target"), "rule_idx", "problem")


@query("duplicate_rule_sets", f"""WITH {sql.targets()}
    SELECT left(target, 1) AS group_name, right(target, 1) AS rule_set FROM t GROUP BY ALL HAVING count(*) > 1""")
def duplicate_rule_sets(spark, sf_dir):
    path = scratch_folder(spark, "rules")
    words = targets(spark, sf_dir).withColumn("letter", F.left("target", F.lit(1)))
    _named_groups(words, ["letter"], F.right("target", F.lit(1))).write.text(path)
    found = build_catalog(read_catalog_lines(spark, path)).problems()
    return found.where("problem = 'duplicate rule set name in group'").select("group_name", "rule_set")


@query("duplicate_groups", f"""WITH {sql.targets()}
    SELECT left(target, 1) AS group_name FROM t GROUP BY 1 HAVING count(DISTINCT strlen(target)) > 1""")
def duplicate_groups(spark, sf_dir):
    path = scratch_folder(spark, "rules")
    words = targets(spark, sf_dir).withColumns({"letter": F.left("target", F.lit(1)), "size": F.octet_length("target")})
    _named_groups(words, ["letter", "size"], F.col("target")).write.text(path)
    found = build_catalog(read_catalog_lines(spark, path)).problems()
    return found.where("problem = 'duplicate group name'").select("group_name")


def _named_groups(words, keys, name):
    member = F.concat(F.lit('{"name":'), quoted(name), F.lit(',"string_match":'), quoted(F.col("target")),
                      F.lit(',"match_rules":[{"rule_type":"confusables"}]}'))
    sets = words.groupBy(*keys).agg(F.array_join(F.collect_list(member), ",").alias("sets"))
    return sets.select(F.concat(F.lit('{"name":'), quoted(F.col("letter")), F.lit(',"rule_sets":['), "sets", F.lit("]}")).alias("value"))


@query("catalog_sizes", f"""WITH {sql.targets()}
    SELECT 1 AS string_groups, count(*) AS rule_sets, count(DISTINCT target) AS target_strings, count(*) * 2 AS rules FROM t""")
def catalog_sizes(spark, sf_dir):
    return catalog(spark, sf_dir, rule("confusables"), rule("match_rating")).sizes().select(
        F.col("string_groups").cast("int").alias("string_groups"), "rule_sets", "target_strings", "rules")


# --- record filters -------------------------------------------------------------------------------------


@query("valid_json_filter", """
    SELECT 'numbers' AS input_type, count(*) AS records FROM events UNION ALL SELECT 'strings', count(*) FROM events
    UNION ALL SELECT 'arrays', count(*) FROM events UNION ALL SELECT 'bare', count(*) FROM events""")
def valid_json_filter(spark, sf_dir):
    kept = mixed_records(spark, sf_dir).where(R.parsed(F.col("value")).isNotNull())
    return kept.groupBy("input_type").agg(F.count("*").alias("records"))




@query("object_filter", f"""SELECT 'numbers' AS input_type, props AS value FROM events
    UNION ALL SELECT 'strings', {_STRINGS} FROM events""")
def object_filter(spark, sf_dir):
    kept = mixed_records(spark, sf_dir).where(R.is_object(R.parsed(F.col("value"))))
    return kept.select("input_type", "value")


@query("field_access", f"WITH {sql.HOSTS} SELECT page_id, host AS name FROM h")
def field_access(spark, sf_dir):
    nested = hosts(spark, sf_dir).select(
        "page_id", F.struct(F.array(F.struct(F.lit("first").alias("name")), F.struct(F.col("host").alias("name"))).alias("items")).alias("answer"))
    records = R.records_from(nested, "pages", "page_id", "answer")
    found = R.usable(records, ".answer.items[1].name")
    return found.select(F.try_variant_get(R.parsed(F.col("value")), "$.page_id", "bigint").alias("page_id"), "name")


@query("string_type_check", "SELECT event_type AS name, count(*) AS records FROM events GROUP BY 1")
def string_type_check(spark, sf_dir):
    """``k`` is a string in some records and a number in others; only strings are usable."""
    return R.usable(mixed_records(spark, sf_dir), ".k").groupBy("name").agg(F.count("*").alias("records"))


# --- counters and sinks ---------------------------------------------------------------------------------


@query("input_counters", f"""
    SELECT 'strings' AS input_type, count(*) AS input_objects, sum(strlen({_STRINGS}))::BIGINT AS input_bytes, 0 AS parse_errors
    FROM events UNION ALL SELECT 'numbers' AS input_type, count(*) AS input_objects, sum(strlen(props))::BIGINT AS input_bytes, 0 AS parse_errors FROM events
    UNION ALL SELECT 'arrays', count(*), sum(strlen(props) + 2)::BIGINT, 0 FROM events
    UNION ALL SELECT 'bare', count(*), sum(strlen(user_id::VARCHAR))::BIGINT, 0 FROM events
    UNION ALL SELECT 'text', 0, 0, count(*) FROM conversations""")
def input_counters_query(spark, sf_dir):
    return input_counters(mixed_records(spark, sf_dir))


@query("output_counters", "WITH " + _MIXED.format(strings=_STRINGS, text="replace(text, chr(10), ' ')") + """
    SELECT 'file' AS output_type, count(*) AS output_objects, sum(strlen(value) + 1)::BIGINT AS output_bytes FROM mixed""")
def output_counters_query(spark, sf_dir):
    """Counted from the lines that the sink wrote."""
    path = scratch_folder(spark, "out")
    write_json_lines(mixed_records(spark, sf_dir).withColumn("value", F.regexp_replace("value", "\n", " ")), path)
    return output_counters(R.read_json_lines(spark, path), "file")


@query("json_lines_sink", f"""WITH {sql.WORDS}, {sql.targets()}
    SELECT word AS name, n AS records FROM w WHERE EXISTS (SELECT 1 FROM t WHERE abs(strlen(word) - strlen(target)) <= 1
      AND levenshtein(word, target) <= 1)""")
def json_lines_sink(spark, sf_dir):
    """Only records with a match come out; each is written once, however many matches it has."""
    path = scratch_folder(spark, "out")
    rules = catalog(spark, sf_dir, rule("levenshtein", maximum_distance=1))
    write_json_lines(enrich(word_records(spark, sf_dir), ".name", rules, alike_together=True), path, compression="gzip")
    back = R.usable(R.read_json_lines(spark, path), ".name")
    return back.groupBy("name").agg(F.count("*").alias("records"))


@query("match_table_sink", f"""WITH {sql.WORDS}, {sql.targets()}
    SELECT 'targets' AS group_name, target AS rule_set, word AS part, levenshtein(word, target)::INT AS distance, n AS records
    FROM w JOIN t ON abs(strlen(word) - strlen(target)) <= 1 AND levenshtein(word, target) <= 1""")
def match_table_sink(spark, sf_dir):
    path = scratch_folder(spark, "matches")
    rules = catalog(spark, sf_dir, rule("levenshtein", maximum_distance=1))
    rows = word_rows(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    write_match_table(match_strings(rows, "word", rules), path)
    return spark.read.parquet(path).groupBy("group_name", "rule_set", "part", "distance").agg(F.count("*").alias("records"))


@query("fan_out", """
    SELECT 'text' AS sink, count(*) AS records FROM pages UNION ALL SELECT 'parquet', count(*) FROM pages""")
def fan_out_query(spark, sf_dir):
    text, parquet = scratch_folder(spark, "text"), scratch_folder(spark, "parquet")
    fan_out(page_records(spark, sf_dir), [
        lambda df: write_json_lines(df, text), lambda df: df.write.parquet(parquet)])
    return spark.read.text(text).agg(F.count("*").alias("records")).select(F.lit("text").alias("sink"), "records").unionByName(
        spark.read.parquet(parquet).agg(F.count("*").alias("records")).select(F.lit("parquet").alias("sink"), "records"))


@query("serialise_or_original", "WITH " + _MIXED.format(strings=_STRINGS, text="text") + """
    SELECT CASE WHEN kind = 'json' THEN 'enriched' ELSE value END AS value, count(*) AS records FROM mixed GROUP BY 1""")
def serialise_or_original(spark, sf_dir):
    out = mixed_records(spark, sf_dir).select(serialised(F.col("value"), F.lit("enriched")))
    return out.groupBy("value").agg(F.count("*").alias("records"))
