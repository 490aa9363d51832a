"""Catalog loading, preprocessors, rule-set control flow, enrichment and streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from nearmark import CatalogError, catalog_from_targets, enrich, load_catalog, match_strings, register_rule, unregister_rule
from nearmark.operators.preprocess import punycode_step, split_step, start_parts
from nearmark.sources.records import read_json_lines, stream_json_lines, union_inputs
from nearmark.streaming.run import RuleSource, observed, stream_enrich, text_folder

RECORDS = ['{"name":"www.tset.com.","x":1.0,"nameMatches":3}', '{"name":"abc.de"}', "not json", "[1]", '{"name":5}', "{}"]
SPLIT = {"preprocessor_type": "split_target", "ignore_tld": True}


def group(name="g", sets=None):
    return {"name": name, "rule_sets": sets if sets is not None else [rule_set()]}


def rule_set(name="s", target="test", rules=None, steps=(SPLIT,)):
    rules = rules or [{"rule_type": "levenshtein", "values": {"maximum_distance": 2}}]
    return {"name": name, "string_match": target, "preprocessors": list(steps), "match_rules": rules}


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w") as file:
        file.write(text)
    return str(path)


def test_catalog_array_and_lines(spark, tmp_path):
    array = write(tmp_path, "a.json", json.dumps([group("a"), group("b")], indent=1))
    lines = write(tmp_path, "b.jsonl", "\n".join(json.dumps(group(n)) for n in "cd"))
    assert load_catalog(spark, array).sizes().first().string_groups == 2
    assert load_catalog(spark, lines).sizes().first().string_groups == 2
    write(tmp_path, "c.txt", "nonsense")
    folder = load_catalog(spark, str(tmp_path))
    assert folder.sizes().first().rules == 4 and folder.rejects.count() == 1


@pytest.mark.parametrize("rules", [
    [{"rule_type": "metaphone", "values": {"max_rule_length": 3}}],
    [{"rule_type": "jaro", "values": {"match_percent_threshold": 1.2}}],
    [{"rule_type": "jaccard", "values": {"minimum_similarity": -0.1}}],
    [{"rule_type": "soundex", "values": {"minimum_similarity": 5}}],
    [{"rule_type": "regex", "values": {"pattern": "["}}],
    [{"rule_type": "cidr", "values": {"address": "test"}}],
    [{"rule_type": "bitflip", "values": {"char_subset": "custom", "custom_char_subset": "abcčćddžđ"}}],
    [{"rule_type": "levenshtein"}],
    [{"rule_type": "unheard_of"}],
])
def test_bad_rules_are_refused(spark, tmp_path, rules):
    path = write(tmp_path, "r.json", json.dumps([group(sets=[rule_set(rules=rules)])]))
    with pytest.raises(CatalogError):
        load_catalog(spark, path)


def test_duplicate_names_are_refused(spark, tmp_path):
    for text in (json.dumps([group("a"), group("a")]), json.dumps([group("a", [rule_set(), rule_set()])])):
        with pytest.raises(CatalogError, match="duplicate"):
            load_catalog(spark, write(tmp_path, "d.json", text))


def test_split_and_names(spark):
    values = spark.createDataFrame([("this.is..test.com.",), ("café.com",)], "value string")
    parts = split_step(start_parts(values, [1]), True).where("value like 'this%'").orderBy("part_ord").collect()
    assert [(p.part, p.split_position) for p in parts] == [("this", 0), ("is", 1), ("test", 2)]
    both = punycode_step(split_step(start_parts(values, [1])), keep_both=True).where("value = 'café.com'").orderBy("part_ord").collect()
    assert [(p.part, p.punycode, p.split_position) for p in both] == [
        ("xn--caf-dma", True, None), ("café", False, 0), ("com", False, 1)]


def test_enrich(spark, tmp_path):
    rules = write(tmp_path, "r.json", json.dumps([group(sets=[
        rule_set("near", rules=[{"rule_type": "levenshtein", "exit_on_match": True, "values": {"maximum_distance": 2}},
                                {"rule_type": "hamming", "values": {"maximum_distance": 4}}]), rule_set("far", "zzzzzzzz")])]))
    catalog = load_catalog(spark, rules)
    records = read_json_lines(spark, write(tmp_path, "in.jsonl", "\n".join(RECORDS)))
    out = [json.loads(r.value) for r in enrich(records, ".name", catalog).collect()]
    assert len(out) == 1 and out[0]["x"] == 1.0
    near = out[0]["nameMatches"]["groups"][0]["rule_sets"]
    assert list(near) == ["near"]
    # "www" has no near match but is hamming-incomparable; "tset" stops at the exit rule
    assert near["near"] == [{"distance": 2, "split_string": "tset", "split_position": 1, "early_match_exit": True,
                             "match": True, "rule_type": "levenshtein"}]
    everything = [json.loads(r.value) for r in enrich(records, ".name", catalog, report_all=True).collect()]
    assert len(everything) == 2
    sizes = {r["name"]: {k: len(v) for k, v in r["nameMatches"]["groups"][0]["rule_sets"].items()} for r in everything}
    assert sizes == {"www.tset.com.": {"near": 3, "far": 2}, "abc.de": {"near": 2, "far": 1}}
    passed = enrich(records, ".name", catalog, on_bad_record="pass").collect()
    assert {r.value for r in passed} >= {"not json", "[1]", "{}"}
    assert union_inputs([records, records]).count() == len(RECORDS)


def test_user_defined_rule(spark):
    register_rule("same_size", lambda pairs: pairs.withColumn("match", F.length("part") == F.length("target")).withColumn(
        "metadata", F.to_json(F.struct(F.length("part").alias("size")))))
    try:
        catalog = catalog_from_targets(spark.createDataFrame([("abc",)], "t string"), "t", [{"rule_type": "same_size"}])
        rows = match_strings(spark.createDataFrame([("xyz",), ("xy",), ("xyz",)], "s string"), "s", catalog).collect()
        assert [r.s for r in rows] == ["xyz", "xyz"] and rows[0].metadata == '{"size":3}'
    finally:
        unregister_rule("same_size")


def test_stream_equals_batch_and_bad_rules_are_kept_out(spark, tmp_path):
    for name in ("in", "rules"):
        os.mkdir(tmp_path / name)
    path = write(tmp_path / "rules", "r.json", json.dumps([group()]))
    write(tmp_path / "in", "a.jsonl", "\n".join(RECORDS))
    source = RuleSource(spark, str(tmp_path / "rules"))
    stream = observed(stream_json_lines(spark, str(tmp_path / "in")))
    query = stream_enrich(stream, ".name", source, [text_folder(str(tmp_path / "out"))], str(tmp_path / "cp"), available_now=True)
    query.awaitTermination()
    batch = enrich(read_json_lines(spark, str(tmp_path / "in")), ".name", load_catalog(spark, path))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(r.value for r in batch.collect())
    assert query.lastProgress["observedMetrics"]["input"]["parse_errors"] == 1
    before = source.current()
    time.sleep(1.1)
    write(tmp_path / "rules", "r.json", json.dumps([group(), group()]))
    assert source.current() is before and source.load_errors == 1


# --- no result hangs on a size, a split or a spelling ------------------------------------------------------


def test_patterns_match_alike_in_any_number(spark):
    from nearmark.operators.exact import regex_hits

    parts = spark.createDataFrame([(1, "xcom"), (1, "acom"), (1, "7abc"), (1, "\x07abc")], "chain_id long, part string")
    asked = ["[a-cx]com$", r"[]x]com", r"\07abc", "[^b]com"]
    for extra in (0, 12, 13, 14, 40):
        patterns = [(1, p) for p in asked + [f"never{i}" for i in range(extra)]]
        found = regex_hits(parts, spark.createDataFrame(patterns, "chain_id long, pattern string"))
        assert {(r.part, r.pattern) for r in found.collect()} == {
            ("xcom", "[a-cx]com$"), ("acom", "[a-cx]com$"), ("xcom", "[]x]com"), ("\x07abc", r"\07abc"), ("xcom", "[^b]com"), ("acom", "[^b]com")}


def test_exclusion_patterns_alike_in_any_number(spark):
    from nearmark.operators.preprocess import drop_matching

    parts = start_parts(spark.createDataFrame([("xcom",), ("kept",)], "value string"), [1])
    for extra in (10, 9000):
        entries = spark.createDataFrame([(1, "[a-cx]com$"), *((1, f"never{i}") for i in range(extra))], "chain_id long, entry string")
        assert [r.part for r in drop_matching(parts, entries).collect()] == ["kept"]


def test_nested_classes_are_refused():
    from nearmark.functions.patterns import pattern_problem, required_texts

    for pattern in ("[[:alpha:]]com", "[a-c[x]]com$", "[a-z&&[^b]]com", "[a-z--b]com"):
        assert "not supported" in pattern_problem(pattern) and required_texts(pattern) == []
    assert pattern_problem(r"[\[a-z]com\.$") is None and required_texts(r"[\[a-z]com\.$") == [["com."]]


def test_many_splits_keep_their_order(spark):
    parts = start_parts(spark.createDataFrame([("a.b.c",)], "value string"), [1])
    for _ in range(6):
        parts = split_step(parts)
    assert [r.part for r in parts.orderBy("part_ord").collect()] == ["a", "b", "c"]


def test_a_bad_catalog_line_rejects_its_file_at_any_split(spark, tmp_path):
    import json

    from nearmark.sources.catalog import build_catalog, read_catalog_lines

    good = [json.dumps({"name": f"g{i}", "rule_sets": [{"name": "s", "string_match": "t", "match_rules": []}]}) for i in range(40)]
    (tmp_path / "bad.jsonl").write_text("\n".join([*good, "not json"]))
    (tmp_path / "good.jsonl").write_text("\n".join(x.replace('"g', '"h') for x in good))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            kept = {mode: build_catalog(read_catalog_lines(spark, str(tmp_path), mode)).sets.count() for mode in ("file", "line")}
            assert kept == {"file": 40, "line": 80}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_an_escaped_result_key_is_replaced_too(spark):
    import json

    from pyspark.sql import functions as F

    from nearmark.operators.control import add_member

    texts = ['{"nameMatche\\u0073": 1, "a": 2}', '{"nameMatches":1,"a":2}', '{"a":2}', ' { } ']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    for r in df.select("value", add_member(F.col("value"), "nameMatches", F.lit("[9]")).alias("out")).collect():
        pairs = json.loads(r.out, object_pairs_hook=list)
        assert [k for k, _ in pairs].count("nameMatches") == 1 and dict(pairs)["nameMatches"] == [9]


def test_matches_beyond_a_broadcast_give_the_same_records(spark, monkeypatch):
    targets = spark.createDataFrame([("test",), ("other",)], "target string")
    rules = catalog_from_targets(targets, "target", [{"rule_type": "levenshtein", "values": {"maximum_distance": 1}}])
    names = ["tset", "test", "tests", "others", "far away", "", "nothing"] * 5
    records = spark.createDataFrame([("file", json.dumps({"name": n, "row": i})) for i, n in enumerate(names)], "input_type string, value string")
    whole = sorted(r.value for r in enrich(records, ".name", rules).collect())
    assert len(whole) == 15
    monkeypatch.setattr("nearmark.plans.enrich.BROADCAST_BYTES", 0)
    assert sorted(r.value for r in enrich(records, ".name", rules).collect()) == whole
    assert enrich(records.limit(0), ".name", rules).collect() == []


def test_a_bitmap_keeps_every_match_and_few_others(spark):
    from nearmark.operators.joins import possible_rows

    names = spark.range(20000).select(F.concat(F.lit("name"), "id").alias("name"))
    found = names.where("name like '%7'")
    kept = possible_rows(names.unionByName(names), found, "name")
    assert kept.columns == ["name"]
    counts = kept.groupBy(F.expr("name like '%7'").alias("wanted")).count().collect()
    counts = {r.wanted: r["count"] for r in counts}
    assert counts[True] == 4000 and counts.get(False, 0) < 20
    assert possible_rows(names, found.limit(0), "name").count() == 0
