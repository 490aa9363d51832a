"""What grows with the records is done once: inputs are read once, records are not kept or shuffled without need."""

import glob
import importlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from nearmark import catalog_from_targets, enrich, match_strings
from nearmark.functions.network import address_bits
from nearmark.operators import Options, overlap, preprocess
from nearmark.operators.control import add_member
from nearmark.operators.counters import exclusion_counters
from nearmark.plans.match import match_targets, match_values, matched_pairs, scored_pairs
from nearmark.schemas import PAIR_KEY
from nearmark.sinks.files import write_json_lines, write_match_table
from nearmark.sources import records as R
from nearmark.streaming.run import append_folder, run_batches, text_folder

K = F.col
WORDS = ["tset", "test", "tests", "contest", "none", "x", "", "tést", "a" * 70 + "testing" + "b" * 9, "z" * 66 + "tst"]


def counting(spark, df, column):
    """The table with a column that counts how often its rows are made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def count(text):
        made.add(1)
        return text

    return df.withColumn(column, count.asNondeterministic()(column)), made


def catalog(spark, targets, *kinds, **values):
    rows = spark.createDataFrame([(t,) for t in targets], "t string")
    return catalog_from_targets(rows, "t", [{"rule_type": kind, "values": values} for kind in kinds])


def joins_on(df, text):
    """Joins of the optimized plan that mention a text in their first line."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join " in line and text in line]


def strings(spark, words, column="value"):
    return spark.createDataFrame([(w, 1) for w in words], f"{column} string, n long")


@pytest.mark.parametrize("kind", ["levenshtein", "levenshtein_substring", "damerau_levenshtein_substring"])
def test_values_are_made_once(spark, kind):
    values, made = counting(spark, strings(spark, WORDS), "value")
    match_targets(values, catalog(spark, ["test", "contest"], kind, maximum_distance=1)).collect()
    assert made.value == len(WORDS)


@pytest.mark.parametrize("report_all", [False, True])
def test_records_are_read_for_their_names_and_for_the_join(spark, report_all):
    records = R.records_from(strings(spark, WORDS, "name"), "t", "name")
    records, made = counting(spark, records, "value")
    enrich(records, ".name", catalog(spark, ["test"], "levenshtein", maximum_distance=1), report_all=report_all).collect()
    assert made.value == 2 * len(WORDS)


def test_few_matches_are_broadcast_to_the_rows(spark):
    rows, made = counting(spark, strings(spark, WORDS, "word"), "word")
    found = match_strings(rows, "word", catalog(spark, ["test"], "levenshtein", maximum_distance=1))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.word for r in found.collect()) == ["test", "tests"]
    assert made.value == 2 * len(WORDS)


def test_many_matches_keep_all_rows(spark, monkeypatch):
    rules = catalog(spark, ["test", "x"], "levenshtein", maximum_distance=1)
    rows = strings(spark, [*WORDS, "test", None], "word").withColumn("word", F.when(K("word") != "none", K("word")))
    expected = sorted(map(tuple, match_strings(rows, "word", rules).select("word", "rule_set", "distance").collect()))
    monkeypatch.setattr("nearmark.plans.match.BROADCAST_BYTES", 1)
    assert sorted(map(tuple, match_strings(rows, "word", rules).select("word", "rule_set", "distance").collect())) == expected
    assert ("test", "test", 0) in expected and expected.count(("test", "test", 0)) == 2


def test_no_schema_of_whole_records(spark):
    rows = spark.createDataFrame([(t,) for t in ['{"k":"a"}', ' \n{"k":"b"}', '[{"k":"c"}]', '"k"', "k", None, '{"k":{"k":"d"}}', '{"k":1}']], "value string")
    found = R.with_field(rows, ".k")
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("schema_of_variant(variant_") == 0
    assert [r.name for r in found.collect()] == ["a", "b", None, None, None, None, None, None]
    assert [r.n for r in R.with_field(rows, ".k.k", "n").collect()] == [None] * 6 + ["d", None]


@pytest.mark.parametrize("kind,limits", [("levenshtein_substring", (0, 1, 3)), ("damerau_levenshtein_substring", (0, 1, 2))])
@pytest.mark.parametrize("mode", ["parity", "exhaustive"])
def test_short_and_long_parts_against_all_pairs(spark, kind, limits, mode):
    targets = spark.createDataFrame([(t,) for t in ["t", "st", "test", "testing", "contesting", "a" * 68, "tést"]], "t string")
    rules = catalog_from_targets(targets, "t", [{"rule_type": kind, "values": {"maximum_distance": k}} for k in limits])
    options, columns = Options(substring_mode=mode), [*PAIR_KEY, "distance", "substring"]
    parts = strings(spark, [*WORDS, "testing", "retesting", "xtesitngx", "a" * 63, "a" * 64, "a" * 69, "a" * 30 + "contestin"])
    found = match_values(parts, rules, options).select(*columns)
    chain = parts.select("value").crossJoin(rules.chains.select("chain_id").distinct()).withColumnRenamed("value", "part")
    expected = scored_pairs(chain, rules, options).where("match").select(*columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_records_can_be_written_compressed(spark, tmp_path):
    lines = spark.createDataFrame([(f'{{"i":{i}}}',) for i in range(50)], "value string")
    write_json_lines(lines, str(tmp_path / "a"), compression="gzip")
    text_folder(str(tmp_path / "b"), "gzip")(lines, 0)
    for name, files in (("a", "a/*.txt.gz"), ("b", "b/batch_id=0/*.txt.gz")):
        assert glob.glob(str(tmp_path / files))
        assert sorted(r.value for r in R.read_json_lines(spark, str(tmp_path / name)).collect()) == sorted(r.value for r in lines.collect())


def test_match_table_of_many_groups(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    rows = spark.range(300).selectExpr("id", "concat('g', id % 20) as group_name")
    write_match_table(rows, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).groupBy("group_name").count().where("count = 15").count() == 20
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_a_batch_that_is_read_once_is_not_kept(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a\nb\n")
    kept, got = [], []

    def work(batch):
        kept.append(batch.is_cached)
        return batch

    for number, once in enumerate((True, False)):
        run_batches(R.stream_json_lines(spark, str(tmp_path / "in")), work, [lambda df, _: got.extend(df.collect())],
                    str(tmp_path / f"checkpoint{number}"), available_now=True, reads_once=once).awaitTermination()
    assert kept == [False, True] and len(got) == 4


@pytest.mark.parametrize("report_all", [False, True])
def test_parts_that_are_values_need_no_join(spark, report_all):
    rules, columns = catalog(spark, ["test", "x"], "levenshtein", maximum_distance=1), ["value", "part_ord", "split_position", *PAIR_KEY, "match"]
    values = strings(spark, [*WORDS, None])
    found = match_values(values, rules, report_all=report_all)
    assert not joins_on(found, "salt")
    chain = values.where("value is not null").select(K("value").alias("part")).crossJoin(rules.chains.select("chain_id").distinct())
    expected = scored_pairs(chain, rules).where(F.lit(report_all) | K("match")).select(
        K("part").alias("value"), F.array().cast("array<int>").alias("part_ord"), F.lit(None).cast("int").alias("split_position"), *PAIR_KEY, "match")
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, expected.collect()))
    twice = match_values(values.unionByName(values), rules, report_all=report_all)
    assert twice.count() == 2 * expected.count()


@pytest.mark.parametrize("limit", [32, 1])
def test_values_are_made_once_for_few_exclusion_patterns(spark, monkeypatch, limit):
    monkeypatch.setattr(preprocess, "FEW_PATTERNS", limit)
    values, made = counting(spark, strings(spark, [*WORDS, None, "the", "THE"]), "value")
    entries = spark.createDataFrame([(1, "^t[he]"), (1, "(?i)THE$"), (1, None), (2, "x")], "chain_id long, entry string")
    parts = preprocess.start_parts(values, [1])
    kept = preprocess.drop_matching(parts, entries)
    if limit > 1:
        assert made.value == 0
    assert sorted(r.part or "" for r in kept.collect()) == sorted(w for w in [*WORDS, ""] if w not in ("test", "tests"))
    if limit > 1:
        assert made.value == len(WORDS) + 3
    assert sorted(r.part for r in preprocess.drop_matching(parts, entries, "left_semi").collect()) == ["THE", "test", "tests", "the"]


def test_exclusion_counters_without_lookups(spark):
    rules = catalog_from_targets(spark.createDataFrame([("a",)], "t string"), "t", [{"rule_type": "confusables", "values": {}}], [
        {"preprocessor_type": "split_target"},
        {"preprocessor_type": "exclusion_set", "exclusion_set_source": "list", "regex": True, "list": ["^th", "(tion|ment)$"]}])
    values, made = counting(spark, spark.createDataFrame([("the.station.x", 2), ("moment.y", 3), ("z", 5)], "value string, n long"), "value")
    assert [(r.step, r.exclusions) for r in exclusion_counters(values, rules).collect()] == [(1, 7)]
    assert made.value == 6  # for the steps and for the counts


def test_addresses_are_read_as_python_reads_them(spark):
    groups, rng, texts = ["1", "a", "0", "FFFF", ":", ":", "::", ".", "12"], random.Random(2), ["::", "::1.2.3.4", "1.2.3.4", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
        "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.04", "fe80::1%a", "::1\n", "1:::2", ":", "a:" * 5000 + "a"]
    texts += ["".join(rng.choice(groups) for _ in range(rng.randint(1, 17))) for _ in range(3000)]

    def expected(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        return None if "%" in text else format(int(address), "0128b" if address.version == 6 else "032b")

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", address_bits(K("t")).alias("bits"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r.t, r.bits) for r in rows.collect()] == [(t, expected(t)) for t in texts]


@pytest.mark.parametrize("kind,values", [("match_rating", {}), ("soundex", {"minimum_similarity": 3}), ("jaccard", {"minimum_similarity": 0.5})])
@pytest.mark.parametrize("limit", [1, 64 << 20])
def test_rules_that_are_broadcast_come_after_the_parts(spark, monkeypatch, kind, values, limit):
    monkeypatch.setattr(overlap, "BROADCAST_BYTES", limit)
    words = ["test", "tests", "tast", "contest", "contests", "smith", "smyth", "x", "a", ""]
    rules = catalog(spark, words[:6] + ["x"], kind, **values)
    parts = spark.createDataFrame([(w,) for w in words], "part string").crossJoin(rules.chains.select("chain_id").distinct())
    found = matched_pairs(parts, rules)
    shuffled = joins_on(found, "salt")
    assert shuffled
    expected = scored_pairs(parts, rules).where("match")
    assert sorted(map(str, found.select(*PAIR_KEY).collect())) == sorted(map(str, expected.select(*PAIR_KEY).collect()))


def small_tables(spark, folder):
    rows = [(i, f"testing the tests, {w} rest; test", "en") for i, w in enumerate([*WORDS, "tset", 'quo"te', "back\\slash"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "test rest contest")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name,module", [("stream_enriched", "results"), ("replayed_batch", "batches")])
def test_streams_read_compressed_records(spark, tmp_path, monkeypatch, name, module):
    written, module = [], importlib.import_module(f"workload.{module}")
    write = module.write_json_lines
    monkeypatch.setattr(module, "write_json_lines", lambda df, path, *how: (written.append(path), write(df, path, *how)))
    monkeypatch.setattr("nearmark.sinks.files.write_json_lines", write)
    found = {r.word: r.records for r in module.QUERIES[name](spark, small_tables(spark, str(tmp_path))).collect()}
    assert found["test"] == len(WORDS) + 3 + WORDS.count("test")
    assert glob.glob(f"{written[0]}/*.txt.gz") and not glob.glob(f"{written[0]}/*.txt")


def test_appended_rows_can_be_compressed_otherwise(spark, tmp_path):
    append_folder(str(tmp_path / "z"), "zstd")(spark.range(5), 0)
    assert glob.glob(str(tmp_path / "z/*.zstd.parquet")) and spark.read.parquet(str(tmp_path / "z")).count() == 5


def test_records_with_the_same_name_come_together(spark):
    names = ["test", "tests", "far", "tset"] * 5
    records = spark.createDataFrame([("t", f'{{"name":"{n}","row":{i}}}') for i, n in enumerate(names)], "input_type string, value string")
    rules = catalog(spark, ["test"], "levenshtein", maximum_distance=2)
    rows = enrich(records.coalesce(1), ".name", rules, alike_together=True).collect()
    came = [json.loads(r.value)["name"] for r in rows]
    assert len(came) == 15 and sum(a != b for a, b in zip(came, came[1:])) == 2
    assert sorted(r.value for r in rows) == sorted(r.value for r in enrich(records, ".name", rules).collect())


def test_plain_records_get_their_member_without_patterns(spark):
    texts = ['{"a":1}', ' {"a":1}\n', "{}", "{ }", '{ "a":1}', '{"m":3}', '{"a":"\\u006d"}', '{"\\u006d":3,"a":1}', '{"a":"}"} ', '{"a":"m"}']
    rows = spark.createDataFrame([(t,) for t in texts], "value string")
    out = rows.select("value", add_member(K("value"), "m", F.lit("[9]")).alias("out"))
    assert [json.loads(r.out) for r in out.collect()] == [json.loads(t) | {"m": [9]} for t in texts]
    assert [r.out for r in out.collect()][:2] == ['{"a":1,"m":[9]}'] * 2
    assert 'StartsWith(value' in out._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_leaf_of_a_record_is_kept(spark):
    plan = R.with_field(spark.createDataFrame([('{"k":"a"}',)], "value string"), ".k")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(array(try_variant_get(" in plan


def test_a_bitmap_is_as_large_as_its_strings_ask(spark, monkeypatch):
    from nearmark.operators import joins

    names = spark.range(3000).select(F.concat(F.lit("name"), "id").alias("name"))
    assert f"{joins.LEAST_BITS})" in joins.possible_rows(names, names, "name")._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(joins, "LEAST_BITS", joins.PIECE_BITS)
    assert "131072)" in joins.possible_rows(names, names, "name")._jdf.queryExecution().optimizedPlan().toString()
    assert joins.possible_rows(names.unionByName(names), names, "name").count() == 6000


def test_rows_that_are_their_strings_are_not_joined_again(spark, monkeypatch):
    monkeypatch.setattr("nearmark.plans.match.BROADCAST_BYTES", 1)
    rules = catalog(spark, ["test"], "levenshtein", maximum_distance=1)
    for names, expected in ((["test", "tset", "tests", None], ["test", "tests"]), (["test", "tests", "test"], ["test", "test", "tests"])):
        found = match_strings(spark.createDataFrame([(n,) for n in names], "word string"), "word", rules)
        assert sorted(r.word for r in found.collect()) == expected
        assert ("Join" in found._jdf.queryExecution().optimizedPlan().toString()) == (len(set(names)) < len(names))


def test_enriched_records_reads_a_record_once(spark, tmp_path):
    from workload.results import QUERIES

    out = QUERIES["enriched_records"](spark, small_tables(spark, str(tmp_path)))
    rows = out.collect()
    assert {(r.word, r.target): r.records for r in rows if r.doc_id == 0}[("test", "rest")] >= 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan[:plan.index("Generate explode(r")].splitlines() if "variant_get" in line]
