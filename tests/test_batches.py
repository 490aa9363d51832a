"""Kept matches, refreshes, repeated batches, and scratch tables of batches."""

import os

import pytest
from pyspark.sql import functions as F

from nearmark import catalog_from_targets
from nearmark.operators import Options
from nearmark.plans.match import match_targets
from nearmark.session import cut, lasting_scratch, scratch_folder, scratch_scope
from nearmark.streaming.memory import MatchMemory, version
from nearmark.streaming.run import CommitLog, append_folder, count_rules, counted_rules, run_batches

K = F.col


def catalog(spark, targets, limit=1, **values):
    rows = spark.createDataFrame([(t,) for t in targets], "t string")
    return catalog_from_targets(rows, "t", [{"rule_type": "levenshtein", "values": {"maximum_distance": limit}, **values}])


def values(spark, words):
    return spark.createDataFrame([(w, 1) for w in words], "value string, n long")


def pairs(df):
    return sorted((r.value, r.rule_set, r.distance) for r in df.collect())


def added(memory):
    return [r.added for r in memory.refreshes().orderBy("generation").collect()]


def test_only_new_parts_are_compared_and_a_repeated_batch_gives_the_same(spark, tmp_path):
    memory, rules = MatchMemory(spark, str(tmp_path / "kept")), catalog(spark, ["abcd", "wxyz"])
    batches = [["abcd", "abce", "none"], ["abce", "wxya", "abcd", "other"], ["none", "abcd"], []]
    for number, words in enumerate(batches):
        for _ in range(2):
            got = pairs(match_targets(values(spark, words), rules, find=memory.finder(number)))
            assert got == pairs(match_targets(values(spark, words), rules))
    assert {r.batch_id: r.parts for r in memory.compared().collect()} == {0: 3, 1: 2}
    assert len(memory.generations()) == 1
    with pytest.raises(ValueError):
        from nearmark.plans.match import match_values

        match_values(values(spark, ["a"]), rules, report_all=True, find=memory.finder(9))


def test_a_refresh_compares_kept_parts_with_changed_rules_only(spark, tmp_path):
    memory, words = MatchMemory(spark, str(tmp_path / "kept")), ["abcd", "abxx", "wxyz", "qqqq"]
    versions = [catalog(spark, ["abcd", "wxyz"]), catalog(spark, ["abcd"]), catalog(spark, ["abcd", "wxyz", "qqqr"]),
                catalog(spark, ["abcd", "wxyz", "qqqr"], limit=2)]
    assert len({version(c) for c in versions}) == 4 and version(versions[0]) == version(catalog(spark, ["wxyz", "abcd"]))
    for number, rules in enumerate(versions):
        seen = [*words, f"wxy{number}"]  # a part that came while a rule was away meets it when the rule is back
        got = pairs(match_targets(values(spark, seen), rules, find=memory.finder(number)))
        assert got == pairs(match_targets(values(spark, seen), rules))
    everything = pairs(match_targets(values(spark, [*words, "wxy0", "wxy1", "wxy2", "wxy3"]), versions[3], find=memory.finder(9)))
    assert everything == pairs(match_targets(values(spark, [*words, "wxy0", "wxy1", "wxy2", "wxy3"]), versions[3]))
    assert added(memory) == [2, 0, 2, 3]
    # other options begin anew
    match_targets(values(spark, words), versions[3], Options(shortcut_distance=True), find=memory.finder(10)).collect()
    assert added(memory)[-1] == 3 and {r.batch_id: r.parts for r in memory.compared().collect()} == {10: 4}


def test_exit_rules_hold_over_kept_matches(spark, tmp_path):
    rows = spark.createDataFrame([("abcd",)], "t string")
    rules = catalog_from_targets(rows, "t", [
        {"rule_type": "levenshtein", "exit_on_match": True, "values": {"maximum_distance": 1}},
        {"rule_type": "hamming", "values": {"maximum_distance": 4}}])
    memory = MatchMemory(spark, str(tmp_path / "kept"))
    for number in range(2):
        found = match_targets(values(spark, ["abcd", "zzzz"]), rules, find=memory.finder(number)).collect()
        assert sorted((r.value, r.rule_type, r.early_match_exit) for r in found) == [("abcd", "levenshtein", True), ("zzzz", "hamming", None)]


def test_a_failed_sink_gets_the_batch_alone(spark, tmp_path):
    source = tmp_path / "in"
    os.mkdir(source)
    for i in range(3):
        (source / f"{i}.txt").write_text(f"a{i}\nb{i}\n")
    stream = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(source))
    faults, taken = [1, 2], []

    def second(df, batch_id):
        taken.append(batch_id)
        if batch_id in faults:
            faults.remove(batch_id)
            raise OSError("full")
        append_folder(str(tmp_path / "second"))(df, batch_id)

    for attempt in range(3):
        run = run_batches(stream, lambda b: cut(b, "lines"), [append_folder(str(tmp_path / "first")), second],
                          str(tmp_path / "cp"), available_now=True, commits=CommitLog(spark, str(tmp_path / "log")))
        try:
            run.awaitTermination()
        except Exception:  # noqa: BLE001 - the two faults
            assert attempt < 2
    want = sorted(f"{c}{i}" for i in range(3) for c in "ab")
    for name in ("first", "second"):
        assert sorted(r.value for r in spark.read.parquet(str(tmp_path / name)).collect()) == want
    assert taken == [0, 1, 1, 2, 2]


def test_scratch_tables_go_when_their_batch_ends(spark):
    def there(path):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    with scratch_scope(spark):
        inner = cut(spark.range(3), "inner").inputFiles()[0]
        with lasting_scratch():
            kept = cut(spark.range(3), "kept").inputFiles()[0]
        empty = scratch_folder(spark, "never-written")
        assert there(inner) and there(kept) and not there(empty)
    assert not there(inner) and there(kept)


def test_counters_of_batches_add_up(spark, tmp_path):
    rules = catalog(spark, ["abcd", "wxyz"])
    folder = str(tmp_path / "counters")
    for number, words in ((0, ["abcd", "none"]), (1, ["abcd", "wxyz"]), (1, ["abcd", "wxyz"])):
        count_rules(values(spark, words), rules, folder, number)
    got = {(r.rule_set, r.rule_matches, r.rule_misses, r.rule_errors) for r in counted_rules(spark, folder).collect()}
    assert got == {("abcd", 2, 2, 0), ("wxyz", 1, 3, 0)}
