"""Near duplicates against brute force."""

import random

import pytest

from nearmark.llm import neardup, tables
from nearmark.llm.graph import components

SCHEMA = "doc_id long, text string, n string, node string, kept int"


def texts():
    rng = random.Random(11)
    words = [f"Word{i}" for i in range(300)]
    out = [None, "", " \n ", "one", "ONE", "two words", "Two words", "three little words"]
    for _ in range(6):
        base = rng.choices(words, k=rng.randrange(40, 160))
        out.append(" ".join(base))
        for _ in range(18):
            copy = list(base)
            for _ in range(rng.randrange(0, 7)):
                kind, at = rng.randrange(3), rng.randrange(len(copy))
                copy[at:at + (kind != 1)] = [] if kind == 2 else [rng.choice(words)]
            out.append(" ".join(copy))
    out.append(" ".join(rng.choices(words, k=20_000)))
    return out + out[10:14]


def sets_of(text, size):
    words = [w.lower() for w in (text or "").split()]
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def brute(rows, size, percent):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, sets_of(t, size)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {(i, len(s), find(i), i == find(i)) for i, s in sets}


@pytest.mark.parametrize(("size", "percent", "rounds", "keys"), [(3, 85, 2, None), (5, 80, 0, None), (3, 85, 1, 0)])
def test_components(spark, monkeypatch, size, percent, rounds, keys):
    if keys is not None:
        monkeypatch.setattr(tables, "BROADCAST_KEYS", keys)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    got = neardup.cluster(df, settings=neardup.Settings(words=size, percent=percent, pivot_rounds=rounds))
    assert {tuple(r) for r in got.drop("class_id").select("doc_id", "n_shingles", "component_id", "kept").collect()} == brute(rows, size, percent)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    same = "a text of a few words that is here more than once"
    rows = [(None, same, None, None, None), (5, same, "x", "y", 1), (5, same, "x", "y", 1), (9, same.upper(), "x", "y", 2),
            (None, None, None, None, None), (3, None, "z", "z", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = neardup.cluster(df)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found.collect()), key=str) == sorted(
        [(None, None, True), (None, None, True), (3, 3, True), (5, 5, True), (5, 5, True), (9, 5, False)], key=str)
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 5, None, None]
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.cluster(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_least_matches_prune_only_unlikely_pairs():
    settings = neardup.Settings(percent=85)
    limits = neardup.least_matches(settings)
    assert limits[-1][0] == settings.hashes
    assert all(0 < m < n * settings.threshold for n, m in limits)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 10 for i in range(11, 41)}, **{i: 100 for i in range(101, 160)}}
