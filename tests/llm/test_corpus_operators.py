"""Licence scans, phrase mining and the manifest against plain Python, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearmark.llm import licences, manifest, phrases, tables

CLASH = "n_words int, licences string, row string, words string, f long, id long, tree string, item string, hash string"


def table_of(spark, rows, clash=True):
    """``rows`` of doc_id, text, lang, with columns whose names the operators use themselves."""
    extra = (1, "x", "y", "z", 2, 3, "t", "i", "h")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, lang string, {CLASH}")


# --- licences ---------------------------------------------------------------------------------------------

LICENCE_TEXTS = [
    None, "", "  ", "plain words only", "GNU General Public License, GNU general public license", "the Apache\nLicense CC BY-NC 4.0",
    "apache licenseé then apache éclair license", "MIT License " * 300, "mit " * 4000 + "license " + "word " * 4000,
    "Permission is hereby granted, free of charge, to any person obtaining a COPY of this software and all associated documentation files "
    "(the Software), to deal in the Software without restriction", "general public license of gnu",
    "This program: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "redistribution and use in source and binary forms, with or without modification, are permitted", "cc by", "by cc", "licence KKK cc",
    "MIT License " * 300,
]


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_licences(texts, settings):
    """Every template tried at every place of every text."""
    words = [plain_words(t) for t in texts]
    seen = {}
    for w in {w for t in settings.templates for w in t.words}:
        if n := sum(w in ws for ws in words):
            seen[w] = n
    out = []
    for ws in words:
        found = []
        for t in settings.templates:
            known = sorted((seen[w], w, i) for i, w in enumerate(t.words) if w in seen)[:1 if t.exact else settings.anchors]
            slack = 0 if t.exact else settings.slack
            for start in range(-len(t.words), len(ws)):
                agree = sum(0 <= start + i < len(ws) and ws[start + i] == w for _, w, i in known)
                if not known or agree < min(settings.agreeing, len(known)):
                    continue
                near = f" {' '.join(ws[max(start - slack, 0):max(start + len(t.words) + slack, 0)])} "
                if all(f" {p} " in near for p in t.phrases):
                    found.append((t.label, t.exact, start, start + len(t.words), agree / len(known)))
        out.append((len(ws), found))
    return out


def test_licences_equal_every_template_at_every_place(spark):
    settings = licences.Settings()
    got = licences.scan(table_of(spark, [(i, t, None) for i, t in enumerate(LICENCE_TEXTS)])).orderBy("doc_id").collect()
    for row, (n, found) in zip(got, plain_licences(LICENCE_TEXTS, settings), strict=True):
        assert row.n_words == n and row.row == "y" and row.tree == "t"
        assert [tuple(x) for x in row.licences] == found
    assert {x.label for x in got[9].licences} == {"mit"} and {x.label for x in got[12].licences} == {"bsd"}
    assert len(got[7].licences) == 300 and got[7].licences == got[16].licences
    assert {x.label for x in got[11].licences} == {"gpl"} and not got[10].licences and not got[15].licences
    empty = table_of(spark, []).drop("licences", "n_words")
    assert licences.scan(empty).count() == 0


def test_licences_read_no_python(spark):
    plan = licences.scan(table_of(spark, [(1, "MIT License", None)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- phrases ----------------------------------------------------------------------------------------------


def plain_phrases(rows, least):
    """All phrases counted one by one."""
    counts, totals = {}, {}
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] = totals.get(lang, 0) + len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    key = lang, tuple(ws[i:i + k])
                    counts[key] = counts.get(key, 0) + 1
    out = []
    often = {k: v for k, v in counts.items() if len(k[1]) > 1 and v >= least}
    for (lang, ws), a in often.items():
        inside = any(lo == lang and len(lw) > len(ws) and 100 * f >= 80 * a
                     and any(lw[i:i + len(ws)] == ws for i in range(len(lw) - len(ws) + 1)) for (lo, lw), f in often.items())
        if not inside:
            score, k = min((2_000_000 * a // (counts[lang, ws[:k]] + counts[lang, ws[k:]]), k) for k in range(1, len(ws)))
            out.append((lang, " ".join(ws), a, counts[lang, ws[:k]], counts[lang, ws[k:]], totals[lang], score))
    return out


def phrase_rows():
    rng = random.Random(5)
    words = ["the", "of", "New", "York", "city", "é", "ÀB", "x-1", "naïve"]
    rows = [(i, " ".join(rng.choices(words, [9, 8, 3, 3, 3, 2, 2, 1, 1], k=rng.randint(1, 40))), rng.choice(["en", "fr", None, "und"]))
            for i in range(120)]
    rows += [(200 + i, "New York city. new york CITY,new\tyork  city\nnew york\x0bcity", "en") for i in range(5)]
    rows += [(300, None, "en"), (301, "", None), (302, " \t ", "de"), (303, "New York " * 3000, "en"), (304, "...", "es"), (None, "of the", "en")]
    return rows


def test_phrases_equal_plain_counts_with_broadcast_and_with_joined_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PAIRS_PER_BUCKET", 1000)
    monkeypatch.setattr(phrases, "BUFFER_PAIRS", 100)
    rows = phrase_rows()
    want = sorted(plain_phrases(rows, 3))
    assert len(want) > 50 and {w[0] for w in want} == {"en", "fr", "und"}
    docs = table_of(spark, rows)
    for settings in (phrases.Settings(min_count=3), phrases.Settings(min_count=3, dictionary_rows=0, hot_ids=2)):
        assert sorted(tuple(r) for r in phrases.collocations(docs, settings=settings).collect()) == want
    best = phrases.best(spark.createDataFrame(want, "lang string, phrase string, a long, l long, r long, n long, score long"), 2).collect()
    for lang in ("en", "fr", "und"):
        first = sorted((w for w in want if w[0] == lang), key=lambda w: (-w[6], -w[2], w[1].encode()))[:2]
        assert [(r.rank, r.phrase) for r in sorted(best, key=lambda r: r["rank"]) if r.lang == lang] == [(i + 1, w[1]) for i, w in enumerate(first)]
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("doc_id = 302")).count() == 0


def test_dense_tiles_count_like_sorted_coordinates(monkeypatch):
    rng = np.random.default_rng(3)
    ids = (rng.integers(0, 60, 20_000) ** 2 + 1).astype(np.int64)
    keys = ids[:-1] << 32 | ids[1:]
    want = np.unique(keys, return_counts=True)
    for dense in (1, 3_000, 1 << 40):
        monkeypatch.setattr(phrases, "DENSE_PAIRS", dense)
        got = phrases.tile_counts(keys)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))
    assert [len(x) for x in phrases.tile_counts(keys[:0])] == [0, 0]


def test_top_lists_cut_in_parts_are_the_same(spark):
    rows = [("en", f"p{i % 977} q{i}", 30 + i % 5, 100, 100, 9, i % 50) for i in range(3000)]
    scored = spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long")
    want = sorted(rows, key=lambda r: (-r[6], -r[2], r[1].encode()))[:20]
    assert [r.phrase for r in phrases.best(scored, 20).orderBy("rank").collect()] == [r[1] for r in want]


# --- numbering --------------------------------------------------------------------------------------------


def test_numbers_run_through_ranges(spark, monkeypatch):
    monkeypatch.setattr(tables, "RANGE_ROWS", 50)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "a").when(F.col("id") < 703, "b").alias("g"), (F.col("id") * 7919 % 1000).alias("v"))
    got = tables.numbered(rows, ["g"], [F.col("v").desc()], "numbers").collect()
    for g in ("a", "b", None):
        held = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in held] == list(range(len(held))) and [r.v for r in held] == sorted((r.v for r in held), reverse=True)
        assert len(held) == {"a": 700, "b": 3, None: 297}[g]


# --- manifest ---------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """Levels from the leaves to the top."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_manifest(rows, tampered):
    """Proofs and folds of all leaves, by keeping every level."""

    def leaf(r):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in r])

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]])
    above = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for n, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            fold, proof = leaf(tampered(r)), ""
            for levels, at in ((trees[g], i), (above, n)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    proof += other
                    fold = h(other, fold) if at & 1 else h(fold, other)
                    at >>= 1
            out.append((r[0], leaf(r), trees[g][-1][0], above[-1][0], h(proof), fold, fold == above[-1][0]))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


def check_manifest(spark, rows):
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, tree string, key string")
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = manifest.verify(manifest.manifest(
        docs, "doc_id", "lang", fields, {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})).collect()

    def tampered(r):
        one_more = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        return (*r[:3], r[3] + 1, r[4]) if one_more else r

    want = plain_manifest(rows, tampered)
    assert in_order(tuple(r) for r in got) == in_order(want)
    return want


def test_manifest_of_awkward_rows(spark):
    rows = [(i, f"s{i % 3}", ["en", "fr", None, "é", ""][i % 5] if i < 40 else "en", i if i % 4 else None, "é" * i if i % 6 else None)
            for i in range(70)]
    rows += [(5, "s", "en", 1, "x")] * 3 + [(None, None, None, None, None), (-7, "", "alone", 0, ""), (99, "s", "long", 9, "w " * 50_000)]
    want = check_manifest(spark, rows)
    assert 0 < sum(not w[6] for w in want) < len(want)
    assert check_manifest(spark, [(3, "s", "en", 1, "one")])[0][2] == check_manifest(spark, [(3, "s", "en", 1, "one")])[0][3]
    assert check_manifest(spark, []) == []


def test_manifest_over_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(manifest, "TIER_LEVELS", 2)
    monkeypatch.setattr(manifest, "RUN", 4)
    monkeypatch.setattr(manifest, "LEAVES_PER_COPY", 3)
    monkeypatch.setattr(manifest, "BROADCAST_NODES", 10)
    check_manifest(spark, [(i, "s", f"l{i % 23}" if i > 150 else "hot", i, f"text {i}") for i in range(400)])


def test_ids_are_looked_up_by_the_words_of_a_chunk(spark):
    known = pa.array(["the", "of", "a", "é"], pa.large_string())
    words = pa.array(["a", ".", "the", "a", "é", "none", ""], pa.large_string())
    assert phrases.ids_among(words, known).tolist() == [3, 0, 1, 3, 4, 0, 0]
    assert phrases.ids_among(words[:0], known).tolist() == [] and phrases.ids_among(words, known[:0]).tolist() == [0] * 7


def test_joined_ids_are_laid_out_without_collecting_pieces(spark):
    ids = spark.createDataFrame([("en", "the", 1), ("en", "of", 2), ("fr", "de", 1)], "lang string, word string, id long")
    rows = [("en", ["the", "x", "of", "the"]), ("fr", ["x", "de"]), ("en", ["x"]), ("de", ["the"]), ("en", ["of"] * 300)]
    laid = phrases._joined(spark.createDataFrame(rows, "lang string, held array<string>"), ids, "word", phrases.Settings(hot_ids=1))
    assert "collect_list" not in laid._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.lang, np.frombuffer(r.held, np.int32).tolist()) for r in laid.collect())
    assert got == [("en", [1, 0, 2, 1, 0]), ("en", [2] * 300 + [0]), ("fr", [0, 1, 0])]
