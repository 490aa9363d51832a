"""The gram query of regular expressions against the engine itself."""

from __future__ import annotations

import random
import re

import pytest

from nearmark.functions.patterns import FOLD_FROM, FOLD_TO, portable, required_texts
from nearmark.operators import exact

FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def branch_inside(pattern: str, text: str) -> bool:
    folded = text.translate(FOLD)
    branches = required_texts(pattern)
    return not branches or any(all(t in folded for t in branch) for branch in branches)


def random_pattern(draw: random.Random, depth: int = 3) -> str:
    kind = draw.randrange(9 if depth else 4)
    if kind < 3:
        return "".join(draw.choice("abAk") for _ in range(draw.randint(1, 3)))
    if kind == 3:
        return draw.choice([".", "[ab]", "[^a]", r"\w", r"\b", "^", "$", r"\.", "é"])
    inner = random_pattern(draw, depth - 1)
    if kind == 4:
        return f"({inner}|{random_pattern(draw, depth - 1)})"
    if kind == 5:
        return f"(?:{inner}){draw.choice(['?', '*', '+', '{2}', '{1,2}', '{0,1}', '+?', '{2,}'])}"
    if kind == 6:
        return f"{inner}|{random_pattern(draw, depth - 1)}"
    return inner + random_pattern(draw, depth - 1)


def test_no_match_without_a_branch():
    draw = random.Random(5)
    matches = 0
    for _ in range(4000):
        pattern = draw.choice(["", "", "(?i)"]) + random_pattern(draw)
        for _ in range(12):
            text = "".join(draw.choice("abAkK.é\u212a") for _ in range(draw.randint(0, 9)))
            if re.search(pattern, text):
                matches += 1
                assert branch_inside(pattern, text), (pattern, text)
    assert matches > 5000


@pytest.mark.parametrize("pattern, branches", [
    ("(?i)Foo|bar", [["bar"], ["foo"]]),
    (r"g(oo|00)gle\.com", [["g00gle.com"], ["google.com"]]),
    ("colou?r.*red", [["color", "red"], ["colour", "red"]]),
    ("^(?P<first>login|pay)-[a-z]+bank", [["login-", "bank"], ["bank", "pay-"]]),
    (r"\p{L}+abc|x", [["abc"], ["x"]]),
    ("(?i)straße", [["stra", "e"]]),
    ("(ab+)+c", [["ab", "c"]]),
    ("abc|", []), ("(?x)a b c", []), (r"\Qa|b\E", []), (r"\07abc", []), ("a{0}", []), ("(abc)*", []),
])
def test_branches(pattern, branches):
    assert required_texts(pattern) == branches


def test_long_choices_and_products():
    words = [f"word{i:04d}" for i in range(1000)]
    assert required_texts("|".join(words)) == [[w] for w in words]
    many = "(" + "|".join(words) + ")"
    assert required_texts(f"{many}.*{many}.*z") == [[w, "z"] for w in words]
    assert required_texts("(" * 5000 + "a" + ")" * 5000) == []


PATTERNS = ["(?i)Foo|bar", "colou?r.*red", "^.?cat(s|ed)?$", "x|yy", "(?i)kelvin", "(?i)éa", "[ab]c|dog", ".", "a*", "never|neither", "o.o"]
TEXTS = ["foo", "xFOOx", "bar", "color red", "colour is red", "redcolor", "cat", "cats", "scated", "acats2", "x", "yy", "y", "\u212aelvin",
         "KELVIN", "Éa", "éA", "ac", "bc", "hotdog", "", "foobar", "olo"]


@pytest.mark.parametrize("limit", [None, 0])
def test_hits_are_those_of_the_engine(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr("nearmark.operators.joins.BROADCAST_BYTES", limit)
    tried = []
    whole = exact._try_all

    def seen(parts, patterns):
        tried.extend(r.pattern for r in patterns.collect())
        return whole(parts, patterns)

    monkeypatch.setattr(exact, "_try_all", seen)
    parts = spark.createDataFrame([(c, t) for c in (1, 2) for t in TEXTS], "chain_id long, part string")
    patterns = spark.createDataFrame([(c, p) for c in (1, 2) for p in PATTERNS[c - 1:]] * 2, "chain_id long, pattern string")
    found = exact.regex_hits(parts, patterns).collect()
    pairs = patterns.distinct().join(parts, "chain_id").collect()
    java = {p: portable(p) for p in PATTERNS}
    rows = spark.createDataFrame([(r.chain_id, r.part, r.pattern, java[r.pattern]) for r in pairs], "c long, part string, pattern string, java string")
    wanted = {(r.c, r.part, r.pattern) for r in rows.where("part rlike java").collect()}
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert sorted(set(tried)) == [".", "a*"]


def test_hits_of_no_patterns(spark):
    parts = spark.createDataFrame([(1, "a")], "chain_id long, part string")
    none = spark.createDataFrame([], "chain_id long, pattern string")
    assert exact.regex_hits(parts, none).collect() == []
