"""Field paths, patterns, kernels, names, look-alikes and Kafka options: no Spark job needed."""

import json
import random

import numpy as np
import pandas as pd
import pytest

from nearmark.functions import domains, kernels, lookalike, paths
from nearmark.functions.patterns import pattern_problem, portable, required_texts
from nearmark.sources import kafka


@pytest.mark.parametrize("path,compiled", [
    (".domain_name", "$['domain_name']"), ("domain_name", "$['domain_name']"), ("names[0]", "$['names'][0]"),
    (".values.array[0].domain_name", "$['values']['array'][0]['domain_name']"), ("a[1][2].b", "$['a'][1][2]['b']"),
])
def test_good_paths(path, compiled):
    assert paths.compile_path(path) == compiled


@pytest.mark.parametrize("path,reason", [
    ("...", paths.EMPTY_NAME), (".", paths.EMPTY_NAME), ("a.", paths.EMPTY_NAME), (".values[3.x", paths.NO_CLOSING_BRACKET),
    (".values[3]domain_name", paths.NO_DOT_AFTER_INDEX), (".values.[3].domain_name", paths.EMPTY_NAME),
    ("[3].values.domain_name", paths.STARTS_WITH_INDEX), ("a[x]", paths.BAD_INDEX),
])
def test_bad_paths(path, reason):
    with pytest.raises(paths.FieldPathError) as error:
        paths.compile_path(path)
    assert error.value.reason == reason


def test_patterns():
    assert pattern_problem("[") and pattern_problem("a(?=b)") and pattern_problem(r"(a)\1")
    assert pattern_problem(r"netflix\.com\.$") is None
    assert portable(r"com\.$") == r"(?U)com\.\z" and portable("[$]") == "(?U)[$]"
    assert required_texts("^.?abc(s|ed)?$") == [["abc"]] and required_texts("abc|def") == [["abc"], ["def"]]
    assert required_texts("ab{2,3}cd") == [["abb", "cd"]] and required_texts(r"\d+foo") == [["foo"]]


def slow_osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_swap_distance():
    rng = random.Random(1)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(600)]
    left, right = kernels._bytes(words[::2]), kernels._bytes(words[1::2])
    assert list(kernels.osa_distances(left, right)) == [slow_osa(a, b) for a, b in zip(left, right)]
    assert list(kernels.osa_distances(kernels._bytes(["ca", "test"]), kernels._bytes(["abc", "tset"]))) == [3, 1]


def test_jaro():
    scores = kernels.jaro_scores(kernels._chars(["example", "", "a"]), kernels._chars(["exemple", "", ""]))
    assert np.round(scores, 2).tolist() == [0.90, 1.0, 0.0]
    assert round(kernels.jaro_winkler.func(pd.Series(["example"]), pd.Series(["exemple"]))[0], 2) == 0.92


def test_internationalised_names():
    assert domains.encode("www.café.com") == "www.xn--caf-dma.com"
    assert domains.decode("www.xn--caf-dma.com") == "www.café.com"
    assert domains.decode(domains.encode("café")) == "café"
    assert domains.decode("a.xn--€.b") is None


def test_look_alikes():
    same = lookalike.skeleton_of
    assert same("t℮st") == same("test") and same("𝓗℮𝐥1೦") == same("Hello") and same("𝓗℮𝐥1೦") != same("test")


def test_kafka_options():
    options = kafka.source_options("broker", ["a", "b"], "group", pointer="begin", client_options={"x.y": "1"})
    assert options == {"kafka.x.y": "1", "kafka.bootstrap.servers": "broker:9092", "subscribe": "a,b",
                       "groupIdPrefix": "group", "startingOffsets": "earliest"}
    assert kafka.starting_offsets("now") == "latest" and kafka.starting_offsets(None) is None
    assert json.loads(kafka.starting_offsets(5, {"a": {0: 12, 1: 3}})) == {"a": {"0": 7, "1": 0}}
    with pytest.warns(UserWarning):
        assert kafka.starting_offsets("yesterday") is None
    assert kafka.sink_options("h", "t", "me", 1)["topic"] == "t"


def test_whole_names_with_a_sharp_s_come_back(spark):
    import __spark_entry__ as contract

    query = contract.queries()["whole_name_round_trip_every_letter"]
    rows = query(spark, "/root/testdata/sf0.001").collect()
    assert any("ß" in r.domain for r in rows) and all(r.back == r.domain.lower() for r in rows)
