"""Repeated byte strings and word windows against brute force, on every path of the plan."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from nearmark.llm import recompression, repeats, suffixes, tables

SCHEMA = "doc_id long, text string, spans string, doc string, h int"


def texts():
    """Random, periodic and copied texts, with shared passages at odd places."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=160))
    out = [None, "", " ", "short text", passage, passage]
    for i in range(25):
        before, after = (" ".join(rng.choices(words, k=rng.randrange(5, 200))) for _ in range(2))
        cut = rng.randrange(0, 300)
        out.append(f"{before} {passage[cut:cut + rng.randrange(300, 700)]} {after}")
        edited = passage.split()
        edited[rng.randrange(len(edited))] = "edit"
        out.append(" ".join(edited) + f" {i}")
    out += ["a b " * 300, "a b c " * 250, "x " * 900, "é" * 500, "é" * 450 + "z", "\n".join(["same line of words"] * 60)]
    out.append(" ".join(rng.choices(words, k=20_000)))
    return out


def rows(spark):
    data = [(i, t, "mine", "clash", 1) for i, t in enumerate(texts())]
    data += [data[7], (7, "another text under the same id", "mine", "clash", 2), (None, data[8][1], None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def brute(units, size, join):
    """Covered flags of each sequence of units."""
    seen = Counter(join(u[i:i + size]) for u in units for i in range(len(u) - size + 1))
    flags = []
    for u in units:
        gone = np.zeros(len(u), bool)
        for i in range(len(u) - size + 1):
            if seen[join(u[i:i + size])] > 1:
                gone[i:i + size] = True
        flags.append(gone)
    return flags


def runs(flags):
    return int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())


@pytest.fixture(scope="module")
def docs(spark):
    return rows(spark).cache()


@pytest.fixture(params=["plain", "hot", "shuffled", "small groups"])
def path(request, monkeypatch):
    if request.param == "hot":
        monkeypatch.setattr(repeats, "HOT_ZONES", 3)
    if request.param == "shuffled":
        monkeypatch.setattr(tables, "BROADCAST_KEYS", 0)
    if request.param == "small groups":
        monkeypatch.setattr(repeats, "GROUP_ROWS", 5)


def test_bytes(docs, path):
    marked = suffixes.repeated_bytes(docs)
    assert marked.columns == ["doc_id", "text", "doc", "h", "spans"]
    got = sorted(map(str, suffixes.summary(marked).collect()))
    given = docs.select("doc_id", "text").collect()
    units = [(r.text or "").encode() for r in given]
    want = []
    for r, u, f in zip(given, units, brute(units, 400, bytes), strict=True):
        kept = bytes(np.frombuffer(u, np.uint8)[~f])
        want.append((r.doc_id, len(u), int(f.sum()), runs(f), hashlib.sha256(kept).hexdigest()))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, w, strict=True)) + ")" for w in want)


def test_words(docs, path):
    got = sorted(map(str, recompression.summary(recompression.repeated_words(docs)).collect()))
    given = docs.select("doc_id", "text").collect()
    units = [(r.text or "").encode().split() for r in given]
    want = []
    for r, u, f in zip(given, units, brute(units, 35, b" ".join), strict=True):
        kept = b" ".join(w for w, gone in zip(u, f, strict=True) if not gone)
        want.append((r.doc_id, len(u), int(f.sum()), hashlib.sha256(kept).hexdigest()))
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted("Row(" + ", ".join(f"{c}={v!r}" for c, v in zip(columns, w, strict=True)) + ")" for w in want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffixes.repeated_bytes(empty).count() == 0
    assert recompression.repeated_words(empty).count() == 0


def test_blind_tries_sort_like_python():
    rng = random.Random(1)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(0, 60))) for _ in range(400)]
    strings += [b"q" * 40 + bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) for _ in range(200)]
    group = np.array([rng.randrange(3) for _ in strings])
    order, lcp = suffixes.sort_suffixes(strings, group)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings, strict=True))
    for j in range(1, len(order)):
        a, b = order[j - 1], order[j]
        common = next((k for k, (x, y) in enumerate(zip(strings[a], strings[b], strict=False)) if x != y),
                      min(len(strings[a]), len(strings[b])))
        assert lcp[j] == (common if group[a] == group[b] else -1)
