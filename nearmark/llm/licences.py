"""Licence notices by a positional index of rare words, in DataFrame functions only.

The corpus says how rare each word of the notices is. Every template is indexed under its rarest words that the corpus has,
with their places in it. A text looks up these words among its own; what a word finds, its place in the text less its place in the
template, is the place where the template would begin, and a template stands where enough of its words agree on that
place. It counts if all its key phrases are there, within ``slack`` words of where the template says it lies.

A phrase template (``exact``) is indexed under its one rarest word and is its own key phrase, so every place of it is found.
What the driver holds is bounded by the templates: a count for each of their words.

Defined results: a null text counts as empty and has no licences; a text of any length is read whole; equal rows get equal
results; an empty table gives an empty table; all columns of the input are kept, and one that has the name of a result column
(``n_words``, ``licences``) is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """Words of a notice, and the phrases without which it does not count."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    exact: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split(" ")

    @property
    def phrases(self) -> tuple[str, ...]:
        return (self.text,) if self.exact else self.keys


# The phrases and labels that are always looked for, then sentences that licences ask to be quoted.
PHRASES = (
    Template("gpl", "gnu general public license", exact=True),
    Template("apache", "apache license", exact=True),
    Template("cc-by", "cc by", exact=True),
    Template("mit", "mit license", exact=True),
)
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the software without restriction", ("free of charge", "without restriction")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("for any purpose", "without fee")),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
             "with the license", ("version 2 0",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("public license version 3",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
             "free software foundation", ("gnu general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
             ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
             ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
             "following conditions are met", ("source and binary forms", "with or without modification")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable",
             ("as is", "held liable")),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights",
             ("waived all copyright",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
             ("creative commons attribution 4 0",)),
)


@dataclass(frozen=True)
class Settings:
    templates: Sequence[Template] = field(default=PHRASES + NOTICES)
    anchors: int = 6  # words a template is indexed under
    agreeing: int = 4  # of these, how many must agree on a place
    slack: int = 6


@dataclass(frozen=True)
class Entry:
    """What the index holds of a template: its number, its rare words with their places, how many must agree."""

    number: int
    anchors: list[tuple[str, int]]
    agreeing: int


def _once(value: Column) -> Column:
    """A value as the one row of a generator, which evaluates it once however often it is read."""
    return F.explode(F.array(value))


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; ``lower`` does it where there are no other letters that it would change."""
    body = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.when(body.rlike(r"[^\x00-\x7F]"), F.translate(body, UPPER, LOWER)).otherwise(F.lower(body))
    return F.array_remove(F.split(plain, NOT_WORD), "")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def document_counts(words: DataFrame, settings: Settings = Settings()) -> dict[str, int]:
    """In how many texts each word of the templates occurs, from a table with a ``words`` column."""
    vocabulary = sorted({w for t in settings.templates for w in t.words})
    counted = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counted.collect()}


def index(counts: dict[str, int], settings: Settings = Settings()) -> list[Entry]:
    """The rarest words of each template among those the corpus has; templates whose key phrases it cannot have are left out."""
    entries = []
    for number, template in enumerate(settings.templates):
        if not all(w in counts for p in template.phrases for w in p.split(" ")):
            continue
        known = sorted((counts[w], w, i) for i, w in enumerate(template.words) if w in counts)
        rarest = [(w, i) for _, w, i in known[:1 if template.exact else settings.anchors]]
        entries.append(Entry(number, rarest, min(settings.agreeing, len(rarest))))
    return entries


def _found(words: Column, entries: list[Entry], settings: Settings) -> Column:
    """``template, start, agreeing`` of each template that stands in the words."""
    postings = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(e.number).alias("template"), F.lit(i).alias("at"))
                         for e in entries for w, i in e.anchors])
    rare = _strings(sorted({w for e in entries for w, _ in e.anchors}))
    agreeing = {e.number: e.agreeing for e in entries}
    needed = F.array(*[F.lit(agreeing.get(t, 0)) for t in range(len(settings.templates))])
    slack = F.array(*[F.lit(0 if t.exact else settings.slack) for t in settings.templates])
    length = F.array(*[F.lit(len(t.words)) for t in settings.templates])
    phrases = F.array(*[_strings([f" {p} " for p in t.phrases]) for t in settings.templates])

    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("place")))
    hits = F.filter(placed, lambda x: F.array_contains(rare, x["word"]))
    starts = F.sort_array(F.flatten(F.transform(hits, lambda h: F.transform(
        F.filter(postings, lambda p: p["word"] == h["word"]),
        lambda p: F.struct(p["template"].alias("template"), (h["place"] - p["at"]).alias("start"))))))

    def runs(s: Column) -> Column:
        """Equal neighbours of a sorted array, with their number: from each first one to the next."""
        first = F.filter(F.transform(s, lambda x, i: F.when(F.get(s, i - 1).isNull() | (F.get(s, i - 1) != x), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(F.array(first), lambda f: F.transform(f, lambda b, j: F.struct(
            F.get(s, b)["template"].alias("template"), F.get(s, b)["start"].alias("start"),
            (F.coalesce(F.get(f, j + 1), F.size(s)) - b).alias("agreeing")))))

    def whole(r: Column) -> Column:
        margin = F.get(slack, r["template"])
        begin = F.greatest(r["start"] - margin, F.lit(0))
        size = F.greatest(r["start"] + F.get(length, r["template"]) + margin - begin, F.lit(0))
        near = F.concat(F.lit(" "), F.array_join(F.slice(words, begin + 1, size), " "), F.lit(" "))
        return F.forall(F.get(phrases, r["template"]), lambda p: F.contains(near, p))

    candidates = F.flatten(F.transform(F.array(starts), lambda s: F.filter(runs(s), lambda r: r["agreeing"] >= F.get(needed, r["template"]))))
    return F.when(F.arrays_overlap(words, rare), F.filter(candidates, whole))


def scan(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Add ``n_words`` and ``licences``: ``label, exact, start, end, score`` of each notice, in order of template and place.

    Places count words from 0, ``end`` is exclusive; ``score`` is the share of the template's index words that agree.
    """
    held = docs.select(F.struct("*").alias("row"), _once(words_of(F.col(text))).alias("words"))
    entries = index(document_counts(held.select("words"), settings), settings)
    kind = "array<struct<label: string, exact: boolean, start: int, end: int, score: double>>"
    licences = F.array().cast(kind)
    if entries:
        anchors = {e.number: len(e.anchors) for e in entries}
        facts = F.array(*[F.struct(F.lit(t.label).alias("label"), F.lit(t.exact).alias("exact"), F.lit(len(t.words)).alias("words"),
                                   F.lit(anchors.get(n, 1)).alias("anchors")) for n, t in enumerate(settings.templates)])
        found = _found(F.col("words"), entries, settings)

        def told(r: Column) -> Column:
            fact = F.get(facts, r["template"])
            return F.struct(fact["label"].alias("label"), fact["exact"].alias("exact"), r["start"].alias("start"),
                            (r["start"] + fact["words"]).alias("end"), (r["agreeing"] / fact["anchors"]).alias("score"))

        licences = F.coalesce(F.transform(found, told).cast(kind), licences)
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "licences")]
    scanned = held.select("row", F.size("words").cast("long").alias("n"), _once(licences).alias("found"))
    return scanned.select(*kept, F.col("n").alias("n_words"), F.col("found").alias("licences"))


def labels(licences: Column) -> Column:
    """Different labels in order, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(licences, lambda x: x["label"]))), ",")
