"""Rule vectors, sound codes against commons-codec, and keyed jobs against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from nearmark import Options, catalog_from_targets, match_strings
from nearmark.functions import phonetic, text
from nearmark.operators import bitmaps, edit, joins
from nearmark.operators.preprocess import make_parts
from nearmark.plans.match import matched_pairs, scored_pairs


def rule(rule_type, exit_on_match=False, **values):
    return {"rule_type": rule_type, "values": values, "exit_on_match": exit_on_match}


def results(spark, target, rules, inputs, **kwargs):
    catalog = catalog_from_targets(spark.createDataFrame([(target,)], "t string"), "t", rules)
    rows = match_strings(spark.createDataFrame([(i,) for i in inputs], "s string"), "s", catalog, **kwargs).collect()
    return {(r.s, r.rule_idx): r for r in rows}


def test_vectors_of_edit_rules(spark):
    found = results(spark, "netflix", [
        rule("levenshtein_substring", maximum_distance=1), rule("damerau_levenshtein_substring", maximum_distance=1)],
        ["confirmimonnetfloxconfirmation", "netfli", "somecompletelyotherstring", "confirmimonneftlixconfirmation"])
    assert found["confirmimonnetfloxconfirmation", 0].substring == "netflox"
    assert found["netfli", 0].distance == 1 and found["netfli", 0].substring is None
    assert found["confirmimonneftlixconfirmation", 1].substring == "neftlix"
    assert not any(s == "somecompletelyotherstring" for s, _ in found)
    found = results(spark, "tset", [rule(t, maximum_distance=2) for t in ("levenshtein", "damerau_levenshtein", "hamming")],
                    ["test", "longer string"], report_all=True)
    assert [found["test", i].distance for i in range(3)] == [2, 1, 2]
    assert found["longer string", 2].distance is None and not found["longer string", 2].match


def test_window_modes(spark):
    rules = [rule("levenshtein_substring", maximum_distance=1)]
    assert not results(spark, "test", rules, ["mytestx"])
    assert results(spark, "test", rules, ["mytestx"], options=Options(substring_mode="exhaustive"))["mytestx", 0].distance == 0


def test_vectors_of_other_rules(spark):
    found = results(spark, "www.google.com", [rule("bitflip"), rule("bitflip", case_sensitive=False),
                                              rule("bitflip", char_subset="custom", custom_char_subset=".n"),
                                              rule("regex", pattern=r"google\.com$"), rule("cidr", address="192.168.0.0/24")],
                    ["wwwngoogle.com", "www.googlu.com", "licrosoft", "WWWNGOOGLE.COM", "www.google.com", "google.com\n",
                     "192.168.0.30", "192.168.1.30"])
    assert set(found) == {
        ("wwwngoogle.com", 0), ("wwwngoogle.com", 1), ("wwwngoogle.com", 2), ("www.googlu.com", 0), ("www.googlu.com", 1),
        ("WWWNGOOGLE.COM", 1), ("www.google.com", 1),
        # a pattern may be found anywhere, and $ is not before a final line break
        ("www.google.com", 3), ("wwwngoogle.com", 3), ("192.168.0.30", 4)}
    found = results(spark, "Smythers", [rule("soundex", minimum_similarity=3),
                                        rule("soundex", minimum_similarity=3, soundex_type="refined")], ["Smithers", "čest"], report_all=True)
    assert found["Smithers", 0].similarity == 4 and found["Smithers", 1].similarity == 8
    assert found["čest", 0].error and not found["čest", 0].match
    assert results(spark, "Frances", [rule("match_rating")], ["Franciszek", "Frances"]).keys() == {("Franciszek", 0), ("Frances", 0)}
    assert results(spark, "Selina", [rule("metaphone")], ["Selena"])["Selena", 0].primary_code == "SLN"
    double = results(spark, "Bryan", [rule("metaphone", metaphone_type="double")], ["Brian"])["Brian", 0]
    assert (double.primary_code, double.alternate_code) == ("PRN", "PRN")
    assert results(spark, "Brown", [rule("nysiis")], ["Brian"])["Brian", 0].encoded == "BRAN"


def test_codes_equal_commons_codec(spark):
    rng = random.Random(2)
    pieces = "CH SCH GH WH TH A E I O U IA IE ER Z S CC LL MB UM GN KN WR EV H W Y J T R C G D X P F B M N K Q V".split()
    words = sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(2, 6))) for _ in range(1500)})
    codec = spark._jvm.org.apache.commons.codec.language
    double, single = codec.DoubleMetaphone(), codec.Metaphone()
    double.setMaxCodeLen(1000)
    single.setMaxCodeLen(1000)
    for word in words:
        assert phonetic.metaphone_of(word) == (single.encode(word) or ""), word
        expected = (double.doubleMetaphone(word, False) or "", double.doubleMetaphone(word, True) or "")
        assert phonetic.double_metaphone_of(word) == expected, word
    w = F.col("w")
    rows = spark.createDataFrame([(x,) for x in words], "w string").select(
        "w", phonetic.soundex_code(w).alias("s"), phonetic.refined_soundex_code(w).alias("r"),
        phonetic.nysiis_code(w, F.lit(False)).alias("n"), phonetic.match_rating_code(w).alias("m")).collect()
    soundex, refined, nysiis, rating = (codec.Soundex.US_ENGLISH, codec.RefinedSoundex(), codec.Nysiis(False),
                                        codec.MatchRatingApproachEncoder())
    for row in rows:
        assert (row.s, row.r, row.n, row.m) == tuple(e.encode(row.w) or "" for e in (soundex, refined, nysiis, rating)), row


CASES = {
    "levenshtein": [rule("levenshtein", maximum_distance=k) for k in (0, 1, 3)],
    "damerau": [rule("damerau_levenshtein", maximum_distance=k) for k in (1, 2, 3)],
    "hamming": [rule("hamming", maximum_distance=k) for k in (0, 1, 3)],
    "windows": [rule("levenshtein_substring", maximum_distance=k) for k in (0, 1, 3)],
    "swap_windows": [rule("damerau_levenshtein_substring", maximum_distance=k) for k in (0, 1, 2)],
    "jaccard": [rule("jaccard", minimum_similarity=s) for s in (0, 0.5, 0.8, 1)],
    "jaro": [rule("jaro", match_percent_threshold=p) for p in (0, 0.6, 0.9)],
    "winkler": [rule("jaro_winkler", match_percent_threshold=p) for p in (0.3, 0.75, 0.9)],
    "soundex": [rule("soundex", minimum_similarity=s) for s in (0, 2, 4)]
    + [rule("soundex", minimum_similarity=s, soundex_type="refined") for s in (0, 3)],
    "metaphone": [rule("metaphone"), rule("metaphone", max_code_length=2, metaphone_type="double")],
    "nysiis": [rule("nysiis"), rule("nysiis", strict=False)],
    "rating": [rule("match_rating")],
    "bits": [rule("bitflip"), rule("bitflip", case_sensitive=False)],
    "regex": [rule("regex", pattern=p) for p in ("abc?", "^a.*b$", r"\.")],
    "cidr": [rule("cidr", address=a) for a in ("192.168.0.0/31", "::/0")],
}


def edited(rng, word, times):
    for _ in range(times):
        i = rng.randrange(len(word) + 1)
        word = rng.choice([
            word[:i] + word[i + 1:], word[:i] + rng.choice("abé") + word[i:], word[:i] + rng.choice("abé") + word[i + 1:],
            word[:i] + word[i:i + 2][::-1] + word[i + 2:]])
    return word


# all targets cut, and none
@pytest.mark.parametrize("key_cost", [0, 10 ** 9])
@pytest.mark.parametrize("kind", ["levenshtein", "damerau_levenshtein", "hamming"])
def test_edits_of_longer_words_equal_brute_force(spark, monkeypatch, kind, key_cost):
    monkeypatch.setattr(bitmaps, "KEY_COST", key_cost)
    rng = random.Random(7)
    targets = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 13))) for _ in range(12)]
    words = sorted({edited(rng, t, rng.randint(0, 4)) for t in targets for _ in range(40)})
    catalog = catalog_from_targets(spark.createDataFrame([(s,) for s in targets], "t string"), "t",
                                   [rule(kind, maximum_distance=k) for k in (1, 2, 3)])
    check_against_all_pairs(spark, catalog, words, ["part", "set_id", "rule_idx", "distance"])


@pytest.mark.parametrize("kind", ["levenshtein", "damerau_levenshtein"])
def test_narrow_and_wide_limits_in_one_catalog(spark, monkeypatch, kind):
    rng = random.Random(5)
    targets = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["", "a"]
    words = sorted({edited(rng, t, rng.choice([0, 1, 2, 8, 10, 12])) for t in targets for _ in range(6)} | {"", "z" * 400})
    catalog = catalog_from_targets(spark.createDataFrame([(s,) for s in set(targets)], "t string"), "t",
                                   [rule(kind, maximum_distance=k) for k in (1, 10)])
    touched = 1 if kind == "levenshtein" else 2
    monkeypatch.setattr(bitmaps, "KEY_COST", 1)
    least = edit.least_cut(catalog.profile[kind], touched)
    assert least[1] <= 40 and least[10] == edit.NEVER
    check_against_all_pairs(spark, catalog, words, ["part", "set_id", "rule_idx", "distance"])
    monkeypatch.setattr(bitmaps, "KEY_COST", 0)
    assert edit.least_cut(catalog.profile[kind], touched)[10] < edit.NEVER
    check_against_all_pairs(spark, catalog, words, ["part", "set_id", "rule_idx", "distance"])


def test_parts_have_fewer_keys_than_there_are_rules(spark):
    parts = spark.createDataFrame([("c", "ab" * n) for n in range(200)], "chain_id string, part string")
    for limits in ([1, 10], [0, 2, 3, 6]):
        profile = Row(n=100_000, distances=limits, lengths=list(range(1, 300)))
        for touched, shifts in ((1, edit._levenshtein_shifts), (2, edit._swap_shifts)):
            lengths = edit.least_cut(profile, touched)
            assert min(lengths.values()) < edit.NEVER
            least, segments = edit._by_limit(lengths), touched * F.col("k") + 1
            keys = edit._part_segments(edit._part_bytes(parts), profile, least, segments, shifts)
            most = keys.groupBy("part", "k").count().agg(F.max("count")).first()[0]
            assert 0 < most <= profile.n / bitmaps.KEY_COST
            assert keys.agg(F.min(F.char_length("segment"))).first()[0] >= 1


# all sizes by keys, and none
@pytest.mark.parametrize("key_cost", [0, 10 ** 9])
@pytest.mark.parametrize("name", ["jaccard", "jaro", "winkler", "soundex", "rating"])
def test_shared_tokens_equal_brute_force_by_keys_and_by_sizes(spark, monkeypatch, name, key_cost):
    monkeypatch.setattr(bitmaps, "KEY_COST", key_cost)
    rng = random.Random(17)
    letters = "abcdest" if name == "soundex" else "abcdesté "
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 7, 12, 25]))) for _ in range(90)} | {"", "a"})
    strings = sorted(set(words[::5]) | {edited(rng, w, 2) for w in words[::9]} | {""})
    if name == "soundex":
        strings = [s for s in strings if s.isascii()]
    catalog = catalog_from_targets(spark.createDataFrame([(s,) for s in strings], "t string"), "t", CASES[name])
    check_against_all_pairs(spark, catalog, words, ["part", "set_id", "rule_idx", "similarity", "match_percent"])


def test_shared_tokens_without_parts_or_targets(spark):
    some, none = spark.createDataFrame([("name",)], "t string"), spark.createDataFrame([], "t string")
    for rules in CASES["jaro"], CASES["jaccard"]:
        for values, targets in ((none, some), (some, none)):
            assert not match_strings(values, "t", catalog_from_targets(targets, "t", rules)).collect()


def test_bitmaps_never_tell_more_than_edits(spark):
    rng = random.Random(11)
    # more letters than bits, so that some share one
    letters = [chr(c) for c in range(256) if c != 0]
    lefts = ["".join(rng.choice(letters[: rng.choice([2, 20, 255])]) for _ in range(rng.choice([0, 1, 5, 30, 600]))) for _ in range(60)]
    rows = [(a, b) for a in lefts for b in [a, a[::-1], a[1:], a + "x", edited(rng, a, 6), rng.choice(lefts)]]
    word = [f"word{w}" for w in range(text.BITMAP_WORDS)]
    for row in spark.createDataFrame(rows, "a string, b string").select(
            "a", "b", text.letter_bitmap(F.col("a")).alias("x"), text.letter_bitmap(F.col("b")).alias("y")).collect():
        lacking = sum(bin(row.x[w] & ~row.y[w] & (2 ** 64 - 1)).count("1") for w in word)
        assert lacking <= sum((Counter(row.a) - Counter(row.b)).values())
        assert bool(row.a) == any(row.x[w] for w in word)


@pytest.mark.parametrize("name", ["levenshtein", "damerau", "jaccard", "jaro", "soundex", "regex"])
def test_shuffled_salted_and_sliced_joins_equal_brute_force(spark, monkeypatch, name):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 6000)
    monkeypatch.setattr(bitmaps, "KEY_COST", 0)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdet1") for _ in range(rng.randint(0, 6))) for _ in range(60)})
    catalog = catalog_from_targets(spark.createDataFrame([(s,) for s in words[::6]], "t string"), "t", CASES[name])
    check_against_all_pairs(spark, catalog, words, ["part", "set_id", "rule_idx", "distance", "match_percent", "similarity"])


def check_against_all_pairs(spark, catalog, words, columns):
    parts = make_parts(spark.createDataFrame([(w,) for w in words], "value string"), catalog).select("chain_id", "part").distinct()
    fast = sorted(map(str, matched_pairs(parts, catalog).select(columns).collect()))
    slow = sorted(map(str, scored_pairs(parts, catalog).where("match").select(columns).collect()))
    assert fast and fast == slow


@pytest.mark.parametrize("name", CASES)
def test_keyed_jobs_equal_brute_force(spark, name):
    rng = random.Random(len(name))

    def word(size):
        return "".join(rng.choice("aabcdetsé.hw1") for _ in range(rng.randint(0, size)))

    words = sorted({word(8) for _ in range(120)} | {"192.168.0.1", "::1"})
    strings = sorted({word(6) for _ in range(25)} | set(words[::11]) | {"", "a"})
    if name in ("soundex", "metaphone"):
        strings = [s for s in strings if s.isascii()]
    catalog = catalog_from_targets(spark.createDataFrame([(s,) for s in strings], "t string"), "t", CASES[name])
    check_against_all_pairs(spark, catalog, words, ["part", "set_id", "rule_idx", "distance", "substring", "match_percent", "similarity", "primary_code", "alternate_code", "encoded"])
