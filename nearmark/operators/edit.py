"""Edit-distance rules: levenshtein, damerau-levenshtein, their substring forms, and hamming.

Lengths and positions count bytes. Candidates come from the pigeonhole
principle: a target is cut into more segments than the allowed edits can touch,
so at least one segment occurs unchanged in every match, near its old place.
Where the segments would be too short to say much, or a part would have more
keys than there are targets to look at, parts meet all targets of a possible length
instead, and bitmaps of their letters rule out most pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from nearmark.functions.kernels import osa, osa_bytes, osa_scan, osa_scan_all
from nearmark.functions.text import byte_string, from_byte_string, known, letter_bitmap, substrings
from nearmark.operators import bitmaps
from nearmark.operators.joins import key_join, size_bound, sliced_join
from nearmark.operators.jobs import Options, RuleJob, register
from nearmark.operators.windows import PART_BYTES, find_short, part_id
from nearmark.schemas import RESULT_TYPES, result_columns

K = F.col
LIMIT = ("maximum_distance",)


def _target_bytes(rules: DataFrame) -> DataFrame:
    return rules.withColumns({
        "k": F.col("maximum_distance"), "tb": byte_string(F.col("target")), "tl": F.octet_length("target"),
    }).drop("maximum_distance", "target")


def _part_bytes(parts: DataFrame) -> DataFrame:
    return parts.select(
        "chain_id", "part", byte_string(F.col("part")).alias("pb"), F.coalesce(F.octet_length("part"), F.lit(0)).alias("pl"))


def _sorted_bytes(col: Column) -> Column:
    return F.array_join(F.array_sort(F.split(col, "")), "")


def _segment(segments: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of segment ``i`` of a target of length ``tl``."""
    start = F.floor(i * F.col("tl") / segments).cast("int")
    end = F.floor((i + 1) * F.col("tl") / segments).cast("int")
    return start, end - start


def _rule_segments(rules: DataFrame, segments: Column) -> DataFrame:
    """One row per segment of every target that is long enough."""
    cut = rules.where(F.col("tl") >= segments).withColumn("i", F.explode(F.sequence(F.lit(0), segments - 1)))
    start, size = _segment(segments, K("i"))
    return cut.withColumn("segment", known(F.substring("tb", start + 1, size)))


# Letters that are about as likely as the bytes of a text, and the pairs that keys may let through, one in so many.
LETTERS = 12
PAIRS_KEPT = 8
NEVER = 1 << 30


def least_cut(profile: Row, touched: int) -> dict[int, int]:
    """For each limit of a rule type the length from which targets are cut into segments.

    A part has a key for each target length in reach, segment and shift. More than ``rules / bitmaps.KEY_COST`` of them cost
    more than a look at every rule, and then no target is cut.
    """
    least = {}
    for k in sorted(profile.distances):
        segments = touched * k + 1
        keys = segments * (k + 1)
        size = next(n for n in count(1) if LETTERS ** n >= PAIRS_KEPT * keys or k == 0)
        least[k] = size * segments if (2 * k + 1) * keys * bitmaps.KEY_COST <= profile.n else NEVER
    return least


def _by_limit(values: dict[int, int]) -> Column:
    return F.coalesce(*[F.when(K("k") == k, F.lit(v)) for k, v in values.items()], F.lit(NEVER))


def _part_segments(parts: DataFrame, profile: Row, least: Column, segments: Column,
                   shifts: Callable[[Column, Column], tuple]) -> DataFrame:
    """The substrings of each part that could be a segment of a target in the catalog, each once per segment."""
    start, size = _segment(segments, K("i"))
    low, high = shifts(F.col("pl") - F.col("tl"), K("i"))
    segment = F.substring("pb", F.col("at") + 1, size)
    first = F.greatest(start + F.col("low"), F.lit(0))
    seen = F.contains(F.substring("pb", first + 1, F.col("at") - first + size - 1), segment)
    return (
        parts.where("pl > 0")
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(profile.distances)])))
        .where(F.col("pl") + F.col("k") >= least)
        .withColumn("tl", F.explode(F.sequence(F.greatest(F.col("pl") - F.col("k"), least), F.col("pl") + F.col("k"))))
        .where(F.col("tl").isin(sorted(profile.lengths)))
        .withColumn("i", F.explode(F.sequence(F.lit(0), segments - 1)))
        .withColumns({"low": low.cast("int"), "high": high.cast("int")})
        .where("low <= high")
        .withColumn("shift", F.explode(F.sequence("low", "high")))
        .withColumn("at", start + F.col("shift"))
        .where((F.col("at") >= 0) & (F.col("at") + size <= F.col("pl")) & ~seen)
        .select(*parts.columns, "k", "tl", "i", known(segment).alias("segment"))
    )


def _length_pairs(parts: DataFrame, rules: DataFrame, profile: Row, condition: Column) -> DataFrame:
    """Targets that are not cut, against the parts whose length allows a match."""
    span = 2 * (profile.distance or 0) + 1
    by_length = rules.withColumn(
        "pl", F.explode(F.sequence(F.greatest(F.col("tl") - F.col("k"), F.lit(0)), F.col("tl") + F.col("k"))))
    return sliced_join(parts, by_length, ["chain_id", "pl"], size_bound(profile, span), condition)


def _near_pairs(parts: DataFrame, rules: DataFrame, profile: Row, touched: int, shifts, condition: Column,
                scratch: tuple[str, ...] = ()) -> DataFrame:
    """All pairs that may be within the limit and pass ``condition``, each once, without the ``scratch`` columns.

    No edit or swap changes more than one letter of each side into another, so bitmaps come before ``condition``.
    """
    lengths = least_cut(profile, touched)
    least, segments = _by_limit(lengths), touched * K("k") + 1
    # no longer part can match, and the bitmap of a long text is the work of many short ones
    near = parts.where(K("pl") <= max(profile.lengths) + max(profile.distances))
    parts = bitmaps.with_bitmap(near, letter_bitmap(K("pb")), "p_")
    rules = bitmaps.with_bitmap(rules, letter_bitmap(K("tb")), "t_")
    condition = (bitmaps.lacking("p_", "t_") <= K("k")) & (bitmaps.lacking("t_", "p_") <= K("k")) & condition
    scratch = [*scratch, *bitmaps.bitmap_columns("p_", "t_")]
    found = []
    if min(lengths.values()) <= max(profile.lengths):
        found.append(key_join(
            _part_segments(parts, profile, least, segments, shifts), _rule_segments(rules.where(K("tl") >= least), segments),
            ["chain_id", "k", "tl", "i", "segment"], size_bound(profile, touched * (profile.distance or 0) + 1), condition,
        ).drop("i", "segment", *scratch).distinct())
    if min(profile.lengths) < max(lengths.values()):
        # a target is either cut or compared whole
        found.append(_length_pairs(parts, rules.where(K("tl") < least), profile, condition).drop(*scratch))
    return reduce(DataFrame.unionByName, found)


def _levenshtein_shifts(delta: Column, i: Column) -> tuple[Column, Column]:
    # some untouched segment i has at most i edits before it and at most k - i behind it
    k = K("k")
    return F.greatest(-i, delta - (k - i)), F.least(i, delta + (k - i))


def _swap_shifts(delta: Column, i: Column) -> tuple[Column, Column]:
    # A swap touches at most two segments, any other edit one, so the 2k + 1 segments are touched at most 2k
    # times. Counting touches minus segments from the left, the first fall below zero is at an untouched
    # segment i with exactly i touches before it. A shift by s before it takes |s| edits of one touch each and
    # at least (i - |s|) / 2 more; behind it |delta - s| are left. So |s| + 2 |delta - s| <= 2k - i and |s| <= i.
    room = 2 * K("k") - i

    def reach(left: Column) -> Column:
        return F.least(F.floor(left / 3), left).cast("int")

    return F.greatest(-i, -reach(room - 2 * delta)), F.least(i, reach(room + 2 * delta))


def _find_levenshtein(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    within = F.expr("levenshtein(pb, tb, k) >= 0")
    parts, rules = _part_bytes(parts), _target_bytes(rules)
    pairs = _near_pairs(parts, rules, profile, 1, _levenshtein_shifts, within)
    return pairs.select("*", *result_columns(match=F.lit(True), distance=F.levenshtein("pb", "tb")))


def _shortcut(distance: Column, match: Column, options: Options) -> Column:
    if not options.shortcut_distance:
        return distance
    gap = F.abs(F.octet_length("part") - F.octet_length("target"))
    return F.when(gap <= K("maximum_distance"), distance)


def _score_levenshtein(pairs: DataFrame, options: Options) -> DataFrame:
    distance = F.levenshtein(byte_string(K("part")), byte_string(K("target")))
    match = distance <= K("maximum_distance")
    return pairs.select("*", *result_columns(match=match, distance=_shortcut(distance, match, options)))


def _find_damerau(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    # t swaps cost t but may be 2t plain edits, so the plain distance is at most 2k, and a pair at plain
    # distance d > k has at most 2k - d edits that are no swaps. Only those change the sorted bytes, by at
    # most two each; at d <= k the same bound holds by itself. What passes is worth sending to Python.
    parts, rules = _part_bytes(parts), _target_bytes(rules)
    parts = parts.withColumn("ps", F.explode(F.array(_sorted_bytes(K("pb")))))
    rules = rules.withColumn("ts", _sorted_bytes(K("tb")))
    possible = F.expr("""levenshtein(pb, tb, 2 * k) >= 0 and
        levenshtein(ps, ts, 2 * (2 * k - levenshtein(pb, tb, 2 * k))) >= 0""")
    pairs = _near_pairs(parts, rules, profile, 2, _swap_shifts, possible, ("ps", "ts"))
    scored = pairs.withColumn("distance", osa("part", from_byte_string(K("tb")))).where("distance <= k")
    return scored.withColumnRenamed("distance", "d").select("*", *result_columns(match=F.lit(True), distance=K("d")))


def _score_damerau(pairs: DataFrame, options: Options) -> DataFrame:
    scored = pairs.withColumn("d", osa("part", "target"))
    match = K("d") <= K("maximum_distance")
    return scored.select("*", *result_columns(match=match, distance=_shortcut(K("d"), match, options)))


def _find_hamming(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    parts, rules = _part_bytes(parts), _target_bytes(rules)
    segments = K("k") + 1
    start, size = _segment(segments, K("i"))
    # equal lengths, so a segment can only be where it was
    cut = (
        parts.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted(profile.distances)])))
        .where(K("pl") >= segments).withColumn("tl", K("pl"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), segments - 1)))
        .withColumn("segment", known(F.substring("pb", start + 1, size)))
    )
    within = _mismatches(K("pb"), K("tb")) <= K("k")
    keyed = key_join(cut, _rule_segments(rules, segments), ["chain_id", "k", "tl", "i", "segment"],
                     size_bound(profile, profile.distance + 1), within).drop("i", "segment")
    short = rules.where(K("tl") < segments).withColumn("pl", K("tl"))
    all_short = sliced_join(parts, short, ["chain_id", "pl"], size_bound(profile))
    pairs = keyed.unionByName(all_short).distinct()
    return pairs.select("*", *result_columns(match=F.lit(True), distance=_mismatches(K("pb"), K("tb"))))


def _mismatches(left: Column, right: Column) -> Column:
    return F.size(F.filter(
        F.arrays_zip(F.split(left, "").alias("l"), F.split(right, "").alias("r")),
        lambda z: ~z["l"].eqNullSafe(z["r"])))


def _score_hamming(pairs: DataFrame, options: Options) -> DataFrame:
    same_length = F.octet_length("part") == F.octet_length("target")
    distance = F.when(same_length, _mismatches(byte_string(K("part")), byte_string(K("target"))))
    match = F.coalesce(distance <= K("maximum_distance"), F.lit(False))
    return pairs.select("*", *result_columns(match=match, distance=distance))


# --- substring rules ----------------------------------------------------------------------------------

# A target whose segments would have fewer bytes than this is found by its windows: nearly every part has such segments.
SEGMENT_BYTES = 3


def _same_length(shifts) -> Callable[[Column, Column], tuple]:
    """Shifts for strings of equal length only."""

    def only(delta: Column, i: Column) -> tuple[Column, Column]:
        low, high = shifts(delta, i)
        return F.when(delta == 0, low).otherwise(1), F.when(delta == 0, high).otherwise(0)

    return only


def _plain_distance(parts: DataFrame, targets: DataFrame, profile: Row, equal: bool) -> DataFrame:
    """Pairs ``chain_id, pb, pl, tb, k, tl`` within the limit, with the distance ``d``."""
    within = F.expr("levenshtein(pb, tb, k) >= 0")
    shifts, within = (_same_length(_levenshtein_shifts), within & (K("pl") == K("tl"))) if equal else (_levenshtein_shifts, within)
    pairs = _near_pairs(parts, targets, profile, 1, shifts, within)
    return pairs.withColumn("d", F.levenshtein("pb", "tb"))


def _swap_distance(parts: DataFrame, targets: DataFrame, profile: Row, equal: bool) -> DataFrame:
    parts = parts.withColumn("ps", F.explode(F.array(_sorted_bytes(K("pb")))))
    targets = targets.withColumn("ts", _sorted_bytes(K("tb")))
    within = F.expr("""levenshtein(pb, tb, 2 * k) >= 0 and
        levenshtein(ps, ts, 2 * (2 * k - levenshtein(pb, tb, 2 * k))) >= 0""")
    shifts, within = (_same_length(_swap_shifts), within & (K("pl") == K("tl"))) if equal else (_swap_shifts, within)
    pairs = _near_pairs(parts, targets, profile, 2, shifts, within, ("ps", "ts"))
    return pairs.withColumn("d", osa_bytes("pb", "tb")).where("d <= k")


def _find_in_text(touched: int, score, distance) -> Callable:
    """Candidates share one unchanged segment anywhere in the part, since the window may be anywhere.

    ``touched`` is the number of segments one edit can touch. Short parts, and targets with short segments, go by their windows.
    """

    def find(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
        segments = touched * K("k") + 1
        payload = [c for c in rules.columns if c not in ("chain_id", "target", "maximum_distance")]

        def short(length: Column, limit: Column) -> Column:
            return length < SEGMENT_BYTES * (touched * limit + 1)

        long = ~short(F.octet_length("target"), K("maximum_distance"))
        columns = ["chain_id", "part", *payload, *RESULT_TYPES]
        cut = _rule_segments(_target_bytes(rules.where(long)), segments)
        keys = cut.select("chain_id", "segment", "k", "tl", "tb", *payload).distinct()
        # the segment lengths in use; few, because they follow from target lengths and limits
        sizes = cut.select("chain_id", F.char_length("segment").alias("size")).distinct()
        named = parts.where(F.octet_length("part") >= PART_BYTES).select("chain_id", "part", known(part_id(K("part"))).alias("part_id"))
        grams = (
            named.join(F.broadcast(sizes), "chain_id")
            .select("chain_id", "part_id", F.octet_length("part").alias("pl"),
                    F.explode(F.array_distinct(substrings(byte_string(K("part")), K("size")))).alias("segment"))
        )
        bound = size_bound(profile, touched * (profile.distance or 0) + 1)
        candidates = key_join(grams, keys, ["chain_id", "segment"], bound, K("pl") + K("k") >= K("tl"), ["part_id"])
        # one shuffle serves the de-duplication and the join that brings the text back
        candidates = candidates.drop("segment", "pl").repartition("chain_id", "part_id").distinct()
        pairs = candidates.join(named, ["chain_id", "part_id"]).withColumns(
            {"target": from_byte_string(K("tb")), "maximum_distance": K("k")})
        pairs = pairs.select("chain_id", "part", "target", "maximum_distance", *payload)
        found = score(pairs, options).where("match").select(*columns)
        by_window = find_short(
            parts, rules, lambda p, t: distance(_part_bytes(p), t, profile, False).withColumn("part", from_byte_string(K("pb"))),
            lambda w, t: distance(w, t, profile, True), lambda p: score(p, options), short, bound, options.substring_mode == "exhaustive")
        return found.unionByName(by_window.select(*columns))

    return find


def _plain_scan(options: Options) -> Column:
    """Distance and start of the window where the sliding scan ends, over ``pb``, ``tb``, ``k`` and the
    distance ``d0`` of the first window."""
    tl, room = F.char_length("tb"), F.char_length("pb") - F.char_length("tb")

    def window(start: Column) -> Column:
        return F.substring("pb", start + 1, tl)

    if options.substring_mode == "exhaustive":
        # the least struct is the first of the closest windows
        return F.array_min(F.transform(F.sequence(F.lit(0), room), lambda s: F.struct(
            F.levenshtein(window(s), K("tb")).alias("distance"), s.alias("start"))))

    def state(start: Column, distance: Column, going: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), distance.alias("distance"), going.alias("going"))

    def slide(s: Column, _: Column) -> Column:
        step = F.least(F.floor((s["distance"] - K("k")) / 2).cast("int"), room - s["start"] - 1)
        going = s["going"] & (step > 0)
        start = F.when(going, s["start"] + step).otherwise(s["start"])
        return F.when(going, state(start, F.levenshtein(window(start), K("tb")), F.lit(True))).otherwise(
            state(s["start"], s["distance"], F.lit(False)))

    # most scans end where they begin
    moves = F.when(K("d0") - K("k") >= 2, F.sequence(F.lit(1), room)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(moves, state(F.lit(0), K("d0"), F.lit(True)), slide)


def _scan_result(pairs: DataFrame) -> DataFrame:
    """Result from ``full`` (whole-string distance) and ``scan`` (distance and window, NULL if not scanned)."""
    whole = K("full") <= K("maximum_distance")
    scanned = ~whole & K("scan.window").isNotNull()
    distance = F.when(scanned, K("scan.distance")).otherwise(K("full"))
    return pairs.select("*", *result_columns(
        match=distance <= K("maximum_distance"), distance=distance, substring=F.when(scanned, K("scan.window"))))


def _score_levenshtein_text(pairs: DataFrame, options: Options) -> DataFrame:
    # what comes out of explode is worked out once; otherwise every use of it would work it out again
    texts = F.struct(byte_string(K("part")).alias("pb"), byte_string(K("target")).alias("tb"))
    ready = pairs.withColumn("texts", F.explode(F.array(texts))).select(
        *pairs.columns, "texts.*", K("maximum_distance").alias("k"))
    # a part longer by more than the limit is only scanned; the gap says so without a comparison
    gap = F.char_length("pb") - F.char_length("tb")
    whole = F.when(gap > K("k"), gap).otherwise(F.levenshtein("pb", "tb"))
    ready = ready.withColumn("full", F.explode(F.array(whole)))
    scans = (K("full") > K("k")) & (gap > 0)
    start = F.levenshtein(F.substring("pb", F.lit(1), F.char_length("tb")), K("tb"))
    ready = ready.withColumn("d0", F.explode(F.array(F.when(scans, start))))
    ready = ready.withColumn("found", F.explode(F.array(F.when(scans, _plain_scan(options)))))
    window = from_byte_string(F.substring("pb", K("found.start") + 1, F.char_length("tb")))
    ready = ready.withColumn("scan", F.struct(K("found.distance").alias("distance"), window.alias("window")))
    return _scan_result(ready).drop("pb", "tb", "k", "d0", "found", "full", "scan")


def _score_damerau_text(pairs: DataFrame, options: Options) -> DataFrame:
    scan = osa_scan_all if options.substring_mode == "exhaustive" else osa_scan
    # a part longer by more than the limit is only scanned, one that is not longer is only compared whole
    gap = F.octet_length("part") - F.octet_length("target")
    near, longer = gap <= K("maximum_distance"), gap > 0

    def only(use: Column, name: str) -> Column:
        return F.when(use, K(name)).otherwise("")

    ready = pairs.withColumn("full", F.when(near, osa(only(near, "part"), only(near, "target"))).otherwise(gap))
    ready = ready.withColumn("s", scan(only(longer, "part"), only(longer, "target"), "maximum_distance"))
    ready = ready.withColumn("scan", F.struct(K("s.distance").alias("distance"), K("s.substring").alias("window")))
    return _scan_result(ready).drop("s", "full", "scan")


register(RuleJob("levenshtein", _score_levenshtein, _find_levenshtein, LIMIT))
register(RuleJob("damerau_levenshtein", _score_damerau, _find_damerau, LIMIT))
register(RuleJob("hamming", _score_hamming, _find_hamming, LIMIT))
register(RuleJob("levenshtein_substring", _score_levenshtein_text, _find_in_text(1, _score_levenshtein_text, _plain_distance), LIMIT))
register(RuleJob("damerau_levenshtein_substring", _score_damerau_text, _find_in_text(2, _score_damerau_text, _swap_distance), LIMIT))
