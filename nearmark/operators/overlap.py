"""Rules that need a minimum number of shared tokens: jaccard, jaro, jaro-winkler, soundex, match rating.

Each reduces to "two token sets of sizes a and b share at least need(a, b)
tokens". With both sets in one global order, the first ``a - need + s`` and the
first ``b - need + s`` tokens must then share at least ``s`` of them, so every
combination of ``s`` tokens from these prefixes is an exact join key. A larger
``s`` makes keys rarer but more numerous; it cannot exceed ``need``. Where
nothing has to be shared, or an item would have more keys than there are
targets of a size, everything of those two sizes meets, and bitmaps of the
tokens rule out most pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from nearmark.functions.kernels import jaro, jaro_winkler
from nearmark.functions.phonetic import match_rating_code, refined_soundex_code, soundex_code
from nearmark.functions.text import characters, index_combinations, is_ascii, known, occurrence_tokens, position_tokens, rare_first, token_bitmap
from nearmark.operators import bitmaps
from nearmark.operators.bitmaps import with_bitmap
from nearmark.operators.joins import BROADCAST_BYTES, ROW_OVERHEAD, hot_join, hot_keys, key_join, size_bound, sliced_join
from nearmark.operators.jobs import Options, RuleJob, register
from nearmark.schemas import result_columns
from nearmark.session import cut

K = F.col


def _ceil(value: Column) -> Column:
    # a need that is a whole number must not be rounded up by floating-point noise
    return F.ceil(value - 1e-9).cast("int")


def _key_size(need: Column, slack: Column) -> Column:
    """Tokens per key: as many as keep the number of combinations low."""
    return F.least(need, F.when(slack <= 6, 3).when(slack <= 15, 2).otherwise(1))


def _combinations(places: Column, size: Column) -> Column:
    return F.when(size == 1, places).when(size == 2, places * (places - 1) / 2).when(
        size == 3, places * (places - 1) * (places - 2) / 6).otherwise(1).cast("bigint")


def shared_token_pairs(left: DataFrame, right: DataFrame, need: Callable[[Column, Column, Column], Column],
                       bound: int, weighted: bool = False) -> DataFrame:
    """Pairs ``chain_id, item, other, p`` that may share enough tokens, each once.

    ``left`` has ``chain_id, item, tokens``; ``right`` has ``chain_id, p, other, tokens`` where ``p``
    is the threshold. Both hold distinct items. With ``weighted``, ``need`` also reads the byte
    lengths ``wa`` and ``wb`` of the items. Runs jobs: both sides are written once and read by every step.
    """
    def ready(side: DataFrame, item: str, size: str, weight: str, prefix: str) -> DataFrame:
        # one token per character, so sizes need no tokens
        sized = side.withColumns({
            size: F.coalesce(F.char_length(item), F.lit(0)),
            weight: F.coalesce(F.octet_length(item), F.lit(0)) if weighted else F.lit(0),
            "tokens": F.explode(F.array("tokens"))})
        return cut(with_bitmap(sized, token_bitmap(K("tokens")), prefix), "token-sets")

    left, right = ready(left, "item", "a", "wa", "p_"), ready(right, "other", "b", "wb", "t_")
    # which sizes can match at all, how long a key is for them, and whether keys pay; at most the distinct sizes, squared
    counted = right.groupBy("chain_id", "p", "b", "wb").agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.octet_length("other")), F.lit(0)).alias("text"))
    sizes = (
        left.select("chain_id", "a", "wa").distinct().join(counted, "chain_id")
        .withColumn("need", F.greatest(need(K("a"), K("b"), K("p")), F.lit(0)))
        .where(K("need") <= F.least("a", "b"))
        .withColumn("s", _key_size(K("need"), F.greatest("a", "b") - K("need")))
        .withColumn("keys", _combinations(K("a") - K("need") + K("s"), K("s")))
        .withColumn("by_key", (K("s") > 0) & (K("keys") * bitmaps.KEY_COST <= K("n")))
    )
    sizes = cut(sizes, "token-sizes")
    total = sizes.agg(
        F.sum(F.when(K("by_key"), K("keys") + _combinations(K("b") - K("need") + K("s"), K("s")))).alias("keys"),
        F.sum(F.when(~K("by_key"), K("n"))).alias("rows"), F.max("text").alias("text")).first()
    # a token that one side lacks may be a bit that its bitmap lacks, and there is room for so many of them only
    possible = (bitmaps.lacking("p_", "t_") <= K("a") - K("need")) & (bitmaps.lacking("t_", "p_") <= K("b") - K("need"))

    def keyed(side: DataFrame, item: str, size: str, on: list[str]) -> DataFrame:
        # the combinations depend on sizes only, so they are made once per size and not per item
        places = sizes.where("by_key").select("chain_id", "p", "a", "wa", "b", "wb", "need", F.explode(
            index_combinations(K(size) - K("need") + K("s"), K("s"))).alias("at"))
        rows = key_join(side, places, on, total.keys * 2 * ROW_OVERHEAD, by=[item])
        token = [F.get("tokens", F.get("at", F.lit(i))) for i in range(3)]
        return rows.withColumn("key", known(F.concat_ws("\u0001", *token))).drop("at")

    found = []
    if total.keys:
        # a shared key says that a pair may have enough in common, the whole token sets say whether it has
        joined = key_join(
            keyed(left, "item", "a", ["chain_id", "a", "wa"]),
            keyed(right, "other", "b", ["chain_id", "p", "b", "wb"]).drop("need").withColumnRenamed("tokens", "others"),
            ["chain_id", "p", "a", "wa", "b", "wb", "key"], bound,
            possible & (F.size(F.array_intersect("tokens", "others")) >= K("need")), by=["item"])
        found.append(joined.select("chain_id", "item", "other", "p").distinct())
    if total.rows or not found:
        whole = sizes.where("not by_key").select("chain_id", "p", "b", "wb", "a", "wa", "need")
        rows = total.rows or 0
        named = right.drop("tokens").withColumns({"set_id": F.xxhash64("other"), "rule_idx": F.lit(0)})
        by_size = key_join(named, whole, ["chain_id", "p", "b", "wb"], rows * ROW_OVERHEAD, by=["other"])
        met = sliced_join(left.drop("tokens"), by_size, ["chain_id", "a", "wa"],
                          rows * (2 * (total.text or 0) + 2 * ROW_OVERHEAD), possible)
        found.append(met.select("chain_id", "item", "other", "p"))
    return reduce(DataFrame.unionByName, found)


def _distinct_targets(rules: DataFrame, p: str, item: Column) -> DataFrame:
    return rules.select("chain_id", K(p).alias("p"), known(item).alias("other")).distinct()


def _with_rules(pairs: DataFrame, rules: DataFrame, p: str, item: Column, bound: int) -> DataFrame:
    """Replace the right item by every rule that has it."""
    named = rules.withColumns({"p": K(p), "other": known(item)})
    return key_join(pairs, named, ["chain_id", "p", "other"], bound, by=["item"])


def coded(parts: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    """Parts with their code as ``item``, and the distinct codes with the number of parts ``n``."""
    named = parts.select("chain_id", "part", known(code).alias("item"))
    return named, named.groupBy("chain_id", "item").agg(F.count("*").alias("n"))


def with_parts(named: DataFrame, counted: DataFrame, found: DataFrame) -> DataFrame:
    """Replace the left item by every part that has it. A code many parts share is spread."""
    return hot_join(named, found, ["chain_id", "item"], hot_keys(counted, ["chain_id", "item"], "n"), ["part"])


def with_both(named: DataFrame, counted: DataFrame, pairs: DataFrame, rules: DataFrame, p: str, item: Column,
              bound: int) -> DataFrame:
    """Replace both items: by parts and by rules. Rules that are broadcast come last, so that only bare pairs are shuffled."""
    if bound <= BROADCAST_BYTES:
        return _with_rules(with_parts(named, counted, pairs), rules, p, item, bound)
    return with_parts(named, counted, _with_rules(pairs, rules, p, item, bound))


# --- jaccard --------------------------------------------------------------------------------------------


def _char_set(col: Column) -> Column:
    return F.array_sort(F.array_distinct(characters(col)))


def _jaccard_need(a: Column, b: Column, p: Column) -> Column:
    # shared >= p * union, and union = a + b - shared
    return _ceil(p / (1 + p) * (a + b))


def _jaccard(left: Column, right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    # two empty strings have no similarity rather than an undefined one
    return F.try_divide(shared.cast("double"), (F.size(left) + F.size(right) - shared).cast("double"))


def _find_jaccard(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    bound = size_bound(profile, 40)
    signature = F.array_join(_char_set(K("part")), "")
    target_signature = F.array_join(_char_set(K("target")), "")
    named, counted = coded(parts, signature)
    items = counted.drop("n").withColumn("tokens", rare_first(characters(K("item"))))
    targets = _distinct_targets(rules, "minimum_similarity", target_signature).withColumn(
        "tokens", rare_first(characters(K("other"))))
    pairs = shared_token_pairs(items, targets, _jaccard_need, bound).withColumn(
        "value", _jaccard(characters(K("item")), characters(K("other")))).where("value >= p")
    matched = with_both(named, counted, pairs, rules, "minimum_similarity", target_signature, bound)
    return matched.select("*", *result_columns(match=F.lit(True), similarity=K("value")))


def _score_jaccard(pairs: DataFrame, options: Options) -> DataFrame:
    value = _jaccard(_char_set(K("part")), _char_set(K("target")))
    match = F.coalesce(value >= K("minimum_similarity"), F.lit(False))
    return pairs.select("*", *result_columns(match=match, similarity=value))


# --- jaro and jaro-winkler ------------------------------------------------------------------------------


def _jaro_need(a: Column, b: Column, p: Column) -> Column:
    # with m matches and no swaps the score is (m/a + m/b + 1) / 3; two empty strings score 1
    return F.when((a == 0) & (b == 0), F.lit(0)).when((a == 0) | (b == 0), F.when(p <= 0, 0).otherwise(1)).otherwise(
        _ceil((3 * p - 1) * a * b / (a + b)))


def _winkler_need(a: Column, b: Column, p: Column) -> Column:
    # the boost is at most 0.4 of what is missing, and only above 0.7
    return _jaro_need(a, b, F.least(p, F.greatest((p - 0.4) / 0.6, F.lit(0.7))))


def _find_by_characters(need, score) -> Callable:
    def find(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
        bound = size_bound(profile, 60)
        items = parts.select("chain_id", known(K("part")).alias("item"), occurrence_tokens(K("part")).alias("tokens"))
        targets = _distinct_targets(rules, "match_percent_threshold", K("target")).withColumn(
            "tokens", occurrence_tokens(K("other")))
        pairs = shared_token_pairs(items, targets, need, bound)
        # each string pair is scored once, however many rules share the target
        value = pairs.withColumn("value", score("item", "other")).where("value >= p")
        found = _with_rules(value, rules, "match_percent_threshold", K("target"), size_bound(profile))
        return found.withColumn("part", K("item")).select(
            "*", *result_columns(match=F.lit(True), match_percent=K("value")))

    return find


def _score_by_characters(score) -> Callable:
    def full(pairs: DataFrame, options: Options) -> DataFrame:
        scored = pairs.withColumn("value", score("part", "target"))
        match = K("value") >= K("match_percent_threshold")
        return scored.select("*", *result_columns(match=match, match_percent=K("value")))

    return full


# --- soundex --------------------------------------------------------------------------------------------


def _soundex_need(a: Column, b: Column, p: Column) -> Column:
    return _ceil(p)


def _equal_positions(left: Column, right: Column) -> Column:
    return F.size(F.array_intersect(position_tokens(left), position_tokens(right)))


def _find_soundex(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    """Codes are compared, not strings: there are far fewer of them."""
    found = None
    for kind, code in (("normal", soundex_code), ("refined", refined_soundex_code)):
        of_kind = rules.where(K("soundex_type") == kind)
        if kind not in profile.kinds:
            continue
        named, counted = coded(parts.where(is_ascii(K("part"))), code(K("part")))
        items = counted.drop("n").withColumn("tokens", position_tokens(K("item")))
        targets = _distinct_targets(of_kind, "minimum_similarity", code(K("target"))).withColumn(
            "tokens", position_tokens(K("other")))
        pairs = shared_token_pairs(items, targets, _soundex_need, size_bound(profile, 40)).withColumn(
            "value", _equal_positions(K("item"), K("other"))).where("value >= p")
        matched = with_both(named, counted, pairs, of_kind, "minimum_similarity", code(K("target")), size_bound(profile))
        found = matched if found is None else found.unionByName(matched)
    return found.select("*", *result_columns(match=F.lit(True), similarity=K("value")))


NOT_ASCII = "non-ASCII input"


def _score_soundex(pairs: DataFrame, options: Options) -> DataFrame:
    def value_of(code) -> Column:
        return _equal_positions(code(K("part")), code(K("target")))

    value = F.when(K("soundex_type") == "normal", value_of(soundex_code)).otherwise(value_of(refined_soundex_code))
    usable = is_ascii(K("part"))
    return pairs.select("*", *result_columns(
        match=F.when(usable, value >= K("minimum_similarity")).otherwise(F.lit(False)),
        similarity=F.when(usable, value), error=F.when(~usable, F.lit(NOT_ASCII))))


# --- match rating ---------------------------------------------------------------------------------------


def _minimum_rating(total: Column) -> Column:
    # Rating needed by the summed length of both codes.
    return F.when(total <= 4, 5).when(total <= 7, 4).when(total <= 11, 3).when(total == 12, 2).otherwise(1)


def _rating_need(a: Column, b: Column, p: Column) -> Column:
    # what is left of the longer code after cancelling may have at most 6 - minimum characters
    need = F.greatest(a, b) - 6 + _minimum_rating(K("wa") + K("wb"))
    return F.when(F.abs(K("wa") - K("wb")) < 3, need).otherwise(F.greatest(a, b) + 1)


# Fixed value: a code has at most the first three and the last three characters of a name.
CODE_SIZE = 6


def with_rating(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Add ``agree``: whether two codes are rated as similar.

    Characters equal at the same position are cancelled, then those equal counted from the end; the
    rating is 6 minus what is left of the longer code. Written out for the few positions a code has.
    """
    def at(text: str, place: int) -> Column:
        return F.substring(text, place, 1)

    def rest(one: str, two: str) -> Column:
        return F.concat(*[F.when(at(one, i) == at(two, i), F.lit("")).otherwise(at(one, i))
                          for i in range(1, CODE_SIZE + 1)])

    shorter = F.least(F.char_length("left_"), F.char_length("right_"))
    equal = sum((F.when((at("left_", -i) == at("right_", -i)) & (shorter >= i), 1).otherwise(0)
                 for i in range(1, CODE_SIZE + 1)), F.lit(0))
    remaining = F.greatest(F.char_length("left_"), F.char_length("right_")) - equal
    # code lengths count bytes, remainders count characters
    total = F.octet_length(left) + F.octet_length(right)
    near = F.abs(F.octet_length(left) - F.octet_length(right)) < 3
    # a filter on the result would be pushed down with every expression written out; not through explode
    rests = F.struct(rest(left, right).alias("left_"), rest(right, left).alias("right_"))
    return (
        pairs.withColumn("rests_", F.explode(F.array(rests)))
        .withColumns({"left_": K("rests_.left_"), "right_": K("rests_.right_")})
        .withColumn("agree", near & (F.abs(6 - remaining) >= _minimum_rating(total)))
        .drop("left_", "right_", "rests_")
    )


def _rated(col: Column) -> Column:
    """Whether a string is long enough to be rated; shorter ones must be equal."""
    return F.octet_length(F.regexp_replace(col, r"(?U)^\s+|\s+$", "")) > 1


def _find_match_rating(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    rules = rules.withColumn("p", F.lit(0))
    named, counted = coded(parts.where(_rated(K("part"))), match_rating_code(K("part")))
    items = counted.drop("n").withColumn("tokens", occurrence_tokens(K("item")))
    targets = _distinct_targets(rules, "p", match_rating_code(K("target"))).withColumn(
        "tokens", occurrence_tokens(K("other")))
    # every pair of codes is rated once
    pairs = shared_token_pairs(items, targets, _rating_need, size_bound(profile, 40), weighted=True)
    pairs = with_rating(pairs, "item", "other").where("agree").drop("agree")
    rated = with_both(named, counted, pairs, rules, "p", match_rating_code(K("target")), size_bound(profile))
    short = parts.where(~_rated(K("part"))).select("chain_id", "part")
    equal = key_join(short, rules.withColumn("part", K("target")), ["chain_id", "part"], size_bound(profile))
    both = rated.select(equal.columns).unionByName(equal)
    return both.select("*", *result_columns(match=F.lit(True)))


def _score_match_rating(pairs: DataFrame, options: Options) -> DataFrame:
    coded_pairs = pairs.withColumn("one", F.explode(F.array(match_rating_code(K("part"))))).withColumn(
        "two", F.explode(F.array(match_rating_code(K("target")))))
    match = F.when(_rated(K("part")), K("agree")).otherwise(K("part") == K("target"))
    return with_rating(coded_pairs, "one", "two").select("*", *result_columns(match=match)).drop("one", "two", "agree")


register(RuleJob("jaccard", _score_jaccard, _find_jaccard, ("minimum_similarity",)))
register(RuleJob("jaro", _score_by_characters(jaro), _find_by_characters(_jaro_need, jaro), ("match_percent_threshold",)))
register(RuleJob("jaro_winkler", _score_by_characters(jaro_winkler), _find_by_characters(_winkler_need, jaro_winkler),
                 ("match_percent_threshold",)))
register(RuleJob("soundex", _score_soundex, _find_soundex, ("minimum_similarity",)))
register(RuleJob("match_rating", _score_match_rating, _find_match_rating))
