"""Rules whose targets can be enumerated or looked up: bit flips, networks, regular expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from nearmark.functions.network import address_bits, cidr_bits
from nearmark.functions.patterns import FOLD_FROM, FOLD_TO, portable, required_texts
from nearmark.functions.text import substrings
from nearmark.operators.joins import ROW_OVERHEAD, key_join, size_bound
from nearmark.operators.jobs import Options, RuleJob, register
from nearmark.schemas import result_columns

K = F.col

# --- bit flips ------------------------------------------------------------------------------------------

# The characters of a domain name.
DNS_CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-."


def _allowed_codes() -> Column:
    custom = F.transform(F.filter(F.split("custom_char_subset", ""), lambda c: c != ""), F.ascii)
    return (
        F.when(K("char_subset") == "dns", F.array(*[F.lit(ord(c)) for c in DNS_CHARACTERS]))
        .when(K("char_subset") == "printable", F.sequence(F.lit(0x21), F.lit(0x7E)))
        .otherwise(custom)
    )


def flipped_targets(rules: DataFrame) -> DataFrame:
    """Every rule once per string that differs from its target in one bit of one allowed character."""
    at = F.explode(F.sequence(F.lit(1), F.char_length("target")))
    masks = F.array(*[F.lit(1 << bit) for bit in range(8)])
    rows = (
        rules.withColumn("allowed", _allowed_codes())
        .where("target <> ''").withColumn("at", at)
        .withColumn("code", F.ascii(F.substring("target", K("at"), F.lit(1))))
        .where((K("code") < 128) & F.array_contains("allowed", K("code")))
        .withColumn("mask", F.explode(masks))
        .withColumn("flipped", K("code").bitwiseXOR(K("mask")))
        .where(F.array_contains("allowed", K("flipped")))
    )
    variant = F.concat(F.left("target", K("at") - 1), F.char("flipped"), F.substring("target", K("at") + 1, F.char_length("target")))
    folded = F.when(K("case_sensitive"), variant).otherwise(F.lower(variant))
    return rows.withColumn("variant", folded).drop("allowed", "at", "code", "mask", "flipped").distinct()


def _find_bitflip(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    variants = flipped_targets(rules)
    forms = F.array(F.struct(F.lit(True).alias("case_sensitive"), K("part").alias("variant")),
                    F.struct(F.lit(False).alias("case_sensitive"), F.lower("part").alias("variant")))
    keyed = parts.select("chain_id", "part", F.explode(forms).alias("f")).select("chain_id", "part", "f.*")
    found = key_join(keyed, variants, ["chain_id", "case_sensitive", "variant"],
                     size_bound(profile, 8 * (profile.target_bytes or 0)))
    return found.select("*", *result_columns(match=F.lit(True)))


def _score_bitflip(pairs: DataFrame, options: Options) -> DataFrame:
    """A pair matches when exactly one position differs, by one bit, between two allowed characters."""
    fold = F.when(K("case_sensitive"), K("part")).otherwise(F.lower("part"))
    positions = F.sequence(F.lit(1), F.greatest(F.char_length("target"), F.lit(1)))

    def hit(at: Column) -> Column:
        code = F.ascii(F.substring("target", at, F.lit(1)))

        def variant(mask: Column) -> Column:
            flipped = code.bitwiseXOR(mask)
            text = F.concat(F.left("target", at - 1), F.char(flipped), F.substring("target", at + 1, F.char_length("target")))
            text = F.when(K("case_sensitive"), text).otherwise(F.lower(text))
            return F.array_contains("allowed", flipped) & (text == K("fold"))

        return (code < 128) & F.array_contains("allowed", code) & F.exists(
            F.array(*[F.lit(1 << bit) for bit in range(8)]), variant)

    ready = pairs.withColumns({"allowed": _allowed_codes(), "fold": fold})
    match = (K("target") != "") & F.exists(positions, hit)
    return ready.select("*", *result_columns(match=match)).drop("allowed", "fold")


# --- networks -------------------------------------------------------------------------------------------


def _find_cidr(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    nets = rules.withColumn("net", cidr_bits(K("address"))).withColumns({
        "width": K("net.width"), "size": F.char_length("net.bits"), "bits": K("net.bits")}).drop("net")
    # at most 33 + 129 prefix lengths exist
    sizes = nets.select("chain_id", "width", "size").distinct()
    looks_like_address = K("part").rlike(r"^[0-9A-Fa-f:.]+\z") & K("part").rlike("[:.]")
    addresses = (
        # what comes out of explode is worked out once
        parts.where(looks_like_address).select("chain_id", "part", F.explode(F.array(address_bits(K("part")))).alias("address_bits"))
        .where("address_bits is not null").withColumn("width", F.char_length("address_bits"))
        .join(F.broadcast(sizes), ["chain_id", "width"])
        .withColumn("bits", F.left("address_bits", K("size")))
    )
    found = key_join(addresses, nets, ["chain_id", "width", "size", "bits"], size_bound(profile))
    return found.select("*", *result_columns(match=F.lit(True)))


def _score_cidr(pairs: DataFrame, options: Options) -> DataFrame:
    ready = pairs.withColumns({"net": cidr_bits(K("address")), "own": address_bits(K("part"))})
    inside = (F.char_length("own") == K("net.width")) & F.startswith(K("own"), K("net.bits"))
    return ready.select("*", *result_columns(match=F.coalesce(inside, F.lit(False)))).drop("net", "own")


# --- regular expressions --------------------------------------------------------------------------------

GRAM = 3
TEXTS_CHECKED = 3


@F.pandas_udf(StringType())
def _portable(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else portable(p))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _needs(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: [] if p is None else required_texts(p))


def _folded(col: Column) -> Column:
    return F.translate(col, FOLD_FROM, FOLD_TO)


def _gram_keys(branches: DataFrame) -> DataFrame:
    """Every branch with each gram of its texts, of three characters where one of them has as many."""
    longest = F.array_max(F.transform("texts", F.char_length))
    sized = branches.withColumn("size", F.least(longest, F.lit(GRAM)))
    grams = F.array_distinct(F.flatten(F.transform("texts", lambda t: substrings(t, K("size")))))
    return sized.withColumn("gram", F.explode(grams))


def regex_hits(parts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pairs ``chain_id, part, pattern`` of distinct parts and the patterns found in them, each once.

    What a pattern requires is a choice of branches, each a set of texts. A branch meets the parts that have
    its rarest gram, counted over all parts, and contain its longest texts; a branch with a gram that no part has meets
    none. Only a pattern that may match without any certain text is tried on every part.
    """
    distinct = patterns.select("chain_id", "pattern").distinct().withColumns(
        {"java": _portable("pattern"), "needs": _needs("pattern")})
    text_bytes = F.aggregate(F.flatten("needs"), F.lit(0), lambda n, t: n + F.octet_length(t))
    # one key a branch; a pattern has at most as many as its own length, or the bound of a product
    key_bytes = F.size("needs") * (6 * F.octet_length("pattern") + ROW_OVERHEAD) + 28 * text_bytes
    sized = distinct.agg(F.sum(key_bytes).alias("keys"), F.sum(text_bytes * (ROW_OVERHEAD + 4 * GRAM)).alias("grams"),
                         F.max(F.size("needs")).alias("most"), F.min(F.size("needs")).alias("least")).first()
    parts = parts.select("chain_id", "part")
    tables = []
    if sized.most:
        branches = distinct.select("chain_id", "pattern", "java", F.posexplode("needs").alias("branch", "texts"))
        keyed = _gram_keys(branches)
        wanted = keyed.select("chain_id", "gram").distinct()
        sizes = keyed.select("chain_id", "size").distinct()  # at most three a chain
        folded = _folded(K("part"))
        grams = parts.join(F.broadcast(sizes), "chain_id").withColumn("gram", F.explode(F.array_distinct(substrings(folded, K("size"))))).drop("size")
        counts = key_join(grams, wanted, ["chain_id", "gram"], sized.grams).groupBy("chain_id", "gram").agg(F.count("*").alias("n"))
        rarest = keyed.join(counts, ["chain_id", "gram"]).groupBy("chain_id", "pattern", "branch").agg(
            F.first("java").alias("java"), F.first("texts").alias("texts"), F.min(F.struct("n", "gram")).alias("key"))
        # the longest texts are looked for as they are, the pattern itself decides
        longest = [F.coalesce(F.get("texts", F.lit(i)), F.lit("")).alias(f"text{i}") for i in range(TEXTS_CHECKED)]
        keys = rarest.select("chain_id", K("key.gram").alias("gram"), "pattern", "java", *longest)
        inside = reduce(and_, [F.contains(folded, K(f"text{i}")) for i in range(TEXTS_CHECKED)]) & F.expr("part rlike java")
        hits = key_join(grams, keys, ["chain_id", "gram"], sized.keys, inside).select("chain_id", "part", "pattern")
        tables.append(hits.distinct() if sized.most > 1 else hits)
    if sized.least == 0:
        tables.append(_try_all(parts, distinct.where(F.size("needs") == 0)).select("chain_id", "part", "pattern"))
    if not tables:
        return parts.withColumn("pattern", F.lit(None).cast("string")).limit(0)
    return reduce(DataFrame.unionByName, tables)


def _try_all(parts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every pattern on every part of its chain, parts spread over blocks.

    In a merge join the left row stays while the rows of the block pass by, so that a pattern is
    compiled once per block instead of once per part.
    """
    blocks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    spread = parts.withColumn("block", F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("int"))
    copies = patterns.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return copies.hint("merge").join(spread, ["chain_id", "block"]).where(F.expr("part rlike java"))


def _find_regex(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    hits = regex_hits(parts, rules)
    found = key_join(hits, rules, ["chain_id", "pattern"], size_bound(profile, 4))
    return found.select("*", *result_columns(match=F.lit(True)))


def _score_regex(pairs: DataFrame, options: Options) -> DataFrame:
    ready = pairs.withColumn("java", _portable("pattern"))
    return ready.select("*", *result_columns(match=F.expr("part rlike java"))).drop("java")


register(RuleJob("bitflip", _score_bitflip, _find_bitflip, ("char_subset", "custom_char_subset", "case_sensitive")))
register(RuleJob("cidr", _score_cidr, _find_cidr, ("address",)))
register(RuleJob("regex", _score_regex, _find_regex, ("pattern",)))
