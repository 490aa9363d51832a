"""Rules that compare codes for equality: confusables, metaphone, double metaphone, nysiis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from nearmark.functions.lookalike import skeleton
from nearmark.functions.phonetic import capped, double_metaphone_codes, metaphone_code, nysiis_code
from nearmark.functions.text import is_ascii, known
from nearmark.operators.jobs import Options, RuleJob, register
from nearmark.operators.overlap import NOT_ASCII, coded, with_parts
from nearmark.schemas import result_columns

K = F.col


def _equal_codes(parts: DataFrame, code: Column, rules: DataFrame) -> DataFrame:
    """Parts whose code is the rule's ``item``."""
    named, counted = coded(parts, code)
    return with_parts(named, counted, rules)


# --- confusables ----------------------------------------------------------------------------------------


def _find_confusables(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    found = _equal_codes(parts, skeleton(K("part")), rules.withColumn("item", known(skeleton(K("target")))))
    return found.where("part <> target").select("*", *result_columns(match=F.lit(True)))


def _score_confusables(pairs: DataFrame, options: Options) -> DataFrame:
    alike = skeleton(K("part")) == skeleton(K("target"))
    return pairs.select("*", *result_columns(match=alike & (K("part") != K("target"))))


# --- metaphone ------------------------------------------------------------------------------------------

NO_CAP = -1


def _caps(rules: DataFrame) -> DataFrame:
    """The few code lengths in use per chain."""
    return rules.select("chain_id", F.coalesce("max_code_length", F.lit(NO_CAP)).alias("cap")).distinct()


def _cut(code: Column) -> Column:
    return capped(code, F.nullif(K("cap"), F.lit(NO_CAP)))


def _find_metaphone(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    rules = rules.withColumn("cap", F.coalesce("max_code_length", F.lit(NO_CAP)))
    parts = parts.where(is_ascii(K("part"))).select("chain_id", "part")
    found = []
    if "normal" in profile.kinds:
        of_kind = rules.where("metaphone_type = 'normal'")
        targets = of_kind.withColumn("item", F.concat_ws(":", "cap", _cut(metaphone_code(K("target")))))
        words = parts.withColumn("code", metaphone_code(K("part"))).join(F.broadcast(_caps(of_kind)), "chain_id")
        words = words.withColumn("primary", _cut(K("code")))
        matched = _keyed(words, F.concat_ws(":", "cap", "primary"), targets, ["primary"])
        found.append(matched.select("*", *result_columns(match=F.lit(True), primary_code=K("primary"))))
    if "double" in profile.kinds:
        of_kind = rules.where("metaphone_type = 'double'")
        codes = double_metaphone_codes(K("target"))
        targets = of_kind.withColumn("c", codes).withColumn(
            "item", F.explode(F.array(F.concat_ws(":", "cap", F.lit("p"), _cut(K("c.primary"))),
                                      F.concat_ws(":", "cap", F.lit("a"), _cut(K("c.alternate")))))).drop("c")
        words = parts.withColumn("c", double_metaphone_codes(K("part"))).join(F.broadcast(_caps(of_kind)), "chain_id")
        words = words.withColumns({"primary": _cut(K("c.primary")), "alternate": _cut(K("c.alternate"))})
        keys = F.explode(F.array(F.concat_ws(":", "cap", F.lit("p"), "primary"),
                                 F.concat_ws(":", "cap", F.lit("a"), "alternate")))
        matched = _keyed(words, keys, targets, ["primary", "alternate"]).drop("item").distinct()
        found.append(matched.select("*", *result_columns(
            match=F.lit(True), primary_code=K("primary"), alternate_code=K("alternate"))))
    columns = [c for c in found[0].columns if all(c in f.columns for f in found)]
    out = found[0].select(columns)
    return out if len(found) == 1 else out.unionByName(found[1].select(columns))


def _keyed(words: DataFrame, item: Column, targets: DataFrame, carried: list[str]) -> DataFrame:
    named = words.select("chain_id", "part", *carried, item.alias("item"))
    counted = named.groupBy("chain_id", "item").agg(F.count("*").alias("n"))
    return with_parts(named, counted, targets.drop("cap"))


def _score_metaphone(pairs: DataFrame, options: Options) -> DataFrame:
    usable = is_ascii(K("part"))
    ascii_part = F.when(usable, K("part"))
    ready = pairs.withColumns({
        "cap": F.coalesce("max_code_length", F.lit(NO_CAP)),
        "m1": metaphone_code(ascii_part), "m2": metaphone_code(K("target")),
        "d1": double_metaphone_codes(ascii_part), "d2": double_metaphone_codes(K("target")),
    })
    single = K("metaphone_type") == "normal"
    primary = F.when(single, _cut(K("m1"))).otherwise(_cut(K("d1.primary")))
    alternate = F.when(~single, _cut(K("d1.alternate")))
    same = F.when(single, _cut(K("m1")) == _cut(K("m2"))).otherwise(
        (_cut(K("d1.primary")) == _cut(K("d2.primary"))) | (_cut(K("d1.alternate")) == _cut(K("d2.alternate"))))
    return ready.select("*", *result_columns(
        match=usable & F.coalesce(same, F.lit(False)), primary_code=F.when(usable, primary),
        alternate_code=F.when(usable, alternate), error=F.when(~usable, F.lit(NOT_ASCII)),
    )).drop("cap", "m1", "m2", "d1", "d2")


# --- nysiis ---------------------------------------------------------------------------------------------


def _find_nysiis(parts: DataFrame, rules: DataFrame, profile: Row, options: Options) -> DataFrame:
    targets = rules.withColumn("item", F.concat_ws(":", "strict", nysiis_code(K("target"), K("strict"))))
    modes = rules.select("chain_id", "strict").distinct()
    words = parts.select("chain_id", "part").join(F.broadcast(modes), "chain_id").withColumn(
        "code", nysiis_code(K("part"), K("strict")))
    named = words.select("chain_id", "part", "code", F.concat_ws(":", "strict", "code").alias("item"))
    counted = named.groupBy("chain_id", "item").agg(F.count("*").alias("n"))
    return with_parts(named, counted, targets.drop("strict")).select(
        "*", *result_columns(match=F.lit(True), encoded=K("code")))


def _score_nysiis(pairs: DataFrame, options: Options) -> DataFrame:
    code = nysiis_code(K("part"), K("strict"))
    return pairs.select("*", *result_columns(match=code == nysiis_code(K("target"), K("strict")), encoded=code))


register(RuleJob("confusables", _score_confusables, _find_confusables))
register(RuleJob("metaphone", _score_metaphone, _find_metaphone))
register(RuleJob("nysiis", _score_nysiis, _find_nysiis, ("strict",)))
