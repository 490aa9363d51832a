"""One query per rule type: all distinct words of the documents against all words of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.operators import Options, register_rule
from nearmark.plans.match import match_targets
from nearmark.sources.catalog import Catalog, catalog_from_rules
from nearmark.session import cut
from workload import sql
from workload.inputs import catalog, rule, table, targets, words
from workload.registry import registry

QUERIES, ORACLES, query = registry()


def found(spark: SparkSession, sf_dir: str, rules: Catalog, *columns, options: Options = Options()) -> DataFrame:
    rows = match_targets(words(spark, sf_dir), rules, options)
    return rows.select(F.col("value").alias("word"), F.col("rule_set").alias("target"), *columns)


def with_words(body: str, ascii_only: bool = False) -> str:
    return f"WITH RECURSIVE {sql.WORDS}, {sql.targets(ascii_only)} {body}"


# --- edit distance --------------------------------------------------------------------------------------


@query("levenshtein_join", with_words("""
    SELECT word, target, levenshtein(word, target)::INT AS distance FROM w JOIN t
      ON abs(strlen(word) - strlen(target)) <= 2 AND levenshtein(word, target) <= 2"""))
def levenshtein_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("levenshtein", maximum_distance=2)), "distance")


@query("limit_by_length_join", with_words("""
    SELECT word, target, levenshtein(word, target)::INT AS distance FROM w JOIN t
      ON abs(strlen(word) - strlen(target)) <= strlen(target) // 3 AND levenshtein(word, target) <= strlen(target) // 3"""))
def limit_by_length_join(spark, sf_dir):
    """Every target has a limit of its own, a third of its length, so that narrow and wide limits share a catalog."""
    limits = targets(spark, sf_dir).select(
        F.lit("words").alias("group_name"), F.col("target").alias("rule_set"), "target", F.lit(0).alias("rule_idx"),
        F.lit("levenshtein").alias("rule_type"), F.floor(F.octet_length("target") / 3).cast("int").alias("maximum_distance"))
    return found(spark, sf_dir, catalog_from_rules(limits), "distance")


_OSA = f"""
    , near AS (SELECT word, target, {sql.byte_text('word')} AS a, {sql.byte_text('target')} AS b FROM w JOIN t
        ON abs(strlen(word) - strlen(target)) <= 2 AND levenshtein(word, target) <= 4),
    dp AS (
      SELECT word, target, a, b, 0 AS i, range(0, length(b) + 1) AS before, range(0, length(b) + 1) AS last FROM near
      UNION ALL
      SELECT word, target, a, b, i + 1, last,
        list_transform(range(0, length(b) + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda q: j - q +
          CASE WHEN q = 0 THEN i + 1 ELSE least(last[q + 1] + 1,
            last[q] + CASE WHEN substr(a, i + 1, 1) = substr(b, q::INT, 1) THEN 0 ELSE 1 END,
            CASE WHEN i >= 1 AND q >= 2 AND substr(a, i + 1, 1) = substr(b, q::INT - 1, 1)
                  AND substr(a, i, 1) = substr(b, q::INT, 1) THEN before[q - 1] + 1 ELSE 1000 END) END)))
      FROM dp WHERE i < length(a))
    SELECT word, target, last[length(b) + 1]::INT AS distance FROM dp
    WHERE i = length(a) AND last[length(b) + 1] <= 2"""


@query("damerau_levenshtein_join", with_words(_OSA))
def damerau_levenshtein_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("damerau_levenshtein", maximum_distance=2)), "distance")


@query("hamming_join", with_words(f"""
    , wb AS (SELECT word, {sql.byte_text('word')} AS a FROM w), tb AS (SELECT target, {sql.byte_text('target')} AS b FROM t)
    SELECT word, target, hamming(a, b)::INT AS distance FROM wb JOIN tb ON length(a) = length(b)
    WHERE CASE WHEN length(a) = length(b) THEN hamming(a, b) <= 2 ELSE false END"""))
def hamming_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("hamming", maximum_distance=2)), "distance")


# every window of target length, compared once per distinct text
_WINDOWS = f"""
    , wb AS (SELECT word, {sql.byte_text('word')} AS a FROM w), tb AS (SELECT target, {sql.byte_text('target')} AS b FROM t),
    sizes AS (SELECT DISTINCT length(b) AS size FROM tb),
    places AS (SELECT a, size, unnest(range(1, length(a) - size + 2)) AS place FROM wb JOIN sizes ON size < length(a)),
    windows AS (SELECT a, size, place, substr(a, place::INT, size::INT) AS piece FROM places),
    close AS (SELECT piece, b, {{distance}}(piece, b) AS d FROM (SELECT DISTINCT size, piece FROM windows)
        JOIN tb ON size = length(b) AND {{distance}}(piece, b) <= 1),
    whole AS (SELECT word, target, a, b, {{distance}}(a, b) AS d FROM wb JOIN tb
        ON abs(length(a) - length(b)) <= 1 AND {{distance}}(a, b) <= 1),
    inside AS (SELECT DISTINCT a, b FROM windows JOIN close USING (piece))"""
_SCAN = with_words(_WINDOWS.format(distance="levenshtein") + f"""
    , scan AS (
      SELECT i.a, i.b, 0 AS start, levenshtein(substr(i.a, 1, length(i.b)), i.b) AS d FROM inside i
        WHERE NOT EXISTS (SELECT 1 FROM whole x WHERE x.a = i.a AND x.b = i.b)
      UNION ALL
      SELECT a, b, start + step, levenshtein(substr(a, (start + step)::INT + 1, length(b)), b) FROM (
        SELECT a, b, start, d, least((d - 1) // 2, length(a) - length(b) - start - 1) AS step FROM scan WHERE d > 1)
      WHERE step > 0)
    SELECT word, target, d::INT AS distance, NULL::VARCHAR AS substring FROM whole
    UNION ALL
    SELECT word, target, d::INT, {sql.from_byte_text('substr(a, start::INT + 1, length(b))')}
    FROM scan JOIN wb USING (a) JOIN tb USING (b) WHERE d <= 1""")


@query("levenshtein_substring_join", _SCAN)
def levenshtein_substring_join(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("levenshtein_substring", maximum_distance=1))
    return found(spark, sf_dir, rules, "distance", "substring")


def _every_window(distance: str) -> str:
    return with_words(_WINDOWS.format(distance=distance) + f"""
    , best AS (SELECT a, b, arg_min(piece, (d, place)) AS piece, min(d) AS d FROM windows JOIN close USING (piece)
        GROUP BY a, b)
    SELECT word, target, d::INT AS distance, NULL::VARCHAR AS substring FROM whole
    UNION ALL
    SELECT word, target, d::INT, {sql.from_byte_text('piece')} FROM best JOIN wb USING (a) JOIN tb USING (b)
    WHERE NOT EXISTS (SELECT 1 FROM whole x WHERE x.a = best.a AND x.b = best.b)""")


EXHAUSTIVE = Options(substring_mode="exhaustive")


@query("levenshtein_substring_every_window", _every_window("levenshtein"))
def levenshtein_substring_every_window(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("levenshtein_substring", maximum_distance=1))
    return found(spark, sf_dir, rules, "distance", "substring", options=EXHAUSTIVE)


@query("damerau_substring_every_window", _every_window("damerau_levenshtein"))
def damerau_substring_every_window(spark, sf_dir):
    # at distance 1 the restricted and the full form agree
    rules = catalog(spark, sf_dir, rule("damerau_levenshtein_substring", maximum_distance=1))
    return found(spark, sf_dir, rules, "distance", "substring", options=EXHAUSTIVE)


# the full form in place of the restricted one: they could part in a step of the scan, but do not on these tables
@query("damerau_levenshtein_substring_join", _SCAN.replace("levenshtein(", "damerau_levenshtein("))
def damerau_levenshtein_substring_join(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("damerau_levenshtein_substring", maximum_distance=1))
    return found(spark, sf_dir, rules, "distance", "substring")


# --- shared tokens --------------------------------------------------------------------------------------


@query("jaccard_join", with_words("""
    , ws AS (SELECT word, array_to_string(list_sort(list_distinct(string_split(word, ''))), '') AS a FROM w),
    ts AS (SELECT target, array_to_string(list_sort(list_distinct(string_split(target, ''))), '') AS b FROM t),
    pairs AS (SELECT a, b, len(list_intersect(string_split(a, ''), string_split(b, ''))) AS shared
        FROM (SELECT DISTINCT a FROM ws) JOIN (SELECT DISTINCT b FROM ts)
        ON length(a) * 5 >= length(b) * 4 AND length(b) * 5 >= length(a) * 4),
    hits AS (SELECT a, b, shared / (length(a) + length(b) - shared) AS s FROM pairs)
    SELECT word, target, round(s, 6) AS similarity FROM hits JOIN ws USING (a) JOIN ts USING (b) WHERE s >= 0.8"""))
def jaccard_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("jaccard", minimum_similarity=0.8)),
                 F.round("similarity", 6).alias("similarity"))


def _by_characters(function: str, limit: float) -> str:
    return with_words(f"""
    , wc AS (SELECT word, {sql.char_text('word')} AS a FROM w), tc AS (SELECT target, {sql.char_text('target')} AS b FROM t)
    SELECT word, target, round({function}(a, b), 6) AS match_percent FROM wc JOIN tc ON {function}(a, b) >= {limit}""")


@query("jaro_join", _by_characters("jaro_similarity", 0.87))
def jaro_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("jaro", match_percent_threshold=0.87)),
                 F.round("match_percent", 6).alias("match_percent"))


@query("jaro_winkler_join", _by_characters("jaro_winkler_similarity", 0.92))
def jaro_winkler_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("jaro_winkler", match_percent_threshold=0.92)),
                 F.round("match_percent", 6).alias("match_percent"))


def _soundex_sql(code, limit: int) -> str:
    return with_words(f"""
    , wc AS (SELECT word, {code('word')} AS a FROM w WHERE strlen(word) = length(word)),
    tc AS (SELECT target, {code('target')} AS b FROM t),
    pairs AS (SELECT a, b, {sql.equal_positions('a', 'b')} AS s FROM
        (SELECT DISTINCT a FROM wc WHERE length(a) >= {limit}) JOIN (SELECT DISTINCT b FROM tc WHERE length(b) >= {limit}) ON true)
    SELECT word, target, s::DOUBLE AS similarity FROM pairs JOIN wc USING (a) JOIN tc USING (b) WHERE s >= {limit}""",
                      ascii_only=True)


@query("soundex_join", _soundex_sql(sql.soundex, 4))
def soundex_join(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("soundex", minimum_similarity=4), ascii_only=True)
    return found(spark, sf_dir, rules, "similarity")


@query("refined_soundex_join", _soundex_sql(sql.refined, 8))
def refined_soundex_join(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("soundex", minimum_similarity=8, soundex_type="refined"), ascii_only=True)
    return found(spark, sf_dir, rules, "similarity")


_RATING = with_words(f"""
    , wc AS (SELECT word, CASE WHEN length(word) < 2 THEN '' WHEN length(c) > 6 THEN substr(c, 1, 3) || substr(c, -3) ELSE c END AS a
        FROM (SELECT word, {sql.match_rating_code('word')} AS c FROM w WHERE strlen(word) > 1)),
    tc AS (SELECT target, CASE WHEN length(target) < 2 THEN '' WHEN length(c) > 6 THEN substr(c, 1, 3) || substr(c, -3) ELSE c END AS b
        FROM (SELECT target, {sql.match_rating_code('target')} AS c FROM t)),
    pairs AS (SELECT a, b, strlen(a) + strlen(b) AS total FROM (SELECT DISTINCT a FROM wc) JOIN (SELECT DISTINCT b FROM tc)
        ON abs(strlen(a) - strlen(b)) < 3),
    step1 AS (SELECT a, b, total,
        array_to_string(list_filter(list_transform(range(1, length(a) + 1), lambda i:
          CASE WHEN substr(a, i::INT, 1) = substr(b, i::INT, 1) THEN '' ELSE substr(a, i::INT, 1) END), lambda x: x <> ''), '') AS ra,
        array_to_string(list_filter(list_transform(range(1, length(b) + 1), lambda i:
          CASE WHEN substr(b, i::INT, 1) = substr(a, i::INT, 1) THEN '' ELSE substr(b, i::INT, 1) END), lambda x: x <> ''), '') AS rb
        FROM pairs),
    step2 AS (SELECT a, b, total, greatest(length(ra), length(rb)) - len(list_filter(range(1, least(length(ra), length(rb)) + 1),
        lambda i: substr(ra, -(i::INT), 1) = substr(rb, -(i::INT), 1))) AS remaining FROM step1),
    hits AS (SELECT a, b FROM step2 WHERE abs(6 - remaining) >=
        CASE WHEN total <= 4 THEN 5 WHEN total <= 7 THEN 4 WHEN total <= 11 THEN 3 WHEN total = 12 THEN 2 ELSE 1 END)
    SELECT word, target FROM hits JOIN wc USING (a) JOIN tc USING (b)
    UNION ALL
    SELECT word, target FROM w JOIN t ON word = target WHERE strlen(word) <= 1""")


@query("match_rating_join", _RATING)
def match_rating_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("match_rating")))


# --- codes ----------------------------------------------------------------------------------------------


def _skeleton_sql(expr: str) -> str:
    return f"replace(translate({expr}, '01I|`', 'Olll' || chr(39)), 'm', 'rn')"


@query("confusables_join", with_words(f"""
    SELECT word, target FROM w JOIN t ON {_skeleton_sql('word')} = {_skeleton_sql('target')} AND word <> target"""))
def confusables_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("confusables")))


@query("metaphone_join", with_words(f"""
    , {sql.metaphone_ctes('(SELECT word FROM w WHERE strlen(word) = length(word))', 'word', 'mw')},
    {sql.metaphone_ctes('t', 'target', 'mt')}
    SELECT word, target, substr(mw.code, 1, 4) AS primary_code, 4 AS max_code_length FROM mw JOIN mt
      ON substr(mw.code, 1, 4) = substr(mt.code, 1, 4)""", ascii_only=True))
def metaphone_join(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("metaphone"), ascii_only=True)
    return found(spark, sf_dir, rules, "primary_code", "max_code_length")


@query("double_metaphone_join")
def double_metaphone_join(spark, sf_dir):
    rules = catalog(spark, sf_dir, rule("metaphone", metaphone_type="double"), ascii_only=True)
    return found(spark, sf_dir, rules, "primary_code", "alternate_code")


@query("nysiis_join", with_words(f"""
    , {sql.nysiis_ctes('w', 'word', 'nw')}, {sql.nysiis_ctes('t', 'target', 'nt')}
    SELECT word, target, substr(nw.code, 1, 6) AS encoded FROM nw JOIN nt ON substr(nw.code, 1, 6) = substr(nt.code, 1, 6)"""))
def nysiis_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("nysiis")), "encoded")


@query("nysiis_uncut_join", with_words(f"""
    , {sql.nysiis_ctes('w', 'word', 'nw')}, {sql.nysiis_ctes('t', 'target', 'nt')}
    SELECT word, target, nw.code AS encoded FROM nw JOIN nt ON nw.code = nt.code"""))
def nysiis_uncut_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("nysiis", strict=False)), "encoded")


# --- enumerated targets ---------------------------------------------------------------------------------


def _bitflip_sql(allowed: str, word: str = "word", folded: str = "v") -> str:
    return with_words(f"""
    , codes AS (SELECT unicode(c) AS code FROM (SELECT unnest({allowed}) AS c)),
    flips AS (SELECT x.code AS old, y.code AS new FROM codes x JOIN codes y ON bit_count(xor(x.code, y.code)) = 1
        AND x.code < 128 AND y.code < 256),
    places AS (SELECT target, unnest(range(1, length(target) + 1))::INT AS place FROM t),
    variants AS (SELECT target, substr(target, 1, place - 1) || chr(new) || substr(target, place + 1) AS v
        FROM places JOIN flips ON unicode(substr(target, place, 1)) = old)
    SELECT DISTINCT word, target FROM w JOIN variants ON {word} = {folded}""")


_DNS = "string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-.', '')"
_PRINTABLE = "list_transform(range(33, 127), lambda i: chr(i::INT))"


@query("bitflip_dns_join", _bitflip_sql(_DNS))
def bitflip_dns_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("bitflip")))


@query("bitflip_printable_join", _bitflip_sql(_PRINTABLE))
def bitflip_printable_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("bitflip", char_subset="printable")))


@query("bitflip_custom_join", _bitflip_sql("string_split('etaonish', '')"))
def bitflip_custom_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("bitflip", char_subset="custom", custom_char_subset="etaonish")))


@query("bitflip_any_case_join", _bitflip_sql(_DNS, "lower(word)", "lower(v)"))
def bitflip_any_case_join(spark, sf_dir):
    return found(spark, sf_dir, catalog(spark, sf_dir, rule("bitflip", case_sensitive=False)))


@query("regex_join", f"""WITH {sql.WORDS}, {sql.targets()},
    p AS (SELECT target, regexp_replace(target, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g') AS escaped FROM t),
    stems AS (SELECT word, word AS stem FROM w UNION SELECT word, substr(word, 2) FROM w),
    cut AS (SELECT word, stem FROM stems UNION SELECT word, left(stem, -1) FROM stems WHERE suffix(stem, 's')
          UNION SELECT word, left(stem, -2) FROM stems WHERE suffix(stem, 'ed')
          UNION SELECT word, left(stem, -3) FROM stems WHERE suffix(stem, 'ing')),
    tails AS (SELECT DISTINCT word, lower(substr(word, unnest(range(1, length(word) + 1))::INT)) AS tail FROM w)
    SELECT DISTINCT word, '^.?' || escaped || '(s|ed|ing)?$' AS pattern FROM cut JOIN p ON stem = target
    UNION ALL SELECT word, '(?i)' || escaped || '$' FROM tails JOIN p ON tail = lower(target)""")
def regex_join(spark, sf_dir):
    """Every target as a stem and, in any case, as an ending; punctuation is escaped."""
    escaped = F.regexp_replace("target", r"(\p{Punct})", r"\\$1")
    patterns = targets(spark, sf_dir).select("target", F.explode(F.array(
        F.concat(F.lit("^.?"), escaped, F.lit("(s|ed|ing)?$")), F.concat(F.lit("(?i)"), escaped, F.lit("$")))).alias("pattern"))
    rules = catalog_from_rules(patterns.select(
        F.lit("patterns").alias("group_name"), F.col("pattern").alias("rule_set"), "target", F.lit(0).alias("rule_idx"),
        F.lit("regex").alias("rule_type"), "pattern"))
    return found(spark, sf_dir, rules).withColumnRenamed("target", "pattern")


@query("cidr_join", """
    WITH a AS (SELECT DISTINCT l_suppkey % 256 AS x, l_partkey // 256 % 256 AS y, l_partkey % 256 AS z FROM lineitem),
    v4 AS (SELECT concat_ws('.', 10, x, y, z) AS address, x, y, z FROM a),
    v6 AS (SELECT 'fd00::' || lower(to_hex(x)) || ':' || lower(to_hex(y)) || ':' || lower(to_hex(z)) AS address, x, y FROM a),
    n AS (SELECT DISTINCT c_nationkey AS x, c_custkey // 256 % 256 AS y FROM customer)
    SELECT address, concat('10.', n.x, '.', n.y, '.0/24') AS network FROM v4 JOIN n ON v4.x = n.x AND v4.y = n.y
    UNION ALL SELECT address, concat('10.', n.x, '.0.0/16') FROM v4 JOIN (SELECT DISTINCT x FROM n) n ON v4.x = n.x
    UNION ALL SELECT address, 'fd00::' || lower(to_hex(n.x)) || ':' || lower(to_hex(n.y)) || ':0/112' FROM v6 JOIN n ON v6.x = n.x AND v6.y = n.y""")
def cidr_join(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 256).alias("x"), (F.floor(F.col("l_partkey") / 256) % 256).alias("y"),
        (F.col("l_partkey") % 256).alias("z")).groupBy("x", "y", "z").agg(F.count("*").alias("n"))

    def hexed(name: str):
        return F.lower(F.hex(F.col(name).cast("bigint")))

    v4 = keys.select(F.concat_ws(".", F.lit(10), "x", "y", "z").alias("value"), "n")
    v6 = keys.select(F.concat(F.lit("fd00::"), F.concat_ws(":", hexed("x"), hexed("y"), hexed("z"))).alias("value"), "n")
    # written: what is asked of a network would else be worked out for every customer
    nets = cut(table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("x"), (F.floor(F.col("c_custkey") / 256) % 256).alias("y")).distinct(), "nets")
    dotted = F.concat(F.lit("10."), "x", F.lit("."))
    networks = nets.select(F.concat(dotted, "y", F.lit(".0/24")).alias("network")).unionByName(
        nets.select(F.concat(dotted, F.lit("0.0/16")).alias("network")).distinct()).unionByName(
        nets.select(F.concat(F.lit("fd00::"), hexed("x"), F.lit(":"), hexed("y"), F.lit(":0/112")).alias("network")))
    rules = catalog_from_rules(networks.select(
        F.lit("networks").alias("group_name"), F.col("network").alias("rule_set"), F.col("network").alias("target"),
        F.lit(0).alias("rule_idx"), F.lit("cidr").alias("rule_type"), F.col("network").alias("address")))
    values = v4.unionByName(v6).groupBy("value").agg(F.sum("n").alias("n"))
    return match_targets(values, rules).select(F.col("value").alias("address"), F.col("rule_set").alias("network"))


# --- a rule of one's own --------------------------------------------------------------------------------


def _common_start(pairs: DataFrame) -> DataFrame:
    size = F.get_json_object("rule_values", "$.characters").cast("int")
    metadata = F.to_json(F.struct(F.left("part", size).alias("start")))
    return pairs.withColumn("match", F.left("part", size) == F.left("target", size)).withColumn("metadata", metadata)


def _same_start(parts: DataFrame, rules: DataFrame) -> DataFrame:
    size = F.get_json_object("rule_values", "$.characters").cast("int")
    keyed = rules.withColumns({"size": size, "start": F.left("target", size)})
    sizes = keyed.select("chain_id", "size").distinct()
    starts = parts.join(F.broadcast(sizes), "chain_id").withColumn("start", F.left("part", F.col("size")))
    return starts.join(keyed, ["chain_id", "size", "start"]).drop("size", "start")


@query("user_defined_rule", with_words("""
    SELECT word, target, substr(word, 1, 7) AS start FROM w JOIN t ON substr(word, 1, 7) = substr(target, 1, 7)"""))
def user_defined_rule(spark, sf_dir):
    register_rule("common_start", _common_start, _same_start)
    rules = catalog(spark, sf_dir, rule("common_start", characters=7))
    return found(spark, sf_dir, rules, F.get_json_object("metadata", "$.start").alias("start"))
