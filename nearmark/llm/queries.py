"""Registered queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.llm import (
    chat, decontaminate, langid, licences, manifest, mixing, neardup, phrases, quality, recompression, secrets, suffixes, warc,
)
from nearmark.session import cut

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


@query("op1_language_id")
def language_id(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text", held.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op2_decontamination")
def decontamination(spark, sf_dir):
    """One row per document and benchmark passage found in it."""
    found = decontaminate.contaminations(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("contamination").alias("hit")).select(
        "doc_id", "hit.item_id", "hit.start", "hit.end", "hit.edits")


_NEAR = r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
        END AS shingles FROM w),
    x AS (SELECT doc_id, len(shingles) AS n, hash(shingle) AS shingle FROM (SELECT doc_id, shingles, unnest(shingles) AS shingle FROM s)),
    links AS (
      SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b USING (shingle) WHERE a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 85
        AND b.n * 100 >= a.n * 85
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    reach AS (SELECT doc_id, doc_id AS node FROM s UNION SELECT reach.doc_id, v FROM reach JOIN links ON u = node)
    SELECT s.doc_id, any_value(len(shingles))::BIGINT AS n_shingles, min(node) AS component_id, s.doc_id = min(node) AS kept
    FROM s JOIN reach USING (doc_id) GROUP BY s.doc_id"""


@query("op3_near_duplicates", _NEAR)
def near_duplicates(spark, sf_dir):
    return neardup.cluster(documents(spark, sf_dir, "doc_id", "text"), settings=neardup.Settings(words=3, percent=85)).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query("op4_secret_scan")
def secret_scan(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir, "doc_id", "text")).drop("text")
    base = secrets.of_kind(F.col("secrets"), *secrets.BASE_KINDS)
    counts = [F.size(secrets.of_kind(F.col("secrets"), k)).cast("long").alias(f"n_{k}") for k in secrets.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"),
                        secrets.joined(F.col("secrets")).alias("spans"))


@query("op5_quality_rules")
def quality_rules(spark, sf_dir):
    featured = cut(quality.with_features(documents(spark, sf_dir, "doc_id", "text")).drop("text"), "quality-features")
    return quality.score(featured).select("doc_id", *quality.COUNTS, "base_failed", "kept", "posterior")


@query("op6_warc")
def warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "range_no", "range_place")


@query("op7_source_mix")
def source_mix(spark, sf_dir):
    mixed, _ = mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op8_repeated_bytes")
def repeated_bytes(spark, sf_dir):
    return suffixes.summary(suffixes.repeated_bytes(documents(spark, sf_dir, "doc_id", "text")))


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    return given.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], given.schema))


@query("op9_chat_format", r"""
    WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(9 + 7 + 4 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')))::BIGINT
        AS formatted_chars
    FROM said GROUP BY conv_id""")
def chat_format(spark, sf_dir):
    made = chat.format_chat(chat.records_from_turns(_conversations(spark, sf_dir))).select("conv_id", "formatted", "loss_spans")
    turns = chat.read_back(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(
        F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return made.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op10_repeated_words", r"""
    WITH w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
      FROM documents),
    starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
    windows AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS seen FROM starts),
    twice AS (SELECT seen FROM windows GROUP BY seen HAVING count(*) > 1),
    gone AS (SELECT DISTINCT doc_id, i + j AS place FROM windows JOIN twice USING (seen), (SELECT unnest(range(35)) AS j)),
    spread AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS body, count(*) AS n FROM spread ANTI JOIN gone USING (doc_id, place)
      GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed,
      sha256(coalesce(body, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""")
def repeated_words(spark, sf_dir):
    return recompression.summary(recompression.repeated_words(documents(spark, sf_dir, "doc_id", "text")))


def _templates() -> str:
    """The templates as rows of comparison SQL."""

    def quoted(values) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"

    return ", ".join(f"({i}, '{t.label}', {t.exact}, {quoted(t.words)}, {quoted(t.phrases)})" for i, t in enumerate(licences.Settings().templates))


@query("op11_licences", r"""
    WITH t(id, label, exact, template, keys) AS (VALUES """ + _templates() + r"""),
    w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
    spread AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM w),
    entries AS (SELECT id, exact, unnest(template) AS word, unnest(range(len(template))) AS spot FROM t),
    seen AS (SELECT word, count(DISTINCT doc_id) AS n FROM spread WHERE word IN (SELECT word FROM entries) GROUP BY word),
    known AS (
      SELECT entries.*, row_number() OVER (PARTITION BY id ORDER BY n, word, spot) AS rarity FROM entries JOIN seen USING (word)),
    anchors AS (SELECT *, count(*) OVER (PARTITION BY id) AS of FROM known WHERE rarity <= CASE WHEN exact THEN 1 ELSE 6 END),
    starts AS (
      SELECT doc_id, id, place - spot AS start, count(*) AS agreeing, any_value(of) AS of FROM spread JOIN anchors USING (word)
      GROUP BY doc_id, id, place - spot HAVING count(*) >= least(4, any_value(of))),
    near AS (
      SELECT starts.*, label, exact, keys, ' ' || array_to_string(words[greatest(start - CASE WHEN exact THEN 0 ELSE 6 END, 0) + 1:
        start + len(template) + CASE WHEN exact THEN 0 ELSE 6 END], ' ') || ' ' AS body
      FROM starts JOIN t USING (id) JOIN w USING (doc_id)),
    found AS (SELECT *, agreeing / of AS score FROM near WHERE len(list_filter(keys, lambda k: NOT contains(body, ' ' || k || ' '))) = 0),
    told AS (
      SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        max(score) AS score FROM found GROUP BY doc_id)
    SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM w LEFT JOIN told USING (doc_id)""")
def licence_scan(spark, sf_dir):
    found = licences.scan(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("licences", lambda x: x["exact"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), licences.labels(base).alias("base_labels"), licences.labels(F.col("licences")).alias("labels"),
        F.coalesce(F.array_max(F.transform("licences", lambda x: x["score"])), F.lit(0.0)).alias("score"))


@query("op12_phrases", r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces),
    spots AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
    counted AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spots GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
    often AS (SELECT * FROM counted WHERE f >= 30),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM often WHERE k > 1),
    cuts AS (SELECT lang, phrase, a, words, unnest(range(1, k)) AS cut_at FROM c),
    scored AS (
      SELECT cuts.lang, cuts.phrase, a, cut_at, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cuts
      JOIN often x ON x.lang = cuts.lang AND x.phrase = array_to_string(words[1:cut_at], ' ')
      JOIN often y ON y.lang = cuts.lang AND y.phrase = array_to_string(words[cut_at + 1:], ' ')),
    least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
    starts AS (SELECT lang, k, a, words, unnest(range(1, k)) AS b FROM c WHERE k > 2),
    ends AS (SELECT *, unnest(range(b + 1, k + 1)) AS e FROM starts),
    longer AS (SELECT lang, array_to_string(words[b:e], ' ') AS phrase, max(a) AS most FROM ends WHERE e - b + 1 < k GROUP BY ALL),
    kept AS (SELECT least.* FROM least LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""")
def frequent_phrases(spark, sf_dir):
    return phrases.best(phrases.collocations(documents(spark, sf_dir, "text", "lang")))


@query("op13_manifest", r"""
    WITH RECURSIVE bytes AS (
      SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
      FROM range(256) AS r(b)),
    crc AS (SELECT list(c ORDER BY b) AS t FROM bytes),
    fields AS (
      SELECT doc_id, coalesce('=' || lang, '') AS tree, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, n_chars,
        coalesce(strlen(text) || ':' || text, '-') AS body,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS hit
      FROM documents, crc),
    leaves AS (
      SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || body) AS leaf,
        sha256(head || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || body) AS now,
        row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place FROM fields),
    levels AS (
      SELECT tree, 0 AS level, list(leaf ORDER BY doc_id) AS h FROM leaves GROUP BY tree
      UNION ALL
      SELECT tree, level + 1, list_transform(range(1, (len(h) + 1) // 2 + 1), lambda i: sha256(h[2 * i - 1] || coalesce(h[2 * i], '')))
      FROM levels WHERE len(h) > 1),
    tops AS (SELECT tree, h[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM levels WHERE len(h) = 1),
    upper_levels AS (
      SELECT 1000 AS level, list(subroot ORDER BY tree) AS h FROM tops
      UNION ALL
      SELECT level + 1, list_transform(range(1, (len(h) + 1) // 2 + 1), lambda i: sha256(h[2 * i - 1] || coalesce(h[2 * i], '')))
      FROM upper_levels WHERE len(h) > 1),
    steps AS (
      SELECT doc_id, level, place >> level AS spot, h FROM leaves JOIN levels USING (tree) WHERE len(h) > 1
      UNION ALL
      SELECT doc_id, level, tops.place >> (level - 1000), h FROM leaves JOIN tops USING (tree), upper_levels WHERE len(h) > 1),
    met AS (SELECT doc_id, level, CASE WHEN spot % 2 = 1 THEN 'L' ELSE 'R' END AS side, h[xor(spot, 1) + 1] AS other FROM steps),
    paths AS (SELECT doc_id, list(CASE WHEN other IS NULL THEN '-' ELSE side || other END ORDER BY level) AS path,
      string_agg(other, '' ORDER BY level) AS proof FROM met GROUP BY doc_id),
    folded AS (
      SELECT doc_id, leaf, subroot, sha256(coalesce(proof, '')) AS proof_sha256,
        substr(list_reduce(list_prepend('x' || now, coalesce(path, [])), lambda a, s: 'x' || sha256(CASE s[1]
          WHEN 'L' THEN s[2:] || a[2:] WHEN 'R' THEN a[2:] || s[2:] ELSE a[2:] END)), 2) AS folded_root
      FROM leaves JOIN tops USING (tree) LEFT JOIN paths USING (doc_id))
    SELECT doc_id, leaf, subroot, h[1] AS root, proof_sha256, folded_root, folded_root = h[1] AS verified
    FROM folded, upper_levels WHERE len(h) = 1""")
def merkle_manifest(spark, sf_dir):
    """``n_chars`` of some documents reads one more than when the manifest was made."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    stored = manifest.manifest(
        table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"],
        {"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return manifest.verify(stored).withColumnRenamed("key", "doc_id")
