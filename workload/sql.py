"""SQL fragments shared by the comparison queries."""

from __future__ import annotations

BREAK = r"""'[ \t\r\n.,;:!?()"]+'"""
WORDS = (
    f"w AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, {BREAK})) AS word FROM documents)"
    " WHERE word <> '' GROUP BY word)"
)
HOSTS = "h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)"
DOMAINS = (
    f"{HOSTS}, d AS (SELECT DISTINCT domain FROM (SELECT word || '.' || lang || '.example.com' AS domain FROM"
    f" (SELECT lang, unnest(string_split_regex(text, {BREAK})) AS word FROM documents) WHERE word <> ''"
    " UNION ALL SELECT host FROM h))"
)
# labels of each domain, numbered from 0
LABELS = (
    "l AS (SELECT domain, list_filter(string_split(domain, '.'), lambda x: x <> '') AS pieces FROM d),"
    " p AS (SELECT domain, unnest(range(0, len(pieces))) AS pos, pieces FROM l),"
    " parts AS (SELECT domain, pos, pieces[pos + 1] AS part, len(pieces) AS total FROM p)"
)
# the letters of the tables that take two bytes
ACCENTED = "éóèñçüêäößíÉÈÑÓÇÄÊÜÖÍ"
_CODES = [c for c in range(2, 32) if c not in (9, 10, 13)]


def targets(ascii_only: bool = False) -> str:
    extra = " AND strlen(target) = length(target)" if ascii_only else ""
    return (
        f"t AS (SELECT DISTINCT target FROM (SELECT unnest(string_split_regex(text, {BREAK})) AS target FROM benchmark)"
        f" WHERE target <> ''{extra})"
    )


def byte_text(expr: str) -> str:
    """One character per byte: a two-byte letter becomes two characters no text has."""
    for letter, code in zip(ACCENTED, _CODES):
        expr = f"replace({expr}, '{letter}', chr(1) || chr({code}))"
    return expr


def from_byte_text(expr: str) -> str:
    """Undo byte_text; half a letter becomes the replacement character."""
    for letter, code in zip(ACCENTED, _CODES):
        expr = f"replace({expr}, chr(1) || chr({code}), '{letter}')"
    for code in [1, *_CODES]:
        expr = f"replace({expr}, chr({code}), chr(65533))"
    return expr


def char_text(expr: str) -> str:
    """One byte per character."""
    codes = " || ".join(f"chr({code})" for code, _ in zip(_CODES, ACCENTED))
    return f"translate({expr}, '{ACCENTED}', {codes})"


def collapse(expr: str, letters: str) -> str:
    """Runs of each of the letters become one letter."""
    for letter in letters:
        expr = f"regexp_replace({expr}, '{letter}+', '{letter}', 'g')"
    return expr


def no_repeats(expr: str) -> str:
    """Drop every character equal to the one before it."""
    return (
        f"array_to_string(list_transform(list_filter(list_zip(string_split({expr}, ''), range(1, length({expr}) + 1)),"
        f" lambda z: z[2] = 1 OR z[1] <> substr({expr}, z[2]::INT - 1, 1)), lambda z: z[1]), '')"
    )


def upper(expr: str) -> str:
    return f"upper(replace({expr}, 'ß', 'ss'))"


def letters(expr: str) -> str:
    return f"regexp_replace({upper(expr)}, '[^A-ZÀ-ÖØ-Þ]', '', 'g')"


def soundex(expr: str) -> str:
    """Four-character soundex of the letters, '' without letters."""
    text = letters(expr)
    first = f"substr({text}, 1, 1)"
    head = f"translate({first}, 'AEIOUYHWBFPVCGJKQSXZDTLMNR', '00000000111122222222334556')"
    tail = f"translate(substr({text}, 2), 'AEIOUYBFPVCGJKQSXZDTLMNRHW', '000000111122222222334556')"
    digits = f"replace(substr({collapse(f'({head} || {tail})', '123456')}, 2), '0', '')"
    return f"CASE WHEN {text} = '' THEN '' ELSE {first} || substr({digits} || '000', 1, 3) END"


def refined(expr: str) -> str:
    text = letters(expr)
    digits = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01360240043788015936020505')"
    return f"(substr({text}, 1, 1) || {collapse(digits, '0123456789')})"


def equal_positions(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i::INT, 1) = substr({b}, i::INT, 1)))"


def nysiis_ctes(source: str, column: str, name: str) -> str:
    """Steps of the NYSIIS key over a table with one text column; the key is not cut."""
    r = "regexp_replace"
    # what follows the first letter: replacements that do not depend on the letter before
    rest = "rest"
    for old, new in (("EV", "AF"),):
        rest = f"replace({rest}, '{old}', '{new}')"
    rest = f"{r}({rest}, 'S(CH)+', 'S', 'g')"
    for old, new in (("PH", "FF"), ("KN", "NN"), ("K", "C"), ("Q", "G"), ("Z", "S"), ("M", "N")):
        rest = f"replace({rest}, '{old}', '{new}')"
    kept = "s"
    for _ in range(2):  # neighbours share a vowel, so one pass misses every second
        kept = rf"{r}({kept}, '([AEIOU])[HW]*H([AEIOU])', '\1h\2', 'g')"
    return rf"""
    {name}0 AS (SELECT DISTINCT {column}, {letters(column)} AS s FROM {source}),
    {name}1 AS (SELECT {column}, {r}({r}({r}({r}({r}(s, '^MAC', 'MCC'), '^KN', 'NN'), '^K', 'C'), '^P[HF]', 'FF'), '^SCH', 'SSS') AS s FROM {name}0),
    {name}2 AS (SELECT {column}, {r}({r}(s, '(EE|IE)$', 'Y'), '(DT|RT|RD|NT|ND)$', 'D') AS s FROM {name}1),
    {name}3 AS (SELECT {column}, substr(s, 1, 1) AS f, substr(s, 2) AS rest FROM {name}2),
    {name}4 AS (SELECT {column}, f || {rest} AS s FROM {name}3),
    {name}5 AS (SELECT {column}, {kept} AS s FROM {name}4),
    {name}6 AS (SELECT {column}, {r}(s, '([AEIOU])[HW]+', '\1', 'g') AS s FROM {name}5),
    {name}7 AS (SELECT {column}, upper(substr(s, 1, 1) || translate(replace(substr(s, 2), 'H', ''), 'EIOU', 'AAAA')) AS s FROM {name}6),
    {name}8 AS (SELECT {column}, {no_repeats('s')} AS s FROM {name}7),
    {name} AS (SELECT {column}, {r}({r}({r}({r}(s, '^AS$', ''), '(.)S$', '\1'), '(.)AY$', '\1Y'), '(.)A$', '\1') AS code FROM {name}8)"""


def match_rating_code(expr: str) -> str:
    text = f"regexp_replace(translate({upper(expr)}, 'ÉÓÈÑÇÜÊÄÖÍ', 'EOENCUEAOI'), '[-&''.,]', '', 'g')"
    rest = f"translate({text}, 'AEIOU', '')"
    rest = f"(CASE WHEN regexp_matches({text}, '^[AEIOU]') THEN substr({text}, 1, 1) ELSE '' END || {rest})"
    for c in "BCDFGHJKLMNPQRSTVWXYZ":
        rest = f"replace({rest}, '{c}{c}', '{c}')"
    return rest


def metaphone_ctes(source: str, column: str, name: str) -> str:
    """Uncut metaphone code over a table with one text column."""
    def at(offset: int) -> str:
        place = f"i::INT + {offset}" if offset >= 0 else f"i::INT - {-offset}"
        return f"CASE WHEN {place} >= 1 THEN substr(s, {place}, 1) ELSE '' END"

    c, p, pp, ppp, n, n2 = at(0), at(-1), at(-2), at(-3), at(1), at(2)
    vowel = "('A','E','I','O','U')"
    front = "('E','I','Y')"
    last = "i = length(s)"
    case = f"""CASE
      WHEN {c} = {p} AND {c} <> 'C' THEN ''
      WHEN {p} = 'D' AND {pp} <> 'D' AND {c} = 'G' AND {n} IN {front} THEN ''
      WHEN {pp} = 'D' AND {ppp} <> 'D' AND {p} = 'G' AND {c} IN {front} THEN ''
      WHEN {c} IN {vowel} THEN CASE WHEN i = 1 THEN {c} ELSE '' END
      WHEN {c} = 'B' THEN CASE WHEN {p} = 'M' AND {last} THEN '' ELSE 'B' END
      WHEN {c} = 'C' THEN CASE
        WHEN {p} = 'S' AND {n} IN {front} THEN ''
        WHEN {n} = 'I' AND {n2} = 'A' THEN 'X'
        WHEN {n} IN {front} THEN 'S'
        WHEN {p} = 'S' AND {n} = 'H' THEN 'K'
        WHEN {n} = 'H' THEN CASE WHEN i = 1 AND {n2} IN {vowel} THEN 'K' ELSE 'X' END
        ELSE 'K' END
      WHEN {c} = 'D' THEN CASE WHEN {n} = 'G' AND {n2} IN {front} THEN 'J' ELSE 'T' END
      WHEN {c} = 'G' THEN CASE
        WHEN {n} = 'H' AND i + 1 = length(s) THEN ''
        WHEN {n} = 'H' AND {n2} NOT IN {vowel} THEN ''
        WHEN i > 1 AND {n} = 'N' THEN ''
        WHEN {n} IN {front} THEN 'J' ELSE 'K' END
      WHEN {c} = 'H' THEN CASE WHEN {p} NOT IN ('C','S','P','T','G') AND {n} IN {vowel} THEN 'H' ELSE '' END
      WHEN {c} IN ('F','J','L','M','N','R') THEN {c}
      WHEN {c} = 'K' THEN CASE WHEN {p} = 'C' THEN '' ELSE 'K' END
      WHEN {c} = 'P' THEN CASE WHEN {n} = 'H' THEN 'F' ELSE 'P' END
      WHEN {c} = 'Q' THEN 'K'
      WHEN {c} = 'S' THEN CASE WHEN {n} = 'H' OR ({n} = 'I' AND {n2} IN ('O','A')) THEN 'X' ELSE 'S' END
      WHEN {c} = 'T' THEN CASE
        WHEN {n} = 'I' AND {n2} IN ('O','A') THEN 'X'
        WHEN {n} = 'C' AND {n2} = 'H' THEN ''
        WHEN {n} = 'H' THEN '0' ELSE 'T' END
      WHEN {c} = 'V' THEN 'F'
      WHEN {c} IN ('W','Y') THEN CASE WHEN {n} IN {vowel} THEN {c} ELSE '' END
      WHEN {c} = 'X' THEN 'KS'
      WHEN {c} = 'Z' THEN 'S'
      ELSE '' END"""
    return f"""
    {name}0 AS (SELECT DISTINCT {column}, upper({column}) AS u FROM {source}),
    {name}1 AS (SELECT {column}, u, CASE
        WHEN regexp_matches(u, '^([KGP]N|AE|WR)') THEN substr(u, 2)
        WHEN regexp_matches(u, '^WH') THEN 'W' || substr(u, 3)
        WHEN regexp_matches(u, '^X') THEN 'S' || substr(u, 2) ELSE u END AS s FROM {name}0),
    {name} AS (SELECT {column}, CASE WHEN length(u) = 1 THEN u
        ELSE array_to_string(list_transform(range(1, length(s) + 1), lambda i: {case}), '') END AS code FROM {name}1)"""
