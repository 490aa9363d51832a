"""Sound codes. Soundex, NYSIIS and match rating are Catalyst expressions; the two metaphones scan
a rule table over Arrow batches of words."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _letters(col: Column) -> Column:
    return F.regexp_replace(F.upper(col), r"[^\p{L}]", "")


def soundex_code(col: Column) -> Column:
    """Four-character code of the letters, ``''`` when there are none."""
    letters = _letters(col)
    return F.when(letters == "", F.lit("")).otherwise(F.soundex(letters))


# Refined soundex digits of the letters A to Z.
REFINED_DIGITS = "01360240043788015936020505"


def refined_soundex_code(col: Column) -> Column:
    """First letter, then the digits of all letters with repeats collapsed."""
    letters = _letters(col)
    digits = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", REFINED_DIGITS)
    return F.concat(F.left(letters, F.lit(1)), F.regexp_replace(digits, r"(.)\1+", "$1"))


# NYSIIS replacements, in the order they apply to the upper-case letters of a word.
# A lower-case h is an H that stays.
NYSIIS_STEPS = [
    (r"^MAC", "MCC"), (r"^KN", "NN"), (r"^K", "C"), (r"^P[HF]", "FF"), (r"^SCH", "SSS"),
    (r"(?:EE|IE)$", "Y"), (r"(?:DT|RT|RD|NT|ND)$", "D"),
    (r"(?<=.)EV", "AF"),
    (r"(?<=.)S(?:CH)+", "S"), (r"(?<=.)PH", "FF"), (r"(?<=.)KN", "NN"), (r"(?<=.)K", "C"),
    (r"(?<=.)Q", "G"), (r"(?<=.)Z", "S"), (r"(?<=.)M", "N"),
    (r"(?<=[AEIOU])[HW]*H(?=[AEIOU])", "h"), (r"(?<=[AEIOU])[HW]+", ""), (r"(?<=.)H", ""),
    (r"h", "H"),
    (r"(?<=.)[EIOU]", "A"),
    (r"(.)\1+", "$1"),
    (r"^AS$", ""), (r"(?<=.)S$", ""), (r"(?<=.)AY$", "Y"), (r"(?<=.)A$", ""),
]


def nysiis_code(col: Column, strict: Column) -> Column:
    """NYSIIS key, cut to six characters when ``strict``."""
    out = _letters(col)
    for pattern, replacement in NYSIIS_STEPS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.when(strict, F.left(out, F.lit(6))).otherwise(out)


# Combining marks and the letters match rating takes them off.
_ACCENTED = {
    "̀": "AEIOU", "́": "AEIOUY", "̂": "AEIOUY", "̃": "AON",
    "̈": "AEIOUY", "̊": "A", "̧": "C", "̋": "OU",
}
_PLAIN = {unicodedata.normalize("NFC", c + mark): c for mark, letters in _ACCENTED.items() for c in letters}


def match_rating_code(col: Column) -> Column:
    """Consonants without doubles, first three and last three of them; ``''`` for short input."""
    clean = F.regexp_replace(F.upper(col), r"[-&'.,]", "")
    clean = F.translate(clean, "".join(_PLAIN), "".join(_PLAIN.values()))
    clean = F.regexp_replace(clean, r"\s+", "")
    first, rest = F.left(clean, F.lit(1)), F.regexp_replace(clean, "[AEIOU]", "")
    name = F.when(first.rlike("[AEIOU]"), F.concat(first, rest)).otherwise(rest)
    name = F.regexp_replace(name, r"([BCDFGHJ-NP-TV-Z])\1", "$1")
    short = F.when(F.char_length(name) > 6, F.concat(F.left(name, F.lit(3)), F.right(name, F.lit(3)))).otherwise(name)
    return F.when(F.char_length(col) < 2, F.lit("")).otherwise(short)


# Metaphone rules. At each position the first rule that matches gives the code of the
# text it covers; text no rule covers has no code.
METAPHONE_RULES = [
    (r"\A(?=[AEIOU])[AEIOU]", r"\g"),
    (r"(?<=M)B\Z", ""), (r"B", "B"),
    (r"(?<=S)C(?=[EIY])", ""), (r"C(?=IA)", "X"), (r"C(?=[EIY])", "S"), (r"(?<=S)C(?=H)", "K"),
    (r"\AC(?=H[AEIOU])", "K"), (r"C(?=H)", "X"), (r"C", "K"),
    (r"DG[EIY]", "J"), (r"D", "T"),
    (r"G(?=H\Z)", ""), (r"G(?=H[^AEIOU])", ""), (r"(?!\A)G(?=N)", ""), (r"G(?=[EIY])", "J"), (r"G", "K"),
    (r"(?<![CSPTG])H(?=[AEIOU])", "H"),
    (r"[FJLMNR]", r"\g"),
    (r"(?<!C)K", "K"),
    (r"P(?=H)", "F"), (r"P", "P"),
    (r"Q", "K"),
    (r"S(?=H|IO|IA)", "X"), (r"S", "S"),
    (r"T(?=IA|IO)", "X"), (r"T(?=CH)", ""), (r"T(?=H)", "0"), (r"T", "T"),
    (r"V", "F"),
    (r"[WY](?=[AEIOU])", r"\g"),
    (r"X", "KS"),
    (r"Z", "S"),
]
# How a word may start, and what it is read as.
METAPHONE_STARTS = [(r"\A[KGP](?=N)", ""), (r"\AA(?=E)", ""), (r"\AW(?=R)", ""), (r"\AWH", "W"), (r"\AX", "S")]


def _alternation(rules) -> re.Pattern:
    return re.compile("|".join(f"(?P<r{i}>{rule[0]})" for i, rule in enumerate(rules)), re.S)


_METAPHONE = _alternation(METAPHONE_RULES)


def metaphone_of(word: str) -> str:
    text = word.upper()
    if len(text) == 1:
        return text
    for pattern, replacement in METAPHONE_STARTS:
        text, changed = re.subn(pattern, replacement, text)
        if changed:
            break
    codes, i = [], 0
    while i < len(text):
        repeated = i > 0 and text[i] == text[i - 1] and text[i] != "C"
        found = None if repeated else _METAPHONE.match(text, i)
        if found is None:
            i += 1
            continue
        code = METAPHONE_RULES[int(found.lastgroup[1:])][1]
        codes.append(found.group() if code == r"\g" else code)
        i = found.end()
    return "".join(codes)


# Double metaphone rules as (text covered, primary code, alternate code, word condition).
# A condition names facts about the whole word, "!" in front of one means it must not hold.
DOUBLE_METAPHONE_RULES = [
    (r"\A[AEIOUY]", "A", "A", ""),
    (r"BB?", "P", "P", ""),
    ("Ç", "S", "S", ""),
    # C
    (r"CH(?=IA)", "K", "K", ""),
    (r"(?<=[^AEIOUY]A)CH(?![IE])", "K", "K", ""),
    (r"(?<=[BM]A)CH(?=ER)", "K", "K", ""),
    (r"\ACA(?=ESAR)", "S", "S", ""),
    (r"(?!\A)CH(?=AE)", "K", "X", ""),
    (r"\ACH(?=(?:ARAC|ARIS|OR|YM|IA|EM))(?!ORE)", "K", "K", ""),
    (r"CH", "K", "K", "germanic"),
    (r"(?<=OR)CH(?=ES)|(?<=AR)CH(?=IT)|(?<=OR)CH(?=ID)", "K", "K", ""),
    (r"CH(?=[TS])", "K", "K", ""),
    (r"(?:(?<=[AOUE])|\A)CH(?=[LRNMBHFVW ]|\Z)", "K", "K", ""),
    (r"(?!\A)CH", "K", "K", "mc"),
    (r"(?!\A)CH", "X", "K", ""),
    (r"CH", "X", "X", ""),
    (r"(?<!WI)CZ", "S", "X", ""),
    (r"CCI(?=A)", "X", "X", ""),
    (r"(?<=\AA)CC(?!HU)[IEH]|(?<=U)CCE(?=E|S)", "KS", "KS", ""),
    (r"(?<!\AM)CC(?!HU)[IEH]", "X", "X", ""),
    (r"(?<!\AM)CC", "K", "K", ""),
    (r"C[KGQ]", "K", "K", ""),
    (r"CI(?=[OEA])", "S", "X", ""),
    (r"C[IEY]", "S", "S", ""),
    (r"C [CQG]", "K", "K", ""),
    (r"CC(?![EI])", "K", "K", ""),
    (r"C", "K", "K", ""),
    # D
    (r"DG[IEY]", "J", "J", ""),
    (r"DG", "TK", "TK", ""),
    (r"D[TD]?", "T", "T", ""),
    (r"FF?", "F", "F", ""),
    # G before H
    (r"(?!\A)(?<![AEIOUY])GH", "K", "K", ""),
    (r"\AGH(?=I)", "J", "J", ""),
    (r"\AGH", "K", "K", ""),
    (r"(?<=[BHD].)GH|(?<=[BHD]..)GH|(?<=[BH]...)GH", "", "", ""),
    (r"(?<=[CGLRT].U)GH", "F", "F", ""),
    (r"(?<!I)GH", "K", "K", ""),
    (r"GH", "", "", ""),
    # other G
    (r"(?<=\A[AEIOUY])GN", "KN", "N", "!slavic"),
    (r"GN(?!EY)", "N", "KN", "!slavic"),
    (r"GN", "KN", "KN", ""),
    (r"GL(?=I)", "KL", "L", "!slavic"),
    (r"\AG(?:Y|E(?=[SPBLYIR])|I(?=[BLNE]))", "K", "J", ""),
    (r"(?<![EI])(?<![RO](?=GY))G(?:E(?=R)|Y)", "K", "J", "!danger"),
    (r"G(?:[EIY])", "K", "K", "germanic"),
    (r"(?<=[AO])GG(?=I)", "K", "K", "germanic"),
    (r"GE(?=T)", "K", "K", ""),
    (r"GI(?=ER)", "J", "J", ""),
    (r"G[EIY]", "J", "K", ""),
    (r"(?<=[AO])GG(?=I)", "J", "K", ""),
    (r"GG?", "K", "K", ""),
    # H
    (r"(?:\A|(?<=[AEIOUY]))H[AEIOUY]", "H", "H", ""),
    # J
    (r"J(?=OSE)", "H", "H", "four"),
    (r"J", "H", "H", "san"),
    (r"\AJ(?=OSE )", "H", "H", ""),
    (r"J(?=OSE)", "J", "H", ""),
    (r"\AJJ?", "J", "A", ""),
    (r"(?<=[AEIOUY])J(?=[AO])", "J", "H", "!slavic"),
    (r"J\Z", "J", " ", ""),
    (r"(?<![SKL])J(?![LTKSNMBZ])J?", "J", "J", ""),
    (r"JJ?", "", "", ""),
    (r"KK?", "K", "K", ""),
    # L
    (r"(?:(?<=I)LL(?=[OA]\Z)|(?<=A)LL(?=E\Z))", "L", "", ""),
    (r"(?<=A)LL(?=E.*(?:AS|OS|A|O)\Z)", "L", "", ""),
    (r"LL?", "L", "L", ""),
    (r"MM", "M", "M", ""),
    (r"(?<=U)MB(?=\Z|ER)", "M", "M", ""),
    (r"M", "M", "M", ""),
    (r"NN?", "N", "N", ""),
    ("Ñ", "N", "N", ""),
    (r"PH", "F", "F", ""),
    (r"P[PB]?", "P", "P", ""),
    (r"QQ?", "K", "K", ""),
    (r"(?<!ME..)(?<!MA..)(?<=IE)R\Z", "", "R", "!slavic"),
    (r"RR?", "R", "R", ""),
    # S
    (r"(?<=[IY])S(?=L)", "", "", ""),
    (r"\AS(?=UGAR)", "X", "S", ""),
    (r"SH(?=EIM|OEK|OLM|OLZ)", "S", "S", ""),
    (r"SH", "X", "X", ""),
    (r"SI[OA]", "S", "S", "slavic"),
    (r"SI[OA]", "S", "X", ""),
    (r"SZ", "S", "X", ""),
    (r"\AS(?=[MNLW])", "S", "X", ""),
    (r"SCH(?=ER|EN)", "X", "SK", ""),
    (r"SCH(?=OO|UY|ED|EM)", "SK", "SK", ""),
    (r"\ASCH(?![AEIOUYW])", "X", "S", ""),
    (r"SCH", "X", "X", ""),
    (r"SC[IEY]", "S", "S", ""),
    (r"SC.?", "SK", "SK", ""),
    (r"(?<=[AO]I)S\Z", "", "S", ""),
    (r"S[SZ]?", "S", "S", ""),
    # T
    (r"TI(?:O(?=N)|A)|TCH", "X", "X", ""),
    (r"T(?:H|T(?=H))", "T", "T", "germanic"),
    (r"TH(?=OM|AM)", "T", "T", ""),
    (r"T(?:H|T(?=H))", "0", "T", ""),
    (r"T[TD]?", "T", "T", ""),
    (r"VV?", "F", "F", ""),
    # W
    (r"WR", "R", "R", ""),
    (r"\AW(?=[AEIOUY])", "A", "F", ""),
    (r"\AW(?=H)", "A", "A", ""),
    (r"(?<=[AEIOUY])W\Z", "", "F", ""),
    (r"(?<=[EO])W(?=SKI|SKY)", "", "F", ""),
    (r"W", "", "F", "sch"),
    (r"WI[CT]Z", "TS", "FX", ""),
    # X and Z
    (r"\AX", "S", "S", ""),
    (r"(?:(?<=IAU)|(?<=EAU)|(?<=AU)|(?<=OU))X\Z", "", "", ""),
    (r"X[CX]?", "KS", "KS", ""),
    (r"ZH", "J", "J", ""),
    (r"Z(?=Z[OIA])Z", "S", "TS", ""),
    (r"Z(?=Z[OIA]|[^\w\W])", "S", "TS", ""),
    (r"(?!\A)(?<!T)ZZ?", "S", "TS", "slavic"),
    (r"ZZ?", "S", "S", ""),
]
# The word facts used above.
WORD_FACTS = {
    "slavic": re.compile(r"W|K|CZ"),
    "germanic": re.compile(r"\A(?:VAN |VON |SCH)"),
    "sch": re.compile(r"\ASCH"),
    "mc": re.compile(r"\AMC"),
    "danger": re.compile(r"\A[DRM]ANGER"),
    "san": re.compile(r"\ASAN "),
    "four": re.compile(r"\A.{4}\Z", re.S),
}
_SILENT_START = re.compile(r"\A(?:GN|KN|PN|WR|PS)")


@lru_cache(maxsize=128)
def _double_rules(facts: frozenset) -> tuple[list, re.Pattern]:
    kept = [r for r in DOUBLE_METAPHONE_RULES
            if not r[3] or (r[3] in facts if r[3][0] != "!" else r[3][1:] not in facts)]
    return kept, _alternation(kept)


def double_metaphone_of(word: str) -> tuple[str, str]:
    text = word.strip().upper()
    rules, pattern = _double_rules(frozenset(name for name, p in WORD_FACTS.items() if p.search(text)))
    primary, alternate = [], []
    i = 1 if _SILENT_START.match(text) else 0
    while i < len(text):
        found = pattern.match(text, i)
        if found is None:
            i += 1
            continue
        _, first, second, _ = rules[int(found.lastgroup[1:])]
        primary.append(first)
        alternate.append(second)
        i = found.end()
    return "".join(primary), "".join(alternate)


DOUBLE_TYPE = StructType([StructField("primary", StringType()), StructField("alternate", StringType())])


@F.pandas_udf(StringType())
def _metaphone_column(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else metaphone_of(w))


@F.pandas_udf(DOUBLE_TYPE)
def _double_column(words: pd.Series) -> pd.DataFrame:
    codes = [(None, None) if w is None else double_metaphone_of(w) for w in words]
    return pd.DataFrame(codes, columns=["primary", "alternate"])


def metaphone_code(col: Column) -> Column:
    """Uncut metaphone code; a cap is a prefix of it."""
    return _metaphone_column(col)


def double_metaphone_codes(col: Column) -> Column:
    """Uncut primary and alternate codes as a struct."""
    return _double_column(col)


def capped(code: Column, cap: Column) -> Column:
    """At most ``cap`` characters of a code, all of it when the cap is NULL."""
    return F.when(cap.isNull(), code).otherwise(F.left(code, cap))
