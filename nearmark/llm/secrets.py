"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

The guess cost of a value is the least sum, over all ways to cut it into segments, of the logarithm of the guesses
each segment takes: a known word, a date, a repeat, a keyboard walk or sequence, or brute force. A value after a
credential key is reported if its cost reaches a threshold, so that ``pwd = Password1!`` or ``pin: 12345678`` is
told from a random string. Such a value is costed and reported whole, also where a fixed pattern has matched a part of
it; only a value that lies wholly inside a span of a fixed pattern adds nothing.

Defined results: null and empty texts have no spans; spans are in code points, end exclusive, ordered by start, then
by kind as in ``KINDS``; repeated rows get the same spans; texts are scanned whole; an input column that has the name
of the result column is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
MIN_LOG10 = 9.0

SPANS = "array<struct<start:bigint,kind:int,end:bigint,log10_guesses:double>>"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the same as runs of any length of which those under 24 are dropped
_CONTEXT = re.compile(
    r"""(?<![^\W_])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|private|auth)[_-]?key)["']?"""
    r"""[\x20\t]{0,8}(?:[:=]|(\bis\b))[\x20\t]{0,8}(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\x20\x09-\x0D]{6,}))""",
    re.IGNORECASE)
# What closes a sentence or a bracket around an unquoted value, and is not taken for a part of it.
_CLOSING = "\"'.,;:!?)]}>"
# A word of prose, of any language: letters with inner hyphens or apostrophes.
_PROSE = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_CONTEXT_KEYS = ("pass", "pwd", "secret", "token", "credential", "key")

# Frequent password words, most frequent first.
WORDS = (
    "password the qwerty admin welcome login letmein monkey dragon master love secret iloveyou princess sunshine "
    "shadow football baseball superman batman trustno summer winter spring autumn hello freedom whatever access "
    "ninja mustang michael jordan hunter charlie thomas george robert daniel computer internet service server "
    "database root user guest test demo change default temp pass word key token api private public system manager "
    "office company secure security home money happy family friend flower orange purple silver golden diamond "
    "cookie chocolate ginger pepper buster tigger soccer hockey killer maggie jessica ashley nicole "
    "and for with from this that your have not you are was"
).split()
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LONGEST = max(map(len, WORDS))
# Usual replacements of letters.
_PLAIN = str.maketrans("@4301!5$7", "aaeoiisst")
# Rows of the usual keyboard, and the sequences of letters and digits.
_WALKS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "abcdefghijklmnopqrstuvwxyz", "qazwsxedc", "0123456789")


@lru_cache(maxsize=1)
def _next_on_walk() -> frozenset[str]:
    pairs = {a + b for w in _WALKS for a, b in zip(w, w[1:], strict=False)}
    return frozenset(pairs | {p[::-1] for p in pairs})


def _alphabet(value: str) -> int:
    size = 0
    for test, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += n * any(map(test, value))
    return max(10, size + 33 * any(not c.isalnum() for c in value))


def _date_cost(s: str) -> float | None:
    """Six or eight digits, or parts parted by one character: day, month and year in a usual order."""
    parts = re.split(r"[-/._]", s)
    if len(parts) == 3 and all(p.isdigit() for p in parts):
        digits = [(int(p), len(p)) for p in parts]
    elif s.isascii() and s.isdigit() and len(s) in (6, 8):
        y = len(s) - 4
        digits = [(int(s[:y]), y), (int(s[y:y + 2]), 2), (int(s[y + 2:]), 2)]
        other = [(int(s[:2]), 2), (int(s[2:4]), 2), (int(s[4:]), y)]
        if not _is_date(digits):
            digits = other
    elif s.isascii() and s.isdigit() and len(s) == 4 and 1900 <= int(s) <= 2050:
        return math.log10(150)
    else:
        return None
    return math.log10(365 * 150) if _is_date(digits) else None


def _is_date(parts: list[tuple[int, int]]) -> bool:
    years = [i for i in (0, 2) if parts[i][1] in (2, 4) and (parts[i][1] == 2 or 1900 <= parts[i][0] <= 2050)]
    for i in years:
        a, b = parts[1][0], parts[2 - i][0]
        if 1 <= min(a, b) <= 12 and 1 <= max(a, b) <= 31:
            return True
    return False


def log10_guesses(value: str) -> float:
    """Least cost over all segmentations, by dynamic programming over end positions.

    Linear in the length: words and dates have a greatest length, and a repeat or walk that ends at a position is one
    maximal run whose best start is among its beginnings so far.
    """
    n = len(value)
    lower, plain = value.lower(), value.lower().translate(_PLAIN)
    if len(lower) != n or len(plain) != n:  # rare letters change length when lowered
        lower = plain = value
    brute = math.log10(_alphabet(value))
    best = [0.0] + [math.inf] * n
    walk = repeat = 0  # where the present walk and repeat began
    for end in range(1, n + 1):
        cost = best[end - 1] + brute
        if end > 1 and lower[end - 2:end] not in _next_on_walk():
            walk = end - 1
        if end > 1 and value[end - 1] != value[end - 2]:
            repeat = end - 1
        if end - walk >= 3:
            cost = min(cost, best[walk] + math.log10(50 * (end - walk)) + 0.3)
        if end - repeat >= 3:
            cost = min(cost, best[repeat] + brute + math.log10(end - repeat) + 0.3)
        for start in range(max(0, end - _LONGEST), end - 2):
            rank = _RANK.get(lower[start:end]) or _RANK.get(plain[start:end], 0) * 4
            if rank:
                upper = sum(c.isupper() for c in value[start:end])
                forms = 1 if not upper else 2 if upper in (1, end - start) else math.comb(end - start, upper)
                cost = min(cost, best[start] + math.log10(rank * forms + 1) + 0.3)
        for start in range(max(0, end - 10), end - 3):
            dated = _date_cost(value[start:end])
            if dated is not None:
                cost = min(cost, best[start] + dated + 0.3)
        best[end] = cost
    return best[n]


def is_prose(value: str) -> bool:
    """Whether a value is written like words of a text: only letters, without case in the middle of a word.

    "the token is available" names no secret, and neither does a quoted sentence; a random string of this length has digits,
    signs or capitals among its letters, but for about one in 300 of eight letters and more that are lower case throughout.
    """
    words = re.split(r"[\x20,;.:!?()]+", value.strip(_CLOSING))
    return all(_PROSE.fullmatch(w) and (w.islower() or w.istitle() or w.isupper()) for w in words if w)


def spans(text: str, min_log10: float = MIN_LOG10) -> list[tuple[int, int, int, float | None]]:
    """``(start, kind, end, log10 of guesses)`` of one text; the cost is null for the fixed patterns."""
    found: list[tuple[int, int, int, float | None]] = []
    low = text.lower()  # only to rule patterns out: it holds every ASCII key in lower case
    if any(k in low for k in _ASSIGN_KEYS):
        found += [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), None) for m in _HEX.finditer(text)]
    if any(k in low for k in _CONTEXT_KEYS):
        taken = [(s, e) for s, _, e, _ in found]
        for m in _CONTEXT.finditer(text):
            start, end = m.span(m.lastindex)
            if m.lastindex == 4:
                end = start + len(text[start:end].rstrip(_CLOSING))
            if end - start < 6 or any(s <= start and end <= e for s, e in taken) or is_prose(text[start:end]):
                continue
            cost = log10_guesses(text[start:end])
            if cost >= min_log10:
                found.append((start, 3, end, cost))
    return sorted(found, key=lambda x: x[:2])


def scan(df: DataFrame, text: str = "text", out: str = "secrets", min_log10: float = MIN_LOG10) -> DataFrame:
    """Add the spans of each text; all other columns pass through."""
    rest = df.drop(out)
    # An unnamed text column is found by position, so that names may clash in case or hold dots.
    at = rest.columns.index(text)
    names = [f"c{i}" for i in range(len(rest.columns))]
    renamed = rest.toDF(*names)
    schema = StructType([*renamed.schema.fields])
    element = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("log10_guesses", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [dict(zip(("start", "kind", "end", "log10_guesses"), s, strict=True)) for s in spans(t.as_py() or "", min_log10)]
                for t in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(element))], [*names, "found"])

    from pyspark.sql.types import _parse_datatype_string

    schema = schema.add("found", _parse_datatype_string(SPANS))
    return renamed.mapInArrow(run, schema).toDF(*rest.columns, out)


def joined(found: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def of_kind(found: Column, *kinds: str) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*[KINDS.index(k) for k in kinds]))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", min_log10: float = MIN_LOG10) -> DataFrame:
    """Replace every found span, overlapping spans as one, by a mark. Rows, columns and null texts stay."""
    held = df.select("*")
    scanned = scan(held, text, "_secrets", min_log10)
    body = F.col(text)
    done = F.aggregate(
        "_secrets",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                acc["out"], F.substring(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).alias("out")))
    rest = F.concat(done["out"], F.substring(body, (done["at"] + 1).cast("int"), F.char_length(body)))
    return scanned.withColumn(text, F.when(F.size("_secrets") > 0, rest).otherwise(body)).drop("_secrets")
