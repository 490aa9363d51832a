"""String helpers written as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(col: Column, use: Callable[[Column], Column]) -> Column:
    """``use(col)`` with ``col`` evaluated a single time, also where ``use`` mentions it inside a lambda."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def known(col: Column) -> Column:
    """A string that is never NULL, for computed join keys.

    For a key that may be NULL the optimizer adds a NULL test of its whole expression to the rows the key
    is computed from, and pushes it below the de-duplication, where it runs on every raw row.
    """
    return F.coalesce(col, F.lit(""))


def byte_string(col: Column) -> Column:
    """One character per UTF-8 byte, so built-in string functions count bytes."""
    return known(F.decode(F.encode(col, "UTF-8"), "ISO-8859-1"))


def from_byte_string(col: Column) -> Column:
    """Undo :func:`byte_string`; a cut inside a character becomes U+FFFD instead of an error."""
    return F.make_valid_utf8(F.encode(col, "ISO-8859-1").cast("string"))


def is_ascii(col: Column) -> Column:
    return F.octet_length(col) == F.char_length(col)


def characters(col: Column) -> Column:
    """Code points of a string as an array; the empty string has none."""
    return F.filter(F.split(col, ""), lambda c: c != "")


# Letters from rare to frequent; the order of tokens only affects speed.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"


def rare_first(chars: Column) -> Column:
    """Characters in one fixed order, rare ones first."""
    ranked = F.transform(chars, lambda c: F.struct(F.instr(F.lit(RARE_FIRST), F.lower(c)).alias("rank"), c.alias("c")))
    return F.array_sort(ranked)["c"]


def occurrence_tokens(col: Column) -> Column:
    """Characters numbered by occurrence (``b1 a1 a2``), so a multiset can be handled as a set."""
    return once(rare_first(characters(col)), lambda chars: F.transform(
        chars,
        # in a sorted array the distance to the first equal item is the occurrence number
        lambda c, i: F.concat(c, (i + 2 - F.array_position(chars, c)).cast("string")),
    ))


def position_tokens(col: Column) -> Column:
    """Characters tagged with their position (``0:K 1:A``)."""
    return F.transform(characters(col), lambda c, i: F.concat(i.cast("string"), F.lit(":"), c))


def index_combinations(count: Column, size: Column) -> Column:
    """All ascending combinations of ``size`` positions below ``count``, as arrays."""
    start = F.expr("array(cast(array() as array<int>))")
    positions = F.filter(F.sequence(F.lit(0), count), lambda i: i < count)
    grown = F.aggregate(
        positions, start,
        lambda acc, i: F.concat(
            acc, F.transform(F.filter(acc, lambda a: F.size(a) < size), lambda a: F.concat(a, F.array(i)))),
    )
    return F.filter(grown, lambda a: F.size(a) == size)


def substrings(col: Column, size: Column) -> Column:
    """All substrings of the given length, left to right."""
    return once(col, lambda text: F.transform(
        F.filter(F.sequence(F.lit(0), F.char_length(text)), lambda i: i + size <= F.char_length(text)),
        lambda i: F.substring(text, i + 1, size)))


BITMAP_WORDS = 4


def _bitmap(bits: Column) -> Column:
    def word(found: Column, w: int) -> Column:
        mine = F.filter(found, lambda b: F.floor(b / 64) == w)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), b % 64)))

    return once(bits, lambda found: F.struct(*[word(found, w).alias(f"word{w}") for w in range(BITMAP_WORDS)]))


def _bit(*token: Column) -> Column:
    return F.pmod(F.xxhash64(*token), F.lit(64 * BITMAP_WORDS)).cast("int")


def letter_bitmap(col: Column) -> Column:
    """Four 64-bit words with a bit for the n-th occurrence of each character.

    Each bit that only one of two bitmaps has stands for a character that only that string has at that count. So the
    bits of one without those of the other never number more than the edits between the strings, swaps not counted,
    wherever two characters share a bit. ``col`` is used several times and should be a plain column.
    """
    return _bitmap(F.flatten(F.transform(F.array_distinct(characters(col)), lambda c: F.transform(
        F.sequence(F.lit(1), F.char_length(col) - F.char_length(F.replace(col, c, F.lit("")))),
        lambda n: _bit(c, n)))))


def token_bitmap(tokens: Column) -> Column:
    """The same for a set of tokens: bits that one of two bitmaps lacks never number more than the tokens it lacks."""
    return _bitmap(F.transform(tokens, lambda token: _bit(token)))


def quoted(col: Column) -> Column:
    """A string as a JSON string literal."""
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.char_length(wrapped) - 2)
