"""IP addresses and networks as strings of bits, so that "in the network" is a prefix test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearmark.functions.text import once

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"
# Fixed value: characters of the longest way to write an address.
_V6_SIZE = 45
_GROUP = r"[0-9A-Fa-f]{1,4}"
_V6 = rf"^(?:{_GROUP}(?::{_GROUP}){{7}}|(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?)\z"


def v4_bits(col: Column) -> Column:
    octets = F.transform(F.split(col, r"\."), lambda o: F.lpad(F.bin(o.cast("bigint")), 8, "0"))
    return F.when(col.rlike(_V4), F.array_join(octets, ""))


def v6_bits(col: Column) -> Column:
    """128 bits of an address, of which one run of zero groups may be left out and the last two may be an IPv4 address."""
    # a zone is not part of an address
    text = F.when((F.char_length(col) <= _V6_SIZE) & col.rlike(r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\z"), col)
    tail = F.substring_index(text, ":", -1)
    dotted = v4_bits(tail)
    as_groups = F.concat(F.left(text, F.char_length(text) - F.char_length(tail)),
                         F.conv(F.left(dotted, F.lit(16)), 2, 16), F.lit(":"), F.conv(F.right(dotted, F.lit(16)), 2, 16))
    plain = F.when(F.contains(text, F.lit(".")), as_groups).otherwise(text)

    def bits(groups: Column) -> Column:
        return F.when(F.size(groups) == 8, once(
            F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""),
            lambda digits: F.concat(*[F.lpad(F.conv(half(digits, F.lit(16)), 16, 2), 64, "0") for half in (F.left, F.right)])))

    return once(F.when(plain.rlike(_V6), F.split(once(plain, _written_out), ":")), bits)


def _written_out(text: Column) -> Column:
    """A text with its run of zero groups as groups; a run stands for one group at least."""
    start, end = F.startswith(text, F.lit("::")), F.endswith(text, F.lit("::"))
    # a run at an end is brought inside, then there are as many groups as colons
    inner = F.concat(F.when(start, F.lit("0")).otherwise(F.lit("")), text, F.when(end, F.lit("0")).otherwise(F.lit("")))
    missing = 8 - F.char_length(F.regexp_replace(text, "[^:]", ""))
    run = F.when((missing >= 1) | start | end, F.concat(F.lit(":"), F.repeat(F.lit("0:"), missing)))
    return F.when(F.contains(text, F.lit("::")), F.replace(inner, F.lit("::"), run)).otherwise(text)


def address_bits(col: Column) -> Column:
    """32 or 128 bits of an address, NULL for anything that is not one."""
    return F.coalesce(v4_bits(col), v6_bits(col))


def cidr_bits(col: Column) -> Column:
    """The fixed leading bits of a network as ``struct<width, bits>``, NULL when it is not valid."""
    halves = F.split(col, "/")
    bits = address_bits(F.try_element_at(halves, F.lit(1)))
    prefix = F.try_element_at(halves, F.lit(2))
    size = F.when(prefix.rlike(r"^[0-9]{1,3}\z"), prefix.cast("int"))
    valid = (F.size(halves) == 2) & (size <= F.char_length(bits))
    return F.when(
        valid, F.struct(F.char_length(bits).alias("width"), F.left(bits, size).alias("bits"))
    )
