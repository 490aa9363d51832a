"""ASCII and Unicode forms of internationalised names, for Arrow batches of strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters the name mapping keeps although case folding would replace them, and the
# invisible characters it drops.
_KEPT = "ßς‌‍"
_DROPPED = dict.fromkeys([0x00AD, 0x200B, 0x2060, 0xFEFF, *range(0xFE00, 0xFE10)])
_ACE = "xn--"


def _mapped(text: str) -> str:
    folded = "".join(c if c in _KEPT else unicodedata.normalize("NFKC", c).casefold() for c in text)
    folded = folded.translate(_DROPPED)
    return unicodedata.normalize("NFC", folded).replace("。", ".")


def _valid(label: str) -> bool:
    if label and unicodedata.category(label[0]).startswith("M"):
        return False
    return all(c in _KEPT or unicodedata.category(c)[0] not in "CZ" for c in label)


def _label_to_unicode(label: str) -> str | None:
    if not label.startswith(_ACE):
        return label if _valid(label) else None
    try:
        decoded = label[len(_ACE):].encode("ascii").decode("punycode")
    except UnicodeError:
        return None
    return decoded if not decoded.isascii() and _valid(decoded) and _mapped(decoded) == decoded else None


def _name_to_unicode(name: str) -> str | None:
    labels = [_label_to_unicode(label) for label in _mapped(name).split(".")]
    return None if None in labels else ".".join(labels)


def encode(text: str) -> str | None:
    """ASCII form of a non-ASCII text: per label for a dotted name, as one label otherwise."""
    if "." not in text:
        return _ACE + text.encode("punycode").decode("ascii")
    name = _name_to_unicode(text)
    if name is None:
        return None
    return ".".join(
        label if label.isascii() else _ACE + label.encode("punycode").decode("ascii") for label in name.split(".")
    )


def decode(text: str) -> str | None:
    """Unicode form of a text that has the ASCII prefix; ``None`` when it cannot be decoded."""
    if "." in text:
        return _name_to_unicode(text)
    try:
        return text.replace(_ACE, "").encode("ascii").decode("punycode")
    except UnicodeError:
        return None


@F.pandas_udf(StringType())
def _encode_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else encode(t))


@F.pandas_udf(StringType())
def _decode_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else decode(t))


def has_ace_prefix(col: Column) -> Column:
    """Anywhere in a dotted name, at the start of a single label."""
    return F.when(col.contains("."), col.contains(_ACE)).otherwise(col.startswith(_ACE))


def ascii_form(col: Column) -> Column:
    return _encode_column(col)


def unicode_form(col: Column) -> Column:
    return _decode_column(col)
