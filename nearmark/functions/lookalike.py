"""Look-alike skeletons: two strings that look the same have the same skeleton."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from nearmark.functions.text import is_ascii

# Characters and the text they look like, from the public Unicode confusables list.
# The list has thousands of entries; compatibility characters (mathematical letters, full-width
# forms) need none because normalisation resolves them. Coverage is partial.
_ASCII = {"0": "O", "1": "l", "I": "l", "|": "l", "m": "rn", "`": "'"}
_OTHER = {
    "℮": "e", "೦": "o", "౦": "o", "൦": "o", "०": "o", "௦": "o",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x",
    "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "ԛ": "q", "ԝ": "w", "ѵ": "v", "г": "r",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "l",
    "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "Х": "X", "Ү": "Y", "Ӏ": "l",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "l",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u",
    "օ": "o", "ց": "g", "հ": "h", "զ": "q",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "‘": "'", "’": "'", "ʼ": "'", "․": ".", "⁄": "/", "∕": "/",
}
_TABLE = str.maketrans({**_ASCII, **_OTHER})


def skeleton_of(text: str) -> str:
    # mapping first: compatibility normalisation would turn some listed characters into others
    folded = unicodedata.normalize("NFKD", text.translate(str.maketrans(_OTHER)))
    return unicodedata.normalize("NFD", folded.translate(_TABLE))


@F.pandas_udf(StringType())
def _skeleton_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else skeleton_of(t))


def ascii_skeleton(col: Column) -> Column:
    """Skeleton of an ASCII string, without leaving the JVM."""
    singles = {k: v for k, v in _ASCII.items() if len(v) == 1}
    out = F.translate(col, "".join(singles), "".join(singles.values()))
    for char, text in _ASCII.items():
        if len(text) > 1:
            out = F.replace(out, F.lit(char), F.lit(text))
    return out


def skeleton(col: Column) -> Column:
    other = _skeleton_column(F.when(~is_ascii(col), col))
    return F.coalesce(other, ascii_skeleton(col))
