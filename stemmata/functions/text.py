"""Normalising and tokenising text.

``normalise`` is Unicode NFKD, lower case, combining marks dropped. Spark has no NFKD, so it runs as an
Arrow function; everything that does not need it stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def _marks() -> str:
    """Character class of all combining characters, written as ranges."""
    points = [i for i in range(0x300, 0x110000) if unicodedata.combining(chr(i))]
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]+"


MARKS = re.compile(_marks())
TOKEN = re.compile(r"\w+")
#: the same tokens on the JVM, where \w alone would be ASCII
TOKEN_JVM = r"[\p{L}\p{N}_]+"
SPACE_JVM = r"(?U)\s+"


def normalise(text: str) -> str:
    if text.isascii():
        return text.lower()
    return MARKS.sub("", unicodedata.normalize("NFKD", text).lower())


def tokens(text: str) -> list[str]:
    """Maximal runs of letters, digits and underscores of the normalised text."""
    return TOKEN.findall(normalise(text))


@pandas_udf(StringType())
def normalise_col(text: pd.Series) -> pd.Series:
    return text.map(normalise, na_action="ignore")


def raw_tokens(text: Column) -> Column:
    """Word tokens as stored, not normalised; null text gives null."""
    return F.regexp_extract_all(text, F.lit(TOKEN_JVM), F.lit(0))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return text.isNull() | ~text.rlike(r"(?U)\S")


def words(text: Column) -> Column:
    """Words split at white space; blank and null text give an empty array."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_JVM))
