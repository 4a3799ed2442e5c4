"""Cleaning of segment texts, in the order that the comparison expects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.functions.text import SPACE_JVM, TOKEN_JVM

# Lines of modern headers, mark-up, critical apparatus, stock phrases, milestones.
HEADER_LINE = r"Gregory R\. Crane|Editor-in-Chief, Perseus|Creative Commons|Attribution-ShareAlike|University of Leipzig|urn:cts:|This work is licensed|Digital Library|National Endowment"
TAG = r"</?[a-zA-Z][^<>]*>"
_IN, _ON = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
APPARATUS = rf"{_IN}om\.|\(\p{{Nd}}+\)\s*[a-z]:\s*om\.|{_IN}\p{{Nd}}+[a-z]{_ON}|{_IN}[cq]\p{{Nd}}+{_ON}"
STOCK_PHRASES = ("δὲ τὰ ἑξῆς", "τοῦτο δὲ ταὐτὸν ἐστι τῷ", "ἐν δὲ τῇ λέξει τῇ", "ἐν δὲ τῇ λεξεί τῇ")
MILESTONE = r"[\(\[][0-9]+[\)\]]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
GREEK = r"[Ͱ-Ͽἀ-῿]"


def squeeze(text: Column) -> Column:
    """White space runs as one space, none outside."""
    return F.trim(F.regexp_replace(text, SPACE_JVM, " "))


def strip_milestones(text: Column) -> Column:
    """Bracketed numbers vanish, so their neighbours touch; then white space is squeezed."""
    return squeeze(F.regexp_replace(text, MILESTONE, ""))


def clean(text: Column) -> Column:
    """Header lines, tags, apparatus, stock phrases and milestones out, white space squeezed. Null gives ''."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: ~x.rlike(HEADER_LINE))
    out = F.array_join(lines, " ")
    for pattern in (TAG, APPARATUS, "|".join(STOCK_PHRASES)):
        out = F.regexp_replace(out, pattern, " ")
    return strip_milestones(out)


def is_greek(text: Column, share: float = 0.5) -> Column:
    """Whether at least ``share`` of the tokens hold a Greek letter; a text without tokens is not Greek."""
    tokens = F.regexp_extract_all(F.regexp_replace(text, MILESTONE, " "), F.lit(TOKEN_JVM), F.lit(0))
    return F.coalesce(F.size(F.filter(tokens, lambda t: t.rlike(GREEK))) / F.nullif(F.size(tokens), F.lit(0)) >= F.lit(share), F.lit(False))


def _without_apparatus(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"{_IN}\p{{Nd}}+{_ON}", " "), rf"{_IN}[A-Za-z]+{_ON}", " ")


def strip_apparatus(text: Column) -> Column:
    """Bare numbers and purely Latin words out of Greek texts; other texts stay."""
    return F.when(is_greek(text), _without_apparatus(text)).otherwise(text)


def clean_text(text: Column, apparatus: bool = True) -> Column:
    cleaned = clean(text)
    return squeeze(strip_apparatus(cleaned)) if apparatus else cleaned


def with_clean_text(rows: DataFrame, apparatus: bool = True) -> DataFrame:
    """Rows with ``text`` cleaned as ``clean_text`` does, the steps behind one another: a generator between them keeps the optimiser from working out the same step for each place that reads it."""
    others = [c for c in rows.columns if c != "text"]
    cleaned = rows.select(*others, F.explode(F.array(clean(F.col("text")))).alias("text"))
    if not apparatus:
        return cleaned
    tokens = F.regexp_extract_all(F.regexp_replace("text", MILESTONE, " "), F.lit(TOKEN_JVM), F.lit(0))
    told = cleaned.select(*others, "text", F.explode(F.array(tokens)).alias("__tokens"))
    greek = F.coalesce(F.size(F.filter("__tokens", lambda t: t.rlike(GREEK))) / F.nullif(F.size("__tokens"), F.lit(0)) >= F.lit(0.5), F.lit(False))
    told = told.select(*others, "text", F.explode(F.array(greek)).alias("__greek"))
    return told.select(*others, squeeze(F.when(F.col("__greek"), _without_apparatus(F.col("text"))).otherwise(F.col("text"))).alias("text"))
