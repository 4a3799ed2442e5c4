"""Word similarity and the small parsers of references and ranges, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemmata.config import STEP


def ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / summed length; two empty words are equal. Null words give null."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / total)


def word_match(a: Column, b: Column, fuzz: float) -> Column:
    """Equal, or close enough. The length test comes first and decides alone, as it can refuse a pair that the ratio would just admit."""
    la, lb = F.char_length(a), F.char_length(b)
    far = F.abs(la - lb).cast("double") / (la + lb) > F.lit(1.0) - F.lit(fuzz)
    return F.when(a == b, True).when(far, False).otherwise(ratio(a, b) >= F.lit(fuzz))


def bridge_fuzz(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100.0


def parse_range(rng: Column) -> Column:
    """'12–34' or '12-34' as struct<lo, hi>; anything else is null."""
    pattern = r"^\s*(\d+)\s*[–-]\s*(\d+)\s*$"
    found = F.struct(F.regexp_extract(rng, pattern, 1).cast("int").alias("lo"), F.regexp_extract(rng, pattern, 2).cast("int").alias("hi"))
    return F.when(rng.rlike(pattern), found)


def overlap_ratio(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """The part of range a, ends included, that lies in b."""
    shared = F.greatest(F.lit(0), F.least(a_hi, b_hi) - F.greatest(a_lo, b_lo) + 1)
    return shared.cast("double") / (a_hi - a_lo + 1)


def ref_prefix(ref: Column) -> Column:
    """The page of a reference: what stands before its first '#'."""
    return F.substring_index(ref, "#", 1)


def abs_span(ref: Column, lo: Column, hi: Column) -> Column:
    """struct<unit, lo, hi>: a window-local range in words of the whole unit; a reference without a window is its first."""
    pattern = r"^(.*)#(\d+)$"
    windowed = ref.rlike(pattern)
    base = (F.when(windowed, F.regexp_extract(ref, pattern, 2).cast("int")).otherwise(1) - 1) * STEP
    return F.struct(F.when(windowed, F.regexp_extract(ref, pattern, 1)).otherwise(ref).alias("unit"), (base + lo).alias("lo"), (base + hi).alias("hi"))


def gap_words(lo: Column, hi: Column, count: Column) -> Column:
    """Words inside a range that matched nothing; null where the count is."""
    return F.when(count.isNotNull(), F.greatest(F.lit(0), hi - lo + 1 - count))


def clip(text: Column, limit: int) -> Column:
    """Cut at a word's end with ' …', bars as slashes; a first word longer than the limit stays whole."""
    t = F.translate(F.array_join(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), " "), "|", "/")
    head = F.substring(t, 1, limit)
    by_space = F.regexp_extract(head, r"(?s)^(.+) [^ ]*$", 1)
    rest = F.locate(" ", t, limit + 1)
    long_first = F.when(rest == 0, t).otherwise(F.concat(F.rtrim(F.substring(t, F.lit(1), rest - 1)), F.lit(" …")))
    return F.when(F.char_length(t) <= limit, t).when(by_space != "", F.concat(F.rtrim(by_space), F.lit(" …"))).otherwise(long_first)


def gloss_tags(raw: Column) -> Column:
    """A stringified list or a comma list as an array; '', 'nan' and null are empty. Nothing is evaluated."""
    bare = F.regexp_replace(F.trim(raw), r"^[\[\]'\" ]+|[\[\]'\" ]+$", "")
    parts = F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.when(raw.isNull() | F.trim(raw).isin("", "nan"), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda x: x != ""))


def format_record(columns: dict[str, Column]) -> Column:
    """One line for a reader: identifier, works with references, chain, score, snippets."""
    c = columns
    return F.format_string("%s | %s %s ↔ %s %s | chain %d, score %.4f | %s ↔ %s", c["rel_id"], c["work_i"], c["ref_i"], c["work_j"], c["ref_j"], c["chain_len"], c["score"], clip(c["snippet_i"], 120), clip(c["snippet_j"], 120))
