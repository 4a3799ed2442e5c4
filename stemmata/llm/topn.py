"""The best N items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, which must end in a unique column for a stable result.

    row_number with a rank filter: the optimiser turns it into a group limit before the shuffle and another
    after it, so a task passes on at most n rows of a group however large it is. Null group values form
    a group of their own; groups smaller than n come whole; repeated rows count each; an empty table gives an empty table. ``rank`` keeps the rank
    under that name.
    """
    name = rank or "__top_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def era(name: str) -> Column:
    """An era trimmed and lower-cased; null and empty are 'unknown'."""
    clean = F.lower(F.trim(F.col(name)))
    return F.when(clean.isNull() | (clean == ""), F.lit("unknown")).otherwise(clean)


def number_or_null(name: str) -> Column:
    """A score with NaN as null, so that both sort last."""
    return F.when(~F.isnan(name), F.col(name))


def longest_by_era_pair(records: DataFrame, n: int = 20) -> DataFrame:
    """(era_a, era_b, match_id, rank): for each unordered pair of eras the ``n`` records with the longest chain.

    Ties go by score descending (null and NaN last), then match_id ascending. Records without a chain length are left out.
    """
    a, b = era("era_i"), era("era_j")
    rows = records.filter(F.col("chain_len").isNotNull()).select(F.least(a, b).alias("era_a"), F.greatest(a, b).alias("era_b"), "match_id", "chain_len", number_or_null("score").alias("score"))
    order = [F.col("chain_len").desc(), F.col("score").desc_nulls_last(), F.col("match_id").asc()]
    return top_n(rows, ["era_a", "era_b"], order, n, "rank").select("era_a", "era_b", "match_id", "rank")
