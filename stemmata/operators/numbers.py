"""The reported counts, each one aggregate over the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.config import COMMONPLACE, CONTROL_ERA, ERA_RANK, OTHER_ERA
from stemmata.operators.packages import base


def _control() -> Column:
    is_ = lambda s: F.coalesce(F.col(f"era_{s}") == CONTROL_ERA, F.lit(False))
    return is_("i") | is_("j")


def _same_author() -> Column:
    """Unknown authors count as one name, as a lookup with '' as default has it."""
    return F.coalesce("author_i", F.lit("")) == F.coalesce("author_j", F.lit(""))


def names_of_works(records: DataFrame, order: str = "match_id") -> DataFrame:
    """(work_id, author, title): of each work the last author and title that a record gives, in the order of the records, in each record i before j; null and empty ones do not count.

    A work that has only empty ones has none. Combined map-side, so a work that stands in most records is no hot key.
    """
    side = lambda s, at: F.struct(F.col(f"work_{s}").alias("work_id"), F.col(f"author_{s}").alias("author"), F.col(f"title_{s}").alias("title"), F.struct(F.col(order).alias("o"), F.lit(at).alias("s")).alias("at"))
    rows = records.select(F.explode(F.array(side("i", 0), side("j", 1))).alias("x")).select("x.*")
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("at"))).alias(c)
    return rows.filter(F.col("work_id").isNotNull()).groupBy("work_id").agg(last("author"), last("title"))


def with_authors(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records with author and title by work from ``known`` (work_id, author, title), as ``names_of_works`` gives them; unknown works give null."""
    side = lambda s: known.select(F.col("work_id").alias(f"work_{s}"), F.col("author").alias(f"author_{s}"), F.col("title").alias(f"title_{s}"))
    bare = records.drop("author_i", "author_j", "title_i", "title_j")
    return bare.join(side("i"), "work_i", "left").join(side("j"), "work_j", "left")


def partition(records: DataFrame) -> DataFrame:
    """(part, n): control pairs first, then same author, then different authors."""
    part = F.when(_control(), "control").when(_same_author(), "same_author").otherwise("diff_author")
    return records.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def tag_analysis(records: DataFrame) -> DataFrame:
    """One row: tagged and clean records by same and different author, with percentages, null where nothing is to divide by."""
    tagged = F.coalesce(F.col("tag") == COMMONPLACE, F.lit(False))
    same, diff = ~_control() & _same_author(), ~_control() & ~_same_author()
    n = records.agg(F.count_if(same).alias("same"), F.count_if(diff).alias("diff"), F.count_if(tagged & _same_author()).alias("tagged_same"), F.count_if(tagged & ~_same_author()).alias("tagged_diff"))
    share = lambda a, b: F.when(b > 0, 100.0 * a / b)
    total = F.col("tagged_same") + F.col("tagged_diff")
    return n.select(
        total.alias("tagged"), "tagged_same", "tagged_diff", (F.col("same") - F.col("tagged_same")).alias("clean_same"), (F.col("diff") - F.col("tagged_diff")).alias("clean_diff"),
        share(total, F.col("same") + F.col("diff")).alias("pct_all"), share(F.col("tagged_diff"), F.col("diff")).alias("pct_diff"),
    )


def era_base(records: DataFrame) -> DataFrame:
    """(era, n): base records between the control era and each of the three later ones."""
    rows = base(records).filter(_control())
    other = F.when(F.col("era_i") == CONTROL_ERA, F.col("era_j")).otherwise(F.col("era_i"))
    return rows.groupBy(other.alias("era")).agg(F.count("*").alias("n")).filter(F.col("era").isin([e for e in ERA_RANK if e != CONTROL_ERA]))


def chain_distribution(records: DataFrame, least: int = 6) -> DataFrame:
    """One row (total, below, above, pct_below) of different-author records without a control side; a null chain counts as 0."""
    rows = records.filter(~_control() & ~_same_author())
    chain = F.coalesce("chain_len", F.lit(0))
    n = rows.agg(F.count("*").alias("total"), F.count_if(chain < least).alias("below"), F.count_if(chain >= least).alias("above"))
    return n.withColumn("pct_below", F.when(F.col("total") > 0, 100.0 * F.col("below") / F.col("total")))


def rank_of(era: Column) -> Column:
    out = F.lit(OTHER_ERA)
    for name, r in ERA_RANK.items():
        out = F.when(era == name, r).otherwise(out)
    return out


def era_ordered(records: DataFrame) -> DataFrame:
    """Records with era_first and era_second, the earlier era first; equal ranks stay as they are."""
    i, j = F.coalesce("era_i", F.lit("")), F.coalesce("era_j", F.lit(""))
    swap = rank_of(i) > rank_of(j)
    return records.withColumn("era_first", F.when(swap, j).otherwise(i)).withColumn("era_second", F.when(swap, i).otherwise(j))


def era_pair_top(records: DataFrame, least_chain: int = 6, n: int = 10) -> DataFrame:
    """Of each ordered era pair the n cross-author records with the longest chains, with ``rank``."""
    rows = era_ordered(records.filter((F.col("chain_len") >= max(1, least_chain)) & ~_same_author()))
    w = Window.partitionBy("era_first", "era_second").orderBy(F.col("chain_len").desc(), "match_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def leaders(records: DataFrame) -> DataFrame:
    """(kind, match_id, value): the first record by chain, by matched words, by score; the least match_id among equals."""
    kinds = ("chain_len", "matched_words", "score")
    value = lambda k: F.when(~F.isnan(k), F.col(k)) if k == "score" else F.col(k)
    aggs = [F.struct(F.lit(k).alias("kind"), F.max_by("match_id", F.when(value(k).isNotNull(), F.struct(value(k), -F.col("match_id")))).alias("match_id"), F.max(value(k)).cast("double").alias("value")).alias(k) for k in kinds]
    spread = records.agg(*aggs).select(F.explode(F.array(*kinds)).alias("x")).select("x.*")  # one pass for all three
    return spread.filter(F.col("match_id").isNotNull())


def report_split(records: DataFrame, least_chain: int = 6) -> DataFrame:
    """(relation, n, longest): records above the report's threshold, cross-author and intra-author."""
    rows = records.filter(F.col("chain_len") >= max(1, least_chain))
    return rows.groupBy(F.when(_same_author(), "intra").otherwise("cross").alias("relation")).agg(F.count("*").alias("n"), F.max("chain_len").alias("longest"))
