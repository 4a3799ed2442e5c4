"""Records that describe one passage: overlapping windows give the same parallel several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions.similarity import abs_span

PLACE = ["work_i", "unit_i", "work_j", "unit_j"]
NAMED = 6


def placed(records: DataFrame) -> DataFrame:
    """Records with match_id and their ranges in words of the whole unit: unit, abs_lo, abs_hi of either side."""
    i, j = abs_span(F.col("ref_i"), F.col("lo_i"), F.col("hi_i")), abs_span(F.col("ref_j"), F.col("lo_j"), F.col("hi_j"))
    return records.select("match_id", "work_i", "work_j", "chain_len", i.alias("i"), j.alias("j")).select(
        "match_id", "work_i", F.col("i.unit").alias("unit_i"), "work_j", F.col("j.unit").alias("unit_j"), "chain_len",
        F.col("i.lo").alias("lo_i"), F.col("i.hi").alias("hi_i"), F.col("j.lo").alias("lo_j"), F.col("j.hi").alias("hi_j"),
    )


def clustered(records: DataFrame) -> DataFrame:
    """Placed records with ``cluster``: a record joins the one before it, in order of its range in i, if it begins at or before that one's end.

    The row before counts, not the farthest end so far, as the reference semantics have it.
    """
    order = Window.partitionBy(*PLACE).orderBy("lo_i", "hi_i", "match_id")
    opens = F.when(F.col("lo_i") <= F.lag("hi_i").over(order), 0).otherwise(1)
    return placed(records).withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(order)).drop("opens")


def clusters(records: DataFrame) -> DataFrame:
    """(place, cluster, size, i_lo, i_hi, j_lo, j_hi): clusters of two records or more, with their joint extents."""
    ends = [F.min("lo_i").alias("i_lo"), F.max("hi_i").alias("i_hi"), F.min("lo_j").alias("j_lo"), F.max("hi_j").alias("j_hi")]
    return clustered(records).groupBy(*PLACE, "cluster").agg(F.count("*").alias("size"), *ends).filter("size > 1")


def distinct_passages(records: DataFrame) -> DataFrame:
    """One row (records, clusters, redundant, passages): redundant records are those beyond the first of each cluster."""
    per = clustered(records).groupBy(*PLACE, "cluster").agg(F.count("*").alias("size"))
    redundant = F.coalesce(F.sum(F.col("size") - 1), F.lit(0))
    total = F.coalesce(F.sum("size"), F.lit(0))
    return per.agg(total.alias("records"), F.count_if(F.col("size") > 1).alias("clusters"), redundant.alias("redundant"), (total - redundant).alias("passages"))


def neighbours(records: DataFrame, most: int = NAMED) -> DataFrame:
    """(place, cluster, match_id, between, rank): for each cluster the nearest records of the same place that are in no cluster.

    ``between`` counts the words between the two ranges in i. Joined by place, so only records of the same units meet.
    """
    rows = clustered(records)
    sizes = Window.partitionBy(*PLACE, "cluster")
    lone = rows.withColumn("size", F.count("*").over(sizes)).filter("size = 1").select(*PLACE, "match_id", "chain_len", "lo_i", "hi_i")
    found = clusters(records).join(lone, PLACE)
    between = F.greatest(F.lit(0), F.greatest(F.col("lo_i") - F.col("i_hi"), F.col("i_lo") - F.col("hi_i")) - 1)
    order = Window.partitionBy(*PLACE, "cluster").orderBy("between", F.col("chain_len").desc_nulls_last(), "match_id")
    return found.withColumn("between", between).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(*PLACE, "cluster", "match_id", "between", "rank")
