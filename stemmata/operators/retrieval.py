"""Candidate pairs of units: an equi-join on bigrams between works, frequent bigrams left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.config import Params
from stemmata.operators.grams import bigrams

PAIR = ["work_i", "work_j"]
#: works in a block of a bigram's second side
BLOCK = 128


def work_pairs(works: DataFrame, limit: int | None = None) -> DataFrame:
    """(work_i, work_j, ord_i, ord_j) for every two works, the earlier first; one row a pair of works of the manifest."""
    a = works.select(F.col("work_id").alias("work_i"), F.col("ord").alias("ord_i"))
    b = works.select(F.col("work_id").alias("work_j"), F.col("ord").alias("ord_j"))
    pairs = a.join(b, F.col("ord_i") < F.col("ord_j"))
    return pairs.orderBy("ord_i", "ord_j").limit(limit) if limit is not None else pairs


def bigram_df(grams: DataFrame, units: DataFrame, floor: int = 40) -> DataFrame:
    """(work_id, g1, g2, df, cap): in how many units of its work a bigram stands, and the work's cap max(floor, n / 25)."""
    caps = units.groupBy("work_id").agg(F.greatest(F.lit(floor), F.expr("count(*) div 25")).alias("cap"))
    return grams.groupBy("work_id", "g1", "g2").agg(F.count("*").alias("df")).join(caps, "work_id")


def candidates(units: DataFrame, works: DataFrame, params: Params) -> DataFrame:
    """(work_i, work_j, i, j, shared): pairs of units of two works with at least ``min_shared`` common bigrams.

    v2 leaves a bigram out if it is frequent in both works, v1 if it is in the second. Bigrams of one work only are dropped before the join, on the
    counts per work. The join never meets frequent with frequent: in v2 the second side has a lane for its frequent rows, and only
    rows that are not frequent on the first side go there; in v1 frequent rows have no second side.

    The cap is per work, as the reference semantics have it, so a bigram of W works still meets itself some (cap * W) ** 2 / 2 times. Its rows are spread: the second side is dealt into
    blocks of about BLOCK works and the first sends a copy to each, so one bigram is the key of W / BLOCK tasks. ``most_works`` leaves out bigrams that nearly all works have; it is off by default.
    """
    grams = bigrams(units)
    counted = bigram_df(grams, units, params.cap_floor)
    # counted map-side and joined back, so the rows of all works that have a bigram are in no one task
    several = counted.groupBy("g1", "g2").agg(F.count("*").alias("n")).filter("n > 1")
    if params.most_works is not None:
        several = several.filter(F.col("n") <= params.most_works)
    known = counted.join(several, ["g1", "g2"]).select("work_id", "g1", "g2", (F.col("df") > F.col("cap")).alias("frequent"), (F.floor(F.col("n") / F.lit(BLOCK)) + 1).cast("int").alias("blocks"))
    rows = grams.join(known, ["work_id", "g1", "g2"]).join(works.select("work_id", "ord"), "work_id")
    side = lambda s: [F.col("work_id").alias(f"work_{s}"), F.col("unit_pos").alias(s), F.col("ord").alias(f"ord_{s}")]
    # lanes 0.. hold the blocks of the second side's rows that are not frequent, -1 and below those of its frequent rows
    own = F.pmod(F.xxhash64("work_id"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    if params.mode == "v1":
        left, right = rows.select("g1", "g2", F.explode(every).alias("lane"), *side("i")), rows.filter(~F.col("frequent")).select("g1", "g2", own.alias("lane"), *side("j"))
    else:
        lanes = F.when(F.col("frequent"), every).otherwise(F.concat(every, F.transform(every, lambda x: -1 - x)))
        lane = F.when(F.col("frequent"), -1 - own).otherwise(own)
        left, right = rows.select("g1", "g2", F.explode(lanes).alias("lane"), *side("i")), rows.select("g1", "g2", lane.alias("lane"), *side("j"))
    hits = left.join(right, ["g1", "g2", "lane"]).filter(F.col("ord_i") < F.col("ord_j"))
    return hits.groupBy(*PAIR, "i", "j").agg(F.count("*").alias("shared")).filter(F.col("shared") >= params.min_shared)


def top_candidates(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` candidates of each pair of works by (shared descending, i, j), with ``rank`` from 1: a group limit."""
    w = Window.partitionBy(*PAIR).orderBy(F.col("shared").desc(), "i", "j")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def candidate_meta(found: DataFrame, units: DataFrame, most: int) -> DataFrame:
    """(work_i, work_j, pairs_total, before_cap, after_cap, cap_hit) per pair of works that has candidates."""
    n = units.groupBy("work_id").agg(F.count("*").alias("n"))
    c = found.groupBy(*PAIR).agg(F.count("*").alias("before_cap"))
    joined = c.join(n.select(F.col("work_id").alias("work_i"), F.col("n").alias("n_i")), "work_i").join(n.select(F.col("work_id").alias("work_j"), F.col("n").alias("n_j")), "work_j")
    after = F.least(F.col("before_cap"), F.lit(most))
    return joined.select(*PAIR, (F.col("n_i") * F.col("n_j")).alias("pairs_total"), "before_cap", after.alias("after_cap"), (F.col("before_cap") > most).alias("cap_hit"))


def saturation(matches: DataFrame, top: int = 2) -> DataFrame:
    """(work_i, work_j, n): the pairs of works with the most records; a first one at the cap and far above the next tells saturation."""
    return matches.groupBy(*PAIR).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *PAIR).limit(top)
