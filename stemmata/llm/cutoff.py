"""A score cutoff per source that keeps a target fraction of the source's records.

A mergeable KLL sketch per source, combined map-side, has a size that does not depend on the number of
records and brackets the cutoff: its quantiles at the target rank, plus and minus the sketch's rank error. Another
pass counts how many records lie above the bracket and inside it, which proves the bracket or, since the
error bound holds with high probability only, refutes it; then the next round takes a wider one. A
bracket that still holds too many different scores for one task gets a sketch of its own. At last the scores inside the
bracket are counted by value, and the cutoff is the value at which the count reaches the target rank: it is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.scratch import Scratch

#: sketch size parameter, and a rank error above what it gives (about 0.7 % at k = 400)
SKETCH_K = 400
RANK_ERROR = 0.02
#: different scores inside a bracket that one task may order
BRACKET = 50_000
ROUNDS = 12
#: constant ranks at which a sketch is read
GRID = 128


def _valid(rows: DataFrame, source: str, score: str) -> DataFrame:
    return rows.filter(F.col(source).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))


def _narrowed(rows: DataFrame, state: DataFrame, source: str, score: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The bracket that a sketch of the values inside the present one gives, and how the rows lie to it."""
    at = F.col(score)
    inside = rows.join(state, source).filter((at >= F.col("low")) & (at <= F.col("high")))
    sketch = inside.groupBy(source).agg(F.kll_sketch_agg_double(score, F.lit(k)).alias("sketch"), *[F.first(c).alias(c) for c in ("n", "target", "low", "high", "above", "error")], F.count("*").alias("m"))
    rank = 1.0 - (F.col("target") - F.col("above")) / F.col("m")  # share of the inside values below the cutoff
    slack = F.col("error") + 1.0 / F.col("m")  # one more rank for rounding in small sources
    # the ranks asked of a sketch must be constants: a grid of them, of which the bracket takes the next outside ones
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    sketch = sketch.withColumn("grid", grid).drop("sketch")
    step = lambda q: F.greatest(F.lit(0), F.least(F.lit(GRID), q)).cast("int")
    bracket = sketch.select(source, "n", "target", "low", "high", "above", "error", F.col("grid")[step(F.floor((rank - slack) * GRID))].alias("lo"), F.col("grid")[step(F.ceil((rank + slack) * GRID))].alias("hi"))
    return inside, bracket


def cutoffs(rows: DataFrame, source: str, score: str, fraction: float = 0.25, *, k: int = SKETCH_K, error: float = RANK_ERROR, bracket_values: int = BRACKET) -> DataFrame:
    """(source, n, target, cutoff): the score at rank ceil(n * fraction) from the top, exactly, for every source.

    ``rows`` must be cheap to read more than once (a written table). Null and NaN scores and null sources are left
    out. A source of one record keeps it; ties at the cutoff are all kept, so a source may keep more than the fraction. An
    empty table gives an empty table. Other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "cutoffs")
    rows = _valid(rows, source, score).select(source, F.col(score).cast("double").alias(score))
    at = F.col(score)
    first = rows.groupBy(source).agg(F.count("*").alias("n"))
    state = first.select(source, "n", F.ceil(F.col("n") * F.lit(fraction)).cast("bigint").alias("target"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("bigint").alias("above"), F.lit(error).alias("error"))
    open_, done = scratch.put(state), None
    for _ in range(ROUNDS):
        _, bracket = _narrowed(rows, open_, source, score, k)
        bracket = scratch.put(bracket)
        seen = rows.join(bracket, source).filter((at >= F.col("low")) & (at <= F.col("high")))
        within = (at >= F.col("lo")) & (at <= F.col("hi"))
        keep = [F.first(c).alias(c) for c in ("n", "target", "low", "high", "above", "error", "lo", "hi")]
        counted = seen.groupBy(source).agg(*keep, F.count_if(at > F.col("hi")).alias("over"), F.count_if(within).alias("inside"), F.approx_count_distinct(F.when(within, at), 0.02).alias("values"))
        proved = (F.col("above") + F.col("over") < F.col("target")) & (F.col("above") + F.col("over") + F.col("inside") >= F.col("target"))
        counted = scratch.put(counted.withColumn("proved", proved))
        took = lambda new, old: F.when(F.col("proved"), F.col(new)).otherwise(F.col(old))
        step = counted.select(source, "n", "target", took("lo", "low").alias("low"), took("hi", "high").alias("high"), (F.col("above") + F.when(F.col("proved"), F.col("over")).otherwise(0)).alias("above"), F.when(F.col("proved"), F.lit(error)).otherwise(F.col("error") * 2).alias("error"), (F.col("proved") & (F.col("values") <= bracket_values)).alias("ready"))
        ready = step.filter("ready").drop("ready")
        done = ready if done is None else done.unionByName(ready)
        open_ = step.filter("NOT ready").drop("ready")
        if open_.isEmpty():
            break
    else:
        done = done.unionByName(open_)
    inside = rows.join(done, source).filter((at >= F.col("low")) & (at <= F.col("high")))
    counts = inside.groupBy(source, at.alias("value")).agg(F.count("*").alias("c"), *[F.first(x).alias(x) for x in ("n", "target", "above")])
    running = counts.withColumn("upto", F.col("above") + F.sum("c").over(Window.partitionBy(source).orderBy(F.col("value").desc())))
    reached = running.filter(F.col("upto") >= F.col("target"))
    return scratch.put(reached.groupBy(source).agg(F.first("n").alias("n"), F.first("target").alias("target"), F.max("value").alias("cutoff")))


def kept(rows: DataFrame, cuts: DataFrame, source: str, score: str) -> DataFrame:
    """The rows at or above their source's cutoff; null and NaN scores and null sources are never kept."""
    found = _valid(rows, source, score).join(cuts.select(source, F.col("cutoff").alias("__cutoff")), source)
    return found.filter(F.col(score) >= F.col("__cutoff")).drop("__cutoff")


def report(rows: DataFrame, cuts: DataFrame, source: str, score: str) -> DataFrame:
    """(source, n, target, cutoff, kept, ties): the kept rows and those exactly at the cutoff, counted in another pass."""
    joined = _valid(rows, source, score).select(source, score).join(cuts.select(source, "n", "target", "cutoff"), source)
    at = F.col(score)
    return joined.groupBy(source).agg(F.first("n").alias("n"), F.first("target").alias("target"), F.first("cutoff").alias("cutoff"), F.count_if(at >= F.col("cutoff")).alias("kept"), F.count_if(at == F.col("cutoff")).alias("ties"))
