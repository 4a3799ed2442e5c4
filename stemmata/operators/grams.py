"""Word n-grams, leave-n-out grams, inverse document frequencies and cosines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.config import Params

UNIT = ["work_id", "unit_pos"]


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words as arrays; a shorter list has none."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(words, i, n))


def bigrams(units: DataFrame) -> DataFrame:
    """(work_id, unit_pos, g1, g2): the distinct bigrams of each unit."""
    found = F.array_distinct(ngrams(F.col("norm"), 2))
    return units.select(*UNIT, F.explode(found).alias("g")).select(*UNIT, F.col("g")[0].alias("g1"), F.col("g")[1].alias("g2"))


def _chosen(params: Params, words: str) -> Column:
    """All grams of a unit, as arrays of words."""
    picks = list(combinations(range(params.ngram), params.kept))
    each = lambda w: F.array(*[F.array(*[w[i] for i in pick]) for pick in picks])
    return F.flatten(F.transform(ngrams(F.col(words), params.ngram), each))


def leave_out_grams(units: DataFrame, params: Params, words: str = "norm") -> DataFrame:
    """(work_id, unit_pos, gram, c): counts of all order-preserving choices of ngram - n_out words from each window of ngram.

    The words themselves are the key. A unit shorter than a window has no grams.
    """
    return units.select(*UNIT, F.explode(_chosen(params, words)).alias("gram")).groupBy(*UNIT, "gram").agg(F.count("*").alias("c"))


def gram_keys(units: DataFrame, params: Params, words: str = "norm") -> DataFrame:
    """(work_id, unit_pos, ka, kb, c): the same counts with two 64-bit numbers in place of the words, a fraction of their size in a shuffle."""
    exploded = units.select(*UNIT, F.explode(_chosen(params, words)).alias("g"))
    numbered = exploded.select(*UNIT, F.xxhash64("g").alias("ka"), F.xxhash64(F.lit(1), "g").alias("kb"))
    return numbered.groupBy(*UNIT, "ka", "kb").agg(F.count("*").alias("c"))


def idf(grams: DataFrame, n_units: int, by: list[str] | None = None) -> DataFrame:
    """(gram, df, idf): ln(1 + n / (1 + df)) + 1, n counting all units, those without grams too. ``by`` names the key, the words by default."""
    counted = grams.groupBy(*(by or ["gram"])).agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log(F.lit(1.0) + F.lit(float(n_units)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))


def vectors(keys: DataFrame, idfs: DataFrame) -> DataFrame:
    """(work_id, unit_pos, keys, weights): each unit's grams, in order of their first number, with count times idf; a gram that the index does not know weighs nothing.

    A unit has at most 400 tokens, which bounds its vector. The division by the unit's total is left out: it cancels in a cosine.
    """
    weighed = keys.join(idfs.select("ka", "kb", "idf"), ["ka", "kb"], "left").select(*UNIT, F.struct("ka", (F.col("c") * F.coalesce("idf", F.lit(0.0))).alias("w")).alias("x"))
    listed = weighed.groupBy(*UNIT).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select(*UNIT, F.col("x.ka").alias("keys"), F.col("x.w").alias("weights"))


def call_vectors(candidates: DataFrame, keys: DataFrame, units: DataFrame) -> DataFrame:
    """(work_id, unit_pos, other, keys, weights): vectors whose idf counts only the units of the unit's own work and of the work it is compared with.

    Scores of this scope compare within a pair of works only. Just the units that are candidates get vectors, one for each other work.
    """
    n = units.groupBy("work_id").agg(F.count("*").alias("n"))
    df = keys.groupBy("work_id", "ka", "kb").agg(F.count("*").alias("df"))
    one = candidates.select(F.col("work_i").alias("work_id"), F.col("i").alias("unit_pos"), F.col("work_j").alias("other"))
    two = candidates.select(F.col("work_j").alias("work_id"), F.col("j").alias("unit_pos"), F.col("work_i").alias("other"))
    rows = one.unionByName(two).distinct().join(n, "work_id").join(n.select(F.col("work_id").alias("other"), F.col("n").alias("n_other")), "other").join(keys, UNIT).join(df, ["work_id", "ka", "kb"])
    rows = rows.join(df.select(F.col("work_id").alias("other"), "ka", "kb", F.col("df").alias("df_other")), ["other", "ka", "kb"], "left")
    value = F.log(F.lit(1.0) + (F.col("n") + F.col("n_other")) / (F.lit(1.0) + F.col("df") + F.coalesce("df_other", F.lit(0)))) + F.lit(1.0)
    listed = rows.select(*UNIT, "other", F.struct("ka", (F.col("c") * value).alias("w")).alias("x")).groupBy(*UNIT, "other").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select(*UNIT, "other", F.col("x.ka").alias("keys"), F.col("x.w").alias("weights"))


def cosine(ka: np.ndarray, wa: np.ndarray, kb: np.ndarray, wb: np.ndarray) -> float:
    """Of two vectors with ordered keys; 0 where either is empty or has no length."""
    na, nb = float(np.sqrt(wa @ wa)), float(np.sqrt(wb @ wb))
    if na == 0 or nb == 0:
        return 0.0
    at = np.searchsorted(kb, ka)
    at[at == len(kb)] = 0
    same = kb[at] == ka
    return float(wa[same] @ wb[at[same]]) / (na * nb)


def cosines(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates with ``score``, the cosine of their units' vectors; 0 where one has none. ``units`` are vectors of either scope. Two vectors meet in a row, their grams are not shuffled."""
    call = "other" in units.columns

    def side(s: str, other: str) -> tuple[DataFrame, list[str]]:
        names = [F.col("work_id").alias(f"work_{s}"), F.col("unit_pos").alias(s), *([F.col("other").alias(f"work_{other}")] if call else [])]
        return units.select(*names, F.col("keys").alias(f"keys_{s}"), F.col("weights").alias(f"weights_{s}")), [f"work_{s}", s, *([f"work_{other}"] if call else [])]

    both = candidates
    for mine, other in (("i", "j"), ("j", "i")):
        vector, on = side(mine, other)
        both = both.join(vector, on, "left")
    both = both.select(*candidates.columns, "keys_i", "weights_i", "keys_j", "weights_j")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = zip(b["keys_i"], b["weights_i"], b["keys_j"], b["weights_j"])
            score = [cosine(ka, wa, kb, wb) if ka is not None and kb is not None else 0.0 for ka, wa, kb, wb in rows]
            yield b[candidates_columns].assign(score=np.array(score, dtype=np.float64))

    candidates_columns = list(candidates.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return both.mapInPandas(run, f"{schema}, score double")


def auto_threshold(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, mean, threshold): mean + 1.2 standard deviations of the population, 0 under two scores. Reported, never applied."""
    s = scores.groupBy(*by).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    return s.select(*by, "n", "mean", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("mean") + 1.2 * F.col("sd")).alias("threshold"))
