"""Work packages: tagged records filtered by era pair, chain length and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.config import COMMONPLACE, CONTROL_ERA, PACKAGES, Package

SCORE_MODES = ("auto", "none", "percentile", "absolute")


def cross_author() -> Column:
    """Authors differ; an unknown author differs from any."""
    return F.col("author_i").isNull() | F.col("author_j").isNull() | (F.col("author_i") != F.col("author_j"))


def untagged() -> Column:
    return F.col("tag").isNull() | (F.col("tag") == "")


def base(records: DataFrame) -> DataFrame:
    return records.filter(cross_author() & untagged())


def era_pair(a: str, b: str) -> Column:
    i, j = F.col("era_i"), F.col("era_j")
    return ((i == a) & (j == b)) | ((i == b) & (j == a))


def percentile(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Rows with ``pct``: the average rank of ties over the group's size; null and NaN scores have none and are not counted."""
    known = F.when(~F.isnan(score), F.col(score))
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(known.asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*by, known))
    return rows.withColumn("pct", F.when(known.isNotNull(), (F.rank().over(order) + (ties - 1) / 2.0) / F.count(known).over(group)))


def package(records: DataFrame, p: Package, mode: str = "none", share: float = 0.25, corpus_idf: bool = False) -> DataFrame:
    """Records of one package from the base set. ``auto`` takes the absolute floor if the scores come from a corpus index, else none."""
    if mode not in SCORE_MODES:
        raise ValueError(f"score mode is one of {SCORE_MODES}")
    mode = ("absolute" if corpus_idf else "none") if mode == "auto" else mode
    rows = base(records).filter(era_pair(p.era_a, p.era_b) & (F.col("chain_len") >= p.least_chain))
    if mode == "absolute":
        return rows.filter(~F.isnan("score") & (F.col("score") >= p.least_score))
    if mode == "percentile":
        return percentile(rows, ["work_i", "work_j"]).filter(F.col("pct") >= share).drop("pct")
    return rows


def synthesis(records: DataFrame, least_chain: int = 6) -> DataFrame:
    """The fourth package: cross-author and long enough, tags kept, all eras."""
    return records.filter(cross_author() & (F.col("chain_len") >= least_chain))


def control_set(records: DataFrame) -> DataFrame:
    """The base records with a control side."""
    return base(records).filter((F.col("era_i") == CONTROL_ERA) | (F.col("era_j") == CONTROL_ERA))


def all_packages(records: DataFrame, mode: str = "none", share: float = 0.25) -> DataFrame:
    """Records of all four packages with ``wp_key``."""
    out = synthesis(records).withColumn("wp_key", F.lit("wp4"))
    for p in PACKAGES:
        out = out.unionByName(package(records, p, mode, share).withColumn("wp_key", F.lit(p.name)))
    return out


def package_report(records: DataFrame) -> DataFrame:
    """(wp_key, n_era, n_wp, pct, best_score, longest): how many base records an era pair has and how many the package keeps."""
    aggs = []
    for p in PACKAGES:
        inside = era_pair(p.era_a, p.era_b)
        ok = inside & (F.col("chain_len") >= p.least_chain)
        score = F.when(ok & ~F.isnan("score"), F.col("score"))
        aggs.append(F.struct(F.lit(p.name).alias("wp_key"), F.count_if(inside).alias("n_era"), F.count_if(ok).alias("n_wp"), F.max(score).alias("best_score"), F.max(F.when(ok, F.col("chain_len"))).alias("longest")).alias(p.name))
    spread = base(records).agg(*aggs).select(F.explode(F.array(*[p.name for p in PACKAGES])).alias("x")).select("x.*")  # one pass for all packages
    return spread.select("wp_key", "n_era", "n_wp", F.when(F.col("n_era") > 0, 100.0 * F.col("n_wp") / F.col("n_era")).alias("pct"), "best_score", "longest")


def longest(rows: DataFrame, n: int = 3, by: list[str] | None = None) -> DataFrame:
    """The n records with the longest chain, of each group if ``by`` is given, earliest match_id first among equals; with ``rank``."""
    order = [F.col("chain_len").desc(), F.col("match_id").asc()]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(0)).orderBy(*order)
    return rows.filter(F.col("chain_len").isNotNull()).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def composition(records: DataFrame) -> DataFrame:
    """One row (total, control, control_control, tagged, clean) of the fourth package."""
    i, j = F.coalesce(F.col("era_i") == CONTROL_ERA, F.lit(False)), F.coalesce(F.col("era_j") == CONTROL_ERA, F.lit(False))
    tagged = F.coalesce(F.col("tag") == COMMONPLACE, F.lit(False))
    return synthesis(records).agg(F.count("*").alias("total"), F.count_if(i | j).alias("control"), F.count_if(i & j).alias("control_control"), F.count_if(~(i | j) & tagged).alias("tagged"), F.count_if(~(i | j) & ~tagged).alias("clean"))


def delta(records: DataFrame, shipped: DataFrame) -> DataFrame:
    """(wp_key, n, shipped, delta): package sizes against earlier ones (wp_key, shipped); null where there is no earlier one."""
    now = all_packages(records).groupBy("wp_key").agg(F.count("*").alias("n"))
    return now.join(shipped, "wp_key", "left").select("wp_key", "n", "shipped", (F.col("n") - F.col("shipped")).alias("delta"))
