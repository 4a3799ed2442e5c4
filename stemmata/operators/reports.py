"""The parts of the reports, each a small ordered table over the records; ``sources.writers`` prints them.

Records have match_id in the order in which they came, authors by side, and where passages are grouped lo_i, hi_i, lo_j, hi_j. A record is listed if its longest chain
has ``least_chain`` words; a null chain has none. Two unknown authors are one name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.config import COMMONPLACE, PACKAGES, Package
from stemmata.functions import similarity as sim
from stemmata.operators import numbers, packages, passages

LEAST_CHAIN, TOP = 6, 10
#: columns of a line of the tables
LINE = "rank match_id work_i ref_i work_j ref_j chain_len matched_words matched_words_j gap_i gap_j n_chained score span_i span_j snippet_i snippet_j".split()


def _same() -> Column:
    return F.coalesce("author_i", F.lit("")) == F.coalesce("author_j", F.lit(""))


def _listed(least_chain: int) -> Column:
    return F.coalesce(F.col("chain_len") >= max(1, least_chain), F.lit(False))


def summary(records: DataFrame, least_chain: int = LEAST_CHAIN) -> DataFrame:
    """One row: records, cross-author and intra-author ones, those listed of either, those below the threshold."""
    listed, same = _listed(least_chain), _same()
    n = records.agg(F.count("*").alias("records"), F.count_if(~same).alias("cross_all"), F.count_if(same).alias("intra_all"), F.count_if(listed & ~same).alias("cross_listed"), F.count_if(listed & same).alias("intra_listed"))
    return n.withColumn("below", F.col("records") - F.col("cross_listed") - F.col("intra_listed"))


def _line(rows: DataFrame) -> DataFrame:
    """Records as lines of a table; the count of j is missing in older files, and so is its gap then."""
    gap = lambda s, n: F.when(F.col(n).isNotNull(), sim.gap_words(F.col(f"lo_{s}"), F.col(f"hi_{s}"), F.col(n)))
    span = lambda s: F.concat(F.col(f"lo_{s}").cast("string"), F.lit("–"), F.col(f"hi_{s}").cast("string"))
    clip = lambda s: sim.clip(F.col(f"snippet_{s}"), 70)
    return rows.withColumns({"gap_i": gap("i", "matched_words"), "gap_j": gap("j", "matched_words_j"), "span_i": span("i"), "span_j": span("j"), "snippet_i": clip("i"), "snippet_j": clip("j")}).select(*LINE)


def longest(records: DataFrame, same_author: bool, least_chain: int = LEAST_CHAIN, top: int = TOP) -> DataFrame:
    """The ``top`` listed records with the longest chains, cross-author or intra-author, the first in the order of the records among equals."""
    rows = records.filter(_listed(least_chain) & (_same() if same_author else ~_same()))
    first = rows.orderBy(F.col("chain_len").desc(), "match_id").limit(top)  # a limit before the one-task rank
    return _line(first.withColumn("rank", F.row_number().over(Window.orderBy(F.col("chain_len").desc(), "match_id")))).orderBy("rank")


def leading(records: DataFrame, least_chain: int = LEAST_CHAIN) -> DataFrame:
    """(by, match_id, chain_len, matched_words, n_chained, score): which listed cross-author record leads by chain, by words and by score; of equals the one whose chain comes first."""
    rows = records.filter(_listed(least_chain) & ~_same())
    score = F.when(~F.isnan("score"), F.col("score"))
    who = F.struct("match_id", "chain_len", "matched_words", "n_chained", "score")
    best = [F.max_by(who, F.struct(v, F.col("chain_len"), -F.col("match_id"))).alias(n) for n, v in (("chain_len", F.col("chain_len")), ("matched_words", F.coalesce("matched_words", F.lit(-1))), ("score", F.coalesce(score, F.lit(-1.0))))]
    one = rows.agg(*best)
    spread = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("by"), F.col(n).alias("r")) for n in ("chain_len", "matched_words", "score")])).alias("x"))
    return spread.filter(F.col("x.r.match_id").isNotNull()).select("x.by", "x.r.*")


def era_counts(records: DataFrame, least_chain: int = LEAST_CHAIN) -> DataFrame:
    """(era_first, era_second, n, longest): listed cross-author records of each pair of eras, the earlier era first."""
    rows = numbers.era_ordered(records.filter(_listed(least_chain) & ~_same()))
    return rows.groupBy("era_first", "era_second").agg(F.count("*").alias("n"), F.max("chain_len").alias("longest"))


def era_lines(records: DataFrame, least_chain: int = LEAST_CHAIN, top: int = TOP) -> DataFrame:
    """The lines of the ``top`` records of each pair of eras, with era_first and era_second."""
    rows = numbers.era_pair_top(records, least_chain, top)
    return _line_with(rows, ["era_first", "era_second"]).orderBy("era_first", "era_second", "rank")


def _line_with(rows: DataFrame, keep: list[str]) -> DataFrame:
    named = _line(rows)
    return rows.select(*keep, "match_id").join(named, "match_id").select(*keep, *LINE)


def repeated_passages(records: DataFrame) -> DataFrame:
    """(place, cluster, match_id, chain_len, i_lo, i_hi, j_lo, j_hi, windows_differ): the records of each passage that comes as several records, with the joint extent and the sides (i, j, ij or '') whose window differs."""
    rows = passages.clustered(records)
    refs = records.select("match_id", "ref_i", "ref_j")
    ends = passages.clusters(records).drop("size")
    inside = rows.select(*passages.PLACE, "cluster", "match_id", "chain_len").join(ends, [*passages.PLACE, "cluster"]).join(refs, "match_id")
    several = inside.groupBy(*passages.PLACE, "cluster").agg(F.concat(F.when(F.min("ref_i") < F.max("ref_i"), "i").otherwise(""), F.when(F.min("ref_j") < F.max("ref_j"), "j").otherwise("")).alias("windows_differ"))
    return inside.drop("ref_i", "ref_j").join(several, [*passages.PLACE, "cluster"])


def sweep_parts(records: DataFrame, least_chain: int = LEAST_CHAIN, top: int = TOP) -> dict[str, DataFrame]:
    """The report of a sweep, or of its records read again: tables by heading, in order."""
    groups = repeated_passages(records).orderBy(*passages.PLACE, "cluster", F.col("chain_len").desc(), "match_id")
    return {
        "Records": summary(records, least_chain),
        "Distinct passages": passages.distinct_passages(records),
        "Cross-author records, longest chain first": longest(records, False, least_chain, top),
        "Leaders by chain, words and score": leading(records, least_chain),
        "Records that repeat a passage": groups,
        "Separate passages near them": passages.neighbours(records).orderBy(*passages.PLACE, "cluster", "rank"),
        "Cross-author records by pair of eras": era_counts(records, least_chain).orderBy("era_first", "era_second"),
        "Longest chains of each pair of eras": era_lines(records, least_chain, top),
        "Intra-author records, longest chain first": longest(records, True, least_chain, top),
    }


def tag_totals(tagged: DataFrame) -> DataFrame:
    """One row (records, tagged, clean, tagged_pct, clean_pct) of a tagging run; shares are null without records."""
    n = tagged.agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.col("tag") == COMMONPLACE, F.lit(False))).alias("tagged"))
    share = lambda c: F.when(F.col("records") > 0, 100.0 * c / F.col("records"))
    return n.select("records", "tagged", (F.col("records") - F.col("tagged")).alias("clean"), share(F.col("tagged")).alias("tagged_pct"), share(F.col("records") - F.col("tagged")).alias("clean_pct"))


def tag_origins(tagged: DataFrame) -> DataFrame:
    """(tag_origin, n): on which side the tagged records met a control; without a side 'unknown'."""
    rows = tagged.filter(F.col("tag") == COMMONPLACE)
    side = F.when(F.coalesce("tag_origin", F.lit("")) == "", "unknown").otherwise(F.col("tag_origin"))
    return rows.groupBy(side.alias("tag_origin")).agg(F.count("*").alias("n"))


def base_noise(records: DataFrame, least_chain: int = LEAST_CHAIN) -> DataFrame:
    """One row (base, short, long, short_pct, long_pct): how many of the base records have a chain too short to mean anything."""
    rows = packages.base(records)
    n = rows.agg(F.count("*").alias("base"), F.count_if(F.col("chain_len") < least_chain).alias("short"), F.count_if(F.col("chain_len") >= least_chain).alias("long"))
    share = lambda c: F.when(F.col("base") > 0, 100.0 * F.col(c) / F.col("base")).alias(f"{c}_pct")
    return n.select("*", share("short"), share("long"))


def package_examples(records: DataFrame, n: int = 3) -> DataFrame:
    """(wp_key, kind, rank, match_id, chain_len, score): of each of the first three packages the ``n`` longest chains, and the best score; of equals the earliest record."""
    keys = [F.when(packages.era_pair(p.era_a, p.era_b) & (F.col("chain_len") >= p.least_chain), p.name) for p in PACKAGES]
    rows = packages.base(records).withColumn("wp_key", F.explode(F.array_compact(F.array(*keys)))).select("wp_key", "match_id", "chain_len", "score")
    score = F.when(~F.isnan("score"), F.col("score"))
    kinds = F.explode(F.array(F.struct(F.lit("chain").alias("kind"), F.col("chain_len").cast("double").alias("v")), F.struct(F.lit("score").alias("kind"), score.alias("v"))))
    both = rows.select("*", kinds.alias("x")).select("wp_key", "match_id", "chain_len", "score", "x.*").filter(F.col("v").isNotNull())
    order = Window.partitionBy("wp_key", "kind").orderBy(F.col("v").desc(), "match_id")
    most = F.when(F.col("kind") == "chain", n).otherwise(1)
    return both.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= n) & (F.col("rank") <= most)).select("wp_key", "kind", "rank", "match_id", "chain_len", "score")


def thresholds(all_: tuple[Package, ...] = PACKAGES) -> list[tuple[str, str, str, int, float]]:
    """The packages' eras and floors, as the report's head states them."""
    return [(p.name, p.era_a, p.era_b, p.least_chain, p.least_score) for p in all_]
