"""Topos exclusion: records whose passage also stands in a control corpus are commonplaces, not borrowings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.config import COMMONPLACE, CONTROL_ERA
from stemmata.functions.similarity import abs_span, overlap_ratio, ref_prefix


def _sides(records: DataFrame, coords: str) -> DataFrame:
    """Records with page_i, a_i, b_i and so for j: page and range, window-local or in words of the whole unit."""
    if coords not in ("local", "absolute"):
        raise ValueError("coords is local or absolute")
    out = records
    for s in "ij":
        lo, hi = F.col(f"lo_{s}"), F.col(f"hi_{s}")
        span = abs_span(F.col(f"ref_{s}"), lo, hi)
        out = out.withColumn(f"page_{s}", ref_prefix(F.col(f"ref_{s}")))
        out = out.withColumn(f"a_{s}", lo if coords == "local" else span["lo"]).withColumn(f"b_{s}", hi if coords == "local" else span["hi"])
    return out


def control_coords(controls: DataFrame, coords: str = "local") -> DataFrame:
    """(work_id, page, lo, hi): of every record with a control side the range on its other side; i is looked at first."""
    i_control, j_control = F.col("era_i") == CONTROL_ERA, F.col("era_j") == CONTROL_ERA
    rows = _sides(controls, coords).filter(i_control | j_control)
    pick = lambda c: F.when(i_control, F.col(f"{c}_j")).otherwise(F.col(f"{c}_i"))
    return rows.select(pick("work").alias("work_id"), pick("page").alias("page"), pick("a").alias("lo"), pick("b").alias("hi")).filter(F.col("lo").isNotNull() & F.col("hi").isNotNull()).distinct()


def work_coords(controls: DataFrame, work: str, coords: str = "local") -> DataFrame:
    """(page, lo, hi): the ranges of one work in the records that touch it, side i first."""
    rows = _sides(controls, coords).filter((F.col("work_i") == work) | (F.col("work_j") == work))
    pick = lambda c: F.when(F.col("work_i") == work, F.col(f"{c}_i")).otherwise(F.col(f"{c}_j"))
    return rows.select(F.lit(work).alias("work_id"), pick("page").alias("page"), pick("a").alias("lo"), pick("b").alias("hi")).filter(F.col("lo").isNotNull()).distinct()


def _hits(rows: DataFrame, coords: DataFrame, side: str, least: float) -> DataFrame:
    """match_ids of which this side overlaps a control range of its page: an equi-join on work and page with the interval test as rest."""
    r = rows.select("match_id", F.col(f"work_{side}").alias("work_id"), F.col(f"page_{side}").alias("page"), F.col(f"a_{side}").alias("a"), F.col(f"b_{side}").alias("b"))
    near = (r["work_id"] == coords["work_id"]) & (r["page"] == coords["page"]) & (overlap_ratio(r["a"], r["b"], coords["lo"], coords["hi"]) >= least)
    return r.join(coords, near, "left_semi").select("match_id").distinct()


def tag_global(records: DataFrame, controls: DataFrame, least: float = 0.5, coords: str = "local") -> DataFrame:
    """Records with ``tag`` and ``tag_origin``, '' where untagged. Those with a control side pass untagged; side i is tested before side j."""
    ranges = control_coords(controls, coords)
    rows = _sides(records, coords)
    open_ = rows.filter(~((F.coalesce("era_i", F.lit("")) == CONTROL_ERA) | (F.coalesce("era_j", F.lit("")) == CONTROL_ERA)))
    hit = lambda s: _hits(open_, ranges, s, least).withColumn(f"hit_{s}", F.lit(True))
    joined = records.join(hit("i"), "match_id", "left").join(hit("j"), "match_id", "left")
    origin = F.when(F.col("hit_i"), "work_i").when(F.col("hit_j"), "work_j").otherwise("")
    return joined.withColumn("tag", F.when(origin != "", COMMONPLACE).otherwise("")).withColumn("tag_origin", origin).drop("hit_i", "hit_j")


def tag_single(records: DataFrame, controls: DataFrame, work: str, least: float = 0.5, coords: str = "local") -> DataFrame:
    """Records with ``tag``: only those that touch the focus work are tested, on its side, i first; eras are not looked at."""
    ranges = work_coords(controls, work, coords)
    rows = _sides(records, coords).filter((F.col("work_i") == work) | (F.col("work_j") == work))
    own = lambda c: F.when(F.col("work_i") == work, F.col(f"{c}_i")).otherwise(F.col(f"{c}_j")).alias(f"{c}_i")
    hit = _hits(rows.select("match_id", F.lit(work).alias("work_i"), own("page"), own("a"), own("b")), ranges, "i", least).withColumn("hit", F.lit(True))
    return records.join(hit, "match_id", "left").withColumn("tag", F.when(F.col("hit"), COMMONPLACE).otherwise("")).drop("hit")


def _tagged() -> F.Column:
    return F.count_if(F.col("tag") == COMMONPLACE)


def partner_breakdown(tagged: DataFrame, work: str) -> DataFrame:
    """(partner, total, tagged, clean, tagged_pct) of the records that touch a work; the share is null-safe and in percent."""
    rows = tagged.filter((F.col("work_i") == work) | (F.col("work_j") == work)).withColumn("partner", F.when(F.col("work_i") == work, F.col("work_j")).otherwise(F.col("work_i")))
    return rows.groupBy("partner").agg(F.count("*").alias("total"), _tagged().alias("tagged")).select("partner", "total", "tagged", (F.col("total") - F.col("tagged")).alias("clean"), (100.0 * F.col("tagged") / F.col("total")).alias("tagged_pct"))


def per_work(tagged: DataFrame) -> DataFrame:
    """(work_id, total, tagged, clean): each record counts for both its works."""
    rows = tagged.select(F.explode(F.array("work_i", "work_j")).alias("work_id"), "tag")
    return rows.groupBy("work_id").agg(F.count("*").alias("total"), _tagged().alias("tagged")).withColumn("clean", F.col("total") - F.col("tagged"))


def compare_controls(a: DataFrame, b: DataFrame, work: str) -> DataFrame:
    """(partner, pct_a, pct_b, independence_a, independence_b): two control runs side by side; a partner missing from one counts 0."""
    side = lambda df, s: partner_breakdown(df, work).select("partner", F.col("tagged_pct").alias(f"pct_{s}"))
    both = side(a, "a").join(side(b, "b"), "partner", "full_outer")
    pct = lambda s: F.coalesce(f"pct_{s}", F.lit(0.0))
    return both.select("partner", pct("a").alias("pct_a"), pct("b").alias("pct_b"), (100.0 - pct("a")).alias("independence_a"), (100.0 - pct("b")).alias("independence_b"))
