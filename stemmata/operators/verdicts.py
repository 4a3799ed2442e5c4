"""Verdicts on records: ordered rules, given decisions, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("unverified", "verified", "false_positive")


@dataclass(frozen=True)
class Rules:
    """Floors and ceilings of the rules; None switches a rule off. A later rule overrides an earlier one."""

    fp_chain_below: int | None = None
    fp_score_below: float | None = None
    verify: tuple[str, ...] = ()
    verify_chain: int | None = None
    verify_score: float | None = None
    unverify_chain: int | None = None
    unverify_score: float | None = None


def package_names(raw: list[str]) -> tuple[str, ...]:
    """'1' means wp1; other names stay."""
    return tuple(f"wp{x}" if x.isdigit() else x for x in raw)


def apply_rules(records: DataFrame, rules: Rules) -> DataFrame:
    """Records (wp_key, chain_len, score) with ``status``. Null chains count as 0, null and NaN scores as 0."""
    chain, score = F.coalesce("chain_len", F.lit(0)), F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0))
    never = F.lit(False)
    at_least = lambda c, v, unset: F.lit(unset) if v is None else c >= F.lit(v)
    false = (chain < rules.fp_chain_below if rules.fp_chain_below is not None else never) | (score < rules.fp_score_below if rules.fp_score_below is not None else never)
    named = never
    for prefix in rules.verify:
        named = named | F.col("wp_key").startswith(prefix)
    verified = named & at_least(chain, rules.verify_chain, True) & at_least(score, rules.verify_score, True)
    again = at_least(chain, rules.unverify_chain, False) | at_least(score, rules.unverify_score, False)
    return records.withColumn("status", F.when(again, "unverified").when(verified, "verified").when(false, "false_positive").otherwise("unverified"))


def decided(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records (rel_id, status) with the latest given decision in place of the rule's; status trimmed and lower-cased, unknown ones left out."""
    clean = verdicts.withColumn("given", F.lower(F.trim("status"))).filter(F.col("given").isin(*STATUSES))
    w = Window.partitionBy("rel_id").orderBy(F.col("decided_at").desc_nulls_last(), "given")
    last = clean.withColumn("n", F.row_number().over(w)).filter("n = 1").select("rel_id", "given")
    return records.join(last, "rel_id", "left").withColumn("status", F.coalesce("given", "status")).drop("given")


def export(records: DataFrame) -> DataFrame:
    """(rel_id, status): one row per record; a record of several packages counts once, with the status of the first package by name. Records without rel_id are left out."""
    rows = records.filter(F.col("rel_id").isNotNull())
    return rows.groupBy("rel_id").agg(F.min_by("status", "wp_key").alias("status"))


def chain_bucket() -> Column:
    c = F.coalesce("chain_len", F.lit(0))
    return F.when(c < 6, "<6").when(c < 10, "6–9").when(c < 20, "10–19").otherwise("20+")


def score_bucket() -> Column:
    s = F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0))
    return F.when(s < 0.001, "<0.001").when(s < 0.01, "0.001–0.01").when(s < 0.05, "0.01–0.05").otherwise("0.05+")


def stats(records: DataFrame) -> DataFrame:
    """(dimension, bucket, n): by status, package, chain and score, in one pass."""
    rows = records.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), b.alias("bucket")) for d, b in (("status", F.col("status")), ("wp", F.col("wp_key")), ("chain", chain_bucket()), ("score", score_bucket()))])).alias("x"))
    return rows.groupBy("x.dimension", "x.bucket").agg(F.count("*").alias("n"))


def review(records: DataFrame, wp: str | None = None, chain: tuple[int | None, int | None] = (None, None), score: float | None = None, author: str | None = None) -> DataFrame:
    """Records that a reviewer asks for: package contains, chain within, score at least, author on either side contains, in any case."""
    out = records
    if wp:
        out = out.filter(F.col("wp_key").contains(wp))
    if chain[0] is not None:
        out = out.filter(F.col("chain_len") >= chain[0])
    if chain[1] is not None:
        out = out.filter(F.col("chain_len") <= chain[1])
    if score is not None:
        out = out.filter(~F.isnan("score") & (F.col("score") >= score))
    if author:
        has = lambda s: F.coalesce(F.lower(f"author_{s}").contains(author.lower()), F.lit(False))
        out = out.filter(has("i") | has("j"))
    return out
