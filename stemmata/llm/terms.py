"""How characteristic each term is of a record against all records."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.functions.text import tokens
from stemmata.scratch import Scratch

#: a term in more than one of HEAVY_SHARE postings is joined by broadcast, so at most this many terms are
HEAVY_SHARE = 2000


def term_counts(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, term, tf, n_terms, first): one row per record and distinct normalised token; n_terms is the record's number of tokens, first marks one row of each record.

    Counted where the rows lie, so a record's postings are pre-aggregated before any shuffle. Null and blank texts give no rows.
    """
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[text].notna()]
            if b.empty:
                continue
            counts = [Counter(tokens(t)) for t in b[text]]
            out = {k: b[k] for k in keys}
            yield pd.DataFrame(out | {"terms": [list(c) for c in counts], "tfs": [list(c.values()) for c in counts], "n_terms": [sum(c.values()) for c in counts]})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", terms array<string>, tfs array<int>, n_terms int"
    listed = rows.select(*keys, text).mapInPandas(run, schema)
    spread = listed.select(*keys, "n_terms", F.posexplode(F.arrays_zip("terms", "tfs")).alias("at", "x"))
    return spread.select(*keys, F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"), "n_terms", (F.col("at") == 0).alias("first"))


def tf_idf(rows: DataFrame, keys: list[str], text: str = "text", *, heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """(keys, term, tf, n_terms, df, score): score = tf / n_terms * (ln((1 + N) / (1 + df)) + 1).

    N is the number of records with at least one token, df the number of them that have the term (``keys`` must be unique). The
    distinct term-record counts are written once, counted by term with map-side sums, and joined back. A term in more than
    1 / ``heavy_share`` of all postings would be a hot join key; there are at most ``heavy_share`` of these, so
    their counts are broadcast and only the rest is joined by shuffle. Null keys are kept as they are; an empty table gives an empty table.
    """
    scratch = Scratch(rows.sparkSession, "terms")
    postings = scratch.put(term_counts(rows, keys, text))
    df = scratch.put(postings.groupBy("term").agg(F.count("*").alias("df")))
    total = df.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).collect()[0]["n"]  # one row
    n = postings.filter("first").count()
    limit = max(1, total // heavy_share)
    # proven bound: fewer than heavy_share terms can each have more than total / heavy_share postings
    heavy = F.broadcast(df.filter(F.col("df") > limit))
    light = df.filter(F.col("df") <= limit)
    common = postings.join(heavy, "term")
    rare = postings.join(F.broadcast(heavy.select("term")), "term", "left_anti").join(light, "term")
    score = F.col("tf") / F.col("n_terms") * (F.log((F.lit(1.0) + F.lit(n)) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    return common.unionByName(rare).select(*keys, "term", "tf", "n_terms", "df", score.alias("score"))


def shared_rare(scored: DataFrame, keys: list[str], *, letters: int = 5, least_tf: int = 3, least_df: int = 2, most_df: int = 6) -> DataFrame:
    """(keys, term): terms of at least ``letters`` characters, letters only, frequent here and in few records."""
    word = F.col("term")
    only = word.rlike(r"^\p{L}+$") & (F.char_length(word) >= letters)
    return scored.filter(only & (F.col("tf") >= least_tf) & F.col("df").between(least_df, most_df)).select(*keys, "term")
