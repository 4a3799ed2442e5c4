"""Units of comparison: segments cleaned, grouped by page, cut into overlapping windows of words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.config import ERA_RANK, OTHER_ERA, STEP, UNIT_TOKENS, WINDOW
from stemmata.functions.cleaning import clean_text, with_clean_text
from stemmata.functions.text import TOKEN, normalise
from stemmata.scratch import Scratch

#: rows in a block of a running sum
BLOCK = 1024


def era_rank(era: F.Column) -> F.Column:
    out = F.lit(OTHER_ERA)
    for name, rank in ERA_RANK.items():
        out = F.when(era == name, rank).otherwise(out)
    return out


def built_works(works: DataFrame, segments: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(work_id, era, author, title, era_rank, ord): works that have segments, in order of era and id; ``only`` keeps some."""
    have = works.join(segments.select("work_id").distinct(), "work_id", "left_semi")
    if only:
        have = have.filter(F.col("work_id").isin(only))
    named = have.select("work_id", "era", "author", F.col("title_latin").alias("title"), era_rank(F.col("era")).alias("era_rank"))
    # the manifest is small by nature: one row a work
    return named.withColumn("ord", F.row_number().over(Window.orderBy("era_rank", "work_id")) - 1)


def segment_texts(segments: DataFrame, apparatus: bool = True) -> DataFrame:
    """(work_id, pos, label, text): cleaned texts, one per segment with its ref as label; empty ones are dropped."""
    cleaned = segments.filter(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("text", clean_text(F.col("text"), apparatus))
    return cleaned.filter(F.col("text") != "").select("work_id", F.col("seg_pos").alias("pos"), F.col("ref").alias("label"), "text")


def segment_words(segments: DataFrame, group_by: str = "page", apparatus: bool = True) -> DataFrame:
    """(work_id, page, label, seg_pos, words): the words of each cleaned segment and the page it belongs to: chapter and page, null and empty being the same, or the segment itself."""
    cleaned = with_clean_text(segments.filter(F.coalesce(F.col("text"), F.lit("")) != "").select("work_id", "seg_pos", "chapter", "page", "ref", "text"), apparatus)
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "").alias("words")
    ch, pg = F.coalesce("chapter", F.lit("")), F.coalesce("page", F.lit(""))
    if group_by == "segment":
        page, label = F.col("seg_pos").cast("string"), F.col("ref")
    else:
        page, label = F.concat(ch, F.lit("\0"), pg), F.trim(F.concat(ch, F.lit("/"), pg))
    return cleaned.select("work_id", page.alias("page"), label.alias("label"), F.col("seg_pos").cast("bigint").alias("seg_pos"), words)


def running(rows: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` over the rows of the same keys before it: inside blocks of ``order`` first, then over the blocks, so no key is summed in one task."""
    blocked = rows.withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = blocked.withColumn("__in", before(Window.partitionBy(*keys, "__block").orderBy(order), value))
    sums = blocked.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    starts = sums.withColumn("__start", before(Window.partitionBy(*keys).orderBy("__block"), "__sum")).drop("__sum")
    return inside.join(starts, [*keys, "__block"]).withColumn(out, F.col("__in") + F.col("__start")).drop("__block", "__in", "__start")


def window_units(segments: DataFrame, group_by: str = "page", apparatus: bool = True) -> DataFrame:
    """(work_id, unit_pos, label, text): windows of 140 words that overlap by 25 over the words of each page, '#k' in the label only where there is more than one; numbered
    inside each work in the order of the pages' first segments.

    Segments of a page come in order wherever they stand. No page is gathered: the words of a segment are counted, their place in the page is a running sum, and each segment
    sends to every window the words it has in it. Segments without words count for nothing but the page's place. Null works are left out.
    """
    scratch = Scratch(segments.sparkSession, "words")
    counted = segment_words(segments, group_by, apparatus).filter(F.col("work_id").isNotNull()).withColumn("n", F.size("words"))
    # words travel as one text: a third of the bytes of a list, and they hold no white space
    parts = scratch.put(counted.withColumn("words", F.array_join("words", " ")))
    sized = parts.select("work_id", "page", "seg_pos", "n", "label")
    pages = sized.groupBy("work_id", "page").agg(F.min("seg_pos").alias("pos"), F.sum("n").alias("total"), F.min("label").alias("label")).filter("total > 0")
    count = F.when(F.col("total") <= WINDOW, 1).otherwise(F.ceil((F.col("total") - WINDOW) / F.lit(STEP)) + 1).cast("bigint")
    pages = running(pages.withColumn("windows", count), ["work_id"], "pos", "windows", "first")
    placed = running(sized.filter("n > 0").drop("label"), ["work_id", "page"], "seg_pos", "n", "offset").join(pages, ["work_id", "page"])
    at, n, k0 = F.col("offset"), F.col("n"), F.col("first")
    low = F.greatest(F.lit(0), F.ceil((at - WINDOW + 1) / F.lit(STEP)))
    high = F.least(F.col("windows") - 1, F.floor((at + n - 1) / F.lit(STEP)))

    def part(k: Column) -> Column:
        skip = F.greatest(F.lit(0), k * STEP - at)
        return F.struct(k.alias("k"), (at + skip).alias("at"), F.array_join(F.slice("words", (skip + 1).cast("int"), (F.least(n, k * STEP + WINDOW - at) - skip).cast("int")), " ").alias("words"))

    ranges = F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))  # the last window may end before what the next would begin with
    sent = parts.select("work_id", "seg_pos", "words").join(placed, ["work_id", "seg_pos"]).withColumn("words", F.split("words", " "))
    cells = sent.select("work_id", "label", "windows", k0.alias("first"), F.explode(F.transform(ranges, part)).alias("x"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("x.at", "x.words"))), lambda c: c["words"])  # 140 words
    units = cells.groupBy("work_id", (F.col("first") + F.col("x.k")).alias("unit_pos")).agg(F.first("label").alias("label"), F.first("windows").alias("windows"), F.first("x.k").alias("k"), words.alias("words"))
    label = F.when(F.col("windows") == 1, F.col("label")).otherwise(F.concat("label", F.lit("#"), (F.col("k") + 1).cast("string")))
    return units.select("work_id", F.col("unit_pos").cast("int").alias("unit_pos"), label.alias("label"), F.array_join("words", " ").alias("text"))


def tokenised(units: DataFrame, most: int = UNIT_TOKENS) -> DataFrame:
    """Units with ``orig`` and ``norm``, their first ``most`` word tokens as stored and normalised, index for index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for b in batches:
            orig = [TOKEN.findall(t)[:most] for t in b.column("text").to_pylist()]
            flat = list(chain.from_iterable(orig))
            if len(known) > 1_000_000:
                known.clear()
            known.update((w, normalise(w)) for w in set(flat) - known.keys())
            ends = pa.array(np.r_[0, np.cumsum([len(ws) for ws in orig])].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(ws, pa.string())) for ws in (flat, [known[w] for w in flat])]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "orig", "norm"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInArrow(run, f"{schema}, orig array<string>, norm array<string>")


def build_units(segments: DataFrame, group_by: str = "page", apparatus: bool = True) -> DataFrame:
    """(work_id, unit_pos, label, text, orig, norm), those beyond the limit of a work included."""
    return tokenised(window_units(segments, group_by, apparatus))
