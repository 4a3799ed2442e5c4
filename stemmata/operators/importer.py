"""Turning plain texts into segments: the foreign tail cut off, folios as segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.functions.text import SPACE_JVM

# Fixed values of the tail rule: window, step, share of Greek that counts as low, length of the low stretch, reach of the adjustment; folio marks, Greek letters
# that count, headings of an apparatus or excursus.
WINDOW, STEP, LOW, RUN, REACH = 500, 100, 0.20, 3000, 1500
FOLIO = r"f\s+(\d+[rv]+)\b"
_GREEK = re.compile(r"[α-ωίϊϋόύώάέή]")
_HEADING = re.compile(r"\s+\d+\s+(?:ante|cf\.|cf|Vgl|vgl)|\s+(?:Drei|Zwei|Ein)\s+Exkurse")

GREEK = frozenset(c for c in map(chr, range(0x370, 0x400)) if _GREEK.fullmatch(c))


def tail_cut(text: str) -> int:
    """Where the foreign tail of a Greek text begins; its length if there is none.

    The share of Greek letters in windows of 500 characters, every 100, each averaged with its neighbours; the tail begins at the first of a stretch of
    low shares of 3,000 characters. The cut moves back to the last sentence end, and to a heading of the apparatus, within 1,500 characters.
    """
    n = len(text)
    starts = np.arange(0, max(0, n - WINDOW), STEP)
    if not len(starts):
        return n
    codes = np.array([c in GREEK for c in text], dtype=np.int64)
    latin = np.array([c.isascii() and c.isalpha() for c in text], dtype=np.int64)
    before = lambda x: np.r_[0, np.cumsum(x)]
    g, l = before(codes), before(latin)
    greek, other = g[starts + WINDOW] - g[starts], l[starts + WINDOW] - l[starts]
    share = greek / (greek + other + 1)
    padded, weight = np.r_[0, share, 0], np.r_[0, np.ones(len(share)), 0]
    smooth = (padded[:-2] + padded[1:-1] + padded[2:]) / (weight[:-2] + weight[1:-1] + weight[2:])
    low = np.r_[False, smooth < LOW, False]
    edges = np.flatnonzero(low[1:] != low[:-1])
    long = [a for a, b in zip(edges[::2], edges[1::2]) if (b - a) * STEP >= RUN]
    if not long:
        return n
    cut = int(starts[long[0]])
    end = max(text.rfind(c, 0, cut) for c in "·.;")
    if end > cut - REACH:
        cut = end + 1
    heading = _HEADING.search(text, 0, cut)
    if heading and heading.start() > cut - REACH:
        cut = heading.start()
    return len(text[:cut].rstrip())


def trim_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, length, cut): texts without their foreign tail; null texts stay null."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cut = [tail_cut(t) if t is not None else 0 for t in b[text]]
            yield pd.DataFrame({key: b[key], text: [t if t is None else t[:c] for t, c in zip(b[text], cut)], "length": [len(t) if t is not None else 0 for t in b[text]], "cut": cut})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, `{text}` string, length int, cut int")


def folio_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, page, text): what stands between the folio marks; before the first it is 'prefatio', without any mark the page is ''. Empty stretches are dropped."""
    marks = F.regexp_extract_all(text, F.lit(FOLIO), F.lit(1))
    cut = docs.filter(F.col(text).isNotNull()).select(key, marks.alias("marks"), F.split(text, FOLIO).alias("parts"))
    rows = cut.select(key, "marks", F.posexplode("parts").alias("pos", "part"))
    page = F.when(F.size("marks") == 0, "").when(F.col("pos") == 0, "prefatio").otherwise(F.get("marks", F.col("pos") - 1))
    return rows.select(key, "pos", page.alias("page"), F.trim(F.regexp_replace("part", SPACE_JVM, " ")).alias("text")).filter(F.col("text") != "")
