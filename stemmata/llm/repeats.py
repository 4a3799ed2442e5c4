"""Repetition inside a single document.

Two measures. ``repeat_share`` is exact: the share of a text's tokens that lie in a sequence of ``width``
tokens which starts at an earlier token too. ``divergence`` compares a text's histograms of character classes and of common words
with those of its language by Jensen-Shannon distance: a cheap sign of spam or broken generation that does
not depend on order. A histogram cannot tell a repeated passage from two passages of the same
words, so the share, not the distance, decides what is a repeat.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions.text import normalise, tokens
from stemmata.scratch import Scratch

WIDTH = 8
SHARE = Fraction(1, 4)
#: texts under this many tokens have no stable histogram and get no distance
LEAST_TOKENS = 50
#: words per language in the reference histogram
COMMON = 50
CLASSES = ("vowel", "consonant", "digit", "space", "punctuation", "symbol", "mark", "other")
_VOWELS = frozenset("aeiouyαεηιουω")


def repeated(ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each token whether it lies in a repeat. Sequences get exact numbers by doubling, no hashes."""
    n = len(ids) - width + 1
    hit = np.zeros(len(ids), dtype=bool)
    if n < 2:
        return hit
    # number every sequence of `width` tokens: join numbers of halves, then of what is left
    number, have = ids, 1
    while have < width:
        step = min(have, width - have)
        left, right = number[: len(number) - step], number[step:]
        number = np.unique(left * np.int64(int(number.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        have += step
    first = np.full(int(number.max()) + 1, n, dtype=np.int64)
    np.minimum.at(first, number, np.arange(n))
    again = first[number] < np.arange(n)
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return np.cumsum(cover)[:-1] > 0


def share(text: str | None, width: int = WIDTH, least: Fraction = Fraction(0)) -> tuple[int, int]:
    """(tokens, tokens in a repeat), the latter 0 where the text's histogram shows that fewer than ``least`` of its tokens can lie in a repeat."""
    words = tokens(text) if text else []
    n = len(words)
    if n <= width:
        return n, 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    # each token of a repeat stands earlier too, so the histogram of words bounds them: those that are not first of their kind
    if n - len(seen) < max(width, least * n):
        return n, 0
    return n, int(repeated(ids, width).sum())


def repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = WIDTH) -> DataFrame:
    """(key, n_tokens, n_repeated, repeat_share): one row per row of ``docs``.

    Null, empty and blank texts, and those of up to ``width`` tokens, have a share of 0. Whole texts, one at a time, map-side
    only: no shuffle, so no key can be hot. Repeated rows each give a row; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [share(t, width) for t in b[text]]
            n = np.array([x for x, _ in got], dtype=np.int64)
            r = np.array([x for _, x in got], dtype=np.int64)
            yield pd.DataFrame({key: b[key], "n_tokens": n, "n_repeated": r, "repeat_share": r / np.maximum(n, 1)})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_tokens bigint, n_repeated bigint, repeat_share double")


def repetitive(docs: DataFrame, key: str = "doc_id", text: str = "text", *, width: int = WIDTH, least: Fraction = SHARE) -> DataFrame:
    """(key, n_tokens, n_repeated): the rows of ``docs`` of whose tokens at least ``least`` lie in a repeat.

    The histogram of a text's words bounds its repeats from above; only texts that pass the bound have their sequences compared. Whole numbers decide, so exactly a quarter is a quarter.
    Texts without tokens are never repetitive; otherwise as ``repetition``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [share(t, width, least) for t in b[text]]
            keep = np.array([n > 0 and r >= least * n for n, r in got], dtype=bool)
            yield pd.DataFrame({key: b[key][keep], "n_tokens": [n for n, r in got if n > 0 and r >= least * n], "n_repeated": [r for n, r in got if n > 0 and r >= least * n]})

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_tokens bigint, n_repeated bigint")


def _class_of(c: str) -> int:
    if c.isalpha():
        return 0 if c in _VOWELS else 1
    if c.isdigit():
        return 2
    if c.isspace():
        return 3
    return {"P": 4, "S": 5, "M": 6}.get(unicodedata.category(c)[0], 7)


def class_histogram(text: str, known: dict[str, int]) -> list[int]:
    out = [0] * len(CLASSES)
    for c, n in Counter(normalise(text)).items():
        if c not in known:
            known[c] = _class_of(c)
        out[known[c]] += n
    return out


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """The distance (root of the divergence to base 2) between two histograms; 0 to 1, NaN where one is empty."""
    if not p.sum() or not q.sum():
        return float("nan")
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def against(x: np.ndarray) -> float:
        at = x > 0
        return float((x[at] * np.log2(x[at] / m[at])).sum())

    return float(np.sqrt(max(0.0, (against(p) + against(q)) / 2)))


def _sums(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, item, n): how often each character class ('class') and each word ('word') stands in each language, summed by batch before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for b in batches:
            rows: list[tuple[str, str, str, int]] = []
            for name, texts in b[b[text].notna()].groupby(lang)[text]:
                classes, words = np.zeros(len(CLASSES), dtype=np.int64), Counter()
                for t in texts:
                    classes += class_histogram(t, known)
                    words.update(tokens(t))
                rows += [(name, "class", c, int(n)) for c, n in zip(CLASSES, classes)]
                rows += [(name, "word", w, n) for w, n in words.items()]
            yield pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])

    return docs.select(lang, text).mapInPandas(run, "lang string, kind string, item string, n bigint").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))


def references(docs: DataFrame, text: str, lang: str, common: int = COMMON) -> DataFrame:
    """(lang, classes, words, counts, total): per language its character classes, its ``common`` most frequent words with their counts, and all words' number."""
    sums = Scratch(docs.sparkSession, "references").put(_sums(docs, text, lang))
    of = lambda c: F.coalesce(F.sum(F.when(F.col("item") == c, F.col("n"))), F.lit(0))
    classes = sums.filter("kind = 'class'").groupBy("lang").agg(F.array(*[of(c) for c in CLASSES]).alias("classes"))
    words = sums.filter("kind = 'word'")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "item"))
    top = words.withColumn("rank", rank).filter(F.col("rank") <= common)
    heads = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("item", "n"))).alias("top"))  # `common` entries each
    listed = heads.select("lang", F.col("top.item").alias("words"), F.col("top.n").alias("counts"))
    return classes.join(total, "lang").join(listed, "lang")


def divergence(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", *, least_tokens: int = LEAST_TOKENS, common: int = COMMON) -> DataFrame:
    """(key, lang, n_tokens, class_distance, word_distance): Jensen-Shannon distances of each text to its language.

    The references are summed over all texts of a language: the character classes, and its ``common`` most frequent words
    (ties by word) with all others as one class. A null language is one of its own. Texts under ``least_tokens`` tokens, null texts among them, get null
    distances. An empty table gives an empty table. A language that holds most rows is pre-aggregated map-side; only sums are shuffled.
    """
    label = "__lang"
    rows = docs.select(key, F.coalesce(F.col(lang).cast("string"), F.lit("")).alias(label), text)
    refs = Scratch(docs.sparkSession, "divergence").put(references(rows, text, label, common))
    named = refs.select(F.col("lang").alias(label), *[F.col(c).alias(f"__{c}") for c in ("classes", "words", "counts", "total")])
    joined = rows.join(named, label, "left")
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        of: dict[str, tuple[np.ndarray, dict[str, int], np.ndarray]] = {}
        for b in batches:
            n, far = [], []
            for name, t, classes, words, counts, total in zip(b[label], b[text], b["__classes"], b["__words"], b["__counts"], b["__total"]):
                own = tokens(t) if t is not None else []
                n.append(len(own))
                if len(own) < least_tokens:
                    far.append((None, None))
                    continue
                if name not in of:
                    of[name] = np.asarray(classes, dtype=float), {w: i for i, w in enumerate(words)}, np.append(np.asarray(counts, dtype=float), total - sum(counts))
                ref, place, theirs = of[name]
                mine = np.zeros(len(theirs))
                for w, c in Counter(own).items():
                    mine[place.get(w, len(place))] += c
                far.append((jensen_shannon(np.asarray(class_histogram(t, known), dtype=float), ref), jensen_shannon(mine, theirs)))
            yield pd.DataFrame({key: b[key], lang: b[label], "n_tokens": n, "class_distance": pd.Series([x for x, _ in far], dtype="float64"), "word_distance": pd.Series([x for _, x in far], dtype="float64")})

    found = joined.mapInPandas(run, f"`{key}` {kind}, `{lang}` string, n_tokens bigint, class_distance double, word_distance double")
    # pandas turns null distances into NaN on the way
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(key, F.when(F.col(lang) != "", F.col(lang)).alias(lang), "n_tokens", number("class_distance"), number("word_distance"))
