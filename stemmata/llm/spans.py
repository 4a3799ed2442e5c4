"""Long exact spans shared between records, and the fuzzy passages around them, by collinear chaining.

1. Equal texts are one class, so copies are not paired. Of every class the seeds are kept: of each ``k`` consecutive words the sequence of
   ``seed`` words with the least number. Two texts that share k consecutive words share the seed of that stretch, at about a quarter of the
   rows that all sequences would need. A seed is a key of 64 bits and only nominates; seeds that stand in one class only go no further.
2. Classes that share a seed are paired. A seed that more than ``rare`` classes have is a formula: in its place the whole stretches of k words
   around it are joined, so a frequent short formula pairs nothing and no exact span is lost. For fuzzy passages the texts of a formula are paired besides where a chain of
   shorter spans may begin (``near``), so no chain is lost either and ``rare`` changes no result.
3. For each pair the matches of ``seed`` words are found on the words themselves, joined to exact spans, and chained by the best score: words gained less
   the cost of gaps, through a Fenwick tree over positions in the other text. The gaps inside a chain are aligned word by word. A chain is what all results rest
   on: p3_found takes the pairs with a chain that holds an exact span of k words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import reduce
from math import ceil
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.scratch import Scratch

K, SEED = 12, 6
#: for fuzzy passages: words of a seed, and of the stretches that have one each
FUZZY_SEED, WITHIN = 5, 8
#: classes that may be paired by one seed; more make it a formula, which the whole stretches around it replace
RARE = 1000
#: what a word of gap costs against a word gained
GAP_COST = 0.2
#: matches of a sequence that stands more often than this in one text are taken from its first and its last place
PLACES = 8
#: odd multipliers of the two rolling numbers (fixed values)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: sequences whose followers are listed at once
_LISTED = 1 << 13
#: words, classes and texts a task remembers before it starts anew
_KEPT = 1 << 20
_LOW = (1 << 64) - 1
#: a word as str.split has it
_WORD_JVM = r"(?U)[^\s\x1c-\x1f]+"


def rolling(words: np.ndarray, k: int, m: int) -> np.ndarray:
    """A number for every k consecutive words."""
    h = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(m) + (words[i : i + len(h)] ^ (words[i : i + len(h)] >> np.uint64(29))) * np.uint64(m ^ 0xFF51AFD7ED558CCD)
    return h


def sides(records: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(key, side, text, c1, c2, words): one row per text that is not null, with its class and its number of words.

    The class is named by two numbers of the text as stored, so one class means equal texts.
    """
    rows = records.select(key, F.posexplode(F.array(*texts)).alias("side", "text")).filter(F.col("text").isNotNull())
    return rows.withColumns({"c1": F.xxhash64("text"), "c2": F.xxhash64(F.lit(1), "text"), "words": F.regexp_count("text", F.lit(_WORD_JVM))})


class _Numbers:
    """Two independent numbers for each word, remembered."""

    def __init__(self) -> None:
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})

    def of(self, words: list[str], which: int = 0) -> np.ndarray:
        if len(self.known[0]) > _KEPT:
            self.known[0].clear()
            self.known[1].clear()
        for w in set(words).difference(self.known[0]):
            digest = xxhash.xxh3_128_intdigest(w.encode("utf-8", "surrogatepass"))
            self.known[0][w], self.known[1][w] = digest >> 64, digest & _LOW
        return np.fromiter(map(self.known[which].__getitem__, words), dtype=np.uint64, count=len(words))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive numbers."""
    return np.lib.stride_tricks.sliding_window_view(h, width).min(axis=1) if len(h) >= width else h[:0]


def seeds(texts: DataFrame, k: int = K, seed: int = SEED) -> DataFrame:
    """(h, c1, c2): the seeds of each class of (text, c1, c2); of every k consecutive words the least sequence of ``seed`` words. Texts under k words have none.

    A task passes each class on once, so copies are few when they meet.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, passed = _Numbers(), set()
        for b in batches:
            if len(passed) > _KEPT:
                passed.clear()
            names, sizes, flat = [], [], []
            for text, c1, c2 in zip(b["text"], b["c1"], b["c2"]):
                if (c1, c2) in passed:
                    continue
                passed.add((c1, c2))
                words = text.split()
                if len(words) >= k:
                    names.append((c1, c2))
                    sizes.append(len(words))
                    flat += words
            if not names:
                continue
            # all texts of the batch as one; stretches that run over a text's end are left out
            least = _least(rolling(numbers.of(flat), seed, _MULTIPLIERS[0]), k - seed + 1)
            n = np.array(sizes)
            pos = np.arange(len(least)) - np.repeat(np.cumsum(n) - n, n)[: len(least)]
            inside = np.flatnonzero(pos <= np.repeat(n - k, n)[: len(least)])
            at = np.repeat(np.arange(len(n)), n)[inside]
            h = least[inside]
            new = np.ones(len(h), dtype=bool)  # neighbouring stretches mostly have the same seed
            new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
            c = np.array(names, dtype=np.int64)[at[new]]
            yield pd.DataFrame({"h": h[new].view(np.int64), "c1": c[:, 0], "c2": c[:, 1]})

    return texts.select("text", "c1", "c2").mapInPandas(run, "h bigint, c1 bigint, c2 bigint")


def stretches(texts: DataFrame, k: int, seed: int, only: str | None = None) -> DataFrame:
    """(g1, g2, ..., pos): two numbers for every k consecutive words of each row of (text, ...); with ``only``, a column of seeds, those stretches whose seed is one of them."""
    keep = [c for c in texts.columns if c not in ("text", only)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for b in batches:
            lists = [t.split() for t in b["text"]]
            rows = np.array([i for i, words in enumerate(lists) if len(words) >= k], dtype=np.int64)
            if not len(rows):
                continue
            # all texts of the batch as one; stretches that run over a text's end are left out
            n = np.array([len(lists[i]) for i in rows])
            flat = [w for i in rows for w in lists[i]]
            first, starts = numbers.of(flat, 0), np.cumsum(n) - n
            g1, g2 = rolling(first, k, _MULTIPLIERS[0]).view(np.int64), rolling(numbers.of(flat, 1), k, _MULTIPLIERS[1]).view(np.int64)
            size = len(g1)
            pos = np.arange(size) - np.repeat(starts, n)[:size]
            inside = pos <= np.repeat(n - k, n)[:size]
            if only:
                least = _least(rolling(first, seed, _MULTIPLIERS[0]), k - seed + 1).view(np.int64)
                for row, a, m in zip(rows, starts, n):
                    inside[a : a + m] &= np.isin(least[a : a + m], b[only].iloc[row])
            at = np.flatnonzero(inside)
            owner = np.repeat(rows, n)[:size][at]
            yield pd.DataFrame({"g1": g1[at], "g2": g2[at], "pos": pos[at].astype(np.int32)} | {c: b[c].to_numpy()[owner] for c in keep})

    kinds = dict(texts.dtypes)
    return texts.mapInPandas(run, ", ".join(["g1 bigint, g2 bigint, pos int", *(f"`{c}` {kinds[c]}" for c in keep)])).select("g1", "g2", *keep, "pos")


class Fenwick:
    """Greatest (value, index) over a prefix of positions."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: float, index: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, index)
            i += i & -i

    def upto(self, i: int) -> tuple[float, int]:
        """Over positions 0..i."""
        i, out = i + 1, (float("-inf"), -1)
        while i > 0:
            if self.best[i][0] > out[0]:
                out = self.best[i]
            i -= i & -i
        return out


def runs(anchors: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Matches that follow each other on a diagonal as one exact span: (start a, start b, words), ordered by start."""
    out: list[list[int]] = []
    for a, b in sorted(anchors, key=lambda p: (p[1] - p[0], p[0])):
        if out and b - a == out[-1][1] - out[-1][0] and a <= out[-1][0] + out[-1][2]:
            out[-1][2] = a + k - out[-1][0]
        else:
            out.append([a, b, k])
    return sorted((x[0], x[1], x[2]) for x in out)


def chain(spans: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> tuple[float, list[int]]:
    """The best-scoring chain of spans that advance in both texts: (score, indexes of the spans).

    A chain gains the words of its spans and pays ``gap_cost`` for each word between them on either side. The cost splits into a
    part of the span before and a part of the span after, so the best predecessor is a prefix maximum in the tree.
    """
    ends = sorted({b + n for _, b, n in spans})
    tree = Fenwick(len(ends))
    score, back = [0.0] * len(spans), [-1] * len(spans)
    waiting = sorted(range(len(spans)), key=lambda i: spans[i][0] + spans[i][2])  # by end in a
    w = 0
    for i in sorted(range(len(spans)), key=lambda i: spans[i][0]):
        a, b, n = spans[i]
        while w < len(waiting) and spans[waiting[w]][0] + spans[waiting[w]][2] <= a:
            j = waiting[w]
            # a span that ends at or before this one begins was scored already
            tree.put(bisect_left(ends, spans[j][1] + spans[j][2]), score[j] + gap_cost * (spans[j][0] + spans[j][1] + 2 * spans[j][2]), j)
            w += 1
        upto = bisect_left(ends, b + 1) - 1
        best, j = tree.upto(upto) if upto >= 0 else (float("-inf"), -1)
        gain = best - gap_cost * (a + b)
        score[i], back[i] = (n + gain, j) if gain > 0 else (float(n), -1)
    at = max(range(len(spans)), key=lambda i: (score[i], -i))
    top, path = score[at], []
    while at >= 0:
        path.append(at)
        at = back[at]
    return top, path[::-1]


def chains(spans: list[tuple[int, int, int]], gap_cost: float = GAP_COST) -> Iterator[tuple[float, list[tuple[int, int, int]]]]:
    """The best chain of the spans not yet used, again and again until every span is in a chain: (score, spans)."""
    left = sorted(set(spans))
    while left:
        score, path = chain(left, gap_cost) if len(left) > 1 else (float(left[0][2]), [0])
        taken = set(path)
        yield score, [left[i] for i in path]
        left = [s for i, s in enumerate(left) if i not in taken]


def aligned(a: list[str], b: list[str], spans: list[tuple[int, int, int]]) -> int:
    """Words that agree in the passage from the first span of a chain to its last, gaps aligned word by word."""
    total = sum(n for _, _, n in spans)
    for (a0, b0, n0), (a1, b1, _) in zip(spans, spans[1:]):
        left, right = a[a0 + n0 : a1], b[b0 + n0 : b1]
        if left and right:
            total += sum(m.size for m in SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks())
    return total


def places(words: list[str], n: int) -> dict[tuple[str, ...], list[int]]:
    """Where each sequence of n words stands."""
    out: dict[tuple[str, ...], list[int]] = {}
    for i in range(len(words) - n + 1):
        out.setdefault(tuple(words[i : i + n]), []).append(i)
    return out


def exact_spans(a: dict[tuple[str, ...], list[int]], b: dict[tuple[str, ...], list[int]], words: tuple[list[str], list[str]], k: int, seed: int) -> list[tuple[int, int, int]]:
    """The exact spans of ``seed`` words or more of two texts, given by the places of their sequences.

    A sequence that stands more than PLACES times in a text meets the other text from its first and last place only, so two texts that repeat themselves have no product of places. If
    that hides every span of k words, the first such span of the second text is added.
    """
    hits, many = [], False
    for gram in a.keys() & b.keys():
        pa_, pb_ = a[gram], b[gram]
        if len(pa_) > PLACES or len(pb_) > PLACES:
            many = True
            pa_, pb_ = ([p[0], p[-1]] if len(p) > PLACES else p for p in (pa_, pb_))
        hits += [(x, y) for x in pa_ for y in pb_]
    out = runs(hits, seed)
    if many and not any(n >= k for _, _, n in out):
        first = places(words[0], k)
        y = next((i for i in range(len(words[1]) - k + 1) if tuple(words[1][i : i + k]) in first), None)
        if y is not None:
            x = first[tuple(words[1][y : y + k])][0]
            out = runs([*hits, *((x + i, y + i) for i in range(k - seed + 1))], seed)
    return out


def _name(df: DataFrame, side: str, *columns: str) -> DataFrame:
    return df.select(F.col("c1").alias(f"{side}1"), F.col("c2").alias(f"{side}2"), *[F.col(c).alias(f"{c}_{side}") for c in columns])


_CLASS = ["c1", "c2"]
_PAIR = ["a1", "a2", "b1", "b2"]


def _both(left: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of different classes in (c1, c2, on) that meet, (a1, a2) < (b1, b2)."""
    met = _name(left, "a", *on).join(_name(left, "b", *on), reduce(and_, [F.col(f"{c}_a") == F.col(f"{c}_b") for c in on]))
    return met.filter("a1 < b1 OR (a1 = b1 AND a2 < b2)").select(*_PAIR)


def linked_seeds(texts: DataFrame, scratch: Scratch, k: int, seed: int) -> DataFrame:
    """(h, c1, c2), written: the seeds that more than one task or class has; those of a single class among them pair nothing."""
    found = scratch.put(seeds(texts, k, seed))
    shared = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    return scratch.put(found.join(shared, "h").distinct())


def class_texts(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(c1, c2, text): one text of each of the ``classes`` (c1, c2, distinct)."""
    return texts.select(*_CLASS, "text").join(classes, _CLASS, "left_semi").dropDuplicates(_CLASS)


def followers(texts: DataFrame, k: int, seed: int, only: str) -> DataFrame:
    """(g1, g2, after, before, apart, dense, c1, c2): of each row of (text, c1, c2, only) two sequences of ``seed`` words whose numbers the column ``only`` lists, as near to each
    other as the first two spans of a chain, each under k words, can have the last sequence of the one and the first of the other; the word after the one and that before the other,
    empty at the ends of the text; whether they are ``apart``, in this order without a common word. Rows may repeat.

    A chain goes on from a span only while the gaps on both sides together cost less than its words. In ``dense`` texts, with a sequence in more than PLACES places, ``exact_spans``
    may cut a span, which then runs on by k - 1 - seed words at most and may reach into the next.
    """
    low, high = seed - 2 * (k - 1 - seed), seed + ceil((k - 1) / GAP_COST)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Numbers()
        for b in batches:
            lists = [t.split() for t in b["text"]]
            n = np.array([len(words) for words in lists], dtype=np.int64)
            starts, owner = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            flat = [w for words in lists for w in words]
            h = rolling(numbers.of(flat), seed, _MULTIPLIERS[0]).view(np.int64)
            inside, dense = np.zeros(len(h), dtype=bool), np.zeros(len(n), dtype=bool)
            for row, (a, m, wanted) in enumerate(zip(starts, n, b[only])):
                own = h[a : a + m - seed + 1]
                inside[a : a + m - seed + 1] = np.isin(own, wanted)
                dense[row] = np.unique(own, return_counts=True)[1].max() > PLACES
            at = np.flatnonzero(inside)
            words = np.array([*flat, ""], dtype=object)
            of = np.append(owner, -1)
            c1, c2 = b["c1"].to_numpy(), b["c2"].to_numpy()
            for i in range(0, len(at), _LISTED):
                p = at[i : i + _LISTED]
                least, most = np.searchsorted(at, p + low), np.searchsorted(at, p + high, "right")
                size = most - least
                q = at[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(least, size)]
                p = np.repeat(p, size)
                same = owner[p] == owner[q]
                p, q = p[same], q[same]
                after = np.where(of[p + seed] == owner[p], words[p + seed], "")
                before = np.where(of[q - 1] == owner[q], words[q - 1], "")
                yield pd.DataFrame({"g1": h[p], "g2": h[q], "after": after, "before": before, "apart": q - p >= seed, "dense": dense[owner[p]], "c1": c1[owner[p]], "c2": c2[owner[p]]}).drop_duplicates()

    return texts.select("text", *_CLASS, only).mapInPandas(run, "g1 bigint, g2 bigint, after string, before string, apart boolean, dense boolean, c1 bigint, c2 bigint")


def _followed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2), some more than once: pairs of classes of ``followers`` with the same two sequences, if the words after the one differ and those before the other do."""
    key, ends = ["g1", "g2"], ["after", "before"]
    side = lambda df, s, *more: df.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in (*ends, *more)])
    differ = [(F.col(f"{c}_a") == "") | (F.col(f"{c}_a") != F.col(f"{c}_b")) for c in ends]
    # texts that go on alike are one here
    met = side(left, "a").distinct().join(side(right, "b").distinct(), key).filter(reduce(and_, differ))
    met = met.join(side(left, "a", *_CLASS), [*key, *[f"{c}_a" for c in ends]]).join(side(right, "b", *_CLASS), [*key, *[f"{c}_b" for c in ends]])
    x, y = (F.struct(F.col(f"c1_{s}").alias("c1"), F.col(f"c2_{s}").alias("c2")) for s in "ab")
    ordered = met.filter(x != y).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    return ordered.select(F.col("a.c1").alias("a1"), F.col("a.c2").alias("a2"), F.col("b.c1").alias("b1"), F.col("b.c2").alias("b2"))


def near(around: DataFrame, scratch: Scratch, k: int, seed: int, rare: int) -> DataFrame:
    """(a1, a2, b1, b2), (a1, a2) < (b1, b2): of the texts (c1, c2, seeds, text), those with a common seed among ``seeds`` that may have a chain of k words without k consecutive ones.

    Such a chain has two spans under k words near each other. Where the last sequence of the first or the first one of the second is in no more than ``rare`` texts, that
    sequence pairs them; where both are in more, the two together do, if the words that end the spans differ. Texts that share nothing but a formula are not paired.
    """
    grams = scratch.put(stretches(around.select("text", *_CLASS), seed, seed).select(F.col("g1").alias("h"), *_CLASS).distinct())
    counts = scratch.put(grams.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"))
    few = _both(grams.join(counts.filter(F.col("n") <= rare).select("h"), "h"), ["h"])
    held = grams.join(counts.filter(F.col("n") > rare).select("h"), "h").groupBy(*_CLASS).agg(F.collect_list("h").alias("many"))  # bounded: the sequences of one text
    links = scratch.put(followers(around.select("text", *_CLASS).join(held, _CLASS), k, seed, "many").distinct())
    many = _followed(links.filter("apart"), links.filter("apart")).unionByName(_followed(links.filter("dense"), links))
    pairs = few.unionByName(many).distinct()
    return pairs.join(_name(around, "a", "seeds"), ["a1", "a2"]).join(_name(around, "b", "seeds"), ["b1", "b2"]).filter(F.arrays_overlap("seeds_a", "seeds_b")).select(*_PAIR)


def candidates(texts: DataFrame, scratch: Scratch, k: int = K, seed: int = SEED, rare: int = RARE, within: int = K, fuzzy: bool = False) -> DataFrame:
    """(a1, a2, b1, b2), written: classes that share a seed, (a1, a2) < (b1, b2); of formulas, those that share k words around it and, for ``fuzzy`` passages, those whose spans may
    make a chain of k words. Each stretch of ``within`` words has a seed."""
    linked = linked_seeds(texts, scratch, min(k, within), seed)
    formulas = scratch.put(linked.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > rare).select("h"))
    usual = _both(linked.join(formulas, "h", "left_anti"), ["h"])
    held = linked.join(formulas, "h").groupBy(*_CLASS).agg(F.collect_list("h").alias("seeds"))  # bounded: the seeds of one text
    around = class_texts(texts, held.select(*_CLASS)).join(held, _CLASS)
    found = [usual]
    if fuzzy and k > seed and not formulas.isEmpty():  # a span of k words is all there is to a chain where seeds have as many
        around = scratch.put(around)
        found.append(near(around, scratch, k, seed, rare))
    longer = stretches(around, k, seed, "seeds").select("g1", "g2", *_CLASS).distinct()
    return scratch.put(reduce(DataFrame.unionByName, [*found, _both(longer, ["g1", "g2"])]).distinct())


def passages(texts: DataFrame, scratch: Scratch, k: int = K, seed: int = SEED, rare: int = RARE, within: int = K, fuzzy: bool = True) -> DataFrame:
    """(a1, a2, b1, b2, chain, score, exact, longest, matched, passage_a, passage_b): the chains of classes that share a passage, (a1, a2) < (b1, b2).

    A chain counts if k words or more of it agree: ``exact`` words in exact spans of ``seed`` words or more, the ``longest`` of which is given, ``matched`` with those in the gaps
    between them. Without ``fuzzy`` only the first chain with an exact span of k words comes out, and gaps are not aligned (matched is exact).
    """
    pairs = candidates(texts, scratch, k, seed, rare, within, fuzzy)
    needed = _name(pairs.select(F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionByName(pairs.select(F.col("b1").alias("c1"), F.col("b2").alias("c2"))).distinct(), "x")
    read = scratch.put(class_texts(texts, needed.select(F.col("x1").alias("c1"), F.col("x2").alias("c2"))))
    both = pairs.join(_name(read, "a", "text"), ["a1", "a2"]).join(_name(read, "b", "text"), ["b1", "b2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], tuple[list[str], dict[tuple[str, ...], list[int]]]] = {}
        size = 0

        def of(name: tuple[int, int], text: str) -> tuple[list[str], dict[tuple[str, ...], list[int]]]:
            nonlocal size
            got = known.get(name)
            if got is None:
                words = text.split()
                if size > _KEPT:
                    known.clear()
                    size = 0
                size += len(words)
                got = known[name] = words, places(words, seed)
            return got

        for batch in batches:
            at, out = [], []
            names = [batch.column(c).to_pylist() for c in _PAIR]
            for row, (a1, a2, b1, b2, x, y) in enumerate(zip(*names, batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())):
                (x, in_x), (y, in_y) = of((a1, a2), x), of((b1, b2), y)
                no = 0
                for score, path in chains(exact_spans(in_x, in_y, (x, y), k, seed)):
                    exact, longest = sum(n for _, _, n in path), max(n for _, _, n in path)
                    if not fuzzy and longest < k:
                        continue
                    matched = aligned(x, y, path) if fuzzy and len(path) > 1 else exact
                    if matched < k:
                        continue
                    (a0, b0, _), (a_, b_, n) = path[0], path[-1]
                    at.append(row)
                    out.append((no, score, exact, longest, matched, a_ + n - a0, b_ + n - b0))
                    no += 1
                    if not fuzzy:
                        break
            kept = batch.select(_PAIR).take(pa.array(at, pa.int64()))
            columns = list(zip(*out)) if out else [()] * 7
            types = (pa.int32(), pa.float64(), *[pa.int32()] * 5)
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(columns, types))], [*_PAIR, "chain", "score", "exact", "longest", "matched", "passage_a", "passage_b"])

    return both.select(*_PAIR, "text_a", "text_b").mapInArrow(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint, chain int, score double, exact int, longest int, matched int, passage_a int, passage_b int")


def fuzzy_passages(texts: DataFrame, key: str, k: int = K, seed: int = FUZZY_SEED, rare: int = RARE, within: int = WITHIN) -> DataFrame:
    """(a1, a2, key_a, side_a, b1, b2, key_b, side_b, chain, score, exact, longest, matched, passage_a, passage_b): the chains of every two linked classes of ``sides``.

    (a1, a2) and (b1, b2) are classes of equal texts; ``class_members`` tells which records have them. Each is shown by its text with the least key, or by the
    one with the greatest where both would be of one record and another record has the class. Chain 0 is the best one of the pair, further ones follow until
    every span is in a chain; see ``passages`` for what counts. A class that several records have comes out with itself, too, as one chain of the whole text. matched / passage tells
    how close a passage is. Classes that share k consecutive words are always found, and so are chains of k words of classes that share ``within`` consecutive ones, however many
    have them; of those that only share shorter spans most are, the more spans the surer.
    Null texts and texts under k words link nothing; an empty table gives an empty table.
    """
    scratch = Scratch(texts.sparkSession, "passages")
    long = texts.filter(F.col("words") >= k)
    found = passages(long, scratch, k, seed, rare, within)
    own = F.struct(key, "side")
    ends = scratch.put(long.groupBy(*_CLASS).agg(F.min(own).alias("least"), F.max(own).alias("greatest"), F.min("words").alias("words")))
    copies = ends.filter(F.col(f"least.{key}") != F.col(f"greatest.{key}"))
    whole = {c: F.col("words").cast("int") for c in ("exact", "longest", "matched", "passage_a", "passage_b")} | {"chain": F.lit(0), "score": F.col("words").cast("double")}
    same = copies.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2"), *[c.alias(n) for n, c in whole.items()])
    met = F.col(f"least_a.{key}") == F.col(f"least_b.{key}")
    other = lambda s: F.col(f"greatest_{s}.{key}") != F.col(f"least_{s}.{key}")
    both = found.unionByName(same).join(_name(ends, "a", "least", "greatest"), ["a1", "a2"]).join(_name(ends, "b", "least", "greatest"), ["b1", "b2"])
    both = both.withColumn("shown_b", F.when(met & other("b"), F.col("greatest_b")).otherwise(F.col("least_b"))).withColumn("shown_a", F.when(met & ~other("b") & other("a"), F.col("greatest_a")).otherwise(F.col("least_a")))
    numbers = ("chain", "score", "exact", "longest", "matched", "passage_a", "passage_b")
    return both.select("a1", "a2", F.col(f"shown_a.{key}").alias(f"{key}_a"), F.col("shown_a.side").alias("side_a"), "b1", "b2", F.col(f"shown_b.{key}").alias(f"{key}_b"), F.col("shown_b.side").alias("side_b"), *numbers)


def class_members(texts: DataFrame, key: str, k: int = K) -> DataFrame:
    """(c1, c2, key, side, words): every text of k words or more with its class, those without a partner included, so ``fuzzy_passages`` names all linked records."""
    return texts.filter(F.col("words") >= k).select(*_CLASS, key, "side", "words")


def record_pairs(records: DataFrame, key: str, texts: list[str], k: int = K, seed: int = SEED, rare: int = RARE) -> DataFrame:
    """(key_a, key_b) with key_a < key_b: every two records of which some text of one shares k consecutive words with some text of the other.

    Null texts and texts under k words link nothing. Records with an equal text of k words or more are linked too. Words compare
    as stored. Repeated keys are one record; an empty table gives an empty table. The output holds a row for each linked pair, as its definition asks; up
    to there, equal texts are one class.
    """
    scratch = Scratch(records.sparkSession, "pairs")
    sided = sides(records, key, texts).filter(F.col("words") >= k)
    pairs = passages(sided, scratch, k, seed, rare, fuzzy=False).select(*_PAIR)
    names = scratch.put(sided.select(*_CLASS, key))
    in_a = names.select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col(key).alias("x"))
    in_b = names.select(F.col("c1").alias("b1"), F.col("c2").alias("b2"), F.col(key).alias("y"))
    across = pairs.join(in_a, ["a1", "a2"]).join(in_b, ["b1", "b2"]).select("x", "y")
    within = names.select(*_CLASS, F.col(key).alias("x")).join(names.select(*_CLASS, F.col(key).alias("y")), _CLASS).filter("x < y").select("x", "y")
    both = across.unionByName(within).filter("x <> y")
    return both.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()


def covered(pos: Column, k: int) -> Column:
    """struct(total, longest): words in stretches of k words that start at the ordered positions ``pos``, and the longest run of such words."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("longest"), F.lit(-1).alias("first"), F.lit(-1).alias("end"))

    def step(acc: Column, p: Column) -> Column:
        first = F.when(p > acc["end"], p).otherwise(acc["first"])
        return F.struct((acc["total"] + p + k - F.greatest(p, acc["end"])).alias("total"), F.greatest(acc["longest"], p + k - first).alias("longest"), first.alias("first"), (p + k).alias("end"))

    return F.aggregate(pos, start, step)


def shared_part(records: DataFrame, key: str, texts: list[str], carry: list[str], k: int = K, seed: int = SEED) -> DataFrame:
    """(key, carry, words, shared_words, longest, shared): how much of each record's texts stands in other records' texts too.

    A word is shared if it lies in a stretch of k words that stands verbatim in a text of another record; what is shared only between a record's own
    texts does not count. longest is the longest run of shared words in one text. Every record comes out, those that share nothing with 0. Keys must be unique.

    No records are paired: a stretch that two records have is shared for all that have it. Only classes with a common seed or with copies have their stretches
    listed. A null key comes out with 0 and is no other record to anyone.
    """
    scratch = Scratch(records.sparkSession, "shared")
    sided = sides(records, key, texts)
    long = sided.filter(F.col("words") >= k)
    owned = long.groupBy(*_CLASS).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    touched = linked_seeds(long, scratch, k, seed).select(*_CLASS).distinct()
    all_ = scratch.put(stretches(class_texts(long, touched).join(owned, _CLASS), k, seed))
    foreign = all_.groupBy("g1", "g2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("g1", "g2")
    hit = all_.select("g1", "g2", *_CLASS, "pos").join(foreign, ["g1", "g2"], "left_semi").groupBy(*_CLASS).agg(F.array_sort(F.collect_list("pos")).alias("pos"))  # bounded by the text's own positions
    spans = hit.withColumn("got", covered(F.col("pos"), k)).select(*_CLASS, "got.total", "got.longest")
    copied = owned.filter("lo <> hi").select(*_CLASS, F.lit(True).alias("copied"))
    rows = sided.select(key, *_CLASS, "words").join(spans, _CLASS, "left").join(copied, _CLASS, "left")
    got = lambda c: F.when(F.col("copied"), F.col("words")).otherwise(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    summed = rows.groupBy(key).agg(F.sum("words").alias("words"), F.sum(got("total")).alias("shared_words"), F.max(got("longest")).alias("longest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = records.select(key, *carry).join(summed, key, "left").select(key, *carry, *[zero(c) for c in ("words", "shared_words", "longest")])
    return out.withColumn("shared", F.when(F.col("words") > 0, F.col("shared_words") / F.col("words")).otherwise(0.0))
