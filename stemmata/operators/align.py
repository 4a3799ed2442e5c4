"""Alignment of candidate units: words that agree up to a few letters, in diagonal runs fused over small gaps.

The relational form of this (token theta join, then gaps and islands along each diagonal) makes a row for every
cell of a word-by-word matrix, some 15,000 a candidate. Here the matrix of one candidate is a small boolean array in an Arrow
batch: the edit distances of all its word pairs are computed at once, bit-parallel, and only the blocks become rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemmata.config import Params

CONTEXT = 6


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distances of all pairs: each word of ``a`` is a bit pattern, all patterns advance over all of ``b`` in step."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    if not a or not b:
        return out
    la, lb = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    if la.max() > 63:  # a pattern must fit a machine word; such words are rare
        short = [i for i, n in enumerate(la) if n <= 63]
        out[short] = distances([a[i] for i in short], b)
        for i in set(range(len(a))) - set(short):
            out[i] = [_distance(a[i], w) for w in b]
        return out
    code = {c: k for k, c in enumerate(sorted(set("".join(a)) | set("".join(b))))}
    bits = np.uint32 if la.max() <= 31 else np.uint64  # the narrower the faster
    masks = np.zeros((len(code), len(a)), dtype=bits)
    for i, w in enumerate(a):
        for k, c in enumerate(w):
            masks[code[c], i] |= bits(1 << k)
    # the longest words first: those that are read to their end drop out of the rows at work
    order = np.argsort(-lb, kind="stable")
    longest = int(lb.max(initial=0))
    letters = np.zeros((longest, len(b)), dtype=np.int64)
    for row, j in enumerate(order):
        letters[: lb[j], row] = [code[c] for c in b[j]]
    at_work = [int((lb > t).sum()) for t in range(longest)]
    one = bits(1)
    last = np.where(la > 0, one << np.maximum(la - 1, 0).astype(bits), bits(0))
    plus = np.full((len(b), len(a)), ~bits(0))
    minus = np.zeros((len(b), len(a)), dtype=bits)
    score = np.repeat(la[None, :].astype(np.int32), len(b), axis=0)
    for t in range(longest):
        k = at_work[t]
        vp, vn = plus[:k], minus[:k]
        eq = masks[letters[t, :k]]
        vertical = eq | vn
        horizontal = eq & vp
        horizontal += vp
        horizontal ^= vp
        horizontal |= eq
        up = ~(horizontal | vp)
        up |= vn
        down = vp & horizontal
        score[:k] += (up & last) != 0
        score[:k] -= (down & last) != 0
        up <<= one
        up |= one
        down <<= one
        plus[:k] = ~(vertical | up) | down
        minus[:k] = up & vertical
    out[:, order] = score.T
    out[la == 0] = lb
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def _numbered(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words, and the number of each word among them."""
    seen: dict[str, int] = {}
    at = [seen.setdefault(w, len(seen)) for w in words]
    return list(seen), np.array(at, dtype=np.int64)


def cells(a: list[str], b: list[str], fuzz: float) -> np.ndarray:
    """Which words agree: equal, or lengths near enough and the ratio at least ``fuzz``."""
    da, ia = _numbered(a)
    db, ib = _numbered(b)
    la = np.array([len(w) for w in da], dtype=np.float64)[:, None]
    lb = np.array([len(w) for w in db], dtype=np.float64)[None, :]
    total = la + lb
    d = distances(da, db)
    with np.errstate(invalid="ignore", divide="ignore"):
        near = ~(np.abs(la - lb) / total > 1.0 - fuzz) & (1.0 - d / total >= fuzz)
    return ((d == 0) | near)[ia][:, ib]


@dataclass
class Blocks:
    """The blocks of one candidate, in order of diagonal and start; ``block`` numbers the cells' blocks."""

    i: np.ndarray
    j: np.ndarray
    block: np.ndarray
    n: np.ndarray
    core: np.ndarray


def blocks(matrix: np.ndarray, n_out: int) -> Blocks:
    """Maximal runs along diagonals, fused over gaps of up to ``n_out`` words. ``n`` counts the cells, ``core`` the longest run."""
    i, j = np.nonzero(matrix)
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    if not len(i):
        empty = np.empty(0, dtype=np.int64)
        return Blocks(i, j, empty, empty, empty)
    new = np.r_[True, (j - i)[1:] != (j - i)[:-1]]
    step = np.r_[0, np.diff(i)]
    run = np.cumsum(new | (step != 1)) - 1
    block = np.cumsum(new | (step > n_out + 1)) - 1
    length = np.bincount(run)
    core = np.zeros(block[-1] + 1, dtype=np.int64)
    np.maximum.at(core, block, length[run])
    return Blocks(i, j, block, np.bincount(block), core)


def has_run(matrix: np.ndarray, k: int) -> bool:
    """Whether some diagonal has k cells in a row: without one no block is kept."""
    m = matrix
    for _ in range(k - 1):
        if m.shape[0] < 2 or m.shape[1] < 2:
            return False
        m = m[:-1, :-1] & matrix[-(m.shape[0] - 1) :, -(m.shape[1] - 1) :]
    return bool(m.any())


def align_one(a: list[str], b: list[str], params: Params) -> Blocks | None:
    """The kept blocks, renumbered; None without any. The number of raw blocks is in ``raw``."""
    matrix = cells(a, b, params.fuzz)
    if not has_run(matrix, params.ngram):
        return None
    all_ = blocks(matrix, params.n_out)
    keep = (all_.core >= params.ngram) & (all_.n >= params.min_chain)
    if not keep.any():
        return None
    number = np.cumsum(keep) - 1
    on = keep[all_.block]
    found = Blocks(all_.i[on], all_.j[on], number[all_.block[on]], all_.n[keep], all_.core[keep])
    found.raw = len(all_.n)
    return found


def word_map(index: np.ndarray, block: np.ndarray) -> dict[int, int]:
    """Word to block; the last block wins."""
    return dict(zip(index.tolist(), block.tolist()))


def bridges(found: Blocks, a: list[str], b: list[str]) -> tuple[dict[int, float], dict[int, float]]:
    """Gap words inside blocks to the similarity, 0 to 100, of the two gaps they stand in."""
    left: dict[int, float] = {}
    right: dict[int, float] = {}
    for k in range(len(found.n)):
        i, j = found.i[found.block == k], found.j[found.block == k]
        for at in np.flatnonzero(np.diff(i) > 1):
            gi, gj = range(int(i[at]) + 1, int(i[at + 1])), range(int(j[at]) + 1, int(j[at + 1]))
            x, y = " ".join(a[w] for w in gi), " ".join(b[w] for w in gj)
            total = len(x) + len(y)
            fuzz = round(100.0 * (1.0 - _distance(x, y) / total), 1) if total else 100.0
            left.update(dict.fromkeys(gi, fuzz))
            right.update(dict.fromkeys(gj, fuzz))
    return left, right


def snippet(words: Column, lo: Column, hi: Column) -> Column:
    """The words from ``lo`` to ``hi`` (from 1) with six words around."""
    first = F.greatest(F.lit(1), lo - CONTEXT)
    return F.array_join(F.slice(words, first, hi + CONTEXT - first + 1), " ")


KEYS = "work_i string, work_j string, i int, j int"
RECORD = f"{KEYS}, n_blocks int, n_chained int, chain_len int, matched_words int, matched_words_j int, lo_i int, hi_i int, lo_j int, hi_j int, word_range_i string, word_range_j string"
BLOCK = f"{KEYS}, block int, a int, b int, n int, core int"
EVENT = f"{KEYS}, matched_i map<int,int>, matched_j map<int,int>, bridges_i map<int,double>, bridges_j map<int,double>"
BRIDGE = f"{KEYS}, side string, word int, fuzz double"


def with_words(candidates: DataFrame, units: DataFrame, words: str = "norm") -> DataFrame:
    """Candidates with both units' normalised words, or the column ``words`` of the units. Units are joined by their key, so no word is shuffled for a pair that is no candidate."""
    side = lambda s: units.select(F.col("work_id").alias(f"work_{s}"), F.col("unit_pos").alias(s), F.col(words).alias(f"{words}_{s}"))
    return candidates.join(side("i"), ["work_i", "i"]).join(side("j"), ["work_j", "j"])


def _each(df: DataFrame, params: Params, schema: str, rows: object) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples(index=False):
                a, b = list(r.norm_i), list(r.norm_j)
                found = align_one(a, b, params) if len(a) and len(b) else None
                if found is not None:
                    out += rows(r, found, a, b)
            yield pd.DataFrame(out, columns=names)

    return df.mapInPandas(run, schema)


def _record(r: object, f: Blocks, a: list[str], b: list[str]) -> list[tuple]:
    i, j = np.unique(f.i), np.unique(f.j)
    li, hi, lj, hj = int(i[0]), int(i[-1]), int(j[0]), int(j[-1])
    return [(r.work_i, r.work_j, r.i, r.j, f.raw, len(f.n), int(f.n.max()), len(i), len(j), li + 1, hi + 1, lj + 1, hj + 1, f"{li + 1}–{hi + 1}", f"{lj + 1}–{hj + 1}")]


def _blocks(r: object, f: Blocks, a: list[str], b: list[str]) -> list[tuple]:
    first = np.r_[True, f.block[1:] != f.block[:-1]]
    return [(r.work_i, r.work_j, r.i, r.j, k, int(x), int(y), int(n), int(c)) for k, (x, y, n, c) in enumerate(zip(f.i[first], f.j[first], f.n, f.core))]


def _bridges(r: object, f: Blocks, a: list[str], b: list[str]) -> list[tuple]:
    left, right = bridges(f, a, b)
    return [(r.work_i, r.work_j, r.i, r.j, s, w, x) for s, m in (("i", left), ("j", right)) for w, x in sorted(m.items())]


def match_records(candidates: DataFrame, units: DataFrame, params: Params) -> DataFrame:
    """One record per candidate with a kept block: chain length, counts, ranges from 1, snippets with six words around.

    The kernel reads normalised words only; the words as stored are joined to the records that it leaves.
    """
    found = _each(with_words(candidates, units), params, RECORD, _record)
    cut = lambda s: snippet(F.col(f"orig_{s}"), F.col(f"lo_{s}"), F.col(f"hi_{s}")).alias(f"snippet_{s}")
    return with_words(found, units, "orig").select(*found.columns, cut("i"), cut("j"))


def kept_blocks(candidates: DataFrame, units: DataFrame, params: Params) -> DataFrame:
    """(keys, block, a, b, n, core): kept blocks, numbered in order of diagonal and start."""
    return _each(with_words(candidates, units), params, BLOCK, _blocks)


def bridge_words(candidates: DataFrame, units: DataFrame, params: Params) -> DataFrame:
    """(keys, side, word, fuzz): the words in gaps of kept blocks."""
    return _each(with_words(candidates, units), params, BRIDGE, _bridges)


def pair_events(candidates: DataFrame, units: DataFrame, params: Params) -> DataFrame:
    """Per record the word maps of the full event: word index to block, gap word to similarity, both sides."""

    def row(r: object, f: Blocks, a: list[str], b: list[str]) -> list[tuple]:
        left, right = bridges(f, a, b)
        return [(r.work_i, r.work_j, r.i, r.j, word_map(f.i, f.block), word_map(f.j, f.block), left, right)]

    return _each(with_words(candidates, units), params, EVENT, row)
