"""Candidates and their alignment in one pass over pairs of blocks of units, so no bigram and no word is shuffled for a pair.

A block is one row: the words of up to BLOCK units as numbers into the block's own list of distinct words. Two blocks meet in
a product of rows; there the common bigrams are counted on arrays, and the candidates are aligned. Words that may agree are found by the letters
they share, a bound below the edit distance; distances are computed for these only, once for each two words of a batch. What is left out
is proved not to count: the rows are those of ``retrieval.candidates`` and of the kernel in ``align``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.config import Params
from stemmata.operators.align import EVENT, _distance
from stemmata.scratch import Scratch

#: units in a block
BLOCK = 8192
#: hits and cells that are held at once
HITS, CELLS = 2_000_000, 40_000
#: words of one unit times words of others that are looked at together
WIDE = 1 << 19
#: answers that are kept, as a power of two
MEMO = 19
#: letters of a word that fit a bit pattern
LONG = 64
PACKED = "block int, vocab binary, ids binary, sizes binary, at binary, ord binary, pos binary, cap binary, spans binary"
GRAM = "ord int, g1 string, g2 string"


def _bytes(a: np.ndarray, kind: type) -> bytes:
    return np.ascontiguousarray(a, dtype=kind).tobytes()


def packed(units: DataFrame, works: DataFrame, floor: int, scratch: Scratch, block: int | None = None) -> DataFrame:
    """A row for each block of units in the order of works and places; ``cap`` is the frequency cap of a unit's work, ``spans`` the number of blocks that the work may lie in."""
    size = block or BLOCK
    per = units.groupBy("work_id").agg((F.max("unit_pos") + 1).cast("bigint").alias("span"), F.greatest(F.lit(floor), F.expr("count(*) div 25")).cast("bigint").alias("cap"))
    starts = F.coalesce(F.sum("span").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a work
    placed = per.join(works.select("work_id", "ord"), "work_id").withColumn("start", starts)
    spans = (F.floor((F.col("start") + F.col("span") - 1) / F.lit(size)) - F.floor(F.col("start") / F.lit(size)) + 1).cast("int")
    rows = units.select("work_id", "unit_pos", "norm").join(F.broadcast(placed.withColumn("spans", spans)), "work_id")  # a row a work
    at = F.col("start") + F.col("unit_pos")
    rows = rows.select(F.floor(at / F.lit(size)).cast("int").alias("block"), at.alias("at"), F.col("ord").cast("int").alias("ord"), "unit_pos", "cap", "spans", "norm")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Units of a block as numbers into a list of words, some thousands at a time, so the shuffle carries a word once for these."""
        for b in batches:
            t = pa.Table.from_batches([b])
            for block in pc.unique(t["block"]).to_pylist():
                own = t.filter(pc.equal(t["block"], block)).combine_chunks()
                n = pc.list_value_length(own["norm"]).fill_null(0).to_numpy()
                coded = pc.list_flatten(own["norm"]).combine_chunks().dictionary_encode()
                column = lambda c, kind: [_bytes(own[c].to_numpy(), kind)]  # noqa: B023, E731
                ids = coded.indices.to_numpy()
                row = {"block": pa.array([block], pa.int32()), "vocab": ["\n".join(coded.dictionary.to_pylist()).encode()], "ids": [zlib.compress(_bytes(ids, np.uint32), 1)], "sizes": [_bytes(n, np.int32)]}
                row |= {"at": column("at", np.int64), "ord": column("ord", np.int32), "pos": column("unit_pos", np.int32), "cap": column("cap", np.int64), "spans": column("spans", np.int32)}
                yield from pa.table(row).to_batches()

    def pack(t: pa.Table) -> pa.Table:
        """One row of the rows of a block: one sorted list of words, the units in order."""
        rows = t.to_pylist()
        parts = [(r["vocab"].decode().split("\n"), np.frombuffer(zlib.decompress(r["ids"]), dtype=np.uint32)) for r in rows]
        words = sorted({w for ws, ids in parts if len(ids) for w in ws})
        number = {w: k for k, w in enumerate(words)}
        ids = np.concatenate([np.array([number[w] for w in ws], dtype=np.int32)[own] if len(own) else np.empty(0, dtype=np.int32) for ws, own in parts])
        get = {c: np.concatenate([np.frombuffer(r[c], dtype=kind) for r in rows]) for c, kind in (("sizes", np.int32), ("at", np.int64), ("ord", np.int32), ("pos", np.int32), ("cap", np.int64), ("spans", np.int32))}
        order = np.argsort(get["at"], kind="stable")
        n = get["sizes"].astype(np.int64)
        starts = np.cumsum(n) - n
        n, starts = n[order], starts[order]
        ids = ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        row = {"block": pa.array([rows[0]["block"]], pa.int32()), "vocab": ["\n".join(words).encode()], "ids": [_bytes(ids, np.int32)]}
        return pa.table(row | {c: [v[order].tobytes()] for c, v in get.items()})

    rows = rows.mapInArrow(part, PACKED)
    out = rows.groupBy("block").applyInArrow(pack, PACKED)
    return _frequent(scratch.put(out), scratch)


class Block:
    """A packed block as arrays."""

    def __init__(self, row: dict[str, object], side: str = ""):
        get = lambda c, kind: np.frombuffer(row[c + side], dtype=kind)
        self.ids, self.sizes, self.ord, self.pos = (get(c, np.int32) for c in ("ids", "sizes", "ord", "pos"))
        if not side:
            self.cap, self.spans = get("cap", np.int64), get("spans", np.int32)
        self.words = row["vocab" + side].decode().split("\n") if len(self.ids) else []
        self.ends = np.cumsum(self.sizes, dtype=np.int64)
        self.starts = self.ends - self.sizes

    def bigrams(self, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(unit, code) of the distinct bigrams of each unit, in this order; a code is first word * size + second in the numbers given, pairs with a word of number -1 are left out."""
        w = number[self.ids].astype(np.int64)
        unit = np.repeat(np.arange(len(self.sizes), dtype=np.int64), self.sizes)
        same = (unit[1:] == unit[:-1]) & (w[1:] >= 0) & (w[:-1] >= 0)
        key = np.sort((unit[:-1][same] * size + w[:-1][same]) * size + w[1:][same])  # below 2 ** 63: a block has some 2 ** 22 words at most
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        return key // (size * size), key % (size * size)


def _work_counts(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first unit, first word, second word, units) for each bigram of each work in a block."""
    v = max(1, len(b.words))
    unit, code = b.bigrams(np.arange(len(b.words)), v)
    ord_ = b.ord[unit].astype(np.int64)
    order = np.lexsort((code, ord_))
    ord_, code, unit = ord_[order], code[order], unit[order]
    first = np.flatnonzero(np.r_[True, (ord_[1:] != ord_[:-1]) | (code[1:] != code[:-1])]) if len(unit) else np.empty(0, dtype=np.int64)
    n = np.diff(np.r_[first, len(unit)])
    return unit[first], code[first] // v, code[first] % v, n


def _frequent(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """The blocks with ``frequent``, the bigrams that are frequent in each work they hold.

    A bigram of more units of a work than its cap has, in one of the work's blocks at least, more than an equal share of the cap. These are counted in all blocks of the work.
    """
    schema = f"{GRAM}, n bigint, cap bigint, spans int"

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                unit, x, y, n = _work_counts(b)
                on = n * b.spans[unit] > b.cap[unit]
                unit, x, y, n = unit[on], x[on], y[on], n[on]
                yield _batch(ord=b.ord[unit], g1=[b.words[k] for k in x], g2=[b.words[k] for k in y], n=n.astype(np.int64), cap=b.cap[unit], spans=b.spans[unit])

    many = scratch.put(blocks.mapInArrow(heavy, schema))
    here = scratch.put(blocks.mapInArrow(_works_of, "ord int, block int"))
    asked = many.filter("spans > 1").select("ord", "g1", "g2").distinct().join(here, "ord").groupBy("block").agg(F.collect_list(F.struct("ord", "g1", "g2")).alias("grams"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                unit, x, y, n = _work_counts(b)
                on = np.isin(_keys(b.ord[unit], x, y, len(b.words)), _gram_keys(row["grams"], b.words))
                unit, x, y, n = unit[on], x[on], y[on], n[on]
                yield _batch(ord=b.ord[unit], g1=[b.words[k] for k in x], g2=[b.words[k] for k in y], n=n.astype(np.int64), cap=b.cap[unit], spans=b.spans[unit])

    total = blocks.join(asked, "block").mapInArrow(counted, schema).groupBy("ord", "g1", "g2").agg(F.sum("n").alias("n"), F.first("cap").alias("cap")).filter("n > cap")
    all_ = many.filter("spans = 1").select("ord", "g1", "g2").unionByName(total.select("ord", "g1", "g2"))
    lists = all_.join(here, "ord").groupBy("block").agg(F.collect_list(F.struct("ord", "g1", "g2")).alias("frequent"))
    out = scratch.put(blocks.join(lists, "block", "left"))
    for t in (blocks, many, here):
        scratch.drop(t)
    return out


def _works_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ords = np.unique(np.frombuffer(row["ord"], dtype=np.int32))
            yield _batch(ord=ords, block=np.full(len(ords), row["block"], dtype=np.int32))


def _keys(ords: np.ndarray, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    return (ords.astype(np.int64) * max(1, size) + x) * max(1, size) + y


def _gram_keys(grams: list[dict[str, object]] | None, words: list[str]) -> np.ndarray:
    """Keys of bigrams of works in the numbers of a block's words; those with a word that the block lacks are left out."""
    number = {w: k for k, w in enumerate(words)}
    known = [(g["ord"], number[g["g1"]], number[g["g2"]]) for g in grams or [] if g["g1"] in number and g["g2"] in number]
    ords, x, y = np.array(known, dtype=np.int64).reshape(-1, 3).T
    return _keys(ords, x, y, len(words))


def _batch(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.string()) if isinstance(c, list) else pa.array(c) for c in columns.values()], list(columns))


def common(a: Block, b: Block, frequent_a: list | None, frequent_b: list | None, params: Params) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(unit of a, unit of b, common bigrams) of the candidates of two blocks, in order of the units of a, some at a time. b's works come after a's."""
    if not len(a.ids) or not len(b.ids):
        return
    v = len(a.words)
    in_a = pc.index_in(pa.array(b.words, pa.string()), pa.array(a.words, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    ua, ca = a.bigrams(np.arange(v), v)
    ub, cb = b.bigrams(in_a, v)
    flag_a = np.isin(a.ord[ua].astype(np.int64) * (v * v) + ca, _gram_keys(frequent_a, a.words))
    flag_b = np.isin(b.ord[ub].astype(np.int64) * (v * v) + cb, _gram_keys(frequent_b, a.words))
    key = np.sort((cb * 2 + flag_b) * len(b.sizes) + ub)
    cb, ub = key // len(b.sizes), key % len(b.sizes)
    cb, flag_b = cb // 2, cb % 2
    codes, start = np.unique(cb, return_index=True)
    if not len(codes):
        return
    end = np.r_[start[1:], len(cb)]
    mid = end - np.add.reduceat(flag_b, start)
    at = np.searchsorted(codes, ca)
    at[at == len(codes)] = 0
    on = codes[at] == ca
    ua, at, flag_a = ua[on], at[on], flag_a[on]
    low = start[at]
    high = np.where(flag_a | (params.mode == "v1"), mid[at], end[at])
    n = high - low
    total = np.r_[0, np.cumsum(n)]
    first = np.searchsorted(ua, np.arange(len(a.sizes) + 1))  # rows of each unit of a
    width = len(b.sizes)
    u = 0
    while u < len(a.sizes):
        room = max(1, 4 * HITS // width)
        stop = int(np.searchsorted(total[first], total[first[u]] + HITS, side="right")) - 1
        stop = min(max(stop, u + 1), u + room, len(a.sizes))
        rows = slice(first[u], first[stop])
        k = n[rows]
        hits = int(k.sum())
        if hits:
            offset = np.repeat(low[rows] - (np.cumsum(k) - k), k) + np.arange(hits)
            count = np.bincount(np.repeat((ua[rows] - u) * width, k) + ub[offset], minlength=(stop - u) * width)
            found = np.flatnonzero(count >= max(1, params.min_shared))
            i, j = found // width + u, found % width
            later = a.ord[i] < b.ord[j]
            yield i[later], j[later], count[found[later]]
        u = stop


class Letters:
    """The words of two blocks by the letters they share: ``bits`` has the 64 commonest (letter, how many-th in the word), ``rest`` how many others a word has."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], dtype=np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.alphabet, code = np.unique(points, return_inverse=True)
        self.start = np.cumsum(self.length) - self.length
        self.code = code.astype(np.int64)
        key = np.sort(np.repeat(np.arange(len(words)), self.length) * len(self.alphabet) + code)
        w, c = key // len(self.alphabet), key % len(self.alphabet)
        new = np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])]
        at = np.arange(len(w))
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        feature, number, n = np.unique(c * 8192 + np.minimum(nth, 8191), return_inverse=True, return_counts=True)
        bit = np.full(len(feature), -1)
        top = np.argsort(-n, kind="stable")[:64]
        bit[top] = np.arange(len(top))
        b = bit[number]
        self.bits = np.zeros(len(words), dtype=np.uint64)
        np.bitwise_or.at(self.bits, w[b >= 0], np.uint64(1) << b[b >= 0].astype(np.uint64))
        self.rest = np.bincount(w[b < 0], minlength=len(words))
        self.kind = np.minimum(self.length, LONG)

    def agree(self, x: np.ndarray, y: np.ndarray, fuzz: float) -> np.ndarray:
        """Whether the words of two lists agree, place for place: ``align.cells`` for pairs."""
        la, lb = self.length[x].astype(np.float64), self.length[y].astype(np.float64)
        total = la + lb
        d = self.distances(x, y)
        with np.errstate(invalid="ignore", divide="ignore"):
            near = ~(np.abs(la - lb) / total > 1.0 - fuzz) & (1.0 - d / total >= fuzz)
        return (d == 0) | near

    def distances(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Edit distances of two lists of words, place for place: the bit patterns of all pairs advance in step."""
        out = np.zeros(len(x), dtype=np.int64)
        turn = self.length[x] > self.length[y]
        x, y = np.where(turn, y, x), np.where(turn, x, y)  # the shorter word is the pattern
        la, lb = self.length[x], self.length[y]
        long = la >= LONG
        for k in np.flatnonzero(long & (x != y)):
            out[k] = _distance(self.words[x[k]], self.words[y[k]])
        out[la == 0] = lb[la == 0]
        rows = np.flatnonzero(~long & (la > 0) & (x != y))
        rows = rows[np.argsort(-lb[rows], kind="stable")]  # the longest first: those read to their end drop out
        x, y, la, lb = x[rows], y[rows], la[rows], lb[rows]
        patterns, p = np.unique(x, return_inverse=True)
        n = self.length[patterns]
        bits = np.uint32 if n.max(initial=0) <= 31 else np.uint64
        masks = np.zeros((len(patterns), len(self.alphabet)), dtype=bits)
        for k in range(int(n.max(initial=0))):
            on = np.flatnonzero(n > k)
            masks[on, self.code[self.start[patterns[on]] + k]] |= bits(1 << k)
        masks, base = masks.ravel(), p * len(self.alphabet)
        one = bits(1)
        last = (la - 1).astype(bits)
        plus, minus, score = np.full(len(x), ~bits(0)), np.zeros(len(x), dtype=bits), la.copy()
        begin = self.start[y]
        left = np.searchsorted(-lb, -np.arange(int(lb.max(initial=0))), side="left")  # words longer than t
        for t, k in enumerate(left):
            vp, vn = plus[:k], minus[:k]
            eq = masks[base[:k] + self.code[begin[:k] + t]]
            vertical = eq | vn
            horizontal = (((eq & vp) + vp) ^ vp) | eq
            up = vn | ~(horizontal | vp)
            down = vp & horizontal
            score[:k] += ((up >> last[:k]) & one).astype(np.int64) - ((down >> last[:k]) & one).astype(np.int64)
            up = (up << one) | one
            down <<= one
            plus[:k] = down | ~(vertical | up)
            minus[:k] = up & vertical
        out[rows] = score
        return out


def needed(fuzz: float) -> np.ndarray:
    """By the lengths of two words, how many letters they must share to agree; 255 where their lengths forbid it. The distance is at least the longer word's letters less those shared."""
    a, b = np.arange(LONG + 1)[:, None], np.arange(LONG + 1)[None, :]
    total = a + b
    least = np.maximum(0, np.maximum(a, b) - np.floor((1.0 - fuzz) * total + 1e-6)).astype(np.int64)
    least[LONG, :] = least[:, LONG] = 0  # longer words stand for all lengths
    with np.errstate(invalid="ignore", divide="ignore"):
        least[np.abs(a - b) / total > 1.0 - fuzz + 1e-9] = 255
    least[LONG, LONG] = 0
    return least.astype(np.uint8)


class Chance:
    """Which words of two units may agree, by the letters they share, and which do; one unit of a and some of b at a time."""

    def __init__(self, a: Block, b: Block, na: np.ndarray, nb: np.ndarray, letters: Letters, fuzz: float):
        self.a, self.b, self.letters, self.fuzz = a, b, letters, fuzz
        self.wa, self.wb = na[a.ids], nb[b.ids]
        self.least = needed(fuzz).astype(np.int64)
        self.bits, self.kind = letters.bits[self.wb], letters.kind[self.wb]
        self.room = np.empty(WIDE, dtype=np.uint64), np.empty(WIDE, dtype=np.uint8), np.empty(WIDE, dtype=np.uint8)
        # the answers so far, by a place that the two words give; a later answer takes the place of an earlier one
        self.asked, self.answer = np.full(1 << MEMO, -1, dtype=np.int64), np.zeros(1 << MEMO, dtype=bool)
        some = np.random.default_rng(0).integers(0, len(b.ids), 128)  # only the order of tests hangs on it
        words = np.unique(self.wa)
        self.weight = np.zeros(len(letters.words))
        for w in np.array_split(words, max(1, len(words) // 4096)):
            self.weight[w] = self.may(np.repeat(w, len(some)), np.tile(some, len(w))).reshape(len(w), -1).sum(axis=1)

    def may(self, wa: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether words may agree with those at places of b, one by one."""
        need = self.least[self.letters.kind[wa], self.kind[at]]
        return (np.bitwise_count(self.letters.bits[wa] & self.bits[at]) + self.letters.rest[wa] >= need) & (need < 255)

    def agree(self, wa: np.ndarray, wb: np.ndarray) -> np.ndarray:
        """Whether words agree, one by one."""
        code = (np.minimum(wa, wb) * len(self.letters.words) + np.maximum(wa, wb)).ravel()
        place = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MEMO)).astype(np.int64)
        out = self.answer[place]
        new = np.flatnonzero(self.asked[place] != code)
        if len(new):
            order = np.argsort(code[new])
            ordered = code[new][order]
            first = np.r_[True, ordered[1:] != ordered[:-1]]
            two = ordered[first]
            found = self.letters.agree(two // len(self.letters.words), two % len(self.letters.words), self.fuzz)
            out[new[order]] = found[np.cumsum(first) - 1]
            at = place[new[order[first]]]
            self.asked[at] = two
            keep = self.asked[at] == two  # of those that share a place one is kept
            self.answer[at[keep]] = found[keep]
        return out.reshape(wa.shape)

    def tested(self, u: int, run: int) -> np.ndarray:
        """Words of a unit of a so that ``run`` in a row hold one of them at least, such as agree with few."""
        weight = self.weight[self.wa[self.a.starts[u] : self.a.ends[u]]]
        if run == 1:
            return np.arange(len(weight))
        out, at, weight = [], -1, weight.tolist()
        while at + run < len(weight):
            at = min(range(at + run, at, -1), key=weight.__getitem__)
            out.append(at)
        return np.array(out, dtype=np.int64)

    def seen(self, i: np.ndarray, j: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(pair, place in a's unit, place in b's) of the words that may agree, those of ``tested`` only."""
        a, b = self.a, self.b
        edges = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.empty(0, dtype=np.int64)
        for begin, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
            u = i[begin]
            rows = self.tested(u, run)
            if not len(rows):
                continue
            wa = self.wa[a.starts[u] + rows]
            bits = self.letters.bits[wa][None, :]
            need = self.least[self.letters.kind[wa]]
            need = np.where(need == 255, 255, np.maximum(0, need - self.letters.rest[wa][:, None])).astype(np.uint8).T.copy()
            sizes = b.sizes[j[begin:stop]].astype(np.int64)
            part = np.cumsum(sizes) * len(rows) // (WIDE // 4)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for low, high in zip(cut[:-1].tolist(), cut[1:].tolist()):
                size = sizes[low:high]
                ends = np.cumsum(size)
                place = np.arange(ends[-1]) - np.repeat(ends - size, size)
                at = np.repeat(b.starts[j[begin + low : begin + high]], size) + place
                n = len(rows) * len(at)
                both, shared, least = (r[:n] if n <= len(r) else np.empty(n, dtype=r.dtype) for r in self.room)
                both, shared, least = (r.reshape(len(at), len(rows)) for r in (both, shared, least))
                np.bitwise_and(self.bits[at][:, None], bits, out=both)
                np.bitwise_count(both, out=shared)
                np.take(need, self.kind[at], axis=0, out=least, mode="clip")
                y, x = np.divmod(np.flatnonzero(shared >= least), len(rows))
                yield np.repeat(np.arange(begin + low, begin + high), size)[y], rows[x], place[y]

    def having(self, i: np.ndarray, j: np.ndarray, run: int) -> np.ndarray:
        """Whether pairs have ``run`` agreeing words in a row on a diagonal."""
        has = np.zeros(len(i), dtype=bool)
        a, b = self.a, self.b
        for pair, x, y in _together(self.seen(i, j, run)):
            sa, sb = a.starts[i[pair]], b.starts[j[pair]]
            na, nb = a.sizes[i[pair]], b.sizes[j[pair]]
            reach = []
            for sign in (1, -1):  # how far it goes on to either side
                far = np.zeros(len(pair), dtype=np.int64)
                on = np.arange(len(pair))
                for k in range(1, run):
                    xx, yy = x[on] + sign * k, y[on] + sign * k
                    on = on[(xx < na[on]) & (yy < nb[on])] if sign > 0 else on[(xx >= 0) & (yy >= 0)]
                    on = on[self.may(self.wa[sa[on] + x[on] + sign * k], sb[on] + y[on] + sign * k)]
                    far[on] = k
                reach.append(far)
            forward, back = reach
            chosen = np.flatnonzero(forward + back + 1 >= run)
            # the same for what does agree, of what is left
            sa, sb, x, y, pair = sa[chosen], sb[chosen], x[chosen], y[chosen], pair[chosen]
            on = self.agree(self.wa[sa + x], self.wb[sb + y])
            sa, sb, x, y, pair = sa[on], sb[on], x[on], y[on], pair[on]
            length = np.ones(len(pair), dtype=np.int64)
            for sign, far in ((1, forward[chosen][on]), (-1, back[chosen][on])):
                on = np.arange(len(pair))
                for k in range(1, run):
                    on = on[far[on] >= k]
                    on = on[self.agree(self.wa[sa[on] + x[on] + sign * k], self.wb[sb[on] + y[on] + sign * k])]
                    length[on] += 1
            has[pair[length >= run]] = True
        return has


def _together(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The same columns with many rows at a time; a pair's rows stay together if a part has all of a pair."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= CELLS:
            yield tuple(np.concatenate(c) for c in zip(*held))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def cells(seen: Chance, i: np.ndarray, j: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pair, place in a, place in b) of the agreeing words of the pairs that have ``run`` in a row on a diagonal, in order of pair, diagonal and place, many pairs at a time."""
    chosen = np.flatnonzero(seen.having(i, j, run)) if run > 1 else np.arange(len(i))
    i, j = i[chosen], j[chosen]
    for pair, x, y in _together(seen.seen(i, j, 1)):
        on = seen.agree(seen.wa[seen.a.starts[i[pair]] + x], seen.wb[seen.b.starts[j[pair]] + y])
        pair, x, y = pair[on], x[on], y[on]
        key = np.sort((pair << 32) + ((y - x + 32768) << 16) + x)  # a unit has 400 words at most
        pair, y, x = key >> 32, (key >> 16) & 65535, key & 65535
        yield chosen[pair], x, y - 32768 + x


KEY = ["work_i", "work_j", "i", "j"]
KEYS = "ord_i int, i int, ord_j int, j int, shared bigint"
SHARED = KEYS
RUNS = f"{KEYS}, longest bigint, runs bigint"
LIST, GAPS = "array<int>", "array<double>"
RECORDS = f"{KEYS}, n_blocks int, n_chained int, chain_len int, matched_words int, matched_words_j int, lo_i int, hi_i int, lo_j int, hi_j int, x {LIST}, y {LIST}, block {LIST}, gap_i {LIST}, fuzz_i {GAPS}, gap_j {LIST}, fuzz_j {GAPS}"


def _runs(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new, step): where a pair or a diagonal begins, and how far each cell is from the one before."""
    new = np.r_[True, (pair[1:] != pair[:-1]) | ((y - x)[1:] != (y - x)[:-1])]
    return new, np.r_[0, np.diff(x)]


def run_rows(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, longest run, runs) of cells in order."""
    new, step = _runs(pair, x, y)
    first = np.flatnonzero(new | (step != 1))
    length = np.diff(np.r_[first, len(x)])
    own = pair[first]
    edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[edge], np.maximum.reduceat(length, edge), np.diff(np.r_[edge, len(own)])


def record_rows(pair: np.ndarray, x: np.ndarray, y: np.ndarray, params: Params) -> tuple[np.ndarray, ...] | None:
    """(pair, raw blocks, first kept cell, end of the kept cells) of the pairs with a kept block, and (x, y, block) of kept cells, blocks numbered inside a pair; None without any. As ``align.align_one``."""
    new, step = _runs(pair, x, y)
    run = np.cumsum(new | (step != 1)) - 1
    opens = new | (step > params.n_out + 1)
    block = np.cumsum(opens) - 1
    core = np.zeros(block[-1] + 1, dtype=np.int64)
    np.maximum.at(core, block, np.bincount(run)[run])
    n = np.bincount(block)
    keep = (core >= params.ngram) & (n >= params.min_chain)
    if not keep.any():
        return None
    owner = pair[opens]
    raw_pair, raw = np.unique(owner, return_counts=True)
    on = keep[block]
    pair, x, y, block = pair[on], x[on], y[on], block[on]
    number = np.cumsum(keep) - 1
    own, first, count = np.unique(pair, return_index=True, return_counts=True)
    number = number[block] - np.repeat(number[block[first]], count)
    return own, raw[np.searchsorted(raw_pair, own)], first, first + count, x, y, number


def _gaps(own: np.ndarray, pair: np.ndarray, x: np.ndarray, y: np.ndarray, block: np.ndarray, words_of: object) -> tuple[dict[tuple[int, int], float], dict[tuple[int, int], float]]:
    """(pair, gap word inside a block) to the similarity, 0 to 100, of the two gaps it stands in, for both sides: ``align.bridges``."""
    left: dict[tuple[int, int], float] = {}
    right: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero((pair[1:] == pair[:-1]) & (block[1:] == block[:-1]) & (np.diff(x) > 1)).tolist():
        p = int(own[pair[k]])
        gi, gj = range(int(x[k]) + 1, int(x[k + 1])), range(int(y[k]) + 1, int(y[k + 1]))
        a, b = words_of(p)
        s, t = " ".join(a[w] for w in gi), " ".join(b[w] for w in gj)
        total = len(s) + len(t)
        fuzz = round(100.0 * (1.0 - _distance(s, t) / total), 1) if total else 100.0
        left.update(dict.fromkeys(((p, w) for w in gi), fuzz))
        right.update(dict.fromkeys(((p, w) for w in gj), fuzz))
    return left, right


def _distinct(pair: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Different values of x for each of n pairs."""
    return np.bincount(np.unique((pair << 32) + x) >> 32, minlength=n)


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, kind))


def two(row: dict[str, object], params: Params, what: str) -> Iterator[pa.RecordBatch]:
    """The candidates of two blocks, alone or with their runs or their records; null where a candidate has no record."""
    a, b = Block(row, "_a"), Block(row, "_b")
    if not len(a.ids) or not len(b.ids):
        return
    if what == SHARED:
        for i, j, shared in common(a, b, row["frequent_a"], row["frequent_b"], params):
            yield _batch(ord_i=a.ord[i], i=a.pos[i], ord_j=b.ord[j], j=b.pos[j], shared=shared.astype(np.int64))
        return
    # the words of both in one list of numbers
    words = sorted({*a.words, *b.words})
    both = pa.array(words, pa.string())
    na, nb = (pc.index_in(pa.array(s.words, pa.string()), both).to_numpy().astype(np.int64) for s in (a, b))
    seen = Chance(a, b, na, nb, Letters(words), params.fuzz)
    for i, j, shared in common(a, b, row["frequent_a"], row["frequent_b"], params):
        if not len(i):
            continue
        base = {"ord_i": a.ord[i], "i": a.pos[i], "ord_j": b.ord[j], "j": b.pos[j], "shared": shared.astype(np.int64)}
        if what == RUNS:
            longest, many = np.zeros(len(i), dtype=np.int64), np.zeros(len(i), dtype=np.int64)
            for part in cells(seen, i, j, 1):
                if len(part[0]):
                    pair, best, n = run_rows(*part)
                    longest[pair], many[pair] = best, n
            yield _batch(**base, longest=longest, runs=many)
            continue
        # words as numbers of the block's own list, read for gaps only
        words_of = lambda p: ([a.words[w] for w in a.ids[a.starts[i[p]] : a.ends[i[p]]]], [b.words[w] for w in b.ids[b.starts[j[p]] : b.ends[j[p]]]])  # noqa: B023, E731
        ints = {c: np.zeros(len(i), dtype=np.int32) for c in ("n_blocks", "n_chained", "chain_len", "matched_words", "matched_words_j", "lo_i", "hi_i", "lo_j", "hi_j")}
        sizes, kept, gaps = np.zeros(len(i), dtype=np.int64), [], ({}, {})
        for part in cells(seen, i, j, params.ngram):
            found = record_rows(*part, params) if len(part[0]) else None
            if found is None:
                continue
            own, raw, first, end, x, y, block = found
            kept.append((x, y, block))
            sizes[own] = end - first
            pair = np.repeat(np.arange(len(own)), end - first)
            opens = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (block[1:] != block[:-1])])
            chain = np.maximum.reduceat(np.diff(np.r_[opens, len(x)]), np.searchsorted(pair[opens], np.arange(len(own))))
            low, high = (lambda v: np.minimum.reduceat(v, first) + 1), (lambda v: np.maximum.reduceat(v, first) + 1)  # noqa: B023
            for c, v in zip(ints, (raw, block[end - 1] + 1, chain, _distinct(pair, x, len(own)), _distinct(pair, y, len(own)), low(x), high(x), low(y), high(y))):
                ints[c][own] = v
            for m, new in zip(gaps, _gaps(own, pair, x, y, block, words_of)):
                m.update(new)
        null = lambda c: pa.array(c, mask=sizes == 0)  # noqa: B023, E731
        flat = [np.concatenate(c) for c in zip(*kept)] if kept else [np.empty(0, dtype=np.int64)] * 3
        lists = {c: _lists(sizes, v.astype(np.int32), pa.int32()) for c, v in zip(("x", "y", "block"), flat)}
        for s, m in zip("ij", gaps):
            order = sorted(m)
            n = np.bincount(np.array([p for p, _ in order], dtype=np.int64), minlength=len(i))
            lists[f"gap_{s}"] = _lists(n, np.array([w for _, w in order], dtype=np.int32), pa.int32())
            lists[f"fuzz_{s}"] = _lists(n, np.array([m[k] for k in order], dtype=np.float64), pa.float64())
        yield _batch(**base, **{c: null(v) for c, v in ints.items()}, **lists)


def candidates(blocks: DataFrame, works: DataFrame, params: Params, what: str = SHARED) -> DataFrame:
    """(work_i, work_j, i, j, shared); with RUNS the longest run and the number of runs of every candidate, with RECORDS what the alignment keeps of it: null where that is nothing.

    Each two blocks meet once, in a product that shuffles nothing; the works' names are joined last.
    """
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in blocks.columns if c not in ("at", "cap", "spans")])
    pairs = side("a").crossJoin(side("b")).filter("block_a <= block_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from two({c: batch.column(n)[k].as_py() for n, c in enumerate(batch.schema.names)}, params, what)

    found = pairs.mapInArrow(run, what)
    name = lambda s: works.select(F.col("ord").cast("int").alias(f"ord_{s}"), F.col("work_id").alias(f"work_{s}"))
    rest = [c for c in found.columns if c not in ("ord_i", "ord_j", "i", "j", "shared")]
    return found.join(F.broadcast(name("i")), "ord_i").join(F.broadcast(name("j")), "ord_j").select("work_i", "work_j", "i", "j", "shared", *rest)


def events(records: DataFrame) -> DataFrame:
    """Per record the word maps of the full event, as ``align.pair_events``: word index to block, the last block wins, and gap word to similarity, both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(["x", "y", "block", "gap_i", "fuzz_i", "gap_j", "fuzz_j"]).to_pylist()
            maps = [[dict(zip(r[k], r[v])) for r in rows] for k, v in (("x", "block"), ("y", "block"), ("gap_i", "fuzz_i"), ("gap_j", "fuzz_j"))]
            kinds = [pa.map_(pa.int32(), pa.int32())] * 2 + [pa.map_(pa.int32(), pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in KEY), *(pa.array([list(m.items()) for m in ms], t) for ms, t in zip(maps, kinds))], [*KEY, "matched_i", "matched_j", "bridges_i", "bridges_j"])

    return records.select(*KEY, "x", "y", "block", "gap_i", "fuzz_i", "gap_j", "fuzz_j").mapInArrow(run, EVENT)


def bridge_words(records: DataFrame) -> DataFrame:
    """(keys, side, word, fuzz): the words in gaps of kept blocks, as ``align.bridge_words``."""
    side = lambda s: records.select(*KEY, F.lit(s).alias("side"), F.explode(F.arrays_zip(f"gap_{s}", f"fuzz_{s}")).alias("g")).select(*KEY, "side", F.col(f"g.gap_{s}").alias("word"), F.col(f"g.fuzz_{s}").alias("fuzz"))
    return side("i").unionByName(side("j"))
