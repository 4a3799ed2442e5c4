"""Filling containers of fixed capacity with items of varying size.

Sizes are whole numbers up to the capacity, so the number of items of each size says all that a
packing needs: at most ``capacity`` counts, however many items there are. The driver solves the
packing on these counts by exact-complement hashing, giving patterns (a list of sizes, how many
containers are filled that way). Items are then numbered inside their size, and the number tells
the container, without any group being gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 8192
#: parts in which the items of one size are numbered
SALTS = 1024


@dataclass
class Pattern:
    sizes: list[int]  # largest first
    times: int


class _Stock:
    """What is left of each size, and which sums of two sizes could still be made."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.have = self.left > 0
        self._pairs: np.ndarray | None = None

    def pairs(self) -> np.ndarray:
        """For every sum whether two sizes in stock make it (a size counts twice here; ``pair`` checks the stock)."""
        if self._pairs is None:
            n = len(self.have)
            f = np.fft.rfft(self.have.astype(np.float64), 2 * n)
            self._pairs = np.fft.irfft(f * f, 2 * n)[:n] > 0.5
        return self._pairs

    def pair(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """Two sizes in stock with this sum, the larger as large as possible."""
        larger = np.arange(gap - 1, (gap - 1) // 2, -1)
        for b in larger[self.have[larger] & self.have[gap - larger]]:
            b, c = int(b), gap - int(b)
            need = used.get(b, 0) + 1 + (b == c)
            if self.left[b] >= need and self.left[c] >= used.get(c, 0) + 1 + (b == c):
                return [b, c]
        return None

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three sizes in stock that fill the gap exactly."""
        if self.left[gap] > used.get(gap, 0):
            return [gap]
        sums = self.pairs()
        if gap >= 2 and sums[gap] and (got := self.pair(gap, used)):
            return got
        if gap >= 3:
            first = np.arange(gap - 2, 0, -1)
            for b in first[self.have[first] & sums[gap - first]]:
                b = int(b)
                if self.left[b] > used.get(b, 0) and (got := self.pair(gap - b, used | {b: used.get(b, 0) + 1})):
                    return [b, *got]
        return None

    def take(self, used: dict[int, int], times: int) -> None:
        for s, k in used.items():
            self.left[s] -= k * times
            if self.left[s] == 0 and self.have[s]:
                self.have[s], self._pairs = False, None


def solve(counts: np.ndarray) -> list[Pattern]:
    """Patterns that use up all counts (index = size, up to the capacity; index 0 is ignored).

    The largest size left opens a container. While it has a gap: fill it exactly with one, two or
    three sizes if the stock has them; else put in the largest size that fits. The pattern is
    used as often as the stock allows, so each size is exhausted after few patterns.
    """
    capacity = len(counts) - 1
    stock = _Stock(counts)
    stock.left[0], stock.have[0] = 0, False
    out: list[Pattern] = []
    top = capacity
    while True:
        while top > 0 and not stock.have[top]:
            top -= 1
        if top == 0:
            return out
        used, sizes, gap = {top: 1}, [top], capacity - top
        while gap:
            if got := stock.exact(gap, used):
                more = got
            else:
                fits = np.flatnonzero(stock.have[: gap + 1])[::-1]
                b = next((int(b) for b in fits if stock.left[b] > used.get(int(b), 0)), 0)
                if not b:
                    break
                more = [b]
            for b in more:
                used[b] = used.get(b, 0) + 1
                sizes.append(b)
                gap -= b
        times = min(int(stock.left[s]) // k for s, k in used.items())
        stock.take(used, times)
        out.append(Pattern(sorted(sizes, reverse=True), times))


def slots(patterns: list[Pattern]) -> pd.DataFrame:
    """Which numbers of a size go where: the items of ``size`` numbered from ``first`` fill ``each`` places in every container from ``base`` on."""
    rows, seen, base = [], {}, 0
    for p in patterns:
        at = pos = 0
        for size in dict.fromkeys(p.sizes):
            k = p.sizes.count(size)
            first = seen.get(size, 0)
            rows.append((size, first, k, base, pos, at))
            seen[size] = first + k * p.times
            pos += k
            at += k * size
        base += p.times
    table = pd.DataFrame(rows, columns=["size", "first", "each", "base", "pos", "at"], dtype="int64")
    return table.sort_values(["size", "first"], ignore_index=True)


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "size", *, capacity: int = CAPACITY, salts: int = SALTS) -> DataFrame:
    """(key, piece, container, position, start, size): a place for every item, or for every piece of an item over the capacity.

    ``sizes`` must be cheap to read twice (a written table). An item over the capacity is cut into full pieces,
    which fill a container each, and a rest that is packed like any item. Items of size 0 take no space and
    are spread evenly behind the others; a null size counts as 0. Repeated keys are separate items. An empty table gives an empty table.
    ``start`` is the offset inside the container, ``position`` the place in its order. Containers are numbered from 0.

    Only the counts per size reach the driver: at most ``capacity`` rows. Items of one size are numbered in ``salts`` parts whose
    counts are summed first, so a size that holds a third of all items is spread too.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    whole = (n / F.lit(capacity)).cast("bigint")
    full = F.transform(F.sequence(F.lit(0).cast("bigint"), whole - 1), lambda i: F.struct(i.alias("piece"), F.lit(capacity).cast("bigint").alias("size")))
    full = F.when(whole > 0, full).otherwise(F.expr("array()").cast("array<struct<piece:bigint,size:bigint>>"))
    rest = n - whole * capacity
    last = F.when((rest > 0) | (n == 0), F.array(F.struct(whole.alias("piece"), rest.alias("size")))).otherwise(F.expr("array()").cast("array<struct<piece:bigint,size:bigint>>"))
    items = sizes.select(F.col(key), F.explode(F.concat(full, last)).alias("item")).select(key, "item.piece", "item.size")

    items = items.withColumn("part", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    by_part = items.groupBy("size", "part").agg(F.count("*").alias("n"))
    counted = by_part.groupBy("size").agg(F.sum("n").alias("n")).collect()  # bounded: a row for each size up to the capacity
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in counted:
        counts[r["size"]] = r["n"]
    patterns = solve(counts)
    table = slots(patterns)
    containers = max(1, sum(p.times for p in patterns))
    filled = np.cumsum([0, *(p.times for p in patterns)])
    lengths = np.array([len(p.sizes) for p in patterns] or [0], dtype=np.int64)
    used = np.array([sum(p.sizes) for p in patterns] or [0], dtype=np.int64)
    # bounded: a few rows for each size up to the capacity
    shared = spark.sparkContext.broadcast((*(table[c].to_numpy() for c in ("size", "first", "each", "base", "pos", "at")), filled, lengths, used))

    before = F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select("size", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("size", "part").orderBy(key, "piece"))
    numbered = items.withColumn("number", inside - 1).join(offsets, ["size", "part"]).select(key, "piece", "size", (F.col("number") + F.col("offset")).alias("number"))
    kind = dict(sizes.dtypes)[key]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sized, first, each, base, pos, at, filled, lengths, used = shared.value
        for b in batches:
            s, r = b["size"].to_numpy(np.int64), b["number"].to_numpy(np.int64)
            container, position, start = r % containers, np.zeros_like(r), np.zeros_like(r)
            empty = s == 0
            if empty.any():
                p = np.minimum(np.searchsorted(filled, container[empty], side="right") - 1, len(lengths) - 1)
                position[empty], start[empty] = lengths[p] + r[empty] // containers, used[p]
            if not empty.all():
                s, r = s[~empty], r[~empty]
                ends = np.searchsorted(sized, s, side="right")
                lo = np.searchsorted(sized, s, side="left")
                hi = ends.copy()
                while (hi - lo > 1).any():  # halving the slots of each size in step
                    mid = (lo + hi) // 2
                    up = (hi - lo > 1) & (first[np.minimum(mid, len(first) - 1)] <= r)
                    lo, hi = np.where(up, mid, lo), np.where(up | (hi - lo <= 1), hi, mid)
                inside = r - first[lo]
                container[~empty] = base[lo] + inside // each[lo]
                position[~empty] = pos[lo] + inside % each[lo]
                start[~empty] = at[lo] + inside % each[lo] * s
            yield pd.DataFrame({key: b[key], "piece": b["piece"], "container": container, "position": position, "start": start, "size": b["size"]})

    return numbered.mapInPandas(place, f"`{key}` {kind}, piece bigint, container bigint, position bigint, start bigint, size bigint")
