"""Cutting oversized items at natural boundaries, with an overlap, without loading an item whole.

An item (unit) is a sequence of parts, joined by one space; it may be far larger than a task's memory.

1. Parts over the limit are cut into ranges of characters. A range has the character before it as halo, and its border does not lie behind white space, so every
   boundary is seen whole by one range (``ranges``). Workers detect the boundaries of their ranges: sentence ends and white space (``detect``).
2. The ranges' tables are stitched to the longest sentence and run of each part: what is open at a border goes on in the next range (``boundary_table``).
3. The lengths are prefix-summed to the offset of each part in its unit: inside blocks of parts, then over the
   blocks' sums, so a unit of very many parts is not ordered in one task (``offsets``).
4. The unit's line of characters is divided into ranges. Each range gets its own characters and a halo on either side. At
   every border the first natural boundary of the right halo is a cut: the range on its left sees it in its halo, the range on its right
   at its start, so neighbours agree without talking to each other, and ranges emit their pieces by offset on their own (``pieces``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemmata.functions.text import is_blank

LIMIT = 2000
OVERLAP = 200
RANGE = 1 << 16
#: parts in a block of the prefix sum
BLOCK = 1024
ENDERS = ".;·!?;·"
_BETWEEN = re.compile(rf"(?<=[{re.escape(ENDERS)}])\s+|[^\S\n]*\n\s*\n\s*")
_SPACE = re.compile(r"\s+")


def borders(text: str, span: int) -> list[int]:
    """Where ranges of about ``span`` characters begin: every ``span`` characters, moved on until the character before is no white space."""
    out, n = [0], len(text)
    while out[-1] + span < n:
        at = out[-1] + span
        while at < n and text[at - 1].isspace():
            at += 1
        if at >= n:
            break
        out.append(at)
    return out


def _open(pieces: list[str], begins: bool, ends: bool) -> tuple[int, int, int, bool]:
    """(first, last, longest, any) of the stretches of a range: the one that goes on from the range before, the one that is open at its end, the longest between, and whether there is a boundary at all.

    Outer white space is no part of a stretch, but a stretch that goes on over a border keeps what is inside it.
    """
    if len(pieces) == 1:
        only = pieces[0].lstrip() if begins else pieces[0]
        return 0, len(only.rstrip() if ends else only), 0, False
    first = pieces[0].strip() if begins else pieces[0].rstrip()
    last = pieces[-1].strip() if ends else pieces[-1].lstrip()
    return len(first), len(last), max((len(x.strip()) for x in pieces[1:-1]), default=0), True


def detect(text: str, halo: int, begins: bool, ends: bool) -> tuple[int, int, int, bool, int, int, int, bool]:
    """The table of one range whose text has ``halo`` characters before it: sentences, then runs without white space; ``begins`` and ``ends`` tell whether it holds the part's start and end."""
    at, sentences = halo, []
    for m in _BETWEEN.finditer(text, 0):
        if m.end() > halo:
            sentences.append(text[at : max(m.start(), halo)])
            at = m.end()
    sentences.append(text[at:])
    return *_open(sentences, begins, ends), *_open(_SPACE.split(text[halo:]), begins, ends)


def parts_of(segments: DataFrame) -> DataFrame:
    """(work_id, chapter, page, seg_pos, text): segments whose text is not null or blank; a null page is ''."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return segments.filter(~is_blank(F.col("text"))).select("work_id", "chapter", empty("page"), F.col("seg_pos").cast("bigint").alias("seg_pos"), "text")


_TABLE = ("first", "last", "longest", "any")


def ranges(parts: DataFrame, keys: list[str], text: str = "text", *, span: int = RANGE) -> DataFrame:
    """(keys, __no, __of, __halo, text): the ranges of each part, numbered, their number, and the characters of halo that the text begins with. Each character is copied once."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, no, of, halo, texts = [], [], [], [], []
            for row, value in enumerate(batch.column(text)):
                whole = value.as_py()
                starts = borders(whole, span)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(whole)])):
                    at.append(row)
                    no.append(k)
                    of.append(len(starts))
                    halo.append(min(a, 1))
                    texts.append(whole[a - halo[-1] : b])
            kept = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(no, pa.int32()), pa.array(of, pa.int32()), pa.array(halo, pa.int32()), pa.array(texts, pa.string())], [*keys, "__no", "__of", "__halo", text])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    return parts.select(*keys, text).mapInArrow(run, f"{schema}, __no int, __of int, __halo int, `{text}` string")


def _detected(cut: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, __no, __s: sentences, __r: runs): the boundary tables of ranges."""
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    kind = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("longest", pa.int64()), ("any", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [detect(t, h, no == 0, no == of - 1) for t, h, no, of in zip(*(batch.column(c).to_pylist() for c in (text, "__halo", "__no", "__of")))]
            tables = [pa.array([dict(zip(_TABLE, f[k : k + 4])) for f in found], kind) for k in (0, 4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "__no")), *tables], [*keys, "__no", "__s", "__r"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keys)
    table = "struct<first:bigint,last:bigint,longest:bigint,any:boolean>"
    return cut.mapInArrow(run, f"{schema}, __no int, __s {table}, __r {table}")


def _stitch(tables: Column) -> Column:
    """The longest stretch of a part from the tables of its ranges in order."""

    def step(acc: Column, t: Column) -> Column:
        closed = F.greatest(acc["best"], acc["open"] + t["first"], t["longest"])
        return F.struct(F.when(t["any"], t["last"]).otherwise(acc["open"] + t["last"]).alias("open"), F.when(t["any"], closed).otherwise(acc["best"]).alias("best"))

    zero = F.lit(0).cast("bigint")
    return F.aggregate(tables, F.struct(zero.alias("open"), zero.alias("best")), step, lambda acc: F.greatest(acc["open"], acc["best"]))


def boundary_table(parts: DataFrame, unit: list[str], order: str, text: str = "text", *, limit: int = LIMIT, span: int = RANGE) -> DataFrame:
    """(unit, order, length, sentence, run): per part its length, longest sentence and longest run without white space.

    Of a part within the limit no sentence or run can exceed it, so they are not looked for and stand as 0. Parts of one range are worked off where they lie; the ranges of
    longer ones are spread over tasks and their tables stitched. The order must be unique in a unit.
    """
    keys = [*unit, order]
    sized = parts.select(*keys, text).withColumn("length", F.char_length(text).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    small = sized.filter(F.col("length") <= limit).select(*keys, "length", zero.alias("sentence"), zero.alias("run"))
    large = sized.filter(F.col("length") > limit)
    one = _detected(ranges(large.filter(F.col("length") <= span), [*keys, "length"], text, span=span), [*keys, "length"], text)
    spread = ranges(large.filter(F.col("length") > span), [*keys, "length"], text, span=span).repartition(*keys, "__no")
    several = _detected(spread, [*keys, "length"], text)
    # bounded: the ranges of one part
    listed = several.groupBy(*keys, "length").agg(F.array_sort(F.collect_list(F.struct("__no", "__s", "__r"))).alias("t"))
    whole = listed.select(*keys, "length", _stitch(F.transform("t", lambda x: x["__s"])).alias("sentence"), _stitch(F.transform("t", lambda x: x["__r"])).alias("run"))
    single = one.select(*keys, "length", _stitch(F.array("__s")).alias("sentence"), _stitch(F.array("__r")).alias("run"))
    return small.unionByName(single).unionByName(whole)


def oversized(table: DataFrame, unit: list[str], *, limit: int = LIMIT) -> DataFrame:
    """(unit, length, boundary): units over the limit, and the finest boundary that keeps pieces within it.

    'sentence' if no sentence exceeds the limit, else 'word' if no run without white space does, else 'none'. A seam of two parts ends a
    sentence, so the table's maxima say it. Null unit columns group like any value; an empty table gives an empty table.
    """
    whole = table.groupBy(*unit).agg((F.sum("length") + F.count("*") - 1).alias("length"), F.max("sentence").alias("sentence"), F.max("run").alias("run"))
    kind = F.when(F.col("sentence") <= limit, "sentence").when(F.col("run") <= limit, "word").otherwise("none")
    return whole.filter(F.col("length") > limit).select(*unit, "length", kind.alias("boundary"))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of all columns, null like any value."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def offsets(table: DataFrame, unit: list[str], order: str, *, block: int = BLOCK) -> DataFrame:
    """(unit, order, length, offset): where each part starts in its unit, one space between parts."""
    rows = table.select(*unit, order, "length").withColumn("__block", F.floor(F.col(order) / F.lit(block)))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = rows.withColumn("__in", before(Window.partitionBy(*unit, "__block").orderBy(order), F.col("length") + 1))
    sums = rows.groupBy(*unit, "__block").agg(F.sum(F.col("length") + 1).alias("__sum"))
    starts = sums.withColumn("__start", before(Window.partitionBy(*unit).orderBy("__block"), "__sum")).drop("__sum")
    return inside.join(starts, _same(inside, starts, [*unit, "__block"])).select(*[inside[c] for c in (*unit, order)], "length", (F.col("__in") + F.col("__start")).alias("offset"))


def _ends(text: str) -> tuple[list[int], list[int]]:
    """Positions where a piece may end: after a sentence, after a word; in order."""
    sentences = [m.start() for m in _BETWEEN.finditer(text)]
    return sentences, [m.start() for m in _SPACE.finditer(text)]


def _last(ends: list[int], low: int, high: int) -> int:
    """The last of ``ends`` in (low, high], or -1."""
    from bisect import bisect_right

    i = bisect_right(ends, high)
    return ends[i - 1] if i and ends[i - 1] > low else -1


def _border(sentences: list[int], words: list[int], at: int, limit: int) -> tuple[int, str]:
    """The cut at a border: the first natural boundary at or after it, else the border itself."""
    from bisect import bisect_left

    for ends, kind in ((sentences, "sentence"), (words, "word")):
        i = bisect_left(ends, at)
        if i < len(ends) and ends[i] < at + limit:
            return ends[i], kind
    return at, "none"


def cut_range(text: str, base: int, start: int, stop: int, length: int, *, limit: int, overlap: int, seams: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, kind of boundary at the end) of the pieces of one range [start, stop) of a unit of ``length``.

    ``text`` holds the characters from ``base``: the range, ``overlap`` before it and ``limit`` + 1 behind it.
    """
    sentences, words = _ends(text)
    sentences = sorted({base + p for p in sentences} | set(seams))
    words = sorted({base + p for p in words})
    s = 0 if start == 0 else max(0, _border(sentences, words, start, limit)[0] - overlap)
    goal, why = (length, "end") if stop >= length else _border(sentences, words, stop, limit)
    goal, why = (length, "end") if goal >= length else (goal, why)
    if start and s + overlap >= length:  # the piece before took the rest
        return []
    out = []
    while goal - s > limit:
        e, kind = _last(sentences, s + overlap, s + limit), "sentence"
        if e < 0:
            e, kind = _last(words, s + overlap, s + limit), "word"
        if e < 0:
            e, kind = s + limit, "none"
        out.append((s, e, kind))
        s = e - overlap
    if not out or out[-1][1] < goal:
        out.append((s, goal, why))
    return out


def _cells(placed: DataFrame, unit: list[str], text: str, limit: int, overlap: int, span: int) -> DataFrame:
    """(unit, __range, __unit, __at, __text, __seam): what each part gives to each range of its unit, halos included, and where the range has the part's seam. One pass over the part."""
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, no, at, texts, seams = [], [], [], [], []
            for row, (offset, first, last, value) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("offset", "__first", "__last")), batch.column(text))):
                whole = value.as_py() + " "
                for r in range(first, last + 1):
                    lo, hi = r * span - overlap, (r + 1) * span + limit + 1
                    a, b = max(0, lo - offset), min(len(whole), hi - offset)
                    if b > a:
                        rows.append(row)
                        no.append(r)
                        at.append(offset + a)
                        texts.append(whole[a:b])
                        seams.append(offset - 1 if lo < offset <= hi else None)
            kept = batch.select([*unit, "__unit"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(no, pa.int64()), pa.array(at, pa.int64()), pa.array(texts, pa.string()), pa.array(seams, pa.int64())], [*unit, "__unit", "__range", "__at", "__text", "__seam"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in unit)
    return placed.mapInArrow(run, f"{schema}, __unit bigint, __range bigint, __at bigint, __text string, __seam bigint")


def pieces(parts: DataFrame, table: DataFrame, unit: list[str], order: str, text: str = "text", *, limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE) -> DataFrame:
    """(unit, start, end, cut, text): the ordered pieces of all units over the limit.

    A piece has at most ``limit`` characters. It ends after the last sentence that fits, else after the last word, else at the limit;
    ``cut`` says which ('end' at the unit's end). The next piece begins ``overlap`` characters before its end. A null unit column is a value
    like any other; the order must be unique in a unit. ``table`` is the boundary table of ``parts``. An empty table gives an empty table.
    """
    if not 0 <= overlap < limit or span < 2 * limit:
        raise ValueError("the overlap must be smaller than the limit, and a range at least twice the limit")
    big = oversized(table, unit, limit=limit).select(*unit, F.col("length").alias("__unit"))
    at_ = offsets(table, unit, order)
    placed = at_.join(big, _same(at_, big, unit)).select(*[at_[c] for c in (*unit, order)], "length", "offset", "__unit")
    own = parts.select(*unit, order, text)
    carried = own.join(placed, _same(own, placed, [*unit, order])).select(*[own[c] for c in (*unit, order, text)], "length", "offset", "__unit")
    at, size = F.col("offset"), F.col("length") + 1  # a part and the space behind it
    first = F.greatest(F.lit(0), F.floor((at - limit - 1) / F.lit(span)))
    last = F.least(F.floor((at + size - 1 + overlap) / F.lit(span)), F.floor((F.col("__unit") - 1) / F.lit(span)))
    placed = carried.select(*unit, "__unit", "offset", first.cast("bigint").alias("__first"), last.cast("bigint").alias("__last"), text)
    cells = _cells(placed, unit, text, limit, overlap, span)
    # bounded: the characters of one range with its halos
    gathered = cells.groupBy(*unit, "__range").agg(F.first("__unit").alias("__unit"), F.array_sort(F.collect_list(F.struct("__at", "__text"))).alias("__cells"), F.collect_list("__seam").alias("__seams"))
    joined: Column = F.array_join(F.transform("__cells", lambda x: x["__text"]), "")
    ready = gathered.select(*unit, "__range", "__unit", F.col("__cells")[0]["__at"].alias("__base"), joined.alias("__text"), "__seams")
    kinds = dict(parts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                base, whole, n = r["__base"], r["__text"], r["__unit"]
                seams = [x for x in r["__seams"] if 0 < x < n]
                for s, e, kind in cut_range(whole[: n - base], base, r["__range"] * span, (r["__range"] + 1) * span, n, limit=limit, overlap=overlap, seams=seams):
                    rows.append((*[r[c] for c in unit], s, e, kind, whole[s - base : e - base]))
            yield pd.DataFrame(rows, columns=[*unit, "start", "end", "cut", text])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in unit)
    return ready.mapInPandas(run, f"{schema}, start bigint, end bigint, cut string, `{text}` string")
