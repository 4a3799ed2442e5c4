"""Noise in texts read from scanned pages: found by kind, and repaired into continuous paragraphs.

Four kinds: 'hyphen' (a word divided by the end of a printed line), 'glyph' (misread characters), 'header' (a running
header in the text), 'pageno' (a page or folio number by itself).

1. Running headers: lines of a work that are equal once their digits are masked, but stand there with different numbers. Their
   words, and the running titles that are given for a work, are then looked for anywhere in its texts, with digits misread inside them.
   Numbers outside headers, brackets, ranges and chapter marks are page numbers.
2. Every text is examined once; what it shows by itself and its words are written (``examined``). Every word form is counted over all
   texts, words that touch a division or hold an impossible character left out.
3. Forms are grouped by a skeleton in which glyphs that are taken for each other are one sign. A form beside a far more frequent one of
   the same skeleton is a misreading; where the counts alone are not decisive the neighbouring words must support the reading.
4. Two neighbouring words whose joined form is far more frequent than the rarer of them are one divided word.
5. Lines are joined to paragraphs by SQL windows over the lines of a text.

All thresholds are ratios of counts, so they hold at any size of the corpus. Which forms are common only prunes what need not be looked up
(see ``suspects``) and changes no result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stemmata.functions.text import MARKS, normalise_col
from stemmata.scratch import Scratch

#: signs that divide a word at a line's end (fixed values): hyphen, soft hyphen, oblique double hyphen, hyphen, not sign
DIVIDERS = "-­⸗‐‑¬"
#: characters that stand for a misread one inside a word (fixed values)
STRAY = r"_'*|^\\~@!"
#: glyphs taken for each other (fixed values): the first of each row is the skeleton's sign
CONFUSED = ("οσ0o", "υνηuvn", "κχkx", "λδθ", "ιi1!|", "ecε", "tl", "αa", "ρp", "τr", "γy", "ωw", "b6", "g9")
#: letter pairs taken for one letter (fixed values)
MERGED = (("ει", "α"), ("rn", "m"), ("in", "m"))
#: how many times more frequent the joined form of a divided word must be than the rarer of its parts
RATIO = 8
#: how many times more frequent a reading must be than the form if nothing else speaks for it: misreadings of one word scatter, another word of the same skeleton does not
SYSTEMATIC = 60
#: and how many times where a neighbouring word supports the reading
SUPPORTED = 3
#: how many times more often the reading must stand beside that word than chance would put it there
LIFT = 100
#: the fewest letters of a form that context may decide, and of one that counts alone may decide: a single letter has no skeleton that tells words apart
CONTEXT_LETTERS, LEAST_LETTERS = 4, 2
#: occurrences that make a form known
KNOWN = 4
#: a form with more than one HEAVY-th of all words is common; there are at most HEAVY of them, so they may be broadcast
HEAVY = 100_000
#: a running header is a line of so many characters at most
HEADER_LINE = 90

_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}(?:{_LETTER}|[̀-ͯ])*")
_DIVIDER = re.compile(rf"[{re.escape(DIVIDERS)}]")
_DIVIDED = re.compile(rf"(?<={_LETTER})([̀-ͯ]*)[{re.escape(DIVIDERS)}](?=\s+\S)")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_BETWEEN = re.compile(rf"(?<={_LETTER})[{STRAY}]+(?={_LETTER})|(?<={_LETTER})[_^~|\\@](?=[\s.,;·!?]|$)|(?<!\S)[_^~|\\@!](?={_LETTER})")
_DIGIT_IN = re.compile(rf"\d(?={_LETTER})|(?<={_LETTER})\d")
#: folio numbers, sigla of manuscripts, lettered pages: letters and digits that belong together
_PLAIN_CODE = re.compile(r"\d+[a-z]?[rvʳᵛ]?|[A-Z]\d+|\d+[a-e]|\d+ʹ?")
_MIXED = re.compile(r"[Ͱ-Ͽἀ-῿][\u0300-\u036f]*[A-Za-zÀ-ɏ]|[A-Za-zÀ-ɏ][\u0300-\u036f]*[Ͱ-Ͽἀ-῿]")
_STRAY = re.compile(rf"[�{STRAY}]")
_ANY = re.compile(_LETTER)
_TOUCH = frozenset("_^~|\\@0123456789")
_PIECE = re.compile(r"(?:[^\s.,;:·!?()\[\]<>†—–\-\u00ad⸗‐‑¬\u0387\u037e«»\"]|(?<=\w)!(?=\w))+")
_NUMBER = re.compile(r"(?<![\w.\-–/])(\d{1,4}[rvʳᵛ]?)(?![\w\-–/])")
_BEFORE_CHAPTER = re.compile(r"(?:\b(?:κεφ|cap|cod|codd|lib|στ|vv?|ll?|ch|c)\.\s*|[(\[])$")
_PAGE = re.compile(r"(?<![\w.])(?:fol|ff?|pp?|pag|S)\.\s*\d{1,4}[rvʳᵛ]?(?!\w)|(?<!\S)([—–\-~.])\s\d{1,4}\s\1(?!\S)|(?<!\w)\d{1,4}[ʳᵛ]")
_DIGIT = re.compile(r"\d")
_ROMAN = re.compile(r"(?<![\w.])(?=[ivxlc])(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})(?![\w.])")
_LINES_JVM = r"\r\n|[\n\r\u000b\u000c\u0085\u2028\u2029]"
_LINES = re.compile(r"\r\n|[\n\r\u000b\u000c\u0085  ]")

_SIGN = {c: row[0] for row in CONFUSED for c in row[1:]}


def form(word: str) -> str:
    """A word without case and marks, final sigma as sigma."""
    return MARKS.sub("", unicodedata.normalize("NFKD", word).lower()).replace("ς", "σ")


_FORMS: dict[str, str] = {}


def known_form(word: str) -> str:
    """``form`` with a memory of up to a million words a process."""
    got = _FORMS.get(word)
    if got is None:
        if len(_FORMS) > 1 << 20:
            _FORMS.clear()
        got = _FORMS[word] = form(word)
    return got


#: what a wrong character stands for (fixed values): in Greek words, in Latin words
_IN_GREEK = str.maketrans({"0": "ο", "1": "ι", "3": "ε", "6": "σ", "|": "ι", "!": "ι", "s": "ε", "d": "α", "c": "σ", "t": "τ", "e": "ε"})
_IN_LATIN = str.maketrans({"0": "o", "1": "i", "3": "e", "5": "s", "6": "b", "9": "g", "|": "l", "!": "i", "@": "ae"})
_DROPPED = re.compile(r"[_'*^\\~]")
LOST = "\ufffd"


def guess(piece: str) -> str:
    """The form that a word with impossible characters may have; a lost character stays as it is."""
    bare = _DROPPED.sub("", piece)
    table = _IN_GREEK if _GREEK.search(bare) else _IN_LATIN
    return form(form(bare).translate(table))


def skeleton(word: str) -> str:
    for pair, sign in MERGED:
        word = word.replace(pair, sign)
    return "".join(_SIGN.get(c, c) for c in word)


_LEFT = re.compile(r"(?<!\w)(?:(?P<number>\d{1,4})[ \t]+)?(?:[A-Z\d]{3,}(?:[ \t]+[A-Z\d]+)*\.\s+)?\Z")
_RIGHT = re.compile(r"[ \t]+(\d{1,4})(?![\w\-]|\s*[)\]])")


def _title_key(title: str) -> str:
    """A title without spaces, case and marks, misread digits as letters."""
    return form("".join(title.split())).translate(str.maketrans("o0i1", "οοιι"))


def title_pattern(*titles: str) -> re.Pattern[str]:
    """Running titles in capitals or small letters, letters spaced or not, 0 and 1 for O and I."""
    own: dict[str, str] = {}
    for title in sorted(titles, key=lambda t: (len(t.split()), t)):  # of a title spaced in several ways the one with the fewest gaps
        own.setdefault(_title_key(title), title)
    both = []
    for title in sorted(own.values(), key=lambda t: (-len(t), t)):
        for case in (str.upper, str.lower):
            words = []
            for w in MARKS.sub("", unicodedata.normalize("NFKD", case(title))).split():
                words.append(r"\s?".join("[" + {"Ο": "ΟO0", "O": "O0", "Ι": "ΙI1", "I": "I1l", "ο": "οo0", "o": "o0", "ι": "ιi1", "i": "i1", "σ": "σς", "ς": "σς"}.get(c, re.escape(c)) + "]" for c in w))
            both.append(r"\s+".join(words))
    return re.compile(rf"(?<!\w)(?:{'|'.join(both)})(?!\w)")


def masked_titles(texts: DataFrame) -> DataFrame:
    """(work_id, title): titles of running headers, learned from (work_id, text).

    A line that begins or ends with a number is masked: normalised, its digits dropped (0 and 1 inside a word are letters), an author before the title too. A masked line with
    three letters or more that stands in its work with at least two numbers is a header; marks of pages and chapters by themselves are none. Lines are counted map-side
    first, so a work that holds most rows is a few rows when it is shuffled. Null texts, null works and texts without numbers give nothing.
    """
    lines = texts.filter(F.col("work_id").isNotNull() & F.col("text").rlike(r"\d")).select("work_id", F.explode(F.split("text", _LINES_JVM)).alias("line"))
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    edge = lines.select("work_id", line.alias("line")).filter((F.char_length("line") <= HEADER_LINE) & F.col("line").rlike(r"^\d{1,4} |[^\d] \d{1,4}$") & F.col("line").rlike(r"\p{L}\P{L}*\p{L}\P{L}*\p{L}"))
    number = F.regexp_extract("line", r"^(\d{1,4}) |[^\d] (\d{1,4})$", 0)
    pre = edge.groupBy("work_id", "line").agg(F.max(number).alias("number"))
    low = normalise_col(F.col("line"))
    letters = F.regexp_replace(F.regexp_replace(low, r"(?<=\p{L})[0](?=\p{L}|\b)|\b0(?=\p{L})", "ο"), r"(?<=\p{L})1(?=\p{L}|\b)|\b1(?=\p{L})", "ι")
    bare = F.trim(F.regexp_replace(F.regexp_replace(letters, r"^\d{1,4} | \d{1,4}$", ""), r"^[\p{L} ]{3,}\. +", ""))
    named = pre.select("work_id", "number", bare.alias("title")).filter(~F.col("title").rlike(r"\d|^\P{L}*(?:fol|ff?|pp?|pag|s|κεφ|cap|codd?|lib|στ|vv?|ll?|ch|c)\.|[.;·!?:]") & F.col("title").rlike(r"\p{L}\P{L}*\p{L}\P{L}*\p{L}"))
    key = F.translate(F.regexp_replace("title", r"\P{L}", ""), "oi", "οι")
    found = named.groupBy("work_id", key.alias("key")).agg(F.min("number").alias("low"), F.max("number").alias("high"), F.min_by("title", F.struct(F.size(F.split("title", " ")), "title")).alias("title"))
    return found.filter("low <> high").select("work_id", "title")


def headers(text: str, title: re.Pattern[str]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Running headers with author and page number; and, where a number stands on either side, the one that is the page's own."""
    found, pages = [], []
    for m in title.finditer(text):
        a, b = m.span()
        floor = max(0, a - 60)
        left = _LEFT.search(text[floor:a])
        right = _RIGHT.match(text, b)
        number = left.group("number") if left else None
        a = floor + left.start() if left else a
        if number and right:
            pages.append(right.span(1))
        elif right:
            b = right.end()
        found.append((a, b))
    return found, pages


@dataclass
class Finding:
    """What one text shows by itself, and what needs the counts of all texts."""

    text: str
    kinds: set[str] = field(default_factory=set)
    headers: list[tuple[int, int]] = field(default_factory=list)
    pages: list[tuple[int, int]] = field(default_factory=list)
    #: words that may be counted, with their place
    words: list[tuple[str, int, int]] = field(default_factory=list)
    #: words with characters that cannot be right, with their place
    broken: list[tuple[int, int]] = field(default_factory=list)


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans as spaces."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in _joined(spans):
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _line_edge(text: str, at: int, step: int) -> str:
    """The next character that is no space or tab, seen from a place to the left (-1) or right (1); '' at the text's end."""
    k = at - 1 if step < 0 else at
    while 0 <= k < len(text) and text[k] in " \t":
        k += step
    return text[k] if 0 <= k < len(text) else ""


def _pages(body: str) -> list[tuple[int, int]]:
    """Page and folio numbers by themselves."""
    numbers = _DIGIT.search(body) is not None
    out = [m.span() for m in _PAGE.finditer(body)] if numbers else []
    rest = _blank(body, out)
    for m in _NUMBER.finditer(rest) if numbers else ():
        if _BEFORE_CHAPTER.search(rest[max(0, m.start() - 12) : m.start()]) or rest[m.end() : m.end() + 1] in (")", "]"):
            continue
        out.append(m.span())
    edges = len(rest) - len(rest.lstrip()), len(rest.rstrip())
    for m in _ROMAN.finditer(rest):
        a, b = m.span()
        if b - a < 2:
            continue
        line = a <= edges[0] or b >= edges[1] or (_line_edge(rest, a, -1) in ("\n", "\r") and _line_edge(rest, b, 1) in ("\n", "\r"))
        if (b - a >= 3 or line) and not _BEFORE_CHAPTER.search(rest[max(0, a - 12) : a]):
            out.append((a, b))
    return sorted(out)


def _odd(text: str) -> bool:
    """Whether a misread character is possible, other than one that only the counts show: single signs are looked for first."""
    if _STRAY.search(text) or (_DIGIT.search(text) and _DIGIT_IN.search(text)):
        return True
    return not text.isascii() and _LATIN.search(text) is not None and _MIXED.search(text) is not None


def _holds(span: tuple[int, int], places: list[int]) -> bool:
    """Whether one of the ordered places lies in the span."""
    k = bisect_left(places, span[0])
    return k < len(places) and places[k] < span[1]


def examine(raw: str, title: re.Pattern[str] | None) -> Finding:
    """Findings in one text; the text comes back in composed form."""
    text = unicodedata.normalize("NFC", raw)
    found = Finding(text)
    if title is not None:
        found.headers, found.pages = headers(text, title)
    if found.headers:
        found.kinds.add("header")
    body = _blank(text, found.headers)
    found.pages += _pages(_blank(body, found.pages))
    if found.pages:
        found.kinds.add("pageno")
    body = _blank(body, found.pages)
    # a division may have the header or the page number between its halves
    divided = [m.end(1) for m in _DIVIDED.finditer(body)] if _DIVIDER.search(body) else []
    if divided:
        found.kinds.add("hyphen")
    bad: list[tuple[int, int]] = []
    if _odd(body):
        for m in _PIECE.finditer(body):
            piece = m.group(0)
            if _MIXED.search(piece) or ("�" in piece and _ANY.search(piece)):
                bad.append(m.span())
            elif _DIGIT_IN.search(piece) and not _PLAIN_CODE.fullmatch(piece) and (sum(c.isalpha() for c in piece) >= 2 or _GREEK.search(piece)):
                bad.append(m.span())
        strays = sorted(m.span() for m in _BETWEEN.finditer(body))
        starts = [a for a, _ in strays]
        found.broken = sorted({*bad, *(m.span() for m in _PIECE.finditer(body) if _holds(m.span(), starts))})
        bad += strays
    if bad:
        found.kinds.add("glyph")
    if not bad and not divided:
        found.words = [(known_form(m.group(0)), m.start(), m.end()) for m in _WORD.finditer(body)]
        return found
    # the halves of a division and the pieces of a misread word are no words
    clean = _blank(body, bad)
    cut = {*divided, *(b for _, b in bad)}
    edge = {a for a, _ in bad}
    for m in _WORD.finditer(clean):
        a, b = m.span()
        if b in edge or b in cut or a in cut or (a and clean[a - 1].isspace() and _after_divider(clean, a)):
            continue
        if body[b : b + 1] in _TOUCH or (a and body[a - 1] in _TOUCH):
            continue
        found.words.append((known_form(m.group(0)), a, b))
    return found


def _after_divider(text: str, at: int) -> bool:
    """Whether the white space before a place follows a divided word."""
    k = at - 1
    while k >= 0 and text[k].isspace():
        k -= 1
    return k > 0 and text[k] in DIVIDERS and text[k - 1].isalpha()


def scanned(texts: DataFrame, works: DataFrame) -> DataFrame:
    """(src, row_id, text, titles): texts with their work's running titles, learned from masked lines and given in ``works``; null texts are dropped, a work without a title gives null."""
    given = works.filter((F.trim("running_title") != "") & F.col("work_id").isNotNull()).select("work_id", F.col("running_title").alias("title"))
    learned = Scratch(texts.sparkSession, "titles").put(masked_titles(texts.select("work_id", "text")))
    # bounded by the different headers of one work
    titles = given.unionByName(learned).groupBy(F.col("work_id").alias("__work")).agg(F.sort_array(F.collect_set("title")).alias("titles"))
    return texts.filter(F.col("text").isNotNull()).join(titles, F.col("work_id") == F.col("__work"), "left").select("src", "row_id", "text", "titles")


def divided(between: str) -> bool:
    """Whether what stands between two words may be a division: white space, or one sign of division."""
    return between.isspace() or (len(between) == 1 and between in DIVIDERS)


_SPAN = pa.struct([("a", pa.int32()), ("b", pa.int32())])


def examined(rows: DataFrame, places: bool = True) -> DataFrame:
    """One row per text of ``scanned``, and pre-counted rows of words by batch; to be written once and read by all that follows.

    ``text`` composed, ``kinds`` shown by the text itself, ``cuts`` headers and page numbers, ``broken`` words with impossible characters and ``guesses`` of their forms, ``forms`` of
    the words that may be counted, with the characters between each and the one before (``gaps``) and its own (``sizes``), and whether a division may stand before each (``near``). Without ``places``, which only the repair reads, text, cuts, broken, gaps and sizes stay null. Rows with a null ``forms`` are counts: form, surface, n.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    id_type = to_arrow_type(kinds["row_id"])
    schema = pa.schema([("src", pa.string()), ("row_id", id_type), ("text", pa.string()), ("kinds", pa.list_(pa.string())), ("cuts", pa.list_(_SPAN)), ("broken", pa.list_(_SPAN)), ("guesses", pa.list_(pa.string())), ("forms", pa.list_(pa.string())), ("gaps", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("near", pa.list_(pa.bool_())), ("form", pa.string()), ("surface", pa.string()), ("n", pa.int64())])
    spans = "array<struct<a:int,b:int>>"
    ddl = f"src string, row_id {kinds['row_id'].simpleString()}, text string, kinds array<string>, cuts {spans}, broken {spans}, guesses array<string>, forms array<string>, gaps array<int>, sizes array<int>, near array<boolean>, form string, surface string, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: dict[tuple[str, ...], re.Pattern[str]] = {}
        for batch in batches:
            out: list[dict[str, object]] = []
            counted: Counter[str] = Counter()
            for src, row, text, titles in zip(*(batch.column(c).to_pylist() for c in ("src", "row_id", "text", "titles"))):
                known = tuple(titles or ())
                if known and known not in patterns:
                    if len(patterns) > 10_000:
                        patterns.clear()
                    patterns[known] = title_pattern(*known)
                f = examine(text, patterns.get(known))
                words = f.words
                counted.update([f.text[a:b].lower() for _, a, b in words])
                pair = lambda xs: [{"a": a, "b": b} for a, b in xs]
                ends = [-1, *(e for _, _, e in words)]
                near = [e >= 0 and (f.text[e:a] == " " or divided(f.text[e:a])) for e, (_, a, _) in zip(ends, words)]
                one = {"src": src, "row_id": row, "kinds": sorted(f.kinds), "guesses": sorted({guess(f.text[a:b]) for a, b in f.broken}), "forms": [w for w, _, _ in words], "near": near}
                if places:
                    one |= {"text": f.text, "cuts": pair(_joined(f.headers + f.pages)), "broken": pair(f.broken), "gaps": [a - max(e, 0) for e, (_, a, _) in zip(ends, words)], "sizes": [b - a for _, a, b in words]}
                out.append(one)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_pylist([{"form": known_form(w), "surface": w, "n": n} for w, n in counted.items()], schema=schema)

    return rows.select("src", "row_id", "text", "titles").mapInArrow(run, ddl)


def _lists(column: pa.ListArray) -> Iterator[list[object]]:
    """The lists of a column without nulls, taken from its values at once, which is many times faster than list by list."""
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return (flat[a:b] for a, b in zip([0, *ends], ends))


def count_forms(found: DataFrame, extra: DataFrame) -> DataFrame:
    """(form, n, surface): how often each word form stands in the examined texts and in the ``extra`` texts (column text), which are taken as clean, and how it is mostly written.

    Pre-counted by batch, so a frequent word is a few rows when it is shuffled.
    """

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter[str] = Counter()
            for t in b["text"]:
                c.update(_WORD.findall(unicodedata.normalize("NFC", t).lower()))
            yield pd.DataFrame({"form": [known_form(w) for w in c], "surface": list(c), "n": list(c.values())})

    others = extra.filter(F.col("text").isNotNull()).select("text").mapInPandas(plain, "form string, surface string, n bigint")
    by_surface = found.filter(F.col("forms").isNull()).select("form", "surface", "n").unionByName(others).groupBy("form", "surface").agg(F.sum("n").alias("n"))
    return by_surface.groupBy("form").agg(F.max_by("surface", F.struct("n", "surface")).alias("surface"), F.sum("n").alias("n"))


def suspects(found: DataFrame, shared: Broadcast[tuple[frozenset[str], frozenset[str], frozenset[str]]]) -> DataFrame:
    """(src, row_id, kind, a, b, c): words and neighbours of a text that the counts may show to be noise, each once a text.

    ``shared`` holds the common forms; those of them that a still more frequent form of their skeleton may replace; and those that may be the reading of a doubtful form. 'word' is a
    form a between its neighbours b and c, 'pair' two neighbours a, b between which a division may stand, 'context' two neighbours a, b.

    What is left out cannot count: a common form needs a reading that is more frequent and so common too; if both parts of a divided word are common, the joined form must be
    more frequent than the rarer and so common too; a context is only asked for the reading of a doubtful form.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, open_, asked = shared.value
        for batch in batches:
            out: list[tuple[object, ...]] = []
            for src, row, forms, near in zip(batch.column("src").to_pylist(), batch.column("row_id").to_pylist(), _lists(batch.column("forms")), _lists(batch.column("near"))):
                seen: set[tuple[str, ...]] = set()
                n = len(forms)
                rare = [w not in common for w in forms]
                for i, w in enumerate(forms):
                    last = forms[i - 1] if i else None
                    if (rare[i] or w in open_) and len(w) >= LEAST_LETTERS and (w,) not in seen:
                        seen.add((w,))
                        out.append((src, row, "word", w, last, forms[i + 1] if i + 1 < n else None))
                    if last is None or (last, w) in seen:
                        continue
                    some = rare[i] or rare[i - 1]
                    if near[i] and (some or last + w in common):
                        seen.add((last, w))
                        out.append((src, row, "pair", last, w, None))
                    elif some or w in asked or last in asked:
                        seen.add((last, w))
                        out.append((src, row, "context", last, w, None))
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), batch.column("row_id").type, *[pa.string()] * 4))], ["src", "row_id", "kind", "a", "b", "c"])

    kinds = dict(found.dtypes)
    texts = found.filter(F.col("forms").isNotNull()).select("src", "row_id", "forms", "near")
    return texts.mapInArrow(run, f"src string, row_id {kinds['row_id']}, kind string, a string, b string, c string")


@dataclass
class Evidence:
    """Tables written by ``weigh``: what each text shows by itself, and the readings that the counts give."""

    texts: DataFrame  # (src, row_id, text, cuts, broken, gaps, sizes): the texts as ``examined``
    local: DataFrame  # (src, row_id, kind)
    glyphs: DataFrame  # (src, row_id, a, reading): words that only the counts show to be misread
    broken: DataFrame  # (src, row_id, a, reading): words whose characters show it, where a reading is known
    joins: DataFrame  # (src, row_id, a, b)


def _skeleton_col(c: Column) -> Column:
    for pair, sign in MERGED:
        c = F.replace(c, F.lit(pair), F.lit(sign))
    return F.translate(c, "".join(_SIGN), "".join(_SIGN.values()))


def weigh(rows: DataFrame, extra: DataFrame, *, ratio: int = RATIO, supported: int = SUPPORTED, systematic: int = SYSTEMATIC, lift: int = LIFT, known: int = KNOWN, heavy: int = HEAVY, places: bool = True) -> Evidence:
    """All evidence of noise in (src, row_id, text, titles) rows; ``extra`` are texts (column text) that only add to the counts.

    Words are counted with map-side sums. There are fewer than ``heavy`` common forms, so they are broadcast, and only the words that ``suspects`` leaves are shuffled. Null
    titles find no headers. Texts without words show only what their characters show.
    ``repair`` needs the ``places`` of words; the noise alone does not.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "scans")
    texts = scratch.put(examined(rows, places))
    forms = scratch.put(count_forms(texts, extra))
    counted = forms.filter(F.col("n") >= known)
    best = counted.groupBy(_skeleton_col(F.col("form")).alias("skeleton")).agg(F.max_by("form", F.struct("n", "form")).alias("reading"), F.max_by("surface", F.struct("n", "form")).alias("surface"), F.max("n").alias("most"))
    best = scratch.put(best)
    # every form that a more frequent one of its skeleton may replace
    mates = forms.filter(F.char_length("form") >= LEAST_LETTERS).select(F.col("form").alias("a"), "n").withColumn("skeleton", _skeleton_col(F.col("a"))).join(best, "skeleton")
    likely = mates.filter((F.col("reading") != F.col("a")) & (F.col("most") >= F.col("n") * supported))
    likely = scratch.put(likely.select("a", "reading", "surface", "n", "most", (F.col("most") >= F.col("n") * systematic).alias("sure")).filter(F.col("sure") | (F.char_length("a") >= CONTEXT_LETTERS)))

    total = forms.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).collect()[0]["n"]  # one row
    least = max(known, total // heavy)
    # bounded, all three: fewer than `heavy` forms can each have more than total / heavy of all occurrences
    top = forms.filter(F.col("n") > least)
    open_ = likely.filter(F.col("n") > least).select("a")
    asked = likely.filter(~F.col("sure") & (F.col("most") > least)).select("reading").distinct()
    shared = spark.sparkContext.broadcast(tuple(frozenset(r[0] for r in t.collect()) for t in (top.select("form"), open_, asked)))
    found = scratch.put(suspects(texts, shared))

    doubtful = found.filter("kind = 'word'").select("src", "row_id", "a", F.col("b").alias("before"), F.col("c").alias("after")).join(likely, "a")
    sure = doubtful.filter("sure").select("src", "row_id", "a", F.col("surface").alias("reading"))
    # context: in other texts the reading stands beside the same word, and more often than chance would have it
    unsure = doubtful.filter("NOT sure")
    beside = F.explode(F.array(F.struct(F.col("before").alias("l"), F.col("reading").alias("r"), F.col("before").alias("other")), F.struct(F.col("reading").alias("l"), F.col("after").alias("r"), F.col("after").alias("other"))))
    wanted = unsure.select("src", "row_id", "a", "surface", "most", beside.alias("p")).select("src", "row_id", "a", "surface", "most", "p.*").filter(F.col("other").isNotNull())
    times = found.filter("kind IN ('pair', 'context')").groupBy(F.col("a").alias("l"), F.col("b").alias("r")).agg(F.count("*").alias("times")).filter("times > 1")
    met = wanted.join(times, ["l", "r"]).join(forms.select(F.col("form").alias("other"), F.col("n").alias("n_other")), "other")
    backed = met.filter(F.col("times") * total >= F.lit(lift) * F.col("n_other") * F.col("most")).select("src", "row_id", "a", F.col("surface").alias("reading"))
    glyphs = scratch.put(sure.unionByName(backed).distinct())

    pair = found.filter("kind = 'pair'").select("src", "row_id", "a", "b", F.concat("a", "b").alias("form"))
    whole = scratch.put(pair.join(counted.select("form", F.col("n").alias("whole")), "form"))
    part = lambda c: forms.select(F.col("form").alias(c), F.col("n").alias(f"n_{c}"))
    rarer = F.least("n_a", "n_b")
    joins = whole.join(part("a"), "a").join(part("b"), "b").filter(F.col("whole") >= rarer * ratio).select("src", "row_id", "a", "b")
    torn = texts.filter(F.col("forms").isNotNull() & (F.size("guesses") > 0)).select("src", "row_id", F.explode("guesses").alias("a"))
    whole_ = torn.filter(~F.col("a").contains(LOST)).withColumn("skeleton", _skeleton_col(F.col("a"))).join(best.select("skeleton", F.col("surface").alias("reading")), "skeleton")
    # a lost character may be any: known forms with each of their characters lost in turn
    places = F.explode(F.sequence(F.lit(1), F.char_length("form")))
    gapped = counted.select("form", "surface", "n", places.alias("k")).select(F.concat(F.expr("substring(form, 1, k - 1)"), F.lit(LOST), F.expr("substring(form, k + 1)")).alias("a"), "surface", "n")
    filled = torn.filter(F.col("a").contains(LOST)).join(gapped, "a").groupBy("src", "row_id", "a").agg(F.max_by("surface", F.struct("n", "surface")).alias("reading"))
    mended = whole_.select("src", "row_id", "a", "reading").unionByName(filled)
    local = texts.filter(F.col("forms").isNotNull()).select("src", "row_id", F.explode("kinds").alias("kind"))
    return Evidence(texts.filter(F.col("forms").isNotNull()), local, glyphs, mended, scratch.put(joins.distinct()))


def noise(evidence: Evidence) -> DataFrame:
    """(src, row_id, noise): one row per text and kind present."""
    kind = lambda df, k: df.select("src", "row_id", F.lit(k).alias("noise"))
    rows = evidence.local.withColumnRenamed("kind", "noise")
    # of a divided word the halves are no misreadings
    halves = evidence.joins.select("src", "row_id", F.explode(F.array("a", "b")).alias("a")).distinct()
    glyphs = evidence.glyphs.join(halves, ["src", "row_id", "a"], "left_anti")
    return rows.unionByName(kind(glyphs, "glyph")).unionByName(kind(evidence.joins, "hyphen")).distinct()


def _like(word: str, reading: str) -> str:
    """The reading in the word's case."""
    return reading.upper() if word.isupper() and len(word) > 1 else reading.capitalize() if word[:1].isupper() else reading


def _with_line(text: str, a: int, b: int) -> tuple[int, int]:
    """A span with its line's end if it is all that the line holds, so that no blank line is left."""
    if _line_edge(text, a, -1) in ("", "\n", "\r") and _line_edge(text, b, 1) in ("\n", "\r"):
        while text[b] in " \t":
            b += 1
        return a, b + (2 if text[b : b + 2] == "\r\n" else 1)
    return a, b


def repair_text(text: str, cuts: list[tuple[int, int]], broken: list[tuple[int, int]], words: list[tuple[str, int, int]], readings: dict[str, str], joined: set[tuple[str, str]]) -> str:
    """The text without headers and page numbers, divided words joined, misread words read. Lines stay."""
    edits: list[tuple[int, int, str]] = [(*_with_line(text, a, b), "") for a, b in cuts]
    for a, b in broken:
        w = guess(text[a:b])
        if w in readings:
            edits.append((a, b, _like(text[a:b], readings[w])))
    for i, (w, a, b) in enumerate(words):
        nxt = words[i + 1] if i + 1 < len(words) else None
        if nxt and (w, nxt[0]) in joined and divided(text[b : nxt[1]]):
            edits.append((b, nxt[1], ""))
        elif w in readings:
            edits.append((a, b, _like(text[a:b], readings[w])))
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            out += [text[at:a], new]
            at = b
    text = "".join([*out, text[at:]])
    text = re.sub(rf"(?<={_LETTER})([̀-ͯ]*)[{re.escape(DIVIDERS)}]\s+(?={_LETTER})", r"\1", text)
    return re.sub(rf"(?<={_LETTER})[{STRAY}]+(?={_LETTER})", "", text)


def repair(evidence: Evidence) -> DataFrame:
    """(src, row_id, paragraph, text): the repaired texts as continuous paragraphs, numbered from 0.

    Lines are joined by windows over the lines of each text: a paragraph ends at a blank line and after a line that ends a sentence and is clearly shorter than
    the text's longest line. Null and blank texts give no paragraph. ``src`` and ``row_id`` together must be unique.
    """
    readings = evidence.glyphs.unionByName(evidence.broken).groupBy("src", "row_id", "a").agg(F.min("reading").alias("reading")).groupBy("src", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "reading"))).alias("readings"))
    joined = evidence.joins.groupBy("src", "row_id").agg(F.collect_list(F.struct("a", "b")).alias("joined"))
    keys = ["src", "row_id"]
    # the places of words are small numbers and their forms are taken from the text again, since this is what is shuffled
    texts = evidence.texts.select(*keys, "text", "cuts", "broken", "gaps", "sizes")
    full = texts.join(readings, keys, "left").join(joined, keys, "left")
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts, broken, readings, joined, gaps, sizes in zip(*(batch.column(c).to_pylist() for c in ("text", "cuts", "broken", "readings", "joined")), *(_lists(batch.column(c)) for c in ("gaps", "sizes"))):
                plain = lambda xs: [(x["a"], x["b"]) for x in xs]
                words, end = [], 0
                for gap, size in zip(gaps, sizes) if readings or joined else ():  # nothing else needs the words
                    at, end = end + gap, end + gap + size
                    words.append((known_form(text[at:end]), at, end))
                fixed = repair_text(text, plain(cuts), plain(broken), words, dict(readings or ()), {(p["a"], p["b"]) for p in joined or ()})
                out.append([x.strip() for x in _LINES.split(fixed)])
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("row_id"), pa.array(out, pa.list_(pa.string()))], ["src", "row_id", "lines"])

    lined = full.mapInArrow(run, f"src string, row_id {kinds['row_id']}, lines array<string>").select("src", "row_id", F.posexplode("lines").alias("no", "line"))
    text = Window.partitionBy("src", "row_id")
    order = text.orderBy("no")
    before = F.lag("line").over(order)
    short = F.char_length(before) < 0.6 * F.max(F.char_length("line")).over(text)
    ends = before.rlike(r"[.;·!?;·]$")
    breaks = F.when((before == "") | (ends & short), 1).otherwise(0)
    numbered = lined.withColumn("break", breaks).withColumn("part", F.sum("break").over(order)).filter(F.col("line") != "")
    parts = numbered.groupBy("src", "row_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), " ").alias("text"))
    dense = F.row_number().over(Window.partitionBy("src", "row_id").orderBy("part")) - 1
    return parts.select("src", "row_id", dense.alias("paragraph"), "text")
