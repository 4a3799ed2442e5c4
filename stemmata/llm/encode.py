"""Encoding a corpus with a public byte-level BPE vocabulary.

Forced boundaries: a pair of neighbouring bytes that occurs inside no vocabulary token can never be
merged, so a cut there changes nothing. Texts are cut at such pairs into fragments, each fragment is
encoded by itself, and the ids are concatenated. Three conditions keep the splitting pattern that
runs before the merges in step with the cut:

* the cut lies between two characters, never inside one;
* the character before it is not white space (a run of white space is split by what follows it);
* the character after it is not an apostrophe (``'s`` and its like are recognised at a start).

Inside a run of letters, digits or other signs the rest of a run is the same piece wherever it
starts, so a cut that meets these conditions gives exactly the ids of the uncut text.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.scratch import Scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the splitting pattern that belongs to the vocabulary (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: characters after which the next certain cut is taken
FRAGMENT = 512
#: texts over this many characters are spread over tasks, in spans of about SPAN characters
LONG = 1 << 20
SPAN = 1 << 18
_ROW, _SPAN, _IDS = "__row", "__span", "__ids"


class Codec:
    """The encoder and its certain cuts, built from the vocabulary's ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.joined = bytearray(1 << 16)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.joined[a << 8 | b] = 1

    def certain(self, a: str, b: str) -> bool:
        """Whether a cut between two neighbouring characters is certain."""
        if b == "'" or a.isspace():
            return False
        return not self.joined[a.encode("utf-8", "replace")[-1] << 8 | b.encode("utf-8", "replace")[0]]

    def fragments(self, text: str, least: int) -> Iterator[str]:
        """Cut at the first certain place at or after every ``least`` characters; joined they are the text."""
        start, n = 0, len(text)
        while n - start > least:
            cut = start + least
            while cut < n and not self.certain(text[cut - 1], text[cut]):
                cut += 1
            yield text[start:cut]
            start = cut
        if start < n:
            yield text[start:]

    def encode(self, text: str, least: int = FRAGMENT) -> list[int]:
        ids: list[int] = []
        for piece in self.fragments(text, least):
            ids += self.encoding.encode_ordinary(piece)
        return ids


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=2)
def _codec(raw: bytes) -> Codec:
    return Codec(load_ranks(raw))


def _vocabulary(df: DataFrame, path: str) -> Broadcast[bytes]:
    """The vocabulary file (under 1 MB) from the driver; executors need no file of their own."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encoded(df: DataFrame, raw: Broadcast[bytes], text: str, out: str, keep: list[str], fragment: int, count: bool) -> DataFrame:
    """``keep`` columns plus the ids (or only their number) of the ``text`` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for batch in batches:
            ends, flat = [0], []
            for value in batch.column(text).to_pylist():
                flat.append(np.asarray(codec.encode(value, fragment) if value else [], dtype=np.int32))
                ends.append(ends[-1] + len(flat[-1]))
            if count:
                got = pa.array(np.diff(np.asarray(ends, dtype=np.int64)))
            else:
                got = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), got], [*keep, out])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{out}` " + ("bigint" if count else "array<int>")])
    return df.select(*keep, text).mapInArrow(run, schema)


def _spans(df: DataFrame, raw: Broadcast[bytes], key: str, text: str, span: int) -> DataFrame:
    """Long texts cut at certain places into spans: key, a number of the row drawn at random, span number, text of the span.

    The row's number, not its key, holds the spans together, so keys may repeat or be null. It must be written before it is used: a task that runs again draws anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(raw.value)
        for batch in batches:
            for k, value in zip(batch.column(key), batch.column(text)):
                row = uuid.uuid4().hex
                for no, piece in enumerate(codec.fragments(value.as_py(), span)):
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.column(key).type), pa.array([row]), pa.array([no], pa.int32()), pa.array([piece])], [key, _ROW, _SPAN, text])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(key, text).mapInArrow(run, f"`{key}` {kinds[key]}, {_ROW} string, {_SPAN} int, `{text}` string")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", *, vocabulary: str = VOCABULARY, fragment: int = FRAGMENT, long: int = LONG, span: int = SPAN, count: bool = False) -> DataFrame:
    """(``key``, ``out``): the token ids of every text, or their number with ``count``.

    No special tokens: strings that look like one are plain text. Null and empty texts give an empty list
    (count 0). Every row gives one row, at any length; repeated rows and repeated or null keys too. An unpaired
    surrogate cannot occur in a Spark string. Other columns are ignored; an empty table gives an empty table.

    Texts up to ``long`` characters are encoded where they lie, without a shuffle. Longer ones are cut into
    spans, which are written so that any task may take them and one giant text does not hold up a task; the rows are the same either way.
    """
    raw = _vocabulary(df, vocabulary)
    size = F.coalesce(F.char_length(text), F.lit(0))
    short = _encoded(df.filter(size <= long), raw, text, out, [key], fragment, count)
    written = Scratch(df.sparkSession, "spans").put(_spans(df.filter(size > long), raw, key, text, span))
    parts = _encoded(written.repartition(F.col(_ROW), F.col(_SPAN)), raw, text, _IDS, [key, _ROW, _SPAN], fragment, count).groupBy(_ROW)
    if count:
        whole = F.sum(_IDS)
    else:
        whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(_SPAN, _IDS))), lambda x: x[_IDS]))  # the ids of one text
    return short.unionByName(parts.agg(F.first(key).alias(key), whole.alias(out)).select(key, out))
