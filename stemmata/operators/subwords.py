"""Subword encoding with a given list of merges.

The merges come from a model file; none are learned here. Without a model the words themselves are the subwords, and
with a merge limit of 0 the characters are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
STOPS = 50


@dataclass(frozen=True)
class Model:
    """Merges in order of rank, and subwords that carry no meaning. A model without merges is untrained."""

    merges: tuple[tuple[str, str], ...] = ()
    stop: frozenset[str] = field(default_factory=frozenset)
    trained: bool = False

    def ranks(self, limit: int | None = None) -> dict[tuple[str, str], int]:
        kept = self.merges if limit is None else self.merges[:limit]
        return {pair: i for i, pair in enumerate(kept)}


def load(path: str) -> Model:
    """A model file {"merges": [[a, b], ...], "stop": [...]}; a missing or broken file gives an untrained model."""
    try:
        raw = json.loads(Path(path).read_text(encoding="utf-8"))
        merges = tuple((a, b) for a, b in raw["merges"])
        return Model(merges, frozenset(raw.get("stop", [])), bool(merges))
    except (OSError, ValueError, KeyError, TypeError):
        return Model()


def save(model: Model, path: str) -> None:
    Path(path).write_text(json.dumps({"merges": [list(m) for m in model.merges], "stop": sorted(model.stop)}, ensure_ascii=False), encoding="utf-8")


def encode_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the pair of the lowest rank, leftmost first, until none applies; the last piece carries the end mark."""
    if not word:
        return []
    parts = [*word[:-1], word[-1] + END]
    while len(parts) > 1:
        rank, at = min((ranks.get((parts[k], parts[k + 1]), len(ranks)), k) for k in range(len(parts) - 1))
        if rank == len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def word_counts(units: DataFrame) -> DataFrame:
    """(word, n): normalised word tokens over all units."""
    return units.select(F.explode("norm").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def dictionary(words: DataFrame, model: Model, limit: int | None = None) -> DataFrame:
    """(word, subs): each distinct word encoded once. ``words`` has a column word."""
    ranks = words.sparkSession.sparkContext.broadcast(model.ranks(limit))  # the size of the model file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "subs": [encode_word(w, ranks.value) for w in b["word"]]})

    return words.select("word").distinct().mapInPandas(run, "word string, subs array<string>")


def encoded(units: DataFrame, model: Model, limit: int | None = None) -> DataFrame:
    """Units with ``subs`` and ``s2w``, subwords in order and the word each belongs to. Stop subwords are left out before n-grams are made.

    An untrained model gives the words themselves. Words are encoded where they stand, each distinct word of a task once.
    """
    if not model.trained and limit is None:
        return units.withColumn("subs", F.col("norm")).withColumn("s2w", F.when(F.size("norm") > 0, F.sequence(F.lit(0), F.size("norm") - 1)).otherwise(F.array().cast("array<int>")))
    shared = units.sparkSession.sparkContext.broadcast((model.ranks(limit), model.stop))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, stop = shared.value
        known: dict[str, list[str]] = {}
        for b in batches:
            subs, owners = [], []
            for words in b["norm"]:
                s, o = [], []
                for k, w in enumerate(words):
                    if w not in known:
                        if len(known) > 1 << 20:
                            known.clear()
                        known[w] = [x for x in encode_word(w, ranks) if x not in stop]
                    s += known[w]
                    o += [k] * len(known[w])
                subs.append(s)
                owners.append(o)
            yield b.assign(subs=subs, s2w=owners)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema.fields)
    return units.mapInPandas(run, f"{schema}, subs array<string>, s2w array<int>")


def stop_subwords(counts: DataFrame, subs: DataFrame, most: int = STOPS) -> DataFrame:
    """(sub, n): the most frequent word-final subwords by (count, subword) descending. ``counts`` is (word, n), ``subs`` a dictionary."""
    rows = subs.join(counts, "word").select(F.explode("subs").alias("sub"), "n").filter(F.col("sub").contains(END))
    total = rows.groupBy("sub").agg(F.sum("n").alias("n"))
    return total.orderBy(F.col("n").desc(), F.col("sub").desc()).limit(most)
