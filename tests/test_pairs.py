"""The pass over pairs of blocks against the relational candidates and the kernel of one candidate."""

from __future__ import annotations

import random

import pytest

from stemmata.config import Params
from stemmata.operators import align, pairs, retrieval
from stemmata.plans import sweep
from stemmata.scratch import Scratch

KEY = ["work_i", "work_j", "i", "j"]


def made(spark, seed=5):
    """Units of few words, some alike, in works of different sizes; a bigram that is frequent in two of them."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("αβγδε") for _ in range(rng.randint(1, 9))) for _ in range(40)] + ["και", "τε", "λόγος" * 20]
    rows = []
    for w, n in (("a", 70), ("b", 6), ("c", 75), ("d", 1)):
        for k in range(n):
            norm = [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 20, 30]))]
            if k % 3 == 0:  # a passage with a word changed
                norm[3:3] = [rng.choice(words) if x == rng.randint(0, 9) else w_ for x, w_ in enumerate(words[:10])]
            norm += ["και", "τε"] if w in "ac" and k % 2 == 0 else []
            rows.append((w, k, "l", " ".join(norm), norm, norm))
    units = spark.createDataFrame(rows, "work_id string, unit_pos int, label string, text string, orig array<string>, norm array<string>")
    works = spark.createDataFrame([(w, w, w, w, k) for k, w in enumerate("abcd")], "work_id string, era string, author string, title string, ord int")
    return units.cache(), works


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize(("block", "mode"), [(1000, "v2"), (32, "v2"), (32, "v1")])
def test_pairs_of_blocks_give_the_candidates_and_their_alignment(spark, block, mode):
    units, works = made(spark)
    p = Params(mode=mode, cap_floor=20, min_shared=1)
    old = retrieval.candidates(units, works, p).cache()
    scratch = Scratch(spark, "test")
    blocks = pairs.packed(units, works, p.cap_floor, scratch, block)
    new = scratch.put(pairs.candidates(blocks, works, p, pairs.RECORDS))
    assert rows_of(new.select(*old.columns)) == rows_of(old) and old.count() > 100
    found = new.filter("n_blocks is not null")
    want = align.match_records(old.select(*KEY), units, p)
    columns = [*KEY, *sweep.COUNTS]
    assert rows_of(found.select(*columns)) == rows_of(want.select(*columns)) and found.count() > 10
    assert rows_of(pairs.bridge_words(found)) == rows_of(align.bridge_words(old.select(*KEY), units, p))
    assert rows_of(pairs.events(found)) == rows_of(align.pair_events(old.select(*KEY), units, p))


def test_runs_are_those_of_the_matrix(spark):
    units, works = made(spark, 6)
    p = Params(min_shared=1)
    scratch = Scratch(spark, "test")
    got = pairs.candidates(pairs.packed(units, works, p.cap_floor, scratch, 50), works, p, pairs.RUNS).collect()
    norm = {(r["work_id"], r["unit_pos"]): r["norm"] for r in units.collect()}
    for r in got:
        m = align.cells(norm[r["work_i"], r["i"]], norm[r["work_j"], r["j"]], p.fuzz)
        single = align.blocks(m, 0)
        assert (r["longest"], r["runs"]) == (int(single.core.max()), len(single.n))
    assert len(got) > 100


def test_no_unit_is_left_out_by_its_place(spark):
    text = "ἀρχὴ τοῦ λόγου περὶ τῆς ἀρετῆς".split()
    units = spark.createDataFrame([("a", 25_000, "l", "", text, text), ("b", 0, "m", "", text, text)], "work_id string, unit_pos int, label string, text string, orig array<string>, norm array<string>")
    works = spark.createDataFrame([(w, w, w, w, k) for k, w in enumerate("ab")], "work_id string, era string, author string, title string, ord int")
    assert [(r["i"], r["chain_len"]) for r in sweep.records(sweep.of_units(units, works)).collect()] == [(25_000, 6)]
