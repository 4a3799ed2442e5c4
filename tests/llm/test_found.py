"""The pN operators on small fixtures, against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest

from stemmata.functions.text import tokens
from stemmata.llm import cutoff, groups, repeats, spans, split, terms, topn
from stemmata.operators.current import latest


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (2, 1, "x"), (None, 2, "n"), (None, 1, "m"), (3, None, "q")], "k int, t int, v string")
    assert sorted((r["k"] is None, r["k"] or 0, r["v"]) for r in latest(df, ["k"], ["t"]).collect()) == [(False, 1, "new"), (False, 2, "x"), (False, 3, "q"), (True, 0, "n")]
    assert latest(df.limit(0), ["k"], ["t"]).count() == 0


# 1 ---------------------------------------------------------------------------------------------

UNIT = ["work_id", "chapter", "page"]


def parts(spark, rows):
    return split.parts_of(spark.createDataFrame(rows, "work_id string, chapter string, page string, seg_pos int, text string, length string"))


def test_boundaries(spark):
    long = "word " * 500
    df = parts(spark, [("a", "1", None, 0, "x" * 1500, None), ("a", "1", "", 3, "y" * 1500, None), ("b", "1", "p", 0, long, None), ("c", "1", "p", 0, "z" * 2500, None), ("d", "1", "p", 0, "short", None), ("d", "1", "p", 1, None, None), ("e", "1", "p", 0, "s" * 1200 + ". " + "t" * 1200, None), ("f", "1", "p", 0, "s" * 1200 + "\n \n" + "t" * 1200, None)])
    table = split.boundary_table(df, UNIT, "seg_pos")
    got = {r["work_id"]: r["boundary"] for r in split.oversized(table, UNIT).collect()}
    assert got == {"a": "sentence", "b": "word", "c": "none", "e": "sentence", "f": "sentence"}
    assert split.oversized(table.limit(0), UNIT).count() == 0


def test_ranges_are_stitched(spark):
    """Whatever the span of a range, the tables say of a text what the text read whole says."""
    rng = random.Random(12)
    signs = ["a", "λό", ". ", "; ", " ", "  ", "\n", "\n \n", "x" * 9, "end.", "·", " q! ", "\u2003"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 120))) for _ in range(150)] + ["a " * 90, " " * 60 + "b" + " " * 60, "x" * 200, ". " * 70]
    for t in texts:
        starts = split.borders(t, 16)
        assert starts == sorted(set(starts)) and all(not t[a - 1].isspace() for a in starts[1:])
    df = spark.createDataFrame([("w", "1", None, k, t) for k, t in enumerate(texts)], "work_id string, chapter string, page string, seg_pos int, text string")
    want = {k: (len(t), max(len(s.strip()) for s in split._BETWEEN.split(t)), max(map(len, t.split()), default=0)) for k, t in enumerate(texts)}
    for span in (16, 50, 1 << 16):
        got = {r["seg_pos"]: (r["length"], r["sentence"], r["run"]) for r in split.boundary_table(df, UNIT, "seg_pos", limit=10, span=span).collect()}
        assert got == {k: v if v[0] > 10 else (v[0], 0, 0) for k, v in want.items()}


def test_a_giant_part_is_linear():
    """The characters handed on grow with the part, not with its square."""
    text = "word. " * 50_000
    starts = split.borders(text, 1000)
    assert sum(b - a for a, b in zip(starts, [*starts[1:], len(text)])) == len(text) and len(starts) == 300


@pytest.mark.parametrize("span", [100, 1 << 16])
def test_pieces(spark, span):
    rng = random.Random(4)
    words = ["λόγος", "ab", "κ" * 30, "τε", "end.", "x" * 70, "q;"]
    rows = [(w, "1", "", p * 3, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), None) for w in "abc" for p in range(rng.randint(1, 40))]
    df = parts(spark, rows)
    table = split.boundary_table(df, UNIT, "seg_pos", limit=40)
    whole = {}
    for w, _, _, p, t, _ in sorted(rows, key=lambda r: (r[0], r[3])):
        whole[w] = whole[w] + " " + t if w in whole else t
    by = defaultdict(list)
    for r in split.pieces(df, table, UNIT, "seg_pos", limit=40, overlap=8, span=span).collect():
        by[r["work_id"]].append(r)
    assert set(by) == {w for w, t in whole.items() if len(t) > 40}
    for w, found in by.items():
        found.sort(key=lambda r: r["start"])
        assert found[0]["start"] == 0 and found[-1]["end"] == len(whole[w])
        for r in found:
            assert 0 < r["end"] - r["start"] <= 40 and r["text"] == whole[w][r["start"] : r["end"]]
            if r["cut"] == "word":
                assert whole[w][r["end"]].isspace()
        for x, y in zip(found, found[1:]):
            assert y["start"] == x["end"] - 8


def test_offsets_by_blocks(spark):
    df = parts(spark, [("a", "1", "", p, "x" * (p % 7 + 1), None) for p in range(0, 50, 2)])
    table = split.boundary_table(df, UNIT, "seg_pos")
    got = {r["seg_pos"]: r["offset"] for r in split.offsets(table, UNIT, "seg_pos", block=8).collect()}
    at = 0
    for p in range(0, 50, 2):
        assert got[p] == at
        at += p % 7 + 2


# 2 ---------------------------------------------------------------------------------------------


def test_top_n(spark):
    nan = float("nan")
    rows = [(1, "A ", "b", 5, 0.5), (2, "b", "a", 5, None), (3, "a", "B", 5, nan), (4, "a", "b", 9, 0.1), (5, None, "", 2, 0.3), (6, "a", "b", None, 1.0), (7, "b", "a", 5, 0.5)]
    df = spark.createDataFrame(rows, "match_id long, era_i string, era_j string, chain_len int, score double")
    got = topn.longest_by_era_pair(df, 4).orderBy("era_a", "rank").collect()
    assert [(r["era_a"], r["era_b"], r["match_id"]) for r in got] == [("a", "b", 4), ("a", "b", 1), ("a", "b", 7), ("a", "b", 2), ("unknown", "unknown", 5)]
    assert topn.longest_by_era_pair(df.limit(0)).count() == 0


# 3 ---------------------------------------------------------------------------------------------


def brute_pairs(rows, k):
    grams = {key: {tuple(w[i : i + k]) for t in texts if t for w in [t.split()] for i in range(len(w) - k + 1)} for key, *texts in rows}
    keys = sorted(grams)
    return [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if grams[a] & grams[b]]


def test_shared_spans(spark):
    rng = random.Random(8)
    base = [str(rng.randint(0, 40)) for _ in range(400)]
    rows = []
    for key in range(60):
        a, b = rng.randint(0, 380), rng.randint(0, 380)
        rows.append((key, " ".join(base[a : a + rng.randint(1, 25)]), rng.choice([None, "", "  ".join(base[b : b + 15])])))
    rows += [(100, "one two three four five six", "one two three four five six"), (101, "one  two three four five six", None), (102, "x " * 30, "x " * 31)]
    df = spark.createDataFrame(rows, "match_id long, snippet_i string, snippet_j string")
    for rare in (1000, 1):  # with every shared seed a formula the stretches around it find the same
        assert rows_of(spans.record_pairs(df, "match_id", ["snippet_i", "snippet_j"], 5, 3, rare)) == brute_pairs(rows, 5)
    assert spans.record_pairs(df.limit(0), "match_id", ["snippet_i", "snippet_j"], 5, 3).count() == 0
    # the shared part of each record
    grams = {key: [t.split() for t in texts if t is not None] for key, *texts in rows}
    want = {}
    for key, own in grams.items():
        others = {tuple(w[i : i + 5]) for k2, ws in grams.items() if k2 != key for w in ws for i in range(len(w) - 4)}
        n = longest = 0
        for w in own:
            hit = {i + d for i in range(len(w) - 4) if tuple(w[i : i + 5]) in others for d in range(5)}
            n += len(hit)
            longest = max([longest, *(next(j for j in range(i, len(w) + 1) if j not in hit) - i for i in hit)])
        want[key] = (sum(map(len, own)), n, longest)
    shared = {r["match_id"]: (r["words"], r["shared_words"], r["longest"]) for r in spans.shared_part(df, "match_id", ["snippet_i", "snippet_j"], [], 5, 3).collect()}
    assert shared == want


def brute_chain(found, cost):
    best = {}
    for i in sorted(range(len(found)), key=lambda i: found[i][0]):
        a, b, n = found[i]
        best[i] = max([n, *(best[j] + n - cost * (a - x - m + b - y - m) for j, (x, y, m) in enumerate(found) if j in best and x + m <= a and y + m <= b)])
    return max(best.values())


def test_chain_is_the_best_chain():
    rng = random.Random(1)
    for _ in range(200):
        found = [(rng.randint(0, 60), rng.randint(0, 60), rng.randint(3, 9)) for _ in range(rng.randint(1, 12))]
        score, path = spans.chain(found, 0.2)
        assert math.isclose(score, brute_chain(found, 0.2), abs_tol=1e-9)
        picked = [found[i] for i in path]
        assert all(x + n <= a and y + n <= b for (x, y, n), (a, b, _) in zip(picked, picked[1:]))


def test_fuzzy_passage(spark):
    left, right = [f"l{i}" for i in range(12)], [f"r{i}" for i in range(12)]
    rows = [(1, " ".join([*left, "a", "b", "c", *right])), (2, " ".join([*left, "a", "x", "c", *right]))]
    df = spans.sides(spark.createDataFrame(rows, "match_id long, text string"), "match_id", ["text"])
    r = spans.fuzzy_passages(df, "match_id").collect()
    assert len(r) == 1 and r[0]["exact"] == 26 and r[0]["matched"] == 26 and r[0]["passage_a"] == 27


def test_edited_passages_are_found(spark):
    """Recall on passages with a word changed in every nine to eleven, so that no twelve stay the same: 0.9 at least."""
    rng = random.Random(20)
    word = lambda: f"w{rng.randint(0, 5000)}"
    rows, planted = [], 0
    for key in range(0, 600, 2):
        base = [word() for _ in range(rng.randint(30, 60))]
        other, at = list(base), rng.randint(5, 10)
        while at < len(other):
            other[at] = word()
            at += rng.randint(9, 11)
        rows += [(key, " ".join([*(word() for _ in range(8)), *base])), (key + 1, " ".join([*other, *(word() for _ in range(8))]))]
        planted += 1
    df = spans.sides(spark.createDataFrame(rows, "match_id long, text string"), "match_id", ["text"])
    found = {(min(r["match_id_a"], r["match_id_b"]), max(r["match_id_a"], r["match_id_b"])) for r in spans.fuzzy_passages(df, "match_id").collect()}
    right = sum((key, key + 1) in found for key in range(0, 600, 2))
    assert right >= 0.9 * planted and right == len(found)


def test_passages_of_formulas_are_found(spark):
    """A formula that more texts have than a seed may pair drops no passage: every limit gives the rows of no limit."""
    eight, seven, six = ([f"{c}{i}" for i in range(n)] for c, n in (("e", 8), ("s", 7), ("x", 6)))
    named = [(key, " ".join([*eight, f"name{key}", *seven])) for key in range(5)]  # 15 words agree, no 12 in a row
    alone = [(key, " ".join([*(f"w{key}-{i}" for i in range(9)), *eight, *(f"v{key}-{i}" for i in range(9))])) for key in range(5, 9)]  # 8 words agree
    sided = lambda rows: spans.sides(spark.createDataFrame(rows, "match_id long, text string"), "match_id", ["text"])
    columns = ["match_id_a", "match_id_b", "chain", "score", "exact", "longest", "matched", "passage_a", "passage_b"]
    listed = lambda rows, rare: rows_of(spans.fuzzy_passages(sided(rows), "match_id", rare=rare).select(*columns))
    assert {(min(r[:2]), max(r[:2]), r[4], r[6]) for r in listed(named + alone, 4)} == {(a, b, 15, 15) for b in range(5) for a in range(b)}
    # pieces in any order with gaps, words put in between, pieces cut short at the ends of a text, sequences with many places
    rng = random.Random(3)
    rows = []
    for key in range(40):
        words = []
        for _ in range(rng.randint(2, 7)):
            piece = rng.choice([eight, seven, six, ["a"] * 13, ["b", "c"] * 6])
            words += piece[rng.choice([0, 0, 1, 2]) : rng.choice([5, 6, 7, 8, 13])] + [f"y{rng.randint(0, 5)}" for _ in range(rng.choice([0, 1, 1, 2, 20, 30]))]
        rows.append((key, " ".join(words)))
    want = listed(rows, 10**6)
    assert sum(r[5] < 12 for r in want) > 100
    for rare in (1, 4, 12):
        assert listed(rows, rare) == want


def test_texts_that_repeat_themselves():
    for x, y, want in [("a " * 500, "a " * 300 + "b", 300), ("a b " * 200, "c " + "b a " * 90, 180), ("v " + "x " * 20 + "y z w v", "x " * 8 + "y z w v", 12), ("a " * 40 + "b", "b " + "a " * 5, 5)]:
        x, y = x.split(), y.split()
        got = spans.exact_spans(spans.places(x, 6), spans.places(y, 6), (x, y), 12, 6)
        longest = max((n for _, _, n in got), default=0)
        assert (longest >= 12) == (want >= 12) and all(x[a : a + n] == y[b : b + n] for a, b, n in got)


def test_passages_with_members_name_all_pairs(spark):
    rng = random.Random(11)
    base = [str(rng.randint(0, 40)) for _ in range(300)]
    piece = lambda a, n: " ".join(base[a : a + n])
    # copies only; one record that has the least key of both classes; spans in crossed order; a text under k words twice
    rows = [(0, piece(0, 9), None), (1, piece(0, 9), None), (2, piece(20, 9), piece(22, 9)), (3, piece(20, 9), None), (4, f"{piece(50, 8)} y {piece(60, 6)}", None), (5, f"{piece(60, 6)} z {piece(50, 8)}", None), (6, "a b", "a b"), (7, "a b", None)]
    for key in range(20, 60):
        rows.append((key, piece(rng.randint(100, 280), rng.randint(1, 25)), rng.choice([None, "", piece(rng.randint(100, 280), 15)])))
    df = spark.createDataFrame(rows, "match_id long, snippet_i string, snippet_j string")
    texts = spans.sides(df, "match_id", ["snippet_i", "snippet_j"])
    owners = defaultdict(set)
    for r in spans.class_members(texts, "match_id", 5).collect():
        owners[r["c1"], r["c2"]].add(r["match_id"])
    found = spans.fuzzy_passages(texts, "match_id", 5, 3).collect()
    linked = {(min(x, y), max(x, y)) for r in found for x in owners[r["a1"], r["a2"]] for y in owners[r["b1"], r["b2"]] if x != y}
    assert set(linked) >= set(brute_pairs(rows, 5))
    exact = {(min(x, y), max(x, y)) for r in found if r["longest"] >= 5 for x in owners[r["a1"], r["a2"]] for y in owners[r["b1"], r["b2"]] if x != y}
    assert sorted(exact) == brute_pairs(rows, 5)
    for r in found:
        mine, others = owners[r["a1"], r["a2"]], owners[r["b1"], r["b2"]]
        assert r["match_id_a"] in mine and r["match_id_b"] in others and (r["match_id_a"] != r["match_id_b"] or len(mine | others) == 1)
    crossed = sorted((r["chain"], r["exact"], r["matched"]) for r in found if {r["match_id_a"], r["match_id_b"]} == {4, 5})
    assert crossed == [(0, 8, 8), (1, 6, 6)]
    assert [(r["score"], r["exact"], r["matched"], r["passage_a"]) for r in found if {r["match_id_a"], r["match_id_b"]} == {0, 1}] == [(9.0, 9, 9, 9)]


def test_chains_use_every_span():
    rng = random.Random(5)
    for _ in range(50):
        found = sorted({(rng.randint(0, 60), rng.randint(0, 60), rng.randint(3, 9)) for _ in range(rng.randint(1, 12))})
        used = []
        for score, more in spans.chains(found):
            assert math.isclose(score, brute_chain(sorted(set(found).difference(used)), spans.GAP_COST), abs_tol=1e-9)
            used += more
        assert sorted(used) == found


# 4 ---------------------------------------------------------------------------------------------


def test_tf_idf(spark):
    texts = {1: "Λόγος λογος ΛΌΓΟΣ και και", 2: "λόγος και τε", 3: None, 4: "  ", 5: "και και 12 a_b", 6: "ﬁnis finis"}
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "id long, text string, term string")
    counts = {k: Counter(tokens(t or "")) for k, t in texts.items()}
    n = sum(1 for c in counts.values() if c)
    df_of = Counter(w for c in counts.values() for w in c)
    want = {(k, w): c[w] / sum(c.values()) * (math.log((1 + n) / (1 + df_of[w])) + 1) for k, c in counts.items() for w in c}
    for share in (1, 2000):  # all joined by shuffle, and some by broadcast
        got = {(r["id"], r["term"]): r["score"] for r in terms.tf_idf(df, ["id"], heavy_share=share).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    scored = terms.tf_idf(df, ["id"])
    assert rows_of(terms.shared_rare(scored, ["id"])) == [(1, "λογοσ")] or rows_of(terms.shared_rare(scored, ["id"])) == [(1, "λογος")]
    assert terms.tf_idf(df.limit(0), ["id"]).count() == 0


# 5 ---------------------------------------------------------------------------------------------


def brute_groups(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(2)
    if shape == "random":
        links = [(f"n{rng.randint(0, 300):03}", f"n{rng.randint(0, 300):03}") for _ in range(160)] + [(None, "n001"), ("solo", "solo")]
    elif shape == "chain":
        links = [(f"c{i:03}", f"c{i + 1:03}") for i in range(150)] + [("z1", "z2")] * 3
    else:
        links = [("hub", f"leaf{i}") for i in range(100)] + [(f"leaf{i}", f"far{i}") for i in range(20)] + [("λόγος", "Ωμέγα")]
    df = spark.createDataFrame(links, "a string, b string")
    assert rows_of(groups.components(df)) == brute_groups(links)


def test_no_links(spark):
    assert groups.components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert rows_of(groups.components(spark.createDataFrame([("x", "x")], "a string, b string"))) == [("x", "x")]


def test_passages(spark):
    rows = [("w1", " 1/a#2", "w2", "1/a"), ("w2", "1/a#9", "w3", " 2 "), ("w1", "", "w9", "3"), ("w1", "#4", "w9", "3"), ("w5", None, "w9", "3"), ("w7", "1", "w8", "1")]
    df = spark.createDataFrame(rows, "work_i string, ref_i string, work_j string, ref_j string")
    assert rows_of(groups.grouped_passages(df)) == [("w1", "1/a", "w1 1/a"), ("w2", "1/a", "w1 1/a"), ("w3", "2", "w1 1/a")]


# 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bracket", [3, 50_000])
def test_cutoffs(spark, bracket):
    rng = random.Random(6)
    rows = [("hot", rng.random()) for _ in range(3000)] + [("ties", rng.choice([0.1, 0.2, 0.3])) for _ in range(200)] + [("one", 0.5), ("all", 0.4), ("all", 0.4), ("null", None), ("nan", float("nan")), (None, 0.3)]
    df = spark.createDataFrame(rows, "work_id string, score double")
    by = defaultdict(list)
    for w, s in rows:
        if w and s is not None and s == s:
            by[w].append(s)
    want = {w: sorted(v, reverse=True)[-(-len(v) // 4) - 1] for w, v in by.items()}
    cuts = cutoff.cutoffs(df, "work_id", "score", 0.25, bracket_values=bracket)
    assert {r["work_id"]: r["cutoff"] for r in cuts.collect()} == want
    told = {r["work_id"]: (r["n"], r["kept"], r["ties"]) for r in cutoff.report(df, cuts, "work_id", "score").collect()}
    assert told == {w: (len(v), sum(s >= want[w] for s in v), sum(s == want[w] for s in v)) for w, v in by.items()}
    assert cutoff.kept(df, cuts, "work_id", "score").count() == sum(k for _, k, _ in told.values())
    assert cutoff.cutoffs(df.limit(0), "work_id", "score").count() == 0


# 10 --------------------------------------------------------------------------------------------


def brute_share(text, width=8):
    w = tokens(text or "")
    seen, hit = set(), set()
    for i in range(len(w) - width + 1):
        g = tuple(w[i : i + width])
        if g in seen:
            hit.update(range(i, i + width))
        seen.add(g)
    return len(w), len(hit)


def test_repetition(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "a " * 9, "a " * 8, "Ά ά " * 20]
    for _ in range(60):
        phrase = " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 14)))
        filler = [" ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(1, 30))) for _ in range(4)]
        texts.append(". ".join(x for f in filler for x in (f, rng.choice([phrase, "", phrase.upper()]))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_repeated"]) for r in repeats.repetition(df).collect()}
    assert got == {i: brute_share(t) for i, t in enumerate(texts)}
    assert repeats.repetition(df.limit(0)).count() == 0
    many = {r["doc_id"]: (r["n_tokens"], r["n_repeated"]) for r in repeats.repetitive(df).collect()}
    assert many == {i: (n, k) for i, t in enumerate(texts) for n, k in [brute_share(t)] if n and 4 * k >= n} and len(many) > 3


def test_divergence(spark):
    plain = "the cat and the dog of the house and so on "
    rows = [(i, plain * 10, "en") for i in range(20)] + [(50, "12345 67890 !!! " * 40, "en"), (51, None, "en"), (52, "short", None), (53, plain * 10, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in repeats.divergence(df).collect()}
    assert len(got) == len(rows)
    assert got[50]["class_distance"] > 0.5 > got[0]["class_distance"] and got[50]["word_distance"] > 0.5
    assert got[51]["class_distance"] is None and got[52]["class_distance"] is None and got[53]["class_distance"] is not None
