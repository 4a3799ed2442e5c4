"""The engine's operators on small fixtures: known values, brute force, properties."""

import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemmata.config import Params
from stemmata.functions import cleaning, similarity
from stemmata.functions.text import normalise
from stemmata.operators import align, current, grams, importer, numbers, packages, passages, retrieval, subwords, topos, units, verdicts
from stemmata.plans import catalog, sweep
from stemmata.scratch import root


def one(spark, expr_of, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr_of(F.col("x")).alias("y")).collect()[0]["y"]


def test_current_rows_without_shuffling_wide_columns(spark):
    rows = [(1, "k", 5, "old"), (2, "k", 7, "new"), (3, "k", 7, "newer"), (4, None, 1, "a"), (5, None, None, "b"), (6, "x", None, "only")]
    df = spark.createDataFrame(rows, "id long, k string, t int, text string")
    assert sorted(r["text"] for r in current.latest_wide(df, ["k"], ["t", "id"], "id").collect()) == sorted(r["text"] for r in current.latest(df, ["k"], ["t", "id"]).collect()) == ["a", "newer", "only"]
    assert current.latest_wide(df.limit(0), ["k"], ["t"], "id").count() == 0


# similarity -----------------------------------------------------------------------------------


def test_ratio_values(spark):
    rows = [("abc", "abd", 0.8333), ("aaaa", "bbbb", 0.5), ("", "", 1.0), ("το", "τω", 0.75)]
    df = spark.createDataFrame(rows, "a string, b string, want double")
    assert all(math.isclose(r["r"], r["want"], abs_tol=1e-4) for r in df.select("want", similarity.ratio(F.col("a"), F.col("b")).alias("r")).collect())


@pytest.mark.parametrize("a, b", [("το", "τω"), ("δε", "τε"), ("των", "την"), ("μεν", "μην"), ("103", "104"), ("605", "603"), ("18", "13")])
def test_half_the_letters_may_differ(spark, a, b):
    assert align.cells([a], [b], 0.75)[0, 0]
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(similarity.word_match(F.col("a"), F.col("b"), 0.75).alias("m")).collect()[0]["m"]


@pytest.mark.parametrize("n", [2, 4, 6, 8])
def test_one_letter_more_does_not_pass(n):
    assert align.cells(["α" * n], ["α" * (n - n // 2) + "β" * (n // 2)], 0.75)[0, 0]
    assert not align.cells(["α" * n], ["α" * (n - n // 2 - 1) + "β" * (n // 2 + 1)], 0.75)[0, 0]


def test_length_test_may_refuse_what_the_ratio_admits():
    assert 1 - align._distance("ab", "abc") / 5 >= 0.8 and not align.cells(["ab"], ["abc"], 0.8)[0, 0]


def test_distances_are_edit_distances():
    rng = random.Random(20260919)
    word = lambda: "".join(rng.choice("αβγab") for _ in range(rng.randint(0, 12)))
    a, b = [word() for _ in range(60)] + ["x" * 70, ""], [word() for _ in range(60)] + ["x" * 66 + "y", ""]
    got = align.distances(a, b)
    assert all(got[i, j] == align._distance(x, y) for i, x in enumerate(a) for j, y in enumerate(b))


# blocks ---------------------------------------------------------------------------------------


def walked(matrix, n_out):
    """Blocks by walking each diagonal."""
    out = []
    n, m = matrix.shape
    for d in range(-n + 1, m):
        here = [i for i in range(max(0, -d), min(n, m - d)) if matrix[i, i + d]]
        group = []
        for i in here:
            if group and i - group[-1] > n_out + 1:
                out.append((d, group))
                group = []
            group.append(i)
        if group:
            out.append((d, group))
    core = lambda g: max(len(x) for x in np.split(np.array(g), np.flatnonzero(np.diff(g) != 1) + 1))
    return [(g[0], g[0] + d, len(g), core(g)) for d, g in out]


@pytest.mark.parametrize("n_out", [0, 1, 2])
def test_blocks_equal_a_diagonal_walk(n_out):
    rng = np.random.default_rng(5)
    for _ in range(60):
        m = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.4
        b = align.blocks(m, n_out)
        first = np.r_[True, b.block[1:] != b.block[:-1]] if len(b.block) else []
        assert [(int(x), int(y), int(n), int(c)) for x, y, n, c in zip(b.i[first], b.j[first], b.n, b.core)] == walked(m, n_out)
        for k in range(1, 5):
            assert align.has_run(m, k) == any(c >= k for *_, c in walked(m, 0))


def test_particles_in_a_row():
    a, b = "τε και δε το μεν γαρ".split(), "τε και δε τω μην γαρ".split()
    assert align.align_one(a, b, Params()) is not None
    assert align.align_one(a[:3], b[:3], Params()) is None


def test_block_algebra():
    rng = random.Random(3)
    for _ in range(40):
        a, b = [[rng.choice("αλφα βητα γαμμα δελτα".split()) for _ in range(12)] for _ in range(2)]
        f = align.align_one(a, b, Params(ngram=2, min_chain=1))
        if f is None:
            continue
        for k in range(len(f.n)):
            i, j = f.i[f.block == k], f.j[f.block == k]
            assert len(set(i)) == len(set(j)) == f.n[k] and (np.diff(i) > 0).all() and len(set(j - i)) == 1


# cleaning and units ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [("a(1)b  [2] c", "ab c"), ("x <i>y</i> om. z", "x y z"), ("omnis om. q4 12b 7", "omnis 7"), ("a\nCreative Commons b\nc", "a c"), ("(24) a: om. λ", "λ"), (None, ""), ("  ", ""), ("α δὲ τὰ ἑξῆς β", "α β")],
)
def test_clean(spark, text, want):
    assert one(spark, cleaning.clean, text) == want


def test_apparatus_only_in_greek(spark):
    latin = "omnis homo naturaliter scire desiderat signum autem est"
    assert one(spark, cleaning.clean_text, latin) == latin
    assert one(spark, cleaning.clean_text, "ἦθος 3 6 nempe ἄλλῃ 7 ἔχει λόγος") == "ἦθος ἄλλῃ ἔχει λόγος"
    assert one(spark, cleaning.is_greek, "12 [3]") is False


def segments(spark, rows):
    return spark.createDataFrame(rows, "work_id string, seg_pos int, chapter string, page string, ref string, text string")


@pytest.mark.parametrize("n, labels", [(140, ["1/a"]), (141, ["1/a#1", "1/a#2"]), (255, ["1/a#1", "1/a#2"]), (256, ["1/a#1", "1/a#2", "1/a#3"])])
def test_windows(spark, n, labels):
    df = units.window_units(segments(spark, [("w", 0, "1", "a", "r", " ".join(f"λ{'α' * (i % 9)}ν" for i in range(n)))]))
    rows = df.orderBy("unit_pos").collect()
    assert [r["label"] for r in rows] == labels
    assert all(len(r["text"].split()) <= 140 for r in rows)
    if n == 256:
        assert len(rows[2]["text"].split()) == 256 - 230


def test_pages_join_what_belongs_together(spark):
    rows = [("w", 0, "1", None, "r0", "βητα"), ("w", 1, "2", "", "r1", "γαμμα"), ("w", 2, "1", "", "r2", "δελτα"), ("w", 3, "3", "x", "r3", None), ("w", 4, "3", "x", "r4", "(1)")]
    got = units.window_units(segments(spark, rows)).orderBy("unit_pos").collect()
    assert [(r["unit_pos"], r["label"], r["text"]) for r in got] == [(0, "1/", "βητα δελτα"), (1, "2/", "γαμμα")]
    assert units.segment_texts(segments(spark, rows)).count() == 3
    assert [r["label"] for r in units.window_units(segments(spark, rows), "segment").orderBy("unit_pos").collect()] == ["r0", "r1", "r2"]
    assert units.build_units(segments(spark, rows).limit(0)).count() == 0


def test_windows_over_many_segments(spark):
    """Words of a page come from segments of any size, also one that spans many windows, and blocks of the running sums do not show."""
    rng = random.Random(5)
    rows, pages, at = [], {}, 0
    for page in ("a", "b", None):
        for _ in range(60):
            at += rng.randint(1, 40)
            words = [f"λ{rng.randint(0, 9)}α{chr(945 + rng.randint(0, 20))}" for _ in range(rng.choice([0, 1, 3, 50, 700]))]
            rows.append(("w", at, "1", page, "r", " ".join(words)))
            pages.setdefault(page or "", []).extend(words)
    want = []
    for page, words in pages.items():
        n = max(0, -(-(len(words) - 140) // 115)) + 1
        want += [(f"1/{page}" + (f"#{k + 1}" if n > 1 else ""), words[k * 115 : k * 115 + 140]) for k in range(n)]
    got = [(r["label"], r["text"].split()) for r in units.window_units(segments(spark, rows)).orderBy("unit_pos").collect()]
    plain = [(label, [w for t in ws for w in t.split()]) for label, ws in want]
    assert [x for x, _ in got] == [x for x, _ in plain] and all(len(a) == len(b) for (_, a), (_, b) in zip(got, plain))
    summed = units.running(spark.createDataFrame([("k", i, 1) for i in range(50)], "k string, o int, v int"), ["k"], "o", "v", "s", 8)
    assert sorted((r["o"], r["s"]) for r in summed.collect()) == [(i, i) for i in range(50)]


def test_four_hundred_tokens(spark):
    u = units.tokenised(spark.createDataFrame([("λόγος " * 900,)], "text string")).collect()[0]
    assert len(u["orig"]) == len(u["norm"]) == 400 and u["norm"][0] == "λογος"


def test_normalise():
    for text in ("Ὀδυσσεύς", "ΛΟΓΟΣ", "ﬁnis", "Ἀρχὴ"):
        assert normalise(text) == "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))


# grams and candidates -------------------------------------------------------------------------


def unit_rows(spark, by_work):
    rows = [(w, p, f"{p}/", t, t.split(), t.split()) for w, texts in by_work.items() for p, t in enumerate(texts)]
    return spark.createDataFrame(rows, "work_id string, unit_pos int, label string, text string, orig array<string>, norm array<string>")


def works_of(spark, names):
    return spark.createDataFrame([(n, "7th_8th", n, n, 1, i) for i, n in enumerate(names)], "work_id string, era string, author string, title string, era_rank int, ord int")


def test_frequent_bigrams_by_direction(spark):
    same = "αλφα βητα γαμμα δελτα εψιλον ζητα"
    u = unit_rows(spark, {"a": [same], "b": [same] * 200})
    v1, v2 = Params(mode="v1"), Params()
    assert retrieval.candidates(u, works_of(spark, ["a", "b"]), v1).count() == 0
    assert retrieval.candidates(u, works_of(spark, ["b", "a"]), v1).count() == 200
    assert retrieval.candidates(u, works_of(spark, ["a", "b"]), v2).count() == retrieval.candidates(u, works_of(spark, ["b", "a"]), v2).count() == 200



def test_hot_bigrams_are_dealt_into_blocks(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"w{w}", k, ["a", "b", *(rng.choice("cdefg") for _ in range(4)), "a", "b"]) for w in range(9) for k in range(rng.randint(1, 6))]
    u = spark.createDataFrame(rows, "work_id string, unit_pos int, norm array<string>")
    works = works_of(spark, [f"w{w}" for w in range(9)])
    for p in (Params(cap_floor=2, min_shared=1), Params(cap_floor=2, min_shared=1, mode="v1")):
        want = sorted(map(tuple, retrieval.candidates(u, works, p).collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "BLOCK", 2)
            assert sorted(map(tuple, retrieval.candidates(u, works, p).collect())) == want
    few = retrieval.candidates(u, works, Params(cap_floor=100, min_shared=1, most_works=8)).count()
    assert few < retrieval.candidates(u, works, Params(cap_floor=100, min_shared=1)).count()


def test_caps(spark):
    u = spark.createDataFrame([(w, i) for w, n in (("a", 1306), ("b", 1609), ("c", 3)) for i in range(n)], "work_id string, unit_pos int").withColumn("norm", F.array(F.lit("x"), F.lit("y")))
    got = {r["work_id"]: (r["df"], r["cap"]) for r in retrieval.bigram_df(grams.bigrams(u), u).collect()}
    assert got == {"a": (1306, 52), "b": (1609, 64), "c": (3, 40)}


def test_leave_out_grams(spark):
    u = unit_rows(spark, {"a": ["p q r s t"], "b": ["p q"]})
    got = sorted(("".join(r["gram"]), r["c"]) for r in grams.leave_out_grams(u, Params()).collect())
    assert got == [("pqr", 1), ("pqs", 1), ("prs", 1), ("qrs", 2), ("qrt", 1), ("qst", 1), ("rst", 1)]


def test_top_candidates_break_ties_by_place(spark):
    df = spark.createDataFrame([("a", "b", 2, 1, 5), ("a", "b", 1, 9, 5), ("a", "b", 0, 0, 3)], "work_i string, work_j string, i int, j int, shared int")
    assert [(r["i"], r["j"]) for r in retrieval.top_candidates(df, 2).orderBy("rank").collect()] == [(1, 9), (2, 1)]


def test_clamping():
    p = Params(ngram=99, n_out=99, fuzz=0.1, min_chain=0).checked()
    assert (p.ngram, p.n_out, p.fuzz, p.min_chain) == (8, 2, 0.5, 1) and len(p.clamped) == 4


def test_sweep_finds_a_planted_passage(spark):
    shared = "ἀρχὴ τοῦ λόγου περὶ τῆς ἀρετῆς καὶ τῆς παιδείας"
    seg = segments(spark, [("w1", 0, "1", "a", "r", f"πρῶτον εἴπωμεν {shared} ἔνθα δὴ"), ("w2", 0, "1", "a", "r", f"ὡς ἔφη τις {shared} τέλος"), ("w3", 0, "1", "a", "r", "ἄλλο τι παντελῶς")])
    works = spark.createDataFrame([(w, e, w, w) for w, e in (("w1", "ancient_classical"), ("w2", "9th_10th"), ("w3", "7th_8th"))], "work_id string, era string, author string, title_latin string")
    got = sweep.records(sweep.prepare(seg, works)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["work_i"], r["work_j"], r["chain_len"], r["matched_words"], r["n_chained"], r["word_range_i"]) == ("w1", "w2", 9, 9, 1, "3–11")
    assert shared in r["snippet_i"] and 0 < r["score"] <= 1


def test_compare_with_and_without_a_model(spark):
    shared = "ἀρχὴ τοῦ λόγου περὶ τῆς ἀρετῆς καὶ τῆς παιδείας"
    seg = segments(spark, [("w1", 0, "1", "a", "r", f"πρῶτον εἴπωμεν {shared} ἔνθα δὴ"), ("w2", 0, "1", "a", "r", f"ὡς ἔφη τις {shared} τέλος"), ("w2", 1, "2", "a", "r", "περὶ τῆς ἀρετῆς καὶ τῆς ἄλλο")])
    works = spark.createDataFrame([("w1", "ancient_classical", "A", "T"), ("w2", "9th_10th", "B", "U")], "work_id string, era string, author string, title_latin string")
    u, w = units.build_units(seg), units.built_works(works, seg)
    model = subwords.Model((("λ", "ο"), ("η", "ς</w>")), frozenset({"ς</w>"}), True)
    plain, meta = sweep.compare(u, w, Params(min_shared=2))
    rows, with_model = plain.collect(), sweep.compare(u, w, Params(min_shared=2), model=model)[0].collect()
    key = lambda r: (r["work_i"], r["i"], r["work_j"], r["j"], r["chain_len"], r["word_range_i"])
    assert [key(r) for r in rows] == [key(r) for r in with_model] and [r["score"] for r in rows] != [r["score"] for r in with_model]
    assert [r["chain_len"] for r in rows] == sorted((r["chain_len"] for r in rows), reverse=True) and len(rows) == 2
    got = meta.collect()[0]
    assert got["pairs_total"] == 2 and got["before_cap"] == got["after_cap"] == 2 and got["vocab_size"] > 0 and 0 < got["mean"] <= 1
    call = sweep.compare(u, w, Params(min_shared=2, idf_scope="call"))[1].collect()[0]
    assert call["vocab_size"] == got["vocab_size"]  # there are no other works
    events = sweep.compare_iter(u, w, Params(min_shared=2), model=model).collect()
    assert len(events) == 2 and all(e["matched_i"] and 0 < e["score"] <= 1 for e in events)
    assert sweep.compare(u, w, Params(min_shared=2, similarity=1.1))[0].count() == 0
    said = sweep.warnings(sweep.diagnostics(sweep.of_units(u, w, Params(fuzz=0.1))).collect()[0].asDict(), Params(fuzz=0.1).checked())
    assert any("fuzz" in x for x in said) and any("no subword model" in x for x in said)


def test_units_beyond_the_limit_are_reported(spark, monkeypatch):
    monkeypatch.setattr(sweep, "UNITS_PER_WORK", 2)
    seg = segments(spark, [("w", k, "1", f"p{k}", "r", "λόγος τις ἔφη") for k in range(5)])
    works = spark.createDataFrame([("w", "e", "A", "T")], "work_id string, era string, author string, title_latin string")
    row = sweep.diagnostics(sweep.prepare(seg, works)).collect()[0]
    assert row["units"] == 2 and row["units_dropped"] == 3 and any("dropped" in x for x in sweep.warnings(row.asDict(), Params()))


def test_kept_sweeps_follow_their_tables(spark, tmp_path):
    def write(text):
        rows = [("w", 0, "1", "a", "r", text, None, 1)]
        spark.createDataFrame(rows, "work_id string, seg_pos int, chapter string, page string, ref string, text string, loaded_at timestamp, row_id long").write.mode("overwrite").parquet(f"{tmp_path}/plato_respublica_598.parquet")

    spark.createDataFrame([("w", "e", "A", "T")], "work_id string, era string, author string, title_latin string").write.parquet(f"{tmp_path}/works.parquet")
    write("λόγος")
    units_of = lambda: [r["text"] for r in catalog.swept(spark, str(tmp_path)).units.collect()]
    assert units_of() == ["λόγος"] and catalog.swept(spark, str(tmp_path)) is catalog.swept(spark, str(tmp_path))
    write("ἄλλος λόγος")
    assert units_of() == ["ἄλλος λόγος"]
    catalog.forget(1)
    assert len(catalog._KEPT) == 1 and units_of() == ["ἄλλος λόγος"]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        root(Session())
    Session.sparkContext.master = "local[4]"
    assert root(Session()).startswith("file:")


def test_authors_of_works_by_the_last_record(spark):
    rows = [(1, "w", "v", "First", "B", "Z", "T"), (2, "v", "w", "", "Last", None, "A"), (3, "w", "u", "", None, "", ""), (4, None, "w", "X", None, "", None)]
    df = spark.createDataFrame(rows, "match_id long, work_i string, work_j string, author_i string, author_j string, title_i string, title_j string")
    known = {r["work_id"]: (r["author"], r["title"]) for r in numbers.names_of_works(df).collect()}
    assert known == {"w": ("Last", "A"), "v": ("B", "T"), "u": (None, None)}
    got = {r["match_id"]: (r["author_i"], r["author_j"]) for r in numbers.with_authors(df, numbers.names_of_works(df)).collect()}
    assert got == {1: ("Last", "B"), 2: ("B", "Last"), 3: ("Last", None), 4: (None, "Last")}
    assert numbers.names_of_works(df.limit(0)).count() == 0


# subwords and importer ------------------------------------------------------------------------


def test_encode_word():
    ranks = subwords.Model((("λ", "ο"), ("γ", "ο"), ("λο", "γο")), trained=True).ranks()
    assert subwords.encode_word("λογος", ranks) == ["λογο", "ς</w>"]
    assert subwords.encode_word("λο", {}) == ["λ", "ο</w>"] and subwords.encode_word("", {}) == []


def test_untrained_model_keeps_words(spark, tmp_path):
    u = unit_rows(spark, {"a": ["λογος τις", ""]})
    model = subwords.load(str(tmp_path / "none.json"))
    assert not model.trained
    assert [r["subs"] for r in subwords.encoded(u, model).orderBy("unit_pos").collect()][0] == ["λογος", "τις"]
    subwords.save(subwords.Model((("λ", "ο"),), frozenset(["τ"])), str(tmp_path / "m.json"))
    model = subwords.load(str(tmp_path / "m.json"))
    r = subwords.encoded(u, model).orderBy("unit_pos").collect()[0]
    assert r["subs"] == ["λο", "γ", "ο", "ς</w>", "ι", "ς</w>"] and r["s2w"] == [0, 0, 0, 0, 1, 1]


def test_tail_is_cut(spark):
    text = "λόγος ἐστιν ἀρχή. " * 400 + "Die griechische Handschrift ist verloren. " * 150
    cut = importer.tail_cut(text)
    assert 400 * 18 - 1500 <= cut <= 400 * 18 and importer.tail_cut("λόγος. " * 900) == 6300 and importer.tail_cut("") == 0
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert importer.trim_tails(df).count() == 2


def test_folios(spark):
    df = spark.createDataFrame([(1, "titulus f 3r  alpha\nbeta f 3v gamma"), (2, "none"), (3, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["page"], r["text"]) for r in importer.folio_segments(df).orderBy("doc_id", "pos").collect()]
    assert got == [(1, "prefatio", "titulus"), (1, "3r", "alpha beta"), (1, "3v", "gamma"), (2, "", "none")]


# records --------------------------------------------------------------------------------------


@pytest.mark.parametrize("text, want", [("98–128", (98, 128)), ("7-10", (7, 10)), ("5", None), (None, None), ("a–b", None)])
def test_parse_range(spark, text, want):
    got = one(spark, similarity.parse_range, text)
    assert (tuple(got) if got else None) == want


def test_spans_and_overlap(spark):
    df = spark.createDataFrame([("12b/#3", 3, 7)], "ref string, lo int, hi int")
    assert tuple(df.select(similarity.abs_span(F.col("ref"), F.col("lo"), F.col("hi")).alias("s")).collect()[0]["s"]) == ("12b/", 233, 237)
    o = lambda *x: one(spark, lambda _: similarity.overlap_ratio(*[F.lit(v) for v in x]), "")
    assert o(10, 19, 15, 30) == 0.5 and math.isclose(o(15, 30, 10, 19), 5 / 16) and o(1, 2, 3, 4) == 0


@pytest.mark.parametrize("text, want", [("a b", "a b"), ("αβγδ εζηθ", "αβγδ …"), ("αβγδεζηθικ λ", "αβγδεζηθικ …"), ("αβγδεζηθικλμν", "αβγδεζηθικλμν"), ("a|b", "a/b")])
def test_clip(spark, text, want):
    assert one(spark, lambda c: similarity.clip(c, 6), text) == want


@pytest.mark.parametrize("raw, want", [("['a', 'b']", ["a", "b"]), ("a, b", ["a", "b"]), ("nan", []), ("", []), (None, []), ("__import__('os')", ["__import__('os')"])])
def test_gloss_tags_are_not_evaluated(spark, raw, want):
    assert one(spark, similarity.gloss_tags, raw) == want


COLS = "match_id long, work_i string, work_j string, era_i string, era_j string, ref_i string, ref_j string, lo_i int, hi_i int, lo_j int, hi_j int, chain_len int"


def test_topos(spark):
    anc, byz = "ancient_classical", "9th_10th"
    rows = [
        (1, "P", "E", anc, byz, "1/", "5/#1", 1, 9, 10, 19, 6),
        (2, "E", "F", byz, byz, "5/#1", "7/", 15, 20, 1, 5, 6),
        (3, "F", "E", byz, byz, "7/", "5/#2", 1, 5, 12, 18, 6),
        (4, "E", "F", byz, byz, "6/", "7/", 10, 19, 1, 5, 6),
        (5, "E", "F", byz, None, "5/#1", "7/", 19, 40, 1, 5, 6),
    ]
    df = spark.createDataFrame(rows, COLS)
    tagged = topos.tag_global(df, df)
    assert {r["match_id"]: r["tag_origin"] for r in tagged.collect()} == {1: "", 2: "work_i", 3: "work_j", 4: "", 5: ""}
    assert {r["match_id"]: r["tag_origin"] for r in topos.tag_global(df, df, coords="absolute").collect()}[3] == ""
    assert {(r["work_id"], r["total"], r["tagged"]) for r in topos.per_work(tagged).collect()} == {("E", 5, 2), ("F", 4, 2), ("P", 1, 0)}
    single = topos.tag_single(df, df.filter("match_id = 1"), "E")
    assert {r["match_id"] for r in single.filter("tag <> ''").collect()} == {1, 2, 3}
    assert topos.partner_breakdown(single, "none").count() == 0
    assert topos.tag_global(df.limit(0), df).count() == 0


def test_clusters_go_by_the_row_before(spark):
    rows = [(k, "a", "b", "x", "x", "1/", "2/", lo, hi, lo, hi, 5) for k, (lo, hi) in enumerate([(1, 50), (10, 20), (30, 40), (60, 70), (65, 80)])]
    df = spark.createDataFrame(rows, COLS)
    got = sorted((r["size"], r["i_lo"], r["i_hi"]) for r in passages.clusters(df).collect())
    assert got == [(2, 1, 50), (2, 60, 80)]
    r = passages.distinct_passages(df).collect()[0]
    assert (r["records"], r["clusters"], r["redundant"], r["passages"]) == (5, 2, 2, 3)
    near = passages.neighbours(df).collect()
    assert {(r["cluster"], r["match_id"], r["between"]) for r in near} == {(1, 2, 0), (3, 2, 19)}


RECORDS = "match_id long, work_i string, work_j string, era_i string, era_j string, author_i string, author_j string, score double, chain_len int, matched_words int, tag string, rel_id string"


def sample(spark):
    anc = "ancient_classical"
    rows = [
        (1, "a", "b", anc, "7th_8th", "A", "B", 0.5, 6, 7, None, "r1"),
        (2, "b", "a", "7th_8th", anc, "B", "A", 0.0001, 9, 9, "", "r2"),
        (3, "a", "b", anc, "9th_10th", "A", None, float("nan"), 7, 7, None, "r3"),
        (4, "c", "d", "7th_8th", "9th_10th", "C", "C", 0.2, 20, 21, None, "r4"),
        (5, "c", "e", "7th_8th", "9th_10th", "C", "E", 0.3, 8, 8, "ancient_commonplace", "r5"),
        (6, "c", "e", "7th_8th", None, "C", "E", None, None, None, None, "r6"),
        (7, "a", "f", anc, anc, "A", "F", 0.9, 30, 30, None, "r7"),
    ]
    return spark.createDataFrame(rows, RECORDS)


def ids(df):
    return sorted(r["match_id"] for r in df.collect())


def test_packages(spark):
    df = sample(spark)
    assert ids(packages.package(df, packages.PACKAGES[0], "none")) == [1, 2]
    assert ids(packages.package(df, packages.PACKAGES[0], "absolute")) == [1]
    assert ids(packages.package(df, packages.PACKAGES[1], "absolute")) == [] and ids(packages.package(df, packages.PACKAGES[1], "auto")) == [3]
    assert ids(packages.synthesis(df)) == [1, 2, 3, 5, 7]
    c = packages.composition(df).collect()[0]
    assert (c["total"], c["control"], c["control_control"], c["tagged"], c["clean"]) == (5, 4, 1, 1, 0)
    assert c["control"] + c["tagged"] + c["clean"] == c["total"]


def test_percentile_is_the_average_rank_of_ties(spark):
    import pandas as pd

    values = [0.1, 0.2, 0.2, 0.2, 0.5, None]
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(values)], "match_id long, g string, score double")
    got = [r["pct"] for r in packages.percentile(df, ["g"]).orderBy("match_id").collect()]
    want = pd.Series(values).rank(pct=True).tolist()
    assert all((a is None and math.isnan(b)) or math.isclose(a, b) for a, b in zip(got, want))


def test_numbers(spark):
    df = sample(spark)
    assert {r["part"]: r["n"] for r in numbers.partition(df).collect()} == {"control": 4, "same_author": 1, "diff_author": 2}
    t = numbers.tag_analysis(df).collect()[0]
    assert t["tagged"] == t["tagged_same"] + t["tagged_diff"] == 1 and t["clean_diff"] == 1
    assert numbers.tag_analysis(df.limit(0)).collect()[0]["pct_all"] is None
    c = numbers.chain_distribution(df).collect()[0]
    assert c["below"] + c["above"] == c["total"] == 2
    assert {r["kind"]: r["match_id"] for r in numbers.leaders(df).collect()} == {"chain_len": 7, "matched_words": 7, "score": 7}
    assert numbers.leaders(df.limit(0)).count() == 0
    assert {(r["era_first"], r["era_second"]) for r in numbers.era_ordered(df.filter("match_id = 2")).collect()} == {("ancient_classical", "7th_8th")}


def test_verdict_rules_override_in_order(spark):
    df = packages.all_packages(sample(spark))
    rules = verdicts.Rules(fp_chain_below=8, verify=verdicts.package_names(["1"]), verify_chain=6, unverify_chain=30)
    got = {(r["wp_key"], r["match_id"]): r["status"] for r in verdicts.apply_rules(df, rules).collect()}
    assert got["wp1", 1] == "verified" and got["wp4", 1] == "false_positive" and got["wp4", 7] == "unverified" and got["wp4", 5] == "unverified"
    given = spark.createDataFrame([("r1", " Verified ", 1), ("r1", "false_positive", 2), ("r5", None, 9), ("r7", "nonsense", 3)], "rel_id string, status string, decided_at int")
    fixed = {(r["wp_key"], r["match_id"]): r["status"] for r in verdicts.decided(verdicts.apply_rules(df, rules), given).collect()}
    assert fixed["wp1", 1] == "false_positive" and fixed["wp4", 5] == "unverified"
    total = sum(r["n"] for r in verdicts.stats(verdicts.apply_rules(df, rules)).filter("dimension = 'chain'").collect())
    assert total == df.count()
