"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names: defined results, no crash."""

import pytest
from pyspark.sql import functions as F

from stemmata.llm import cutoff, encode, groups, pack, repeats, scans, spans, split, terms, topn

LONG = "λόγος τις ἔφη " * 60_000  # 840,000 characters
UNIT = ["work_id", "chapter", "page"]
#: names that operators use inside
CLASH = ["size", "part", "n", "value", "label", "src", "dst", "id", "rank", "score_", "low", "high", "__top_rank", "__range", "offset", "container", "kind"]


def with_clash(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def seg(spark, rows):
    return spark.createDataFrame(rows, "work_id string, chapter string, page string, seg_pos int, text string, row_id long")


def test_split(spark):
    rows = [(None, "1", "p", 0, "a" * 1500, 1), (None, "1", "p", 1, "b" * 1500, 2), ("w", None, None, 0, LONG, 3), ("w", "2", None, 0, "", 4), ("w", "2", None, 1, " \n ", 5), ("w", "2", None, 2, None, 6)]
    parts = split.parts_of(with_clash(seg(spark, rows)))
    table = split.boundary_table(parts, UNIT, "seg_pos")
    assert {(r["work_id"], r["chapter"], r["boundary"]) for r in split.oversized(table, UNIT).collect()} == {(None, "1", "sentence"), ("w", None, "word")}
    got = split.pieces(parts, table, UNIT, "seg_pos").orderBy("start").collect()
    own = [r for r in got if r["work_id"] is None]
    assert [(r["start"], r["end"]) for r in own] == [(0, 1500), (1300, 3001)]
    big = [r for r in got if r["work_id"] == "w"]
    assert big[0]["start"] == 0 and big[-1]["end"] == len(LONG) and all(y["start"] == x["end"] - 200 and y["end"] - y["start"] <= 2000 for x, y in zip(big, big[1:]))
    assert split.pieces(parts.limit(0), table.limit(0), UNIT, "seg_pos").count() == 0


def test_long_text_in_small_ranges(spark):
    parts = split.parts_of(seg(spark, [("w", "1", "p", k, ("word. " * 30 + "x" * 90) * 3, k) for k in range(40)]))
    table = split.boundary_table(parts, UNIT, "seg_pos")
    one = split.pieces(parts, table, UNIT, "seg_pos", span=4000).orderBy("start").collect()
    whole = " ".join([("word. " * 30 + "x" * 90) * 3] * 40)
    assert all(r["text"] == whole[r["start"] : r["end"]] for r in one)
    assert one[0]["start"] == 0 and one[-1]["end"] == len(whole) and all(y["start"] == x["end"] - 200 for x, y in zip(one, one[1:]))


def test_top_n(spark):
    df = with_clash(spark.createDataFrame([(1, None, 3), (2, None, 3), (2, None, 3), (3, "g", None)], "match_id long, g string, chain_len int"))
    got = topn.top_n(df, ["g"], [F.col("chain_len").desc_nulls_last(), F.col("match_id")], 2)
    assert sorted((r["g"] or "", r["match_id"]) for r in got.collect()) == [("", 1), ("", 2), ("g", 3)] and set(CLASH) <= set(got.columns) | {"__top_rank"}


def test_spans(spark):
    rows = [(None, "a " * 12, None), (1, None, None), (2, "", " "), (3, LONG, LONG), (4, LONG, "x"), (4, LONG, "x"), (5, "b c", "b c")]
    df = with_clash(spark.createDataFrame(rows, "match_id long, snippet_i string, snippet_j string"))
    assert [tuple(r) for r in spans.record_pairs(df, "match_id", ["snippet_i", "snippet_j"]).collect()] == [(3, 4)]


def test_terms(spark):
    df = with_clash(spark.createDataFrame([(None, "alpha alpha"), (1, LONG), (1, "beta"), (2, None), (3, "")], "id_ long, text string"))
    got = {(r["id_"], r["term"]): r["tf"] for r in terms.tf_idf(df, ["id_"]).collect()}
    assert got == {(None, "alpha"): 2, (1, "λογος"): 60_000, (1, "τις"): 60_000, (1, "εφη"): 60_000, (1, "beta"): 1}


def test_groups(spark):
    df = with_clash(spark.createDataFrame([("a", "b"), ("a", "b"), ("b", None), (None, None), ("", "c"), (LONG, "b")], "a string, b string"))
    got = {r["name"][:5]: r["group"][:5] for r in groups.components(df).collect()}
    assert got == {"a": "a", "b": "a", "": "", "c": "", LONG[:5]: "a"}


def test_cutoff(spark):
    df = with_clash(spark.createDataFrame([("w", 0.5)] * 8 + [(None, 0.1), ("w", None), ("w", float("nan")), ("v", float("-inf")), ("v", float("inf"))], "work_id string, score double"))
    cuts = cutoff.cutoffs(df, "work_id", "score")
    assert {r["work_id"]: r["cutoff"] for r in cuts.collect()} == {"w": 0.5, "v": float("inf")}
    kept = cutoff.kept(df, cuts, "work_id", "score")
    assert kept.count() == 9 and set(CLASH) <= set(kept.columns)


@pytest.mark.skipif(not __import__("os").path.exists(encode.VOCABULARY), reason="no vocabulary file")
def test_encode_and_pack(spark):
    df = with_clash(spark.createDataFrame([(None, "a"), (1, LONG), (2, "a" * 300_000), (3, None), (4, ""), (5, "x"), (5, "x")], "doc_id long, text string"))
    got = encode.encode(df, out="tokens", count=True, long=200_000, span=50_000).collect()
    assert len(got) == 7 and {r["doc_id"]: r["tokens"] for r in got}[3] == 0
    sizes = encode.encode(df, out="size", count=True)
    placed = pack.pack(with_clash(sizes).drop("part"), capacity=8192).collect()
    assert sum(r["size"] for r in placed) == sum(r["size"] for r in sizes.collect())
    by = {}
    for r in placed:
        by[r["container"]] = by.get(r["container"], 0) + r["size"]
    assert max(by.values()) <= 8192


def test_repeats(spark):
    df = with_clash(spark.createDataFrame([(None, "a b"), (1, LONG), (2, None), (1, LONG), (3, "日本語" * 50)], "doc_id long, text string, lang string".replace(", lang string", "")))
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_repeated"]) for r in repeats.repetition(df).collect())
    assert got == [(0, 2, 0), (1, 180_000, 179_997), (1, 180_000, 179_997), (2, 0, 0), (3, 1, 0)]
    assert repeats.divergence(df.withColumn("lang", F.lit(None).cast("string"))).count() == 5


def test_scans(spark):
    noisy = "\n".join(f"λόγος τις ἔφη κρυβε-\n{k}\nγαπία νό�ος" for k in range(3000))
    rows = [("match", 1, None, "λόγος"), ("match", 2, "w", ""), ("segment", None, "w", noisy), ("segment", 3, "w", "\x00퟿ -  ­ \n")]
    texts = with_clash(spark.createDataFrame(rows, "src string, row_id long, work_id string, text string").filter("true")).drop("src_")
    works = with_clash(spark.createDataFrame([("w", ""), (None, "περι λογων"), ("w", None)], "work_id string, running_title string"))
    ready = scans.scanned(texts.select("src", "row_id", "work_id", "text"), works)
    evidence = scans.weigh(ready, texts.select("text").limit(0))
    assert sorted((r["row_id"] or 0, r["noise"]) for r in scans.noise(evidence).collect()) == [(0, "glyph"), (0, "hyphen"), (0, "pageno")]
    text = scans.repair(evidence).filter("row_id IS NULL").collect()
    assert "κρυβεγαπία" in text[0]["text"] and "-" not in text[0]["text"]
