import random

import pytest
from pyspark.sql import functions as F

from stemmata.llm import scans

TITLE = scans.title_pattern("περι ζαιξυστους")


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("λόγος καὶ νόμος (12) τε [6] δε", set()),
        ("τον conco- quopit", {"hyphen"}),
        ("τον λευχο­\nξώς και", {"hyphen"}),
        ("κλαθρός-δυθρόυσι και", set()),
        ("κεφ. 12 και κεφ. 3-23 δε cap. 7", set()),
        ("cod. V2 * * * †λόγος† <και> ιβʹ", set()),
        ("ΛΟΓΟΣ και ΝΟΜΟΣ", set()),
        ("τον θαιγρίπa και", {"glyph"}),
        ("τον λό�ος", {"glyph"}),
        ("τον λό~γος", {"glyph"}),
        ("caquaespav1t et", {"glyph"}),
        ("— 474 — και", {"pageno"}),
        ("και fol. 216r", {"pageno"}),
        ("και\n39ᵛ\nτε", {"pageno"}),
        ("cxxii την μεν", {"pageno"}),
        ("και 712", {"pageno"}),
        ("NUGRUNEUS. ΠΕΡΙ ΖΑΙΞΥΣΤΟΥΣ 784 μεν", {"header"}),
        ("663 περι ζαιξυστους και", {"header"}),
        ("Π Ε Ρ Ι Ζ Α Ι Ξ Υ Σ Τ Ο Υ Σ\nκαι", {"header"}),
        ("ΠΕΡΙ ΖΑΙΞΥΣΤ0ΥΣ και", {"header"}),
        ("850 περι ζαιξυστους 794 και", {"header", "pageno"}),
        ("περὶ ζαιξύστους και", set()),
        ("", set()),
    ],
)
def test_local_kinds(text, kinds):
    assert scans.examine(text, TITLE).kinds == kinds


def test_counted_kinds_and_repair(spark):
    clean = "θαιγρίπος λόγον ἔφη κρυβεγαπία νόμος"
    rows = [("segment", i, "w1", clean) for i in range(40)]
    # other words, against which a context may stand out
    rng = random.Random(2)
    rows += [("segment", 200, "w1", " ".join("".join(rng.choice("abdfgklmprsz") for _ in range(12)) for _ in range(6000)))]
    rows += [
        ("match", 1, "w1", "θαιγρίπος λόγσν ἔφη"),  # one letter misread
        ("match", 2, "w1", "λόγον κρυβε γαπία νόμος"),  # the divider is lost
        ("match", 3, "w1", None),
        ("match", 5, "w1", "Θαιγpίπος λόγ*ον κρυβεγ\ufffdπία ν0μος ἔφη"),  # characters that cannot be right
        ("match", 4, "none", "   "),
        ("segment", 90, "w1", "12\nΠΕΡΙ ΖΑΙΞΥΣΤΟΥΣ\nθαιγρίπος κρυβε-\n— 7 —\nγαπία\n39ᵛ \nἔφη.\n\nνόμος"),
    ]
    texts = spark.createDataFrame(rows, "src string, row_id long, work_id string, text string")
    works = spark.createDataFrame([("w1", "περι ζαιξυστους"), ("w2", None)], "work_id string, running_title string")
    ready = scans.scanned(texts, works)
    evidence = scans.weigh(ready, texts.select("text").limit(0))
    got = sorted((r["src"], r["row_id"], r["noise"]) for r in scans.noise(evidence).collect())
    assert got == [("match", 1, "glyph"), ("match", 2, "hyphen"), ("match", 5, "glyph"), ("segment", 90, "header"), ("segment", 90, "hyphen"), ("segment", 90, "pageno")]
    fixed = {(r["src"], r["row_id"], r["paragraph"]): r["text"] for r in scans.repair(evidence).collect()}
    assert fixed["match", 1, 0] == "θαιγρίπος λόγον ἔφη"
    assert fixed["match", 5, 0] == "Θαιγρίπος λόγον κρυβεγαπία νόμος ἔφη"
    assert fixed["match", 2, 0] == "λόγον κρυβεγαπία νόμος"
    assert (fixed["segment", 90, 0], fixed["segment", 90, 1]) == ("θαιγρίπος κρυβεγαπία ἔφη.", "νόμος")
    assert ("match", 4, 0) not in fixed
    assert scans.noise(scans.weigh(ready.limit(0), texts.select("text").limit(0))).count() == 0


def test_titles_from_masked_lines(spark):
    lines = ["12 ΠΕΡΙ ΛΟΓΩΝ", "13 ΠΕΡΙ Λ0ΓΩΝ", "Π Ε Ρ Ι Λ Ο Γ Ω Ν 15", "fol. 12r", "fol. 13r", "κεφ. 4", "κεφ. 5", "NUGRUS. DE 1NSULIS 7", "NUGRUS. DE INSULIS 8", "7 μια φορα", "7 μια φορα", "λόγος τις. 12", "λόγος τις. 13"]
    texts = spark.createDataFrame([("w", "x\n" + x + "\r\ny") for x in lines] + [("v", "9 ΠΕΡΙ ΛΟΓΩΝ"), (None, "1 ΠΕΡΙ ΛΟΓΩΝ\n2 ΠΕΡΙ ΛΟΓΩΝ"), ("w", None)], "work_id string, text string")
    got = sorted((r["work_id"], scans._title_key(r["title"])) for r in scans.masked_titles(texts).collect())
    assert got == [("w", scans._title_key("de insulis")), ("w", scans._title_key("περι λογων"))]
    assert scans.masked_titles(texts.limit(0)).count() == 0
    # a work without a given title: its headers are found everywhere, also without a number
    rows = [("segment", k, "w", f"και\n{k + 20} ΠΕΡΙ ΛΟΓΩΝ\nτε") for k in range(3)] + [("match", 9, "w", "λόγος ΠΕΡΙ ΛΟΓΩΝ και"), ("match", 8, "v", "λόγος ΠΕΡΙ ΛΟΓΩΝ και")]
    ready = scans.scanned(spark.createDataFrame(rows, "src string, row_id long, work_id string, text string"), spark.createDataFrame([], "work_id string, running_title string"))
    found = scans.noise(scans.weigh(ready, ready.select("text").limit(0), places=False)).filter("noise = 'header'").collect()
    assert sorted((r["src"], r["row_id"]) for r in found) == [("match", 9), ("segment", 0), ("segment", 1), ("segment", 2)]


def test_common_words_only_prune(spark):
    """Whatever counts as common, the evidence is the same: short words, both halves common, context between common words."""
    clean = "του λόγου της φύσεως εστιν αρχη παντων και τέλος εν αρχη παντων"
    rows = [("segment", i, "w", clean) for i in range(300)] + [("segment", 400 + i, "w", "αρ χη") for i in range(20)]
    rows += [("match", 1, "w", "τσυ λόγου"), ("match", 2, "w", "της φύσεως εστιν αρ χη παντων"), ("match", 3, "w", "conco της φύ-σεως"), ("match", 4, "w", "φύσεως τέλσς εν")]
    rows += [("match", 10 + i, "w", "και τέλσς εν") for i in range(9)]
    ready = spark.createDataFrame(rows, "src string, row_id long, work_id string, text string").withColumn("titles", F.array().cast("array<string>"))
    got = [sorted((r["src"], r["row_id"], r["noise"]) for r in scans.noise(scans.weigh(ready, ready.select("text").limit(0), heavy=h, lift=5, places=False)).collect()) for h in (1, 50, 100_000)]
    assert got[0] == got[1] == got[2]
    assert {("match", 1, "glyph"), ("match", 2, "hyphen"), ("match", 3, "hyphen"), ("match", 4, "glyph"), ("match", 10, "glyph"), ("segment", 400, "hyphen")} <= set(got[0])
    assert not {r for r in got[0] if r[0] == "segment" and r[1] < 400}
