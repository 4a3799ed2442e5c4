import json

from pyspark.sql import functions as F

from stemmata.config import Params
from stemmata.sources import readers, writers
from stemmata.streaming.tagger import arriving, tag_stream


def test_documents(spark, tmp_path):
    doc = {"meta": {"tlg_id": "w1", "title": "T"}, "segments": [{"chapter": "1", "page": None, "text": "λόγος", "ref": "r"}, {"chapter": "2", "page": "3r", "text": "β"}], "notes": []}
    for name in ("a__x.json", "b__y.json"):
        (tmp_path / name).write_text(json.dumps(doc), encoding="utf-8")
    got = readers.documents(spark, str(tmp_path / "*.json")).orderBy("seg_pos").collect()
    assert [(r["work_id"], r["seg_pos"], r["page"], r["text"]) for r in got] == [("w1", 0, None, "λόγος"), ("w1", 1, "3r", "β")]
    assert readers.fingerprints(spark, str(tmp_path / "*.json")).select("sha256").distinct().count() == 1


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 0.5, "x\ty\nz")], "work_i string, work_j string, score double, snippet_i string")
    writers.ndjson(df, str(tmp_path / "nd"))
    back = readers.records(spark, str(tmp_path / "nd")).collect()[0]
    assert (back["work_i"], back["work_j"], back["score"], back["matched_words_j"]) == ("a", None, 0.5, None)
    writers.tsv(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*")))
    assert text.splitlines()[-1].split("\t")[-1] == "x y z"
    assert readers.records(spark, [str(tmp_path / "nd"), str(tmp_path / "nd")]).count() == 2


def test_package_tables(spark, tmp_path):
    head = "\t".join(writers.TAGGED_COLUMNS)
    row = "\t".join(["w1", "1/", "e", "w2", "2/", "f", "0.5", "7", "8", "s", "t", "A", "B", "T", "U", ""])
    (tmp_path / "wp1_clean.tsv").write_text(f"{head}\n{row}\n{row}\n", encoding="utf-8")
    got = readers.all_package_tables(spark, str(tmp_path), ("wp1", "wp2")).orderBy("rel_id").collect()
    assert [r["rel_id"] for r in got] == ["rel-wp1-00001", "rel-wp1-00002"] and got[0]["tag"] is None and got[0]["chain_len"] == 7
    assert readers.package_table(spark, str(tmp_path), "wp9") is None


def test_scope_and_meta(tmp_path):
    table = tmp_path / "m.tsv"
    assert readers.score_scope(str(table)) == "call"
    writers.run_meta(str(tmp_path / "m.meta.json"), Params(ngram=99).checked(), {}, [], {})
    assert readers.score_scope(str(table)) == "corpus"
    assert json.loads((tmp_path / "m.meta.json").read_text())["clamped"] == {"ngram": 99}


def test_markdown_has_even_rows(spark):
    lines = writers.markdown(spark.createDataFrame([(1, None), (2, "a|b")], "x int, y string"), "t").strip().split("\n")[2:]
    assert len({x.count("|") for x in lines}) == 1 and "–" in lines[2]


def test_stream_tags_as_the_batch_does(spark, tmp_path):
    rows = [("E", "F", "9th_10th", "9th_10th", "5/", "7/", "15–20", "1–5"), ("E", "G", "9th_10th", "9th_10th", "6/", "7/", "1–5", "1–5")]
    cols = "work_i string, work_j string, era_i string, era_j string, ref_i string, ref_j string, word_range_i string, word_range_j string"
    controls = spark.createDataFrame([("P", "E", "ancient_classical", "9th_10th", "1/", "5/", "1–9", "10–19")], cols)
    writers.ndjson(spark.createDataFrame(rows, cols), str(tmp_path / "in"))
    q = tag_stream(arriving(spark, str(tmp_path / "in")), controls, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {r["work_j"]: r["tag"] for r in spark.read.parquet(str(tmp_path / "out")).select("work_j", F.col("tag")).collect()}
    assert got == {"F": "ancient_commonplace", "G": ""}
