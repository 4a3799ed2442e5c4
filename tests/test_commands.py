"""The command line, each command on a few rows."""

import json

import pytest

from stemmata.__main__ import main
from stemmata.sources import readers, writers

SHARED = "ἀρχὴ τοῦ λόγου περὶ τῆς ἀρετῆς καὶ τῆς παιδείας"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    seg = [("w1", 0, "1", "a", "r", f"πρῶτον εἴπωμεν {SHARED} ἔνθα δὴ"), ("w2", 0, "1", "a", "r", f"ὡς ἔφη τις {SHARED} τέλος"), ("w3", 0, "1", "a", "r", f"ἄλλο τι {SHARED} παντελῶς")]
    spark.createDataFrame(seg, "work_id string, seg_pos int, chapter string, page string, ref string, text string").write.parquet(f"{at}/segments.parquet")
    works = [(w, e, a, w) for w, e, a in (("w1", "ancient_classical", "A"), ("w2", "9th_10th", "B"), ("w3", "7th_8th", "C"))]
    spark.createDataFrame(works, "work_id string, era string, author string, title_latin string").write.parquet(f"{at}/works.parquet")
    (at / "model.json").write_text(json.dumps({"merges": [["τ", "ο"]], "stop": []}), encoding="utf-8")
    assert main(["sweep", f"{at}/works.parquet", f"{at}/segments.parquet", f"{at}/run", "--model", f"{at}/model.json", "--fuzz", "0.1"], spark) == 0
    return at


def test_sweep_and_replay(spark, tables, capsys):
    got = readers.records(spark, f"{tables}/run/matches").collect()
    assert len(got) == 3 and min(r["chain_len"] for r in got) >= 9
    meta = json.loads((tables / "run/matches.meta.json").read_text(encoding="utf-8"))
    assert meta["corpus_idf"] is True and meta["clamped"] == {"fuzz": 0.1} and meta["diagnostics"]["trained"] is True and len(meta["works"]) == 3 and meta["sha256"]
    report = (tables / "run/report.md").read_text(encoding="utf-8")
    assert "fuzz was moved" in report and "## Records" in report
    assert main(["report", f"{tables}/run/matches", f"{tables}/again.md", "--top", "2"], spark) == 0
    said = capsys.readouterr().out
    assert "Cross-author records, longest chain first" in said and (tables / "again.md").exists()
    table = readers.markdown_table(spark, f"{tables}/again.md", "Cross-author records, longest chain first")
    assert table.count() == 2 and table.columns[:3] == ["rank", "match_id", "work_i"]
    assert main(["report", f"{tables}/run/matches", f"{tables}/none.md", "--only", "w1"], spark) == 0
    assert "None." in (tables / "none.md").read_text(encoding="utf-8")
    with pytest.raises(ValueError):
        readers.markdown_table(spark, f"{tables}/none.md", "Intra-author records, longest chain first")


def test_tag_controls_numbers_and_packages(spark, tables, capsys):
    run = f"{tables}/run/matches"
    assert main(["tag", run, f"{tables}/tag", "--controls", run], spark) == 0
    assert "Works" in capsys.readouterr().out
    assert main(["tag", run, f"{tables}/tag_w2", "--controls", run, "--work", "w2"], spark) == 0
    assert main(["controls", run, run, run, f"{tables}/controls.md", "--work", "w2"], spark) == 0
    assert "independence_b" in (tables / "controls.md").read_text(encoding="utf-8")
    capsys.readouterr()
    assert main(["numbers", f"{tables}/tag/tagged", "--json", f"{tables}/numbers.json"], spark) == 0
    got = json.loads((tables / "numbers.json").read_text(encoding="utf-8"))
    assert {r["part"]: r["n"] for r in got["partition"]} == {"control": 2, "diff_author": 1} and got["tags"]["tagged"] == 1
    assert main(["numbers", run], spark) == 0
    part = next((tables / "tag/tagged_table").glob("part-*"))
    table = tables / "one.tsv"
    table.write_text(part.read_text(encoding="utf-8"), encoding="utf-8")
    assert main(["packages", str(table), f"{tables}/wp"], spark) == 0
    assert "score mode: none" in capsys.readouterr().out


def test_verdicts_import_documents_and_demo(spark, tmp_path, capsys):
    head = "\t".join(writers.TAGGED_COLUMNS)
    row = "\t".join(["w1", "1/", "e", "w2", "2/", "f", "0.5", "7", "8", "s", "t", "A", "B", "T", "U", ""])
    (tmp_path / "wp1_implicit_clean.tsv").write_text(f"{head}\n{row}\n{row}\n", encoding="utf-8")
    (tmp_path / "decided.json").write_text('{"rel_id": "rel-wp1_implicit-00002", "status": " Verified ", "decided_at": "2026-01-01T00:00:00"}\n', encoding="utf-8")
    assert main(["verdicts", str(tmp_path), f"{tmp_path}/v", "--fp-chain-below", "8", "--decisions", f"{tmp_path}/decided.json"], spark) == 0
    assert {r["rel_id"]: r["status"] for r in spark.read.json(f"{tmp_path}/v").collect()} == {"rel-wp1_implicit-00001": "false_positive", "rel-wp1_implicit-00002": "verified"}
    assert main(["verdicts", str(tmp_path / "no"), f"{tmp_path}/v2"], spark) == 1
    (tmp_path / "t.txt").write_text("λόγος πρῶτος f 1r δεύτερος f 1v τρίτος", encoding="utf-8")
    assert main(["import", f"{tmp_path}/t.txt", f"{tmp_path}/folios"], spark) == 0
    assert sorted(r["page"] for r in spark.read.json(f"{tmp_path}/folios").collect()) == ["1r", "1v", "prefatio"]
    root = tmp_path / "works"
    for era, name, text in (("e1", "w1__b.json", "second"), ("e1", "w1__a.json", "first"), ("e2", "w1__0.json", "other era"), ("e2", "w 2__x.json", "spaced")):
        (root / era).mkdir(parents=True, exist_ok=True)
        (root / era / name).write_text(json.dumps({"meta": {"tlg_id": "?"}, "segments": [{"chapter": "1", "text": text}]}), encoding="utf-8")
    (tmp_path / "manifest.csv").write_text("tlg_id,era,author,title_latin\nw1,e1,A,T\nw 2,e2,B,U\nw3,e1,C,V\n", encoding="utf-8")
    assert main(["documents", f"{tmp_path}/manifest.csv", str(root), f"{tmp_path}/segments"], spark) == 0
    assert sorted((r["work_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/segments").collect()) == [("w 2", "spaced"), ("w1", "first")]
    assert readers.work_documents(spark, str(root), readers.manifest(spark, f"{tmp_path}/manifest.csv").filter("work_id = 'w3'")).count() == 0
    capsys.readouterr()
    assert main(["demo"], spark) == 0
    assert "## Records" in capsys.readouterr().out
    assert main(["query", "work_pairs", "/root/testdata/sf0.001", "--out", f"{tmp_path}/q"], spark) == 0


def test_reports_say_what_they_leave_out(spark):
    df = spark.range(5).toDF("n")
    assert "Only the first 3 rows" in writers.markdown(df, "t", 3) and "Only" not in writers.markdown(df, "t", 5)
