"""Command line: ``python -m stemmata COMMAND``.

sweep     works and segments (parquet) to match records, report and run metadata
report    the report of a sweep's records (JSON lines) again, without comparing
tag       match records (JSON lines) to tagged records and their report, global or for one work
controls  the same records against two controls, side by side
packages  tagged table to the four packages and their report
numbers   records to the reported counts, as tables or JSON
verdicts  packages to verdicts, their statistics or their export
import    plain texts to segments by folio, foreign tails cut off
documents work documents (JSON) of a manifest to segments
demo      two short invented texts compared
query     one registered query over a folder of tables
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.config import Params
from stemmata.deploy import importable
from stemmata.functions.similarity import parse_range
from stemmata.operators import importer, numbers, packages, passages, reports, subwords, topos, units, verdicts
from stemmata.plans import catalog, sweep
from stemmata.scratch import Scratch
from stemmata.sources import readers, writers

PACKAGE_FILES = ("wp1_implicit", "wp2_canon", "wp3_explicit", "wp4_synthesis")
#: two invented texts that share a passage
DEMO = (
    ("demo.a", "ancient_classical", "First", "On Beginnings", "πρῶτον μὲν οὖν εἴπωμεν ὅτι ἀρχὴ τοῦ λόγου περὶ τῆς ἀρετῆς καὶ τῆς παιδείας ἐστὶν ἡ ψυχή, ἔπειτα δὲ περὶ τῶν ἄλλων"),
    ("demo.b", "9th_10th", "Second", "On Ends", "ὡς δὲ ἔφη τις, ἀρχὴ τοῦ λόγου περὶ τῆς ἀρετῆς καὶ τῆς παιδείας ἐστὶν ἡ ψυχή, τοῦτο δὲ οὐκ ἄλλως ἔχει"),
)


def _ranged(df: DataFrame) -> DataFrame:
    for s in "ij":
        df = df.withColumn(f"lo_{s}", parse_range(F.col(f"word_range_{s}"))["lo"]).withColumn(f"hi_{s}", parse_range(F.col(f"word_range_{s}"))["hi"])
    return df


def _records(spark: SparkSession, paths: str | list[str], schema: str = readers.RECORD) -> DataFrame:
    return _ranged(readers.in_order(spark, paths, schema))


def _params(a: argparse.Namespace) -> Params:
    return Params(ngram=a.ngram, n_out=a.n_out, min_chain=a.min_chain, fuzz=a.fuzz, similarity=a.similarity, min_shared=a.min_shared, max_candidates=a.max_candidates, mode=a.mode, idf_scope=a.idf_scope).checked()


def run_sweep(spark: SparkSession, a: argparse.Namespace) -> None:
    params = _params(a)
    model = subwords.load(a.model) if a.model else subwords.Model()
    run = sweep.prepare(spark.read.parquet(a.segments), spark.read.parquet(a.works), params, only=a.only, group_by=a.group_by, apparatus=not a.no_apparatus_strip, model=model, merges=a.merges)
    rows = run.scratch.put(sweep.records(run))
    writers.ndjson(sweep.sorted_records(rows).select(*writers.RECORD_COLUMNS), f"{a.out}/matches")
    told = sweep.diagnostics(run).collect()[0].asDict()
    warned = sweep.warnings(told, params)
    numbered = catalog.numbered(rows, sweep.PAIR, run.scratch)
    writers.report("Text reuse", reports.sweep_parts(numbered, a.report_min_chain, a.top), [*warned, f"parameters: {params}"], f"{a.out}/report.md")
    hashes = {r["path"]: r["sha256"] for p in (a.works, a.segments) for r in readers.fingerprints(spark, f"{p}/*.parquet" if not p.endswith(".parquet") else p).collect()}  # one for each input file
    writers.run_meta(f"{a.out}/matches.meta.json", params, told, [r.asDict() for r in run.works.orderBy("ord").select("work_id", "era", "author", "title").collect()], hashes)
    for line in warned:
        print(line, file=sys.stderr)
    print(json.dumps({"records": rows.count(), "clamped": params.clamped} | told, ensure_ascii=False, default=str))


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _records(spark, a.records)
    if a.only:
        rows = rows.filter(F.col("work_i").isin(a.only) & F.col("work_j").isin(a.only))
    print(writers.report("Text reuse", reports.sweep_parts(rows, a.report_min_chain, a.top), [f"chains of {max(1, a.report_min_chain)} words or more are listed"], a.out))


def run_tag(spark: SparkSession, a: argparse.Namespace) -> None:
    rows, controls = _records(spark, a.records), _ranged(readers.records(spark, a.controls))
    if a.work == "all":
        out = topos.tag_global(rows, controls, a.min_ratio, a.coords)
        parts = {"All records": reports.tag_totals(out), "Sides": reports.tag_origins(out), "Works": topos.per_work(out).orderBy(F.col("tagged").desc(), "work_id")}
    else:
        out = topos.tag_single(rows, controls, a.work, a.min_ratio, a.coords)
        involved = out.filter((F.col("work_i") == a.work) | (F.col("work_j") == a.work))
        parts = {f"Records of {a.work}": reports.tag_totals(involved), "Partners": topos.partner_breakdown(out, a.work).orderBy(F.col("tagged").desc(), "partner")}
    bare = out.drop("match_id", "lo_i", "hi_i", "lo_j", "hi_j")
    writers.ndjson(bare, f"{a.out}/tagged")
    writers.tsv(bare, f"{a.out}/tagged_table", writers.TAGGED_COLUMNS)
    print(writers.report("Commonplaces", parts, [f"overlap of at least {a.min_ratio:.0%} of the record's words"], f"{a.out}/report.md"))


def run_controls(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _records(spark, a.records)
    one, two = (topos.tag_single(rows, _ranged(readers.records(spark, c)), a.work, a.min_ratio, a.coords) for c in (a.first, a.second))
    involved = lambda df: df.filter((F.col("work_i") == a.work) | (F.col("work_j") == a.work))
    parts = {"First control": reports.tag_totals(involved(one)), "Second control": reports.tag_totals(involved(two)), "Partners": topos.compare_controls(one, two, a.work).orderBy("independence_b", "partner")}
    print(writers.report(f"Two controls of {a.work}", parts, None, a.out))


def run_packages(spark: SparkSession, a: argparse.Namespace) -> None:
    mode = a.score_mode
    if mode == "auto":
        mode = "absolute" if readers.score_scope(a.table) == "corpus" else "none"
    rows = readers.in_file_order(readers.table(spark, a.table))
    writers.packages(packages.all_packages(rows, mode, a.score_pct), a.out)
    floors = [f"{name}: {x} and {y}, chain at least {c}, score at least {s}" for name, x, y, c, s in reports.thresholds()]
    parts = {"Packages": packages.package_report(rows), "Examples": reports.package_examples(rows).orderBy("wp_key", "kind", "rank"), "Base records": reports.base_noise(rows), "Fourth package": packages.composition(rows)}
    print(writers.report("Work packages", parts, [*floors, f"score mode: {mode}"], f"{a.out}/report.md"))


def run_numbers(spark: SparkSession, a: argparse.Namespace) -> None:
    raw = readers.in_order(spark, a.records, readers.RECORD + ", tag string, tag_origin string")
    rows = numbers.with_authors(raw, numbers.names_of_works(raw))
    parts = {"partition": numbers.partition(rows), "tags": numbers.tag_analysis(rows), "tag_origins": reports.tag_origins(rows), "eras": numbers.era_base(rows), "chains": numbers.chain_distribution(rows), "packages": packages.package_report(rows), "fourth_package": packages.composition(rows), "leaders": numbers.leaders(rows), "saturation": catalog.retrieval.saturation(rows)}
    if a.json:
        print(json.dumps(writers.numbers_json(parts, a.json), ensure_ascii=False, default=str))
    else:
        print(writers.report("Numbers", parts))


def run_verdicts(spark: SparkSession, a: argparse.Namespace) -> int:
    rules = verdicts.Rules(a.fp_chain_below, a.fp_score_below, verdicts.package_names(a.verify_wp), a.verify_chain, a.verify_score, a.unverify_chain, a.unverify_score)
    tables = readers.all_package_tables(spark, a.folder, PACKAGE_FILES)
    if tables is None:
        print("no package tables there", file=sys.stderr)
        return 1
    ruled = verdicts.apply_rules(tables, rules)
    if a.decisions:
        ruled = verdicts.decided(ruled, spark.read.schema("rel_id string, status string, decided_at timestamp").json(a.decisions))
    writers.ndjson(verdicts.export(ruled), a.out)
    print(writers.markdown(verdicts.stats(ruled).orderBy("dimension", "bucket"), "verdicts"))
    return 0


def run_demo(spark: SparkSession) -> None:
    works = spark.createDataFrame([d[:4] for d in DEMO], "work_id string, era string, author string, title_latin string")
    segments = spark.createDataFrame([(d[0], 0, "1", "a", "1a", d[4]) for d in DEMO], "work_id string, seg_pos int, chapter string, page string, ref string, text string")
    rows, meta = sweep.compare(units.build_units(segments), units.built_works(works, segments))
    numbered = catalog.numbered(rows, sweep.PAIR, Scratch(spark, "demo"))
    print(writers.report("Demonstration", {"Candidates": meta, "Records": reports.longest(numbered, False), "Distinct passages": passages.distinct_passages(numbered)}))


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="stemmata", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = ap.add_subparsers(dest="command", required=True)
    p = sub.add_parser("sweep")
    p.add_argument("works"), p.add_argument("segments"), p.add_argument("out")
    for name, value in (("ngram", 4), ("n-out", 1), ("min-chain", 2), ("min-shared", 3), ("max-candidates", 4000), ("report-min-chain", 6), ("top", 10)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--fuzz", type=float, default=0.75), p.add_argument("--similarity", type=float), p.add_argument("--mode", choices=["v1", "v2"], default="v2"), p.add_argument("--idf-scope", choices=["call", "corpus"], default="corpus")
    p.add_argument("--group-by", choices=["page", "segment"], default="page"), p.add_argument("--no-apparatus-strip", action="store_true"), p.add_argument("--only", nargs="*")
    p.add_argument("--model", help="subword model file; without it words are scored"), p.add_argument("--merges", type=int, help="use only the first merges of the model")
    p = sub.add_parser("report")
    p.add_argument("records"), p.add_argument("out"), p.add_argument("--only", nargs="*"), p.add_argument("--report-min-chain", type=int, default=6), p.add_argument("--top", type=int, default=10)
    p = sub.add_parser("tag")
    p.add_argument("records"), p.add_argument("out"), p.add_argument("--controls", action="append", required=True), p.add_argument("--work", default="all")
    p.add_argument("--min-ratio", type=float, default=0.5), p.add_argument("--coords", choices=["local", "absolute"], default="local")
    p = sub.add_parser("controls")
    p.add_argument("records"), p.add_argument("first"), p.add_argument("second"), p.add_argument("out"), p.add_argument("--work", required=True)
    p.add_argument("--min-ratio", type=float, default=0.5), p.add_argument("--coords", choices=["local", "absolute"], default="local")
    p = sub.add_parser("packages")
    p.add_argument("table"), p.add_argument("out"), p.add_argument("--score-mode", choices=packages.SCORE_MODES, default="auto"), p.add_argument("--score-pct", type=float, default=0.25)
    p = sub.add_parser("numbers")
    p.add_argument("records"), p.add_argument("--json")
    p = sub.add_parser("verdicts")
    p.add_argument("folder"), p.add_argument("out"), p.add_argument("--verify-wp", nargs="*", default=[]), p.add_argument("--decisions", help="JSON lines of rel_id, status, decided_at")
    for name, kind in (("fp-chain-below", int), ("fp-score-below", float), ("verify-chain", int), ("verify-score", float), ("unverify-chain", int), ("unverify-score", float)):
        p.add_argument(f"--{name}", type=kind)
    p = sub.add_parser("import")
    p.add_argument("texts"), p.add_argument("out"), p.add_argument("--keep-tail", action="store_true")
    p = sub.add_parser("documents")
    p.add_argument("manifest"), p.add_argument("root"), p.add_argument("out")
    sub.add_parser("demo")
    p = sub.add_parser("query")
    p.add_argument("name"), p.add_argument("tables"), p.add_argument("--out")
    return ap


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"stemmata {a.command}").getOrCreate()
    importable(spark)
    if a.command == "verdicts":
        return run_verdicts(spark, a)
    if a.command == "demo":
        run_demo(spark)
    elif a.command == "import":
        texts = readers.plain_texts(spark, a.texts)
        whole = texts if a.keep_tail else importer.trim_tails(texts, "path").select("path", "text")
        writers.ndjson(importer.folio_segments(whole, "path"), a.out)
    elif a.command == "documents":
        readers.work_documents(spark, a.root, readers.manifest(spark, a.manifest)).write.mode("overwrite").parquet(a.out)
    elif a.command == "query":
        df = catalog.QUERIES[a.name](spark, a.tables)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
        else:
            df.show(50, truncate=80)
    else:
        {"sweep": run_sweep, "report": run_report, "tag": run_tag, "controls": run_controls, "packages": run_packages, "numbers": run_numbers}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
