"""The engine's own queries by name, over whole tables.

Segments are the current rows of plato_respublica_598, records those of wp2_canon_clean with eras trimmed and
lower-cased ('unknown' for none), references trimmed and NaN scores as null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemmata.config import PACKAGES, Params
from stemmata.functions import similarity as sim
from stemmata.functions.cleaning import clean, clean_text, is_greek
from stemmata.operators import align, grams, importer, numbers, packages, pairs, passages, reports, retrieval, subwords, topos, units, verdicts
from stemmata.operators.current import latest, latest_wide
from stemmata.plans import sweep as sweeps
from stemmata.plans.sql import SQL as _SQL
from stemmata.scratch import Scratch
from stemmata.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "match_records"
SQL: dict[str, str] = _SQL
QUERIES: dict[str, Query] = {}
PAIR = ["work_i", "work_j", "i", "j"]
#: a small model for the queries, in place of a model file (fixed values)
MODEL = subwords.Model((("ο", "υ"), ("ο", "ς</w>"), ("κ", "α"), ("κα", "ι</w>"), ("τ", "ο"), ("το", "ν</w>"), ("ε", "ι")), frozenset({"και</w>", "τον</w>"}), True)
RULES = verdicts.Rules(fp_chain_below=8, fp_score_below=0.01, verify=verdicts.package_names(["1", "2"]), verify_chain=10, verify_score=0.05)
#: sweeps that are kept
KEEP = 4
_KEPT: dict[str, Kept] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "plato_respublica_598").select("work_id", "seg_pos", "chapter", "page", "ref", "text", "loaded_at", "row_id")
    return latest_wide(rows, ["work_id", "seg_pos"], ["loaded_at", "row_id"], "row_id").filter(F.coalesce("text", F.lit("")) != "")


def records(spark: SparkSession, sf: str) -> DataFrame:
    rows = latest(read(spark, sf, "wp2_canon_clean"), ["rel_id"], ["loaded_at", "match_id"])
    era = lambda s: F.coalesce(F.nullif(F.lower(F.trim(f"era_{s}")), F.lit("")), F.lit("unknown"))
    return rows.withColumns({"era_i": era("i"), "era_j": era("j"), "ref_i": F.trim("ref_i"), "ref_j": F.trim("ref_j"), "score": F.when(~F.isnan("score"), F.col("score"))})


def state(spark: SparkSession, sf: str) -> str:
    """The session, the folder, and path, size and time of every file of the tables that a sweep reads: it changes when a table is written anew."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [spark.sparkContext.applicationId, sf]
    for table in ("plato_respublica_598", "works"):
        path = hadoop(f"{sf}/{table}.parquet")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return "\n".join(sorted(found))


@dataclass
class Kept:
    """A sweep and, once they are asked for, its records, with the families of tables to remove when it is forgotten."""

    sweep: sweeps.Sweep
    scratch: list[Scratch]
    records: DataFrame | None = None
    scores: DataFrame | None = None


def forget(most: int = 0) -> None:
    """Remove the tables of all kept sweeps but the last ``most``."""
    while len(_KEPT) > most:
        for scratch in _KEPT.pop(next(iter(_KEPT))).scratch:
            scratch.clear()


def kept(spark: SparkSession, sf: str) -> Kept:
    """The sweep of a folder, made once as long as its input tables are the same. The last KEEP sweeps are kept, since results that were not read yet may need them; the tables of older ones are removed."""
    key = state(spark, sf)
    if key not in _KEPT:
        forget(KEEP - 1)
        made = sweeps.prepare(segments(spark, sf), read(spark, sf, "works"))
        _KEPT[key] = Kept(made, [made.scratch])
    return _KEPT[key]


def swept(spark: SparkSession, sf: str) -> sweeps.Sweep:
    return kept(spark, sf).sweep


def numbered(rows: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Rows with match_id from 1 in the order of the columns: sorted by ranges, numbered inside each partition behind the sizes of those before it, so no task sorts all."""
    placed = scratch.put(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = sizes.select("part", before.alias("offset"))
    return placed.withColumn("n", inside).join(F.broadcast(offsets), "part").withColumn("match_id", F.col("n") + F.col("offset")).drop("part", "n", "offset")


def found_records(spark: SparkSession, sf: str, scores: bool = False) -> DataFrame:
    """The sweep's records with match_id in the order of works and units, with ``score`` if asked for. Their counts and ranges are kept with the sweep, the rest is joined. They are a report: one row a matching pair of windows."""
    own = kept(spark, sf)
    if own.records is None:
        scratch = Scratch(spark, "records")
        own.scratch.append(scratch)
        own.records = scratch.put(numbered(sweeps.narrow(own.sweep), PAIR, scratch))
    if scores and own.scores is None:
        own.scores = own.scratch[-1].put(sweeps.scored(own.sweep, None, own.records.select(*PAIR)).select(*PAIR, F.round("score", 4).alias("score")))
    rows = own.records.join(own.scores, PAIR) if scores else own.records
    return sweeps.described(own.sweep, rows).select(*[c for c in sweeps.RECORD if scores or c != "score"], "match_id")


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = found_records(spark, sf)
    return topos.tag_global(rows, rows)


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.apply_rules(packages.all_packages(records(spark, sf)), RULES)


def aligned_cells(spark: SparkSession, sf: str) -> int:
    """Cells of all match matrices of the sweep: the measure of the alignment's work."""
    s = swept(spark, sf)
    pairs = align.with_words(s.candidates.select(*PAIR), s.units)
    return pairs.agg(F.coalesce(F.sum(F.size("norm_i") * F.size("norm_j")), F.lit(0)).alias("n")).collect()[0]["n"]


# sources --------------------------------------------------------------------------------------

_TABLE = "work_i work_j era_i era_j author_i author_j title_i title_j score chain_len matched_words ref_i ref_j snippet_i snippet_j".split()


@query
def manifest_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest written as CSV and read again."""
    path = Scratch(spark, "io").folder() + ".csv"
    read(spark, sf, "works").select(F.col("work_id").alias("tlg_id"), "era", "author", "title_latin").write.option("header", True).csv(path)
    return readers.manifest(spark, path)


@query
def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = Scratch(spark, "io").folder() + ".json"
    writers.ndjson(read(spark, sf, "works").select(F.col("work_id").alias("tlg_id"), "era", "author", "title_latin"), path)
    return readers.manifest(spark, path)


@query
def ndjson_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as JSON lines to two places and read as one."""
    scratch = Scratch(spark, "io")
    paths = [scratch.folder(), scratch.folder()]
    for k, path in enumerate(paths):
        writers.ndjson(records(spark, sf).filter(F.col("match_id") % 2 == k).select(*_TABLE), path)
    return readers.records(spark, paths).select(*_TABLE)


@query
def tagged_table(spark: SparkSession, sf: str) -> DataFrame:
    """The tagged table written and read again: tabs and line ends are spaces, empty is null."""
    path = Scratch(spark, "io").folder()
    writers.tsv(records(spark, sf), path, writers.TAGGED_COLUMNS)
    return readers.table(spark, path)


@query
def package_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The packages written as tables and read as one, with identifiers by their order."""
    folder = Scratch(spark, "io").folder()
    writers.packages(packages.all_packages(records(spark, sf)), folder)
    found = readers.all_package_tables(spark, folder, tuple(f"wp{k}" for k in range(1, 6)))
    return found.select("wp_key", "rel_id", "work_i", "work_j", "chain_len", "score")


# text and units -------------------------------------------------------------------------------


@query
def clean_text_(spark: SparkSession, sf: str) -> DataFrame:
    plain = clean(F.col("text"))
    return segments(spark, sf).select("work_id", "seg_pos", plain.alias("plain"), clean_text(F.col("text")).alias("text"), is_greek(plain).alias("greek"))


@query
def window_units(spark: SparkSession, sf: str) -> DataFrame:
    return units.window_units(segments(spark, sf))


@query
def segment_units(spark: SparkSession, sf: str) -> DataFrame:
    return units.segment_texts(segments(spark, sf)).select("work_id", F.col("pos").alias("seg_pos"), "label", "text")


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return subwords.word_counts(units.build_units(segments(spark, sf)))


@query
def built_works(spark: SparkSession, sf: str) -> DataFrame:
    return units.built_works(read(spark, sf, "works"), read(spark, sf, "plato_respublica_598"))


@query
def work_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.work_pairs(built_works(spark, sf)).select("work_i", "work_j")


@query
def character_subwords(spark: SparkSession, sf: str) -> DataFrame:
    counts = subwords.word_counts(swept(spark, sf).units)
    subs = subwords.dictionary(counts, subwords.Model(), 0)
    return subs.join(counts, "word").select(F.explode("subs").alias("sub"), "n").groupBy("sub").agg(F.sum("n").alias("n"))


@query
def stop_subwords(spark: SparkSession, sf: str) -> DataFrame:
    counts = subwords.word_counts(swept(spark, sf).units)
    return subwords.stop_subwords(counts, subwords.dictionary(counts, subwords.Model(), 0))


@query
def tail_trim(spark: SparkSession, sf: str) -> DataFrame:
    return importer.trim_tails(read(spark, sf, "documents")).select("doc_id", "length", "cut")


@query
def folio_segments(spark: SparkSession, sf: str) -> DataFrame:
    return importer.folio_segments(read(spark, sf, "documents"))


@query
def text_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))


# retrieval and scores -------------------------------------------------------------------------


@query
def bigram_df(spark: SparkSession, sf: str) -> DataFrame:
    u = swept(spark, sf).units
    return retrieval.bigram_df(grams.bigrams(u), u)


@query
def candidates_v1(spark: SparkSession, sf: str) -> DataFrame:
    s = swept(spark, sf)
    return retrieval.candidates(s.units, s.works, Params(mode="v1"))


@query
def candidates_v2(spark: SparkSession, sf: str) -> DataFrame:
    s = swept(spark, sf)
    return retrieval.candidates(s.units, s.works, Params())


@query
def candidates_v1_low(spark: SparkSession, sf: str) -> DataFrame:
    """With a cap that these works meet, so that the two rules differ."""
    s = swept(spark, sf)
    return retrieval.candidates(s.units, s.works, Params(mode="v1", cap_floor=1, min_shared=1))


@query
def candidates_v2_low(spark: SparkSession, sf: str) -> DataFrame:
    s = swept(spark, sf)
    return retrieval.candidates(s.units, s.works, Params(cap_floor=1, min_shared=1))


@query
def candidates_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.top_candidates(swept(spark, sf).found, 2)


@query
def candidate_meta(spark: SparkSession, sf: str) -> DataFrame:
    s = swept(spark, sf)
    return retrieval.candidate_meta(s.found, s.units, s.params.max_candidates)


@query
def leave_out_grams(spark: SparkSession, sf: str) -> DataFrame:
    s = swept(spark, sf)
    return grams.leave_out_grams(s.units, s.params).withColumn("gram", F.array_join("gram", " "))


@query
def idf_corpus(spark: SparkSession, sf: str) -> DataFrame:
    u = swept(spark, sf).units
    index = grams.idf(grams.leave_out_grams(u, Params()), u.count())
    return index.select(F.array_join("gram", " ").alias("gram"), "df", F.round("idf", 6).alias("idf"))


@query
def cosine_scores(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.scored(swept(spark, sf)).select(*PAIR, F.round("score", 6).alias("score"))


@query
def cosine_call(spark: SparkSession, sf: str) -> DataFrame:
    s = swept(spark, sf)
    call = replace(s, params=Params(idf_scope="call"))
    return sweeps.scored(call).select(*PAIR, F.round("score", 6).alias("score"))


@query
def auto_threshold(spark: SparkSession, sf: str) -> DataFrame:
    t = grams.auto_threshold(sweeps.scored(swept(spark, sf)), ["work_i", "work_j"])
    return t.select("work_i", "work_j", "n", F.round("mean", 6).alias("mean"), F.round("threshold", 6).alias("threshold"))


# alignment and records ------------------------------------------------------------------------


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    """The relational form of the alignment's first step: every agreeing pair of words of every candidate."""
    s = swept(spark, sf)
    pairs = align.with_words(s.candidates.select(*PAIR), s.units)
    one = pairs.select(*PAIR, "norm_j", F.posexplode("norm_i").alias("wi", "a"))
    return one.select(*PAIR, "wi", "a", F.posexplode("norm_j").alias("wj", "b"))


@query
def word_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cells(spark, sf).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a, b = F.col("a"), F.col("b")
    return rows.select("a", "b", F.round(sim.ratio(a, b), 9).alias("ratio"), sim.word_match(a, b, 0.75).alias("agree"))


@query
def match_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = _cells(spark, sf).filter(sim.word_match(F.col("a"), F.col("b"), 0.75))
    return rows.groupBy(*PAIR).agg(F.count("*").alias("cells"), F.count_distinct(F.col("wj") - F.col("wi")).alias("diagonals"))


@query
def diagonal_runs(spark: SparkSession, sf: str) -> DataFrame:
    made = swept(spark, sf).compared
    return made.within(made.runs, made.runs.select(*PAIR, "shared")).filter("runs > 0").select(*PAIR, "longest", "runs")


@query
def kept_blocks(spark: SparkSession, sf: str) -> DataFrame:
    s = swept(spark, sf)
    return align.kept_blocks(s.candidates.select(*PAIR), s.units, s.params)


@query
def bridges(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.bridge_words(swept(spark, sf).compared.records)


@query
def pair_events(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.events(swept(spark, sf).compared.records)


@query
def event_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The word maps of the events, a row for each word."""
    rows = pair_events(spark, sf)
    side = lambda s: rows.select(*PAIR, F.lit(s).alias("side"), F.explode(f"matched_{s}").alias("word", "block"))
    return side("i").unionByName(side("j"))


@query
def match_records(spark: SparkSession, sf: str) -> DataFrame:
    return found_records(spark, sf, True).drop("lo_i", "hi_i", "lo_j", "hi_j", "title_i", "title_j")


@query
def sweep_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return sweeps.diagnostics(swept(spark, sf))


@query
def record_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Of each record the words inside its ranges that matched nothing, and one line for a reader."""
    rows = found_records(spark, sf, True)
    gap = lambda s, n: sim.gap_words(F.col(f"lo_{s}"), F.col(f"hi_{s}"), F.col(n))
    line = sim.format_record({c: F.col(c) for c in ("work_i", "ref_i", "work_j", "ref_j", "chain_len", "score", "snippet_i", "snippet_j")} | {"rel_id": F.col("match_id").cast("string")})
    return rows.select("match_id", gap("i", "matched_words").alias("gap_i"), gap("j", "matched_words_j").alias("gap_j"), F.char_length(line).alias("line_length"))


@query
def passage_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return passages.clusters(found_records(spark, sf))


@query
def distinct_passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.distinct_passages(found_records(spark, sf))


@query
def passage_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return passages.neighbours(found_records(spark, sf))


def _ranged_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the table as if their ranges began at the first word of their window."""
    n = F.coalesce("matched_words", F.lit(0))
    one = F.lit(1)
    return records(spark, sf).filter((F.col("ref_i") != "") & (F.col("ref_j") != "")).withColumns({"lo_i": one, "hi_i": n, "lo_j": one, "hi_j": n})


@query
def table_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return passages.clusters(_ranged_records(spark, sf))


@query
def table_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return passages.neighbours(_ranged_records(spark, sf))


# commonplaces ---------------------------------------------------------------------------------


@query
def topos_tag_global(spark: SparkSession, sf: str) -> DataFrame:
    return tagged(spark, sf).select("match_id", "work_i", "work_j", "tag", "tag_origin")


@query
def topos_per_work(spark: SparkSession, sf: str) -> DataFrame:
    return topos.per_work(tagged(spark, sf))


def _focus(rows: DataFrame) -> str:
    """The work that occurs in most records."""
    top = rows.select(F.explode(F.array("work_i", "work_j")).alias("w")).groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(1).collect()
    return top[0]["w"] if top else ""


def _with_era(rows: DataFrame, era: str) -> DataFrame:
    return rows.filter((F.col("era_i") == era) | (F.col("era_j") == era))


@query
def topos_partner(spark: SparkSession, sf: str) -> DataFrame:
    rows = found_records(spark, sf)
    focus = _focus(rows)
    return topos.partner_breakdown(topos.tag_single(rows, _with_era(rows, "ancient_classical"), focus), focus)


@query
def control_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The same records against two controls: those with an ancient side, and those with a side of the ninth or tenth century."""
    rows = found_records(spark, sf)
    focus = _focus(rows)
    one, two = (topos.tag_single(rows, _with_era(rows, era), focus) for era in ("ancient_classical", "9th_10th"))
    return topos.compare_controls(one, two, focus)


# packages and numbers -------------------------------------------------------------------------

_SHOWN = ["match_id", "work_i", "work_j", "chain_len", "score"]


@query
def wp1(spark: SparkSession, sf: str) -> DataFrame:
    return packages.package(records(spark, sf), PACKAGES[0], "none").select(*_SHOWN)


@query
def wp2(spark: SparkSession, sf: str) -> DataFrame:
    return packages.package(records(spark, sf), PACKAGES[1], "absolute").select(*_SHOWN)


@query
def wp3(spark: SparkSession, sf: str) -> DataFrame:
    return packages.package(records(spark, sf), PACKAGES[2], "auto", corpus_idf=True).select(*_SHOWN)


@query
def wp4(spark: SparkSession, sf: str) -> DataFrame:
    return packages.synthesis(records(spark, sf)).select(*_SHOWN)


@query
def wp_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return packages.package(records(spark, sf), PACKAGES[1], "percentile").select("match_id", "score")


@query
def percentile_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return packages.percentile(records(spark, sf), ["work_i", "work_j"]).select("match_id", F.round("pct", 9).alias("pct"))


@query
def control_set(spark: SparkSession, sf: str) -> DataFrame:
    return packages.control_set(records(spark, sf)).select("match_id", "era_i", "era_j")


@query
def wp_report(spark: SparkSession, sf: str) -> DataFrame:
    return packages.package_report(records(spark, sf))


@query
def wp_composition(spark: SparkSession, sf: str) -> DataFrame:
    return packages.composition(records(spark, sf))


@query
def wp_delta(spark: SparkSession, sf: str) -> DataFrame:
    earlier = spark.createDataFrame([("wp1", 7), ("wp2", 14), ("wp3", 678), ("wp4", 4561)], "wp_key string, shipped bigint")
    return packages.delta(records(spark, sf), earlier)


@query
def longest_by_package(spark: SparkSession, sf: str) -> DataFrame:
    return packages.longest(packages.all_packages(records(spark, sf)), 3, ["wp_key"]).select("wp_key", "match_id", "chain_len", "rank")


@query
def partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return numbers.partition(records(spark, sf))


@query
def tag_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return numbers.tag_analysis(records(spark, sf))


@query
def era_base(spark: SparkSession, sf: str) -> DataFrame:
    return numbers.era_base(records(spark, sf))


@query
def chain_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return numbers.chain_distribution(records(spark, sf))


@query
def era_pair_top(spark: SparkSession, sf: str) -> DataFrame:
    return numbers.era_pair_top(records(spark, sf)).select("era_first", "era_second", "match_id", "chain_len", "rank")


@query
def leaders(spark: SparkSession, sf: str) -> DataFrame:
    return numbers.leaders(records(spark, sf))


@query
def report_split(spark: SparkSession, sf: str) -> DataFrame:
    return numbers.report_split(records(spark, sf))


@query
def saturation(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.saturation(records(spark, sf))


@query
def author_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf)
    return numbers.with_authors(rows, numbers.names_of_works(rows)).select("match_id", "author_i", "author_j", "title_i", "title_j")


@query
def reference_parts(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf).filter(F.col("ref_i").isNotNull())
    span = sim.abs_span(F.col("ref_i"), F.lit(0), F.lit(0))
    return rows.select("match_id", sim.ref_prefix(F.col("ref_i")).alias("page_i"), span["unit"].alias("unit_i"), span["lo"].alias("base_i"))


@query
def clipped_snippets(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).filter(F.col("snippet_i").isNotNull()).select("match_id", sim.clip(F.col("snippet_i"), 70).alias("snippet"))


# reports --------------------------------------------------------------------------------------


@query
def report_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary(records(spark, sf))


@query
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.longest(found_records(spark, sf, True), False).drop("match_id")


@query
def report_leading(spark: SparkSession, sf: str) -> DataFrame:
    return reports.leading(found_records(spark, sf, True))


@query
def report_eras(spark: SparkSession, sf: str) -> DataFrame:
    return reports.era_counts(records(spark, sf))


@query
def report_era_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.era_lines(found_records(spark, sf, True)).select("era_first", "era_second", "rank", "match_id", "gap_i", "gap_j", "span_i", "span_j")


@query
def report_passages(spark: SparkSession, sf: str) -> DataFrame:
    return reports.repeated_passages(_ranged_records(spark, sf))


@query
def topos_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tag_totals(tagged(spark, sf))


@query
def topos_origins(spark: SparkSession, sf: str) -> DataFrame:
    return reports.tag_origins(tagged(spark, sf))


@query
def base_noise(spark: SparkSession, sf: str) -> DataFrame:
    return reports.base_noise(records(spark, sf))


@query
def package_examples(spark: SparkSession, sf: str) -> DataFrame:
    return reports.package_examples(records(spark, sf))


@query
def cosine_subwords(spark: SparkSession, sf: str) -> DataFrame:
    """Scores over the subwords of a small fixed model, stop subwords left out."""
    s = replace(swept(spark, sf), model=MODEL)
    return sweeps.scored(s).select(*PAIR, F.round("score", 6).alias("score"))


@query
def subword_words(spark: SparkSession, sf: str) -> DataFrame:
    words = subwords.word_counts(swept(spark, sf).units)
    return subwords.dictionary(words, MODEL).select("word", F.array_join("subs", " ").alias("subs"))


@query
def subword_words_limited(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the first three merges only."""
    words = subwords.word_counts(swept(spark, sf).units)
    return subwords.dictionary(words, MODEL, 3).select("word", F.array_join("subs", " ").alias("subs"))


# verdicts -------------------------------------------------------------------------------------


@query
def verdict_rules(spark: SparkSession, sf: str) -> DataFrame:
    return ruled(spark, sf).select("wp_key", "match_id", "status")


@query
def verdict_stats(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.stats(ruled(spark, sf))


@query
def verdict_decided(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.decided(ruled(spark, sf), read(spark, sf, "verdicts")).select("wp_key", "match_id", "status")


@query
def verdict_export(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.export(verdicts.decided(ruled(spark, sf), read(spark, sf, "verdicts")))


@query
def review_package(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the packages whose name contains a part, any author."""
    return verdicts.review(ruled(spark, sf), wp="p2", chain=(8, None)).select("wp_key", "match_id", "chain_len")


@query
def review_filter(spark: SparkSession, sf: str) -> DataFrame:
    return verdicts.review(records(spark, sf), chain=(6, 20), score=0.01, author="Younger").select("match_id", "chain_len", "score")


QUERIES["clean_text"] = QUERIES.pop("clean_text_")
