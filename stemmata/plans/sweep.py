"""The sweep: every two works compared in one job, from segments to match records."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemmata.config import UNIT_TOKENS, UNITS_PER_WORK, Params
from stemmata.functions.text import raw_tokens
from stemmata.operators import align, grams, pairs, retrieval, subwords
from stemmata.operators.units import build_units, built_works
from stemmata.scratch import Scratch

PAIR = ["work_i", "work_j", "i", "j"]
COUNTS = "n_blocks n_chained chain_len matched_words matched_words_j lo_i hi_i lo_j hi_j".split()
RECORD = ["work_j", "work_i", "j", "i", *COUNTS, *"word_range_i word_range_j snippet_i snippet_j score ref_i ref_j era_i author_i title_i era_j author_j title_j".split()]


class Compared:
    """The candidates of a sweep and their alignment, each made when it is first asked for. They come from one pass over pairs of blocks, unless bigrams of many works are to be left out."""

    def __init__(self, units: DataFrame, works: DataFrame, params: Params, scratch: Scratch):
        self.units, self.works, self.params, self.scratch = units, works, params, scratch

    @cached_property
    def blocks(self) -> DataFrame:
        return pairs.packed(self.units, self.works, self.params.cap_floor, self.scratch)

    def _passed(self, what: str) -> DataFrame:
        return self.scratch.put(pairs.candidates(self.blocks, self.works, self.params, what))

    @cached_property
    def found(self) -> DataFrame:
        if self.params.most_works is not None:
            return self.scratch.put(retrieval.candidates(self.units, self.works, self.params))
        aligned = self.__dict__.get("aligned")
        return aligned.select(*PAIR, "shared") if aligned is not None else self._passed(pairs.SHARED)

    @cached_property
    def aligned(self) -> DataFrame:
        """Every candidate, with what the alignment keeps of it; null for most."""
        rows = self._passed(pairs.RECORDS)
        # with fewer bigrams there are fewer candidates, which share less
        return rows if self.params.most_works is None else self.scratch.put(rows.drop("shared").join(self.found, PAIR))

    @cached_property
    def runs(self) -> DataFrame:
        return self._passed(pairs.RUNS)

    def within(self, rows: DataFrame, of: DataFrame) -> DataFrame:
        """Rows of the candidates that stand within the limit of their pair of works. Only pairs that have more are ranked."""
        most = self.params.max_candidates
        over = of.groupBy("work_i", "work_j").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("work_i", "work_j")
        first = retrieval.top_candidates(of.join(over, ["work_i", "work_j"], "left_semi"), most).select(*PAIR)
        return rows.join(over, ["work_i", "work_j"], "left_anti").unionByName(rows.join(first, PAIR, "left_semi"))

    @cached_property
    def records(self) -> DataFrame:
        """Candidates within the limit of which the alignment keeps a block."""
        rows = self.aligned
        return self.within(rows.filter(F.col("n_blocks").isNotNull()), rows.select(*PAIR, "shared"))


@dataclass
class Sweep:
    """Tables of a sweep, those used more than once written to the shared folder. ``all_units`` holds those beyond the limit of a work too."""

    works: DataFrame
    units: DataFrame
    compared: Compared
    params: Params
    scratch: Scratch
    model: subwords.Model = field(default_factory=subwords.Model)
    merges: int | None = None
    all_units: DataFrame | None = None

    @property
    def found(self) -> DataFrame:
        return self.compared.found

    @property
    def candidates(self) -> DataFrame:
        return retrieval.top_candidates(self.found, self.params.max_candidates)


def of_units(units: DataFrame, works: DataFrame, params: Params | None = None, *, model: subwords.Model | None = None, merges: int | None = None, scratch: Scratch | None = None) -> Sweep:
    """A sweep over units that are there already (``build_units``) and works with ``ord``."""
    params = (params or Params()).checked()
    scratch = scratch or Scratch(units.sparkSession, "sweep")
    kept = units if UNITS_PER_WORK is None else units.filter(F.col("unit_pos") < UNITS_PER_WORK)
    return Sweep(works, kept, Compared(kept, works, params, scratch), params, scratch, model or subwords.Model(), merges, units)


def prepare(segments: DataFrame, works: DataFrame, params: Params | None = None, *, only: list[str] | None = None, group_by: str = "page", apparatus: bool = True, model: subwords.Model | None = None, merges: int | None = None) -> Sweep:
    """Units and candidates of all pairs of works; ``only`` keeps some works. ``model`` gives the subwords that are scored, its first ``merges`` merges if that is set."""
    have = built_works(works, segments, only)
    kept = segments.filter(F.col("work_id").isin(only)) if only else segments
    scratch = Scratch(segments.sparkSession, "sweep")
    units = scratch.put(build_units(kept, group_by, apparatus))
    return of_units(units, have, params, model=model, merges=merges, scratch=scratch)


def gram_units(sweep: Sweep) -> tuple[DataFrame, str]:
    """Units and the column whose grams are scored: subwords without the stop subwords where a model is trained, else words."""
    if not sweep.model.trained and sweep.merges is None:
        return sweep.units, "norm"
    return subwords.encoded(sweep.units, sweep.model, sweep.merges), "subs"


def index_of(sweep: Sweep) -> tuple[DataFrame, DataFrame]:
    """(gram keys of every unit, idf table over the whole corpus)."""
    units, column = gram_units(sweep)
    counted = grams.gram_keys(units, sweep.params, column)
    n = sweep.units.count()
    return counted, grams.idf(counted, n, ["ka", "kb"])


def scored(sweep: Sweep, index: DataFrame | None = None, pairs_: DataFrame | None = None) -> DataFrame:
    """Candidates, or those given, with their cosine, and the gate if the parameters set one."""
    rows = sweep.candidates if pairs_ is None else pairs_
    counted, own = index_of(sweep)
    if sweep.params.idf_scope == "call" and index is None:
        vectors = grams.call_vectors(rows, counted, sweep.units)
    else:
        vectors = grams.vectors(counted, index if index is not None else own)
    out = grams.cosines(rows, vectors)
    return out if sweep.params.similarity is None else out.filter(F.col("score") >= sweep.params.similarity)


def described(sweep: Sweep, found: DataFrame) -> DataFrame:
    """Records (keys, counts and ranges) with ranges as text, snippets, labels, eras, authors and titles of both works. The words of a unit are cut before the next join, so no unit travels with a record."""
    ranged = lambda s: F.concat(F.col(f"lo_{s}").cast("string"), F.lit("–"), F.col(f"hi_{s}").cast("string")).alias(f"word_range_{s}")
    out = found.select(*found.columns, ranged("i"), ranged("j"))
    for s in "ij":
        unit = sweep.units.select(F.col("work_id").alias(f"work_{s}"), F.col("unit_pos").alias(s), F.col("label").alias(f"ref_{s}"), "orig")
        joined = out.join(unit, [f"work_{s}", s])
        out = joined.select(*out.columns, align.snippet(F.col("orig"), F.col(f"lo_{s}"), F.col(f"hi_{s}")).alias(f"snippet_{s}"), f"ref_{s}")
    for s in "ij":
        out = out.join(sweep.works.select(F.col("work_id").alias(f"work_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("era", "author", "title")]), f"work_{s}")
    return out


def narrow(sweep: Sweep) -> DataFrame:
    """The records without what can be joined to them: keys, counts and ranges."""
    return sweep.compared.records.select(*PAIR, *COUNTS)


def records(sweep: Sweep, index: DataFrame | None = None) -> DataFrame:
    """Match records: ids, eras, authors and titles of both works, score to four places, ranges, counts and snippets.

    Scores are worked out once. Without a gate only the records are scored, which are fewer than the candidates.
    """
    found = narrow(sweep)
    if sweep.params.similarity is None:
        found = sweep.scratch.put(found)
        with_score = scored(sweep, index, found.select(*PAIR))
    else:
        with_score = scored(sweep, index)
    with_score = sweep.scratch.put(with_score.select(*PAIR, F.round("score", 4).alias("score")))
    return described(sweep, found.join(with_score, PAIR)).select(*RECORD)


def sorted_records(rows: DataFrame) -> DataFrame:
    """Longest chain first; equal ones in the order of their works and units."""
    return rows.orderBy(F.col("chain_len").desc(), *PAIR)


def meta(sweep: Sweep, index: DataFrame | None = None) -> DataFrame:
    """(work_i, work_j, pairs_total, before_cap, after_cap, cap_hit, mean, threshold, vocab_size) per pair of works with candidates: the candidate counts, mean and suggested threshold of their scores, and
    the number of different grams, of the whole corpus or of an ``index``, or of the two works where scores are of call scope."""
    counted, own = index_of(sweep)
    base = retrieval.candidate_meta(sweep.found, sweep.units, sweep.params.max_candidates)
    scores = grams.auto_threshold(scored(sweep, index), ["work_i", "work_j"]).select("work_i", "work_j", "mean", "threshold")
    out = base.join(scores, ["work_i", "work_j"], "left")
    if sweep.params.idf_scope == "call" and index is None:
        by_work = sweep.scratch.put(counted.select("work_id", "ka", "kb").distinct())
        size = by_work.groupBy("work_id").agg(F.count("*").alias("n"))
        pair = base.select("work_i", "work_j")
        one = pair.join(by_work.select(F.col("work_id").alias("work_i"), "ka", "kb"), "work_i")
        both = one.join(by_work.select(F.col("work_id").alias("work_j"), "ka", "kb"), ["work_j", "ka", "kb"]).groupBy("work_i", "work_j").agg(F.count("*").alias("both"))
        n = lambda s: size.select(F.col("work_id").alias(f"work_{s}"), F.col("n").alias(f"n_{s}"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        sized = pair.join(n("i"), "work_i", "left").join(n("j"), "work_j", "left").join(both, ["work_i", "work_j"], "left").select("work_i", "work_j", (zero("n_i") + zero("n_j") - zero("both")).alias("vocab_size"))
        return out.join(sized, ["work_i", "work_j"])
    size = (index if index is not None else own).count()
    return out.withColumn("vocab_size", F.lit(size).cast("bigint"))


def compare(units: DataFrame, works: DataFrame, params: Params | None = None, *, index: DataFrame | None = None, model: subwords.Model | None = None, merges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, meta) for all pairs of works in ``units``, the records longest chain first; ``index`` is an idf table of a larger corpus (ka, kb, idf)."""
    sweep = of_units(units, works, params, model=model, merges=merges)
    return sorted_records(records(sweep, index)), meta(sweep, index)


def compare_iter(units: DataFrame, works: DataFrame, params: Params | None = None, *, index: DataFrame | None = None, model: subwords.Model | None = None, merges: int | None = None) -> DataFrame:
    """The events of ``compare``, unordered: ranges, counts and, per side, which word belongs to which block and which words bridge gaps, with the score."""
    sweep = of_units(units, works, params, model=model, merges=merges)
    with_score = sweep.scratch.put(scored(sweep, index).select(*PAIR, "score"))
    return pairs.events(sweep.compared.records).join(with_score, PAIR)


def diagnostics(sweep: Sweep, trained: bool | None = None) -> DataFrame:
    """One row about a run: works, pairs of works, units, units cut at the token limit, units dropped beyond the limit of a work, candidates before and after the cap, pairs at the cap, the pair with most
    candidates, scope of the scores, and whether a subword model was there. A run without candidates has nulls for the worst pair."""
    p = sweep.params
    meta_ = retrieval.candidate_meta(sweep.found, sweep.units, p.max_candidates)
    tokens = F.size(raw_tokens(F.col("text")))
    n = sweep.works.agg(F.count("*").alias("works")).withColumn("work_pairs", F.expr("works * (works - 1) div 2"))
    u = sweep.units.agg(F.count("*").alias("units"), F.count_if(tokens > UNIT_TOKENS).alias("units_truncated"))
    every = sweep.all_units if sweep.all_units is not None else sweep.units
    d = every.agg(F.count_if(F.lit(False) if UNITS_PER_WORK is None else F.col("unit_pos") >= UNITS_PER_WORK).alias("units_dropped"))
    worst = F.max_by(F.concat_ws(" ", "work_i", "work_j"), F.struct("before_cap", "work_i", "work_j"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    c = meta_.agg(F.count("*").alias("pairs_with_candidates"), total("before_cap").alias("before_cap"), total("after_cap").alias("after_cap"), F.count_if("cap_hit").alias("pairs_at_cap"), worst.alias("worst_pair"))
    one = F.lit(1).alias("k")  # each side is one row
    joined = n.withColumn("k", one).join(u.withColumn("k", one), "k").join(d.withColumn("k", one), "k").join(c.withColumn("k", one), "k").drop("k")
    return joined.withColumns({"idf_scope": F.lit(p.idf_scope), "trained": F.lit(sweep.model.trained if trained is None else trained)})


def warnings(row: dict[str, object], params: Params) -> list[str]:
    """What a reader of a run must know, from its diagnostics: parameters that were moved, units cut or dropped, pairs at the cap, scores that do not compare, no model."""
    out = [f"parameter {name} was moved into its range from {value}" for name, value in params.clamped.items()]
    if row.get("units_truncated"):
        out.append(f"{row['units_truncated']} units have more than {UNIT_TOKENS} words and were cut")
    if row.get("units_dropped"):
        out.append(f"{row['units_dropped']} units stand beyond the limit of {UNITS_PER_WORK} a work and were dropped")
    if row.get("pairs_at_cap"):
        out.append(f"{row['pairs_at_cap']} pairs of works have more than {params.max_candidates} candidates, the worst {row['worst_pair']}; the rest was not compared")
    if row.get("idf_scope") == "call":
        out.append("scores are of call scope and compare inside a pair of works only")
    if not row.get("trained"):
        out.append("no subword model: words are scored")
    return out
