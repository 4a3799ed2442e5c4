"""The training-data queries by name, over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemmata.llm import cutoff, encode, groups, pack, repeats, scans, spans, split, terms, topn
from stemmata.operators.current import latest, latest_wide
from stemmata.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]
UNIT = ["work_id", "chapter", "page"]
SEGMENT = ["work_id", "seg_pos"]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def segments(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Current segments with their texts, which are not shuffled."""
    rows = _read(spark, sf, "plato_respublica_598").select(*dict.fromkeys([*SEGMENT, "loaded_at", "row_id", *columns]))
    return latest_wide(rows, SEGMENT, ["loaded_at", "row_id"], "row_id")


def records(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Current match records."""
    rows = _read(spark, sf, "wp2_canon_clean").select(*dict.fromkeys(["rel_id", "loaded_at", "match_id", *columns]))
    return latest(rows, ["rel_id"], ["loaded_at", "match_id"])


def snippets(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    """Current match records with their texts, which are not shuffled."""
    rows = _read(spark, sf, "wp2_canon_clean").select(*dict.fromkeys(["rel_id", "loaded_at", "match_id", "snippet_i", "snippet_j", *columns]))
    return latest_wide(rows, ["rel_id"], ["loaded_at", "match_id"], "match_id").select("match_id", "snippet_i", "snippet_j", *columns)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    table = split.boundary_table(split.parts_of(segments(spark, sf, [*UNIT, "text"])), UNIT, "seg_pos")
    return split.oversized(table, UNIT).select(*UNIT, "boundary")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "pieces")
    parts = split.parts_of(segments(spark, sf, [*UNIT, "text"]))
    table = scratch.put(split.boundary_table(parts, UNIT, "seg_pos"))
    return split.pieces(parts, table, UNIT, "seg_pos")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf, ["era_i", "era_j", "chain_len", "score"])
    return topn.longest_by_era_pair(rows, 20).select("era_a", "era_b", "match_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return spans.record_pairs(snippets(spark, sf, []), "match_id", ["snippet_i", "snippet_j"])


def p3_shared(spark: SparkSession, sf: str) -> DataFrame:
    rows = snippets(spark, sf, ["chain_len"])
    out = spans.shared_part(rows, "match_id", ["snippet_i", "snippet_j"], ["chain_len"])
    return out.withColumn("longest_to_chain", F.when(F.col("chain_len") > 0, F.col("longest") / F.col("chain_len")))


def p3_passages(spark: SparkSession, sf: str) -> DataFrame:
    rows = spans.sides(snippets(spark, sf, []), "match_id", ["snippet_i", "snippet_j"])
    return spans.fuzzy_passages(rows, "match_id")


def p3_members(spark: SparkSession, sf: str) -> DataFrame:
    """The records behind the classes of p3_passages."""
    rows = spans.sides(snippets(spark, sf, []), "match_id", ["snippet_i", "snippet_j"])
    return spans.class_members(rows, "match_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    scored = terms.tf_idf(segments(spark, sf, ["text"]), SEGMENT)
    return terms.shared_rare(scored, SEGMENT)


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    return terms.tf_idf(segments(spark, sf, ["text"]), SEGMENT).withColumn("score", F.round("score", 9))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return groups.grouped_passages(records(spark, sf, ["work_i", "ref_i", "work_j", "ref_j"]))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage that links to anything, groups of two included."""
    return groups.grouped_passages(records(spark, sf, ["work_i", "ref_i", "work_j", "ref_j"]), 1)


def _by_work(spark: SparkSession, sf: str) -> DataFrame:
    rows = records(spark, sf, ["work_i", "work_j", "score"]).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    works = F.array_distinct(F.array("work_i", "work_j"))
    return Scratch(spark, "scores").put(rows.select(F.explode(works).alias("work_id"), "match_id", "score"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _by_work(spark, sf)
    return cutoff.kept(rows, cutoff.cutoffs(rows, "work_id", "score", 0.25), "work_id", "score").select("work_id", "match_id")


def p6_cutoffs(spark: SparkSession, sf: str) -> DataFrame:
    rows = _by_work(spark, sf)
    return cutoff.report(rows, cutoff.cutoffs(rows, "work_id", "score", 0.25), "work_id", "score")


def _scanned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All delivered rows with text, and the other snippets, which only add to the counts of words."""
    segments_ = _read(spark, sf, "plato_respublica_598").select(F.lit("segment").alias("src"), "row_id", "work_id", "text")
    matches = _read(spark, sf, "wp2_canon_clean")
    snippets = matches.select(F.lit("match").alias("src"), F.col("match_id").alias("row_id"), F.col("work_i").alias("work_id"), F.col("snippet_i").alias("text"))
    return scans.scanned(segments_.unionByName(snippets), _read(spark, sf, "works")), matches.select(F.col("snippet_j").alias("text"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.noise(scans.weigh(*_scanned(spark, sf), places=False)).select("src", "row_id", "noise")


def p7_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repair(scans.weigh(*_scanned(spark, sf)))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode(_read(spark, sf, "documents"))


def p9_packing(spark: SparkSession, sf: str) -> DataFrame:
    sizes = Scratch(spark, "sizes").put(encode.encode(_read(spark, sf, "documents"), out="size", count=True))
    return pack.pack(sizes)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repetitive(_read(spark, sf, "documents")).select("doc_id")


def p10_repetition(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repetition(_read(spark, sf, "documents"))


def p10_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.divergence(_read(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_pieces, p2_found, p3_found, p3_shared, p3_passages, p3_members, p4_found, p4_scores, p5_found, p5_groups, p6_found, p6_cutoffs, p7_found, p7_repaired, p8_ids, p9_packing, p10_found, p10_repetition, p10_divergence)
}


def _current(table: str, keys: str, tie: str, columns: str) -> str:
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY loaded_at DESC NULLS LAST, {tie} DESC) AS rn FROM {table}) WHERE rn = 1)"


_SEGMENTS = _current("plato_respublica_598", "work_id, seg_pos", "row_id", "*")
_RECORDS = _current("wp2_canon_clean", "rel_id", "match_id", "*")
_UNIT_OF = "trim(split_part({}, '#', 1))"

# NFKD as far as SQL has it: marks stripped, final sigma of words in capitals, raised letters
_LOW = r"translate(lower(regexp_replace(x, '(\p{L})Σ([\p{N}_]|$)', '\1ς\2', 'g')), 'ᵛʳ', 'vr')"
_TOKENS = rf"list_transform(regexp_extract_all(strip_accents(text), '[\p{{L}}\p{{N}}_]+'), lambda x: {_LOW})"

SQL: dict[str, str] = {
    "p1_found": rf"""
WITH p AS (SELECT work_id, chapter, coalesce(page, '') AS page, text FROM {_SEGMENTS} WHERE regexp_matches(text, '[^\s\x0b]')),
m AS (SELECT *, list_max(list_transform(string_split(regexp_replace(regexp_replace(text, '([.;·!?\x{{37e}}\x{{387}}])\s+', '\1' || chr(1), 'g'), '\s*\n\s*\n\s*', chr(1), 'g'), chr(1)), lambda s: length(trim(s, chr(32) || chr(9) || chr(10) || chr(13))))) AS sentence,
  list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda s: length(s))) AS run FROM p),
u AS (SELECT work_id, chapter, page, sum(length(text)) + count(*) - 1 AS length, max(sentence) AS sentence, max(run) AS run FROM m GROUP BY ALL)
SELECT work_id, chapter, page, CASE WHEN sentence <= 2000 THEN 'sentence' WHEN run <= 2000 THEN 'word' ELSE 'none' END AS boundary FROM u WHERE length > 2000""",
    "p2_found": f"""
WITH e AS (SELECT coalesce(nullif(lower(trim(era_i)), ''), 'unknown') AS a, coalesce(nullif(lower(trim(era_j)), ''), 'unknown') AS b, match_id, chain_len, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM {_RECORDS} WHERE chain_len IS NOT NULL),
r AS (SELECT least(a, b) AS era_a, greatest(a, b) AS era_b, match_id, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY chain_len DESC, score DESC NULLS LAST, match_id) AS n FROM e)
SELECT era_a, era_b, match_id FROM r WHERE n <= 20""",
    "p3_found": rf"""
WITH s AS (SELECT match_id, unnest([snippet_i, snippet_j]) AS t FROM {_RECORDS}),
w AS (SELECT match_id, regexp_split_to_array(trim(t, chr(32) || chr(9) || chr(10) || chr(13)), '\s+') AS w FROM s WHERE t IS NOT NULL),
g AS (SELECT DISTINCT match_id, unnest(list_transform(range(1, len(w) - 10), lambda x: array_to_string(w[x:x + 11], ' '))) AS g FROM w WHERE len(w) >= 12)
SELECT DISTINCT a.match_id AS match_id_a, b.match_id AS match_id_b FROM g a JOIN g b ON a.g = b.g AND a.match_id < b.match_id""",
    "p3_shared": rf"""
WITH r AS (SELECT match_id, chain_len, snippet_i, snippet_j FROM {_RECORDS}),
s AS (SELECT match_id, unnest([0, 1]) AS side, unnest([snippet_i, snippet_j]) AS t FROM r),
w AS (SELECT match_id, side, list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '') AS w FROM s WHERE t IS NOT NULL),
g AS (SELECT match_id, side, unnest(range(1, len(w) - 10)) AS p, unnest(list_transform(range(1, len(w) - 10), lambda x: array_to_string(w[x:x + 11], ' '))) AS g FROM w WHERE len(w) >= 12),
m AS (SELECT g FROM g GROUP BY g HAVING count(DISTINCT match_id) > 1),
h AS (SELECT DISTINCT match_id, side, unnest(range(p, p + 12)) AS q FROM g WHERE g IN (SELECT g FROM m)),
i AS (SELECT match_id, side, q - row_number() OVER (PARTITION BY match_id, side ORDER BY q) AS island FROM h),
l AS (SELECT match_id, max(n) AS longest, sum(n) AS shared_words FROM (SELECT match_id, side, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY match_id),
n AS (SELECT match_id, sum(len(w)) AS words FROM w GROUP BY match_id)
SELECT r.match_id, chain_len, coalesce(words, 0)::BIGINT AS words, coalesce(shared_words, 0)::BIGINT AS shared_words, coalesce(longest, 0)::BIGINT AS longest, CASE WHEN words > 0 THEN coalesce(shared_words, 0) / words ELSE 0.0::DOUBLE END AS shared,
  CASE WHEN chain_len > 0 THEN coalesce(longest, 0) / chain_len END AS longest_to_chain
FROM r LEFT JOIN n USING (match_id) LEFT JOIN l USING (match_id)""",
    "p4_scores": rf"""
WITH t AS (SELECT work_id, seg_pos, unnest({_TOKENS}) AS term FROM {_SEGMENTS} WHERE text IS NOT NULL),
f AS (SELECT work_id, seg_pos, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df, sum(tf) OVER (PARTITION BY work_id, seg_pos) AS n FROM f),
c AS (SELECT count(*) AS records FROM (SELECT DISTINCT work_id, seg_pos FROM f))
SELECT work_id, seg_pos, term, tf::INT AS tf, n::INT AS n_terms, df, round(tf / n * (ln((1 + records) / (1 + df)) + 1), 9) AS score FROM d, c""",
    "p4_found": rf"""
WITH t AS (SELECT work_id, seg_pos, unnest({_TOKENS}) AS term FROM {_SEGMENTS} WHERE text IS NOT NULL),
f AS (SELECT work_id, seg_pos, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM f)
SELECT work_id, seg_pos, term FROM d WHERE tf >= 3 AND df BETWEEN 2 AND 6 AND length(term) >= 5 AND regexp_full_match(term, '\p{{L}}+')""",
    "p5_found": f"""
WITH RECURSIVE l AS (SELECT DISTINCT work_i || ' ' || {_UNIT_OF.format("ref_i")} AS a, work_j || ' ' || {_UNIT_OF.format("ref_j")} AS b FROM {_RECORDS} WHERE {_UNIT_OF.format("ref_i")} <> '' AND {_UNIT_OF.format("ref_j")} <> ''),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w AS (SELECT a AS v, a AS g FROM e UNION SELECT e.b, w.g FROM w JOIN e ON e.a = w.v),
m AS (SELECT v, min(g) AS group_id FROM w GROUP BY v),
big AS (SELECT group_id FROM m GROUP BY group_id HAVING count(*) >= 3)
SELECT split_part(v, ' ', 1) AS work_id, substr(v, strpos(v, ' ') + 1) AS unit, group_id FROM m WHERE group_id IN (SELECT group_id FROM big)""",
    "p10_found": rf"""
WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, len(w) AS n, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM t WHERE len(w) >= 8)),
r AS (SELECT doc_id, n, p, min(p) OVER (PARTITION BY doc_id, g) AS f FROM g),
h AS (SELECT DISTINCT doc_id, n, unnest(range(p, p + 8)) AS q FROM r WHERE p > f)
SELECT doc_id FROM h GROUP BY doc_id, n HAVING 4 * count(*) >= n""",
    "p5_groups": f"""
WITH RECURSIVE l AS (SELECT DISTINCT work_i || ' ' || {_UNIT_OF.format("ref_i")} AS a, work_j || ' ' || {_UNIT_OF.format("ref_j")} AS b FROM {_RECORDS} WHERE {_UNIT_OF.format("ref_i")} <> '' AND {_UNIT_OF.format("ref_j")} <> ''),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
w AS (SELECT a AS v, a AS g FROM e UNION SELECT e.b, w.g FROM w JOIN e ON e.a = w.v),
m AS (SELECT v, min(g) AS group_id FROM w GROUP BY v)
SELECT split_part(v, ' ', 1) AS work_id, substr(v, strpos(v, ' ') + 1) AS unit, group_id FROM m""",
    "p10_repetition": rf"""
WITH t AS (SELECT doc_id, coalesce({_TOKENS}, []) AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM t WHERE len(w) >= 8)),
r AS (SELECT doc_id, p, min(p) OVER (PARTITION BY doc_id, g) AS f FROM g),
h AS (SELECT doc_id, count(*) AS c FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 8)) AS q FROM r WHERE p > f) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_tokens, coalesce(c, 0) AS n_repeated, coalesce(c, 0) / greatest(len(w), 1)::DOUBLE AS repeat_share FROM t LEFT JOIN h USING (doc_id)""",
    "p6_found": f"""
WITH r AS (SELECT match_id, score, unnest(list_distinct([work_i, work_j])) AS work_id FROM {_RECORDS} WHERE score IS NOT NULL AND NOT isnan(score)),
n AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY work_id) AS n FROM r),
c AS (SELECT work_id, min(score) AS cutoff FROM n WHERE rank <= (n + 3) // 4 GROUP BY work_id)
SELECT r.work_id, r.match_id FROM r JOIN c ON r.work_id = c.work_id AND r.score >= c.cutoff""",
    "p6_cutoffs": f"""
WITH r AS (SELECT match_id, score, unnest(list_distinct([work_i, work_j])) AS work_id FROM {_RECORDS} WHERE score IS NOT NULL AND NOT isnan(score)),
n AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY score DESC) AS rank, count(*) OVER (PARTITION BY work_id) AS n FROM r),
c AS (SELECT work_id, n, (n + 3) // 4 AS target, min(score) AS cutoff FROM n WHERE rank <= (n + 3) // 4 GROUP BY work_id, n)
SELECT c.work_id, c.n, c.target, c.cutoff, count(*) FILTER (WHERE r.score >= c.cutoff) AS kept, count(*) FILTER (WHERE r.score = c.cutoff) AS ties FROM r JOIN c ON r.work_id = c.work_id GROUP BY ALL""",
}
