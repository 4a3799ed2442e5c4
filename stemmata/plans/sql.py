"""The same queries in SQL, for comparison: shared table expressions and one statement a query."""

from __future__ import annotations

from stemmata.functions.cleaning import HEADER_LINE, STOCK_PHRASES

W = r"[^\p{L}\p{N}_]"
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
GREEK_LETTERS = "αβγδεζηθικλμνξοπρςστυφχψωʹ"
ONE_BYTE = "ABCDEFGHIJKLMNOPQRSTUVWXY~"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {_q(new)}, 'g')"


def _squeeze(x: str) -> str:
    return f"trim({_sub(x, SPACE, ' ')})"


def clean(x: str) -> str:
    lines = f"array_to_string(list_filter(regexp_split_to_array(coalesce({x}, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), lambda l: NOT regexp_matches(l, {_q(HEADER_LINE)})), ' ')"
    out = _sub(lines, "</?[a-zA-Z][^<>]*>", " ")
    out = _sub(out, r"\(\p{Nd}+\)\s*[a-z]:\s*om\.", " ")
    out = _sub(out, rf"(^|{W})om\.", r"\1 ")
    for p in (r"\p{Nd}+[a-z]", r"[cq]\p{Nd}+"):
        for _ in range(2):  # neighbours share the sign between them
            out = _sub(out, rf"(^|{W}){p}($|{W})", r"\1 \2")
    out = _sub(out, "|".join(STOCK_PHRASES), " ")
    return _squeeze(_sub(out, r"[\(\[][0-9]+[\)\]]", ""))


def greek(x: str) -> str:
    tokens = f"regexp_extract_all({_sub(x, r'[\(\[][0-9]+[\)\]]', ' ')}, '[\\p{{L}}\\p{{N}}_]+')"
    return f"coalesce(len(list_filter({tokens}, lambda t: regexp_matches(t, '[\\x{{370}}-\\x{{3ff}}\\x{{1f00}}-\\x{{1fff}}]'))) / nullif(len({tokens}), 0) >= 0.5, false)"


def stripped(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+')"
    kept = f"array_to_string(list_transform({runs}, lambda r: CASE WHEN regexp_full_match(r, '\\p{{Nd}}+|[A-Za-z]+') THEN ' ' ELSE r END), '')"
    return f"CASE WHEN {greek(x)} THEN {_squeeze(kept)} ELSE {x} END"


def norm(x: str) -> str:
    # sigma at the end of a run of letters in capitals
    return f"translate(lower(regexp_replace(strip_accents({x}), '(\\p{{L}})Σ([\\p{{N}}_]|$)', '\\1ς\\2', 'g')), 'ᵛʳ', 'vr')"


def one_byte(x: str) -> str:
    return f"translate({x}, '{GREEK_LETTERS}', '{ONE_BYTE}')"


SEG = "seg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id, seg_pos ORDER BY loaded_at DESC NULLS LAST, row_id DESC) AS rn FROM plato_respublica_598) WHERE rn = 1 AND coalesce(text, '') <> '')"
CLEANED = f"{SEG}, cl0 AS (SELECT work_id, seg_pos, ref, coalesce(chapter, '') AS ch, coalesce(page, '') AS pg, {clean('text')} AS t0 FROM seg), cl AS (SELECT work_id, seg_pos, ref, ch, pg, t0, {stripped('t0')} AS t FROM cl0)"
PAGES = f"{CLEANED}, pages AS (SELECT * FROM (SELECT work_id, min(seg_pos) AS pos, trim(ch || '/' || pg) AS label, trim(string_agg(t, ' ' ORDER BY seg_pos)) AS text FROM cl GROUP BY work_id, ch, pg) WHERE text <> '')"
WINDOWS = f"""{PAGES}, sp AS (SELECT *, list_filter(regexp_split_to_array(text, '{SPACE}'), lambda w: w <> '') AS words FROM pages),
wk AS (SELECT *, unnest(range(0, CASE WHEN len(words) <= 140 THEN 1 ELSE cast(ceil((len(words) - 140) / 115.0) AS int) + 1 END)) AS k FROM sp),
win AS (SELECT work_id, row_number() OVER (PARTITION BY work_id ORDER BY pos, k) - 1 AS unit_pos, CASE WHEN len(words) <= 140 THEN label ELSE label || '#' || (k + 1) END AS label, array_to_string(words[k * 115 + 1:k * 115 + 140], ' ') AS text FROM wk)"""
UNITS = f"{WINDOWS}, un0 AS (SELECT work_id, unit_pos, label, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')[1:400] AS orig FROM win), un AS (SELECT *, list_transform(orig, lambda w: {norm('w')}) AS norm FROM un0)"
_RANK = "CASE era WHEN 'ancient_classical' THEN 0 WHEN '7th_8th' THEN 1 WHEN '9th_10th' THEN 2 WHEN '11th_12th' THEN 3 ELSE 9 END"
WORKS = f"wo AS (SELECT *, row_number() OVER (ORDER BY era_rank, work_id) - 1 AS ord FROM (SELECT work_id, era, author, title_latin AS title, {_RANK} AS era_rank FROM works WHERE work_id IN (SELECT work_id FROM seg0)))".replace("seg0", "plato_respublica_598")
GRAMS = f"{UNITS}, {WORKS}, bg AS (SELECT DISTINCT work_id, unit_pos, unnest(list_transform(range(1, len(norm)), lambda x: {{'g1': norm[x], 'g2': norm[x + 1]}})) AS g FROM un), caps AS (SELECT work_id, greatest(40, count(*) // 25) AS cap FROM un GROUP BY work_id), bdf AS (SELECT work_id, g, count(*) AS df, any_value(cap) AS cap FROM bg JOIN caps USING (work_id) GROUP BY work_id, g)"


def candidates(keep: str, floor: int = 40, shared: int = 3) -> str:
    return f"""{GRAMS.replace("greatest(40,", f"greatest({floor},")}, hits AS (SELECT a.work_id AS work_i, b.work_id AS work_j, a.unit_pos AS i, b.unit_pos AS j, count(*) AS shared FROM bg a JOIN bg b ON a.g = b.g JOIN wo x ON x.work_id = a.work_id JOIN wo y ON y.work_id = b.work_id AND x.ord < y.ord
  JOIN bdf da ON da.work_id = a.work_id AND da.g = a.g JOIN bdf db ON db.work_id = b.work_id AND db.g = b.g WHERE {keep} GROUP BY ALL HAVING count(*) >= {shared})"""


V2 = "NOT (da.df > da.cap AND db.df > db.cap)"
CANDIDATES = candidates(V2)
TOP = f"{CANDIDATES}, top AS (SELECT *, row_number() OVER (PARTITION BY work_i, work_j ORDER BY shared DESC, i, j) AS rank FROM hits), cand AS (SELECT * FROM top WHERE rank <= 4000)"
LNO = f"{TOP}, gr AS (SELECT work_id, unit_pos, gram, count(*) AS c FROM (SELECT work_id, unit_pos, unnest(flatten(list_transform(range(1, len(norm) - 2), lambda x: [[norm[x], norm[x + 1], norm[x + 2]], [norm[x], norm[x + 1], norm[x + 3]], [norm[x], norm[x + 2], norm[x + 3]], [norm[x + 1], norm[x + 2], norm[x + 3]]]))) AS gram FROM un WHERE len(norm) >= 4) GROUP BY ALL), nn AS (SELECT count(*) AS n FROM un), idf AS (SELECT gram, count(*) AS df, ln(1 + any_value(n)::DOUBLE / (1 + count(*))) + 1 AS idf FROM gr, nn GROUP BY gram)"
SCORES = f"""{LNO}, wt AS (SELECT work_id, unit_pos, gram, c / sum(c) OVER (PARTITION BY work_id, unit_pos) * idf AS w FROM gr JOIN idf USING (gram)), nm AS (SELECT work_id, unit_pos, sqrt(sum(w * w)) AS norm FROM wt GROUP BY ALL),
sc AS (SELECT c.work_i, c.work_j, c.i, c.j, coalesce(sum(a.w * b.w) / nullif(any_value(na.norm) * any_value(nb.norm), 0), 0) AS score FROM cand c LEFT JOIN wt a ON a.work_id = c.work_i AND a.unit_pos = c.i LEFT JOIN wt b ON b.work_id = c.work_j AND b.unit_pos = c.j AND a.gram = b.gram LEFT JOIN nm na ON na.work_id = c.work_i AND na.unit_pos = c.i LEFT JOIN nm nb ON nb.work_id = c.work_j AND nb.unit_pos = c.j GROUP BY ALL)"""


def agree(a: str, b: str) -> str:
    total = f"(length({a}) + length({b}))"
    return f"CASE WHEN {a} = {b} THEN true WHEN abs(length({a}) - length({b})) / {total}::DOUBLE > 1.0::DOUBLE - 0.75::DOUBLE THEN false ELSE 1.0::DOUBLE - levenshtein({one_byte(a)}, {one_byte(b)}) / {total}::DOUBLE >= 0.75::DOUBLE END"


_CELLS = f""", ti AS (SELECT work_i, work_j, i, j, unnest(u.norm) AS w, unnest(range(0, len(u.norm))) AS wi FROM cand JOIN un u ON u.work_id = work_i AND u.unit_pos = i), tj AS (SELECT work_i, work_j, i, j, unnest(u.norm) AS w, unnest(range(0, len(u.norm))) AS wj FROM cand JOIN un u ON u.work_id = work_j AND u.unit_pos = j),
cell AS (SELECT work_i, work_j, i, j, wi, wj, wj - wi AS d FROM ti a JOIN tj b USING (work_i, work_j, i, j) WHERE {agree('a.w', 'b.w')}),
st AS (SELECT *, wi - lag(wi) OVER (PARTITION BY work_i, work_j, i, j, d ORDER BY wi) AS step FROM cell),
rn AS (SELECT *, sum(CASE WHEN step = 1 THEN 0 ELSE 1 END) OVER o AS run, sum(CASE WHEN step <= 2 THEN 0 ELSE 1 END) OVER o AS blk FROM st WINDOW o AS (PARTITION BY work_i, work_j, i, j, d ORDER BY wi)),
runs AS (SELECT work_i, work_j, i, j, d, run, any_value(blk) AS blk, min(wi) AS a, count(*) AS length FROM rn GROUP BY work_i, work_j, i, j, d, run),
blk AS (SELECT work_i, work_j, i, j, d, blk, min(a) AS a, sum(length)::BIGINT AS n, max(length) AS core FROM runs GROUP BY work_i, work_j, i, j, d, blk),
kept AS (SELECT *, row_number() OVER (PARTITION BY work_i, work_j, i, j ORDER BY d, a) - 1 AS block FROM blk WHERE core >= 4 AND n >= 2)"""
CELLS = TOP + _CELLS
RECORDS = f"""{SCORES}{_CELLS}, ro AS (SELECT work_i, work_j, i, j, count(*) AS n_chained, max(n) AS chain_len FROM kept GROUP BY ALL), raw AS (SELECT work_i, work_j, i, j, count(*) AS n_blocks FROM blk GROUP BY ALL),
mw AS (SELECT work_i, work_j, i, j, count(DISTINCT wi) AS matched_words, count(DISTINCT wj) AS matched_words_j, min(wi) AS li, max(wi) AS hi, min(wj) AS lj, max(wj) AS hj FROM rn JOIN kept USING (work_i, work_j, i, j, d, blk) GROUP BY ALL),
rec0 AS (SELECT work_i, work_j, i, j, n_blocks, n_chained, chain_len, matched_words, matched_words_j, li + 1 AS lo_i, hi + 1 AS hi_i, lj + 1 AS lo_j, hj + 1 AS hi_j, (li + 1) || '–' || (hi + 1) AS word_range_i, (lj + 1) || '–' || (hj + 1) AS word_range_j,
  array_to_string(ui.orig[greatest(li - 6, 0) + 1:least(len(ui.orig), hi + 7)], ' ') AS snippet_i, array_to_string(uj.orig[greatest(lj - 6, 0) + 1:least(len(uj.orig), hj + 7)], ' ') AS snippet_j, round(score, 4) AS score, ui.label AS ref_i, uj.label AS ref_j, a.era AS era_i, a.author AS author_i, a.title AS title_i, b.era AS era_j, b.author AS author_j, b.title AS title_j
  FROM ro JOIN raw USING (work_i, work_j, i, j) JOIN mw USING (work_i, work_j, i, j) JOIN sc USING (work_i, work_j, i, j) JOIN un ui ON ui.work_id = work_i AND ui.unit_pos = i JOIN un uj ON uj.work_id = work_j AND uj.unit_pos = j JOIN wo a ON a.work_id = work_i JOIN wo b ON b.work_id = work_j),
rec AS (SELECT *, row_number() OVER (ORDER BY work_i, work_j, i, j) AS match_id FROM rec0)"""

_abs = lambda s: f"(CASE WHEN regexp_matches(ref_{s}, '#[0-9]+$') THEN cast(regexp_extract(ref_{s}, '#([0-9]+)$', 1) AS int) ELSE 1 END - 1) * 115"
_unit = lambda s: f"regexp_replace(ref_{s}, '#[0-9]+$', '')"
PLACED = f"""{RECORDS}, pl AS (SELECT match_id, work_i, {_unit('i')} AS unit_i, work_j, {_unit('j')} AS unit_j, chain_len, {_abs('i')} + lo_i AS lo_i, {_abs('i')} + hi_i AS hi_i, {_abs('j')} + lo_j AS lo_j, {_abs('j')} + hi_j AS hi_j FROM rec),
op AS (SELECT *, CASE WHEN lo_i <= lag(hi_i) OVER (PARTITION BY work_i, unit_i, work_j, unit_j ORDER BY lo_i, hi_i, match_id) THEN 0 ELSE 1 END AS opens FROM pl), cs AS (SELECT *, sum(opens) OVER (PARTITION BY work_i, unit_i, work_j, unit_j ORDER BY lo_i, hi_i, match_id) AS cluster FROM op)"""
_page = lambda s: f"split_part(ref_{s}, '#', 1)"
_over = lambda a, b: f"greatest(0, least({a}.b, {b}.hi) - greatest({a}.a, {b}.lo) + 1) / ({a}.b - {a}.a + 1)::DOUBLE >= 0.5"
TAGGED = f"""{RECORDS}, co AS (SELECT DISTINCT CASE WHEN era_i = 'ancient_classical' THEN work_j ELSE work_i END AS work_id, CASE WHEN era_i = 'ancient_classical' THEN {_page('j')} ELSE {_page('i')} END AS page, CASE WHEN era_i = 'ancient_classical' THEN lo_j ELSE lo_i END AS lo, CASE WHEN era_i = 'ancient_classical' THEN hi_j ELSE hi_i END AS hi FROM rec WHERE era_i = 'ancient_classical' OR era_j = 'ancient_classical'),
sd AS (SELECT match_id, 'work_i' AS side, work_i AS work_id, {_page('i')} AS page, lo_i AS a, hi_i AS b FROM rec WHERE era_i <> 'ancient_classical' AND era_j <> 'ancient_classical' UNION ALL SELECT match_id, 'work_j', work_j, {_page('j')}, lo_j, hi_j FROM rec WHERE era_i <> 'ancient_classical' AND era_j <> 'ancient_classical'),
ht AS (SELECT match_id, min(side) AS tag_origin FROM sd JOIN co USING (work_id, page) WHERE {_over('sd', 'co')} GROUP BY match_id),
tg AS (SELECT rec.*, CASE WHEN tag_origin IS NULL THEN '' ELSE 'ancient_commonplace' END AS tag, coalesce(tag_origin, '') AS tag_origin FROM rec LEFT JOIN ht USING (match_id))"""

_hit = lambda name, era: f"{name} AS (SELECT DISTINCT own.match_id FROM own JOIN (SELECT DISTINCT page, a AS lo, b AS hi FROM own WHERE era_i = '{era}' OR era_j = '{era}') co USING (page) WHERE {_over('own', 'co')})"
FOCUS = f"""{RECORDS}, fo AS (SELECT w FROM (SELECT unnest([work_i, work_j]) AS w FROM rec) GROUP BY w ORDER BY count(*) DESC, w LIMIT 1),
own AS (SELECT match_id, CASE WHEN work_i = w THEN work_j ELSE work_i END AS partner, CASE WHEN work_i = w THEN {_page('i')} ELSE {_page('j')} END AS page, CASE WHEN work_i = w THEN lo_i ELSE lo_j END AS a, CASE WHEN work_i = w THEN hi_i ELSE hi_j END AS b, era_i, era_j FROM rec, fo WHERE work_i = w OR work_j = w),
{_hit('hit_a', 'ancient_classical')}, {_hit('hit_b', '9th_10th')}"""

_era = lambda s: f"coalesce(nullif(lower(trim(era_{s})), ''), 'unknown') AS era_{s}"
M = f"m AS (SELECT * REPLACE ({_era('i')}, {_era('j')}, trim(ref_i) AS ref_i, trim(ref_j) AS ref_j, CASE WHEN isnan(score) THEN NULL ELSE score END AS score) FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY loaded_at DESC NULLS LAST, match_id DESC) AS rn FROM wp2_canon_clean) WHERE rn = 1)"
CROSS = "(author_i IS NULL OR author_j IS NULL OR author_i <> author_j)"
BASE = f"{M}, ba AS (SELECT * FROM m WHERE {CROSS} AND coalesce(tag, '') = '')"
CTRL = "(era_i = 'ancient_classical' OR era_j = 'ancient_classical')"
SAME = "(coalesce(author_i, '') = coalesce(author_j, ''))"


def _pair(era: str) -> str:
    return f"((era_i = 'ancient_classical' AND era_j = '{era}') OR (era_j = 'ancient_classical' AND era_i = '{era}'))"


def _wp(key: str, era: str, chain: int) -> str:
    return f"SELECT match_id, '{key}' AS wp_key, chain_len, score, rel_id FROM ba WHERE {_pair(era)} AND chain_len >= {chain}"


ALL = f"{BASE}, wp AS ({_wp('wp1', '7th_8th', 6)} UNION ALL {_wp('wp2', '9th_10th', 6)} UNION ALL {_wp('wp3', '11th_12th', 8)} UNION ALL SELECT match_id, 'wp4', chain_len, score, rel_id FROM m WHERE {CROSS} AND chain_len >= 6)"
RULED = f"""{ALL}, ru AS (SELECT *, CASE WHEN (wp_key LIKE 'wp1%' OR wp_key LIKE 'wp2%') AND coalesce(chain_len, 0) >= 10 AND coalesce(score, 0) >= 0.05 THEN 'verified' WHEN coalesce(chain_len, 0) < 8 OR coalesce(score, 0) < 0.01 THEN 'false_positive' ELSE 'unverified' END AS status FROM wp)"""
_RK = lambda e: f"CASE {e} WHEN 'ancient_classical' THEN 0 WHEN '7th_8th' THEN 1 WHEN '9th_10th' THEN 2 WHEN '11th_12th' THEN 3 ELSE 9 END"
ORDERED = f"{M}, eo AS (SELECT *, CASE WHEN {_RK('era_i')} > {_RK('era_j')} THEN era_j ELSE era_i END AS era_first, CASE WHEN {_RK('era_i')} > {_RK('era_j')} THEN era_i ELSE era_j END AS era_second FROM m)"


def _clipped(t: str, n: int) -> str:
    return f"CASE WHEN length({t}) <= {n} THEN {t} WHEN regexp_matches({t}[1:{n}], '.+ [^ ]*$') THEN rtrim(regexp_extract({t}[1:{n}], '^(.+) [^ ]*$', 1)) || ' …' WHEN strpos({t}[{n} + 1:], ' ') = 0 THEN {t} ELSE rtrim({t}[1:{n} + strpos({t}[{n} + 1:], ' ') - 1]) || ' …' END"


RECORD_COLUMNS = "match_id, work_i, work_j, i, j, n_blocks, n_chained, chain_len, matched_words, matched_words_j, word_range_i, word_range_j, snippet_i, snippet_j, score, ref_i, ref_j, era_i, era_j, author_i, author_j"
_TABLE_PLACED = f"""{M}, rec AS (SELECT match_id, work_i, ref_i, work_j, ref_j, chain_len, 1 AS lo_i, coalesce(matched_words, 0) AS hi_i, 1 AS lo_j, coalesce(matched_words, 0) AS hi_j FROM m WHERE ref_i <> '' AND ref_j <> '')""" + PLACED[len(RECORDS):]
_TAIL_GREEK = "αβγδεζηθικλμνξοπρςστυφχψωίϊϋόύώάέή"
_HEADING_SQL = r"\s+[0-9]+\s+(?:ante|cf|Vgl|vgl)|\s+(?:Drei|Zwei|Ein)\s+Exkurse"
_PCT = "(rank() OVER (PARTITION BY work_i, work_j ORDER BY score NULLS LAST) + (count(*) OVER (PARTITION BY work_i, work_j, score) - 1) / 2.0) / count(score) OVER (PARTITION BY work_i, work_j)"

_cell = lambda c: f"nullif(translate({c}, chr(9) || chr(10) || chr(13), '   '), '') AS {c}"
_LISTED = "rec.chain_len >= 6 AND coalesce(author_i, '') <> coalesce(author_j, '')"
_LEAD = " UNION ALL ".join(f"(SELECT '{k}' AS by, match_id, chain_len, matched_words, n_chained, score FROM l ORDER BY {k} DESC, l.chain_len DESC, match_id LIMIT 1)" for k in ("chain_len", "matched_words", "score"))
_FLAT = lambda s: f"replace(array_to_string(list_filter(regexp_split_to_array(snippet_{s}, '{SPACE}'), lambda w: w <> ''), ' '), '|', '/') AS t{s}"
_GAPS = "greatest(0, hi_i - lo_i + 1 - matched_words) AS gap_i, greatest(0, hi_j - lo_j + 1 - matched_words_j) AS gap_j"
_SPANS = "lo_i || '–' || hi_i AS span_i, lo_j || '–' || hi_j AS span_j"
_MERGES = (("ο", "υ"), ("ο", "ς</w>"), ("κ", "α"), ("κα", "ι</w>"), ("τ", "ο"), ("το", "ν</w>"), ("ε", "ι"))


def _sub_list(w: str, merges: int = len(_MERGES)) -> str:
    """A word's subwords: no merge of this model makes a pair for an earlier one, so each is a replacement in a string of '⟨a⟩⟨b⟩'."""
    out = f"array_to_string(list_transform(range(1, length({w}) + 1), lambda p: '⟨' || {w}[p] || CASE WHEN p = length({w}) THEN '</w>' ELSE '' END || '⟩'), '')"
    for a, b in _MERGES[:merges]:
        out = f"replace({out}, '⟨{a}⟩⟨{b}⟩', '⟨{a}{b}⟩')"
    return f"regexp_extract_all({out}, '⟨([^⟩]*)⟩', 1)"


_AFTER_TOP = SCORES[len(TOP) :]
_GRAMS_END = _AFTER_TOP.index("nn AS")
SUB_SCORES = (
    f"{TOP}, sw AS (SELECT w, list_filter({_sub_list('w')}, lambda x: x NOT IN ('και</w>', 'τον</w>')) AS l FROM (SELECT DISTINCT unnest(norm) AS w FROM un)), so AS (SELECT work_id, unit_pos, unnest(norm) AS w, unnest(range(0, len(norm))) AS p FROM un), us AS (SELECT work_id, unit_pos, flatten(list(l ORDER BY p)) AS subs FROM so JOIN sw USING (w) GROUP BY ALL)"
    + _AFTER_TOP[:_GRAMS_END].replace("norm", "subs").replace("FROM un ", "FROM us ")
    + _AFTER_TOP[_GRAMS_END:]
)

SQL: dict[str, str] = {
    "manifest_csv": "SELECT work_id, era, author, title_latin FROM works",
    "manifest_lines": "SELECT work_id, era, author, title_latin FROM works",
    "ndjson_records": f"WITH {M} SELECT work_i, work_j, era_i, era_j, author_i, author_j, title_i, title_j, score, chain_len, matched_words, ref_i, ref_j, snippet_i, snippet_j FROM m",
    "tagged_table": f"WITH {M} SELECT {', '.join(_cell(c) for c in 'work_i ref_i era_i work_j ref_j era_j snippet_i snippet_j author_i author_j title_i title_j tag'.split())}, score, chain_len, matched_words FROM m",
    "package_tables": f"WITH {ALL}, k AS (SELECT wp_key, match_id, chain_len, score, row_number() OVER (PARTITION BY wp_key ORDER BY match_id) AS n FROM wp) SELECT wp_key, format('rel-{{}}-{{:05d}}', wp_key, n) AS rel_id, work_i, work_j, k.chain_len, k.score FROM k JOIN m USING (match_id)",
    "report_summary": f"WITH {M}, x AS (SELECT coalesce(chain_len >= 6, false) AS l, {SAME} AS s FROM m) SELECT count(*) AS records, count(*) FILTER (WHERE NOT s) AS cross_all, count(*) FILTER (WHERE s) AS intra_all, count(*) FILTER (WHERE l AND NOT s) AS cross_listed, count(*) FILTER (WHERE l AND s) AS intra_listed, count(*) FILTER (WHERE NOT l) AS below FROM x",
    "report_lines": f"WITH {RECORDS}, c AS (SELECT *, row_number() OVER (ORDER BY chain_len DESC, match_id) AS rank, {_FLAT('i')}, {_FLAT('j')} FROM rec WHERE {_LISTED} QUALIFY rank <= 10) SELECT rank, work_i, ref_i, work_j, ref_j, chain_len, matched_words, matched_words_j, {_GAPS}, n_chained, score, {_SPANS}, {_clipped('ti', 70)} AS snippet_i, {_clipped('tj', 70)} AS snippet_j FROM c",
    "report_leading": f"WITH {RECORDS}, l AS (SELECT * FROM rec WHERE {_LISTED}) {_LEAD}",
    "report_eras": f"WITH {ORDERED} SELECT era_first, era_second, count(*) AS n, max(chain_len) AS longest FROM eo WHERE chain_len >= 6 AND NOT {SAME} GROUP BY ALL",
    "report_era_lines": f"WITH {RECORDS}, eo AS (SELECT *, CASE WHEN {_RK('era_i')} > {_RK('era_j')} THEN era_j ELSE era_i END AS era_first, CASE WHEN {_RK('era_i')} > {_RK('era_j')} THEN era_i ELSE era_j END AS era_second FROM rec WHERE {_LISTED}) SELECT era_first, era_second, row_number() OVER (PARTITION BY era_first, era_second ORDER BY chain_len DESC, match_id) AS rank, match_id, {_GAPS}, {_SPANS} FROM eo QUALIFY rank <= 10",
    "report_passages": f"WITH {_TABLE_PLACED}, g AS (SELECT work_i, unit_i, work_j, unit_j, cluster, min(lo_i) AS i_lo, max(hi_i) AS i_hi, min(lo_j) AS j_lo, max(hi_j) AS j_hi, CASE WHEN count(DISTINCT ref_i) > 1 THEN 'i' ELSE '' END || CASE WHEN count(DISTINCT ref_j) > 1 THEN 'j' ELSE '' END AS windows_differ FROM cs JOIN (SELECT match_id, ref_i, ref_j FROM rec) USING (match_id) GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1) SELECT work_i, unit_i, work_j, unit_j, cluster::BIGINT AS cluster, match_id, chain_len, i_lo, i_hi, j_lo, j_hi, windows_differ FROM cs JOIN g USING (work_i, unit_i, work_j, unit_j, cluster)",
    "topos_totals": f"WITH {TAGGED}, n AS (SELECT count(*) AS records, count(*) FILTER (WHERE tag <> '') AS tagged FROM tg) SELECT records, tagged, records - tagged AS clean, 100.0::DOUBLE * tagged / nullif(records, 0) AS tagged_pct, 100.0::DOUBLE * (records - tagged) / nullif(records, 0) AS clean_pct FROM n",
    "topos_origins": f"WITH {TAGGED} SELECT tag_origin, count(*) AS n FROM tg WHERE tag <> '' GROUP BY tag_origin",
    "base_noise": f"WITH {BASE}, n AS (SELECT count(*) AS base, count(*) FILTER (WHERE chain_len < 6) AS short, count(*) FILTER (WHERE chain_len >= 6) AS long FROM ba) SELECT *, 100.0::DOUBLE * short / nullif(base, 0) AS short_pct, 100.0::DOUBLE * long / nullif(base, 0) AS long_pct FROM n",
    "package_examples": f"WITH {BASE}, w AS ({_wp('wp1', '7th_8th', 6)} UNION ALL {_wp('wp2', '9th_10th', 6)} UNION ALL {_wp('wp3', '11th_12th', 8)}), k AS (SELECT wp_key, match_id, chain_len, score, 'chain' AS kind, chain_len::DOUBLE AS v FROM w UNION ALL SELECT wp_key, match_id, chain_len, score, 'score', score FROM w WHERE score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY wp_key, kind ORDER BY v DESC, match_id) AS rank FROM k) SELECT wp_key, kind, rank, match_id, chain_len, score FROM r WHERE rank <= CASE WHEN kind = 'chain' THEN 3 ELSE 1 END",
    "cosine_subwords": f"WITH {SUB_SCORES} SELECT work_i, work_j, i, j, round(score, 6) AS score FROM sc",
    "subword_words": f"WITH {UNITS} SELECT w AS word, array_to_string({_sub_list('w')}, ' ') AS subs FROM (SELECT DISTINCT unnest(norm) AS w FROM un)",
    "subword_words_limited": f"WITH {UNITS} SELECT w AS word, array_to_string({_sub_list('w', 3)}, ' ') AS subs FROM (SELECT DISTINCT unnest(norm) AS w FROM un)",
    "verdict_export": f"WITH {RULED}, gv AS (SELECT rel_id, lower(trim(status)) AS given FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY decided_at DESC NULLS LAST, lower(trim(status))) AS n FROM verdicts WHERE lower(trim(status)) IN ('unverified', 'verified', 'false_positive')) WHERE n = 1) SELECT rel_id, arg_min(coalesce(given, status), wp_key) AS status FROM ru LEFT JOIN gv USING (rel_id) WHERE rel_id IS NOT NULL GROUP BY rel_id",
    "review_package": f"WITH {RULED} SELECT wp_key, match_id, chain_len FROM ru WHERE contains(wp_key, 'p2') AND chain_len >= 8",
    "clean_text": f"WITH {CLEANED} SELECT work_id, seg_pos, t0 AS plain, t AS text, {greek('t0')} AS greek FROM cl",
    "window_units": f"WITH {WINDOWS} SELECT work_id, unit_pos, label, text FROM win",
    "segment_units": f"WITH {CLEANED} SELECT work_id, seg_pos, ref AS label, t AS text FROM cl WHERE t <> ''",
    "token_counts": f"WITH {UNITS} SELECT w AS word, count(*) AS n FROM (SELECT unnest(norm) AS w FROM un) GROUP BY w",
    "built_works": f"WITH {WORKS} SELECT work_id, era, author, title, era_rank, ord FROM wo",
    "work_pairs": f"WITH {WORKS} SELECT a.work_id AS work_i, b.work_id AS work_j FROM wo a JOIN wo b ON a.ord < b.ord",
    "bigram_df": f"WITH {GRAMS} SELECT work_id, g.g1 AS g1, g.g2 AS g2, df, cap FROM bdf",
    "candidates_v1": f"WITH {candidates('NOT (db.df > db.cap)')} SELECT * FROM hits",
    "candidates_v2": f"WITH {CANDIDATES} SELECT * FROM hits",
    "candidates_v1_low": f"WITH {candidates('NOT (db.df > db.cap)', 1, 1)} SELECT * FROM hits",
    "candidates_v2_low": f"WITH {candidates(V2, 1, 1)} SELECT * FROM hits",
    "candidates_topk": f"WITH {TOP} SELECT work_i, work_j, i, j, shared, rank FROM top WHERE rank <= 2",
    "candidate_meta": f"WITH {CANDIDATES}, n AS (SELECT work_id, count(*) AS n FROM un GROUP BY work_id) SELECT work_i, work_j, any_value(a.n) * any_value(b.n) AS pairs_total, count(*) AS before_cap, least(count(*), 4000) AS after_cap, count(*) > 4000 AS cap_hit FROM hits JOIN n a ON a.work_id = work_i JOIN n b ON b.work_id = work_j GROUP BY work_i, work_j",
    "leave_out_grams": f"WITH {LNO} SELECT work_id, unit_pos, array_to_string(gram, ' ') AS gram, c FROM gr",
    "idf_corpus": f"WITH {LNO} SELECT array_to_string(gram, ' ') AS gram, df, round(idf, 6) AS idf FROM idf",
    "cosine_scores": f"WITH {SCORES} SELECT work_i, work_j, i, j, round(score, 6) AS score FROM sc",
    "cosine_call": f"""WITH {LNO}, nw AS (SELECT work_id, count(*) AS n FROM un GROUP BY work_id), dw AS (SELECT work_id, gram, count(*) AS df FROM gr GROUP BY ALL),
us AS (SELECT work_i AS work_id, i AS unit_pos, work_j AS other FROM cand UNION SELECT work_j, j, work_i FROM cand),
wv AS (SELECT us.work_id, us.unit_pos, us.other, gram, gr.c * (ln(1 + (a.n + b.n) / (1 + o.df + coalesce(x.df, 0))) + 1) AS w FROM us JOIN gr USING (work_id, unit_pos) JOIN dw o USING (work_id, gram) LEFT JOIN (SELECT work_id AS other, gram, df FROM dw) x USING (other, gram) JOIN nw a ON a.work_id = us.work_id JOIN nw b ON b.work_id = us.other),
ln AS (SELECT work_id, unit_pos, other, sqrt(sum(w * w)) AS norm FROM wv GROUP BY ALL),
dt AS (SELECT c.work_i, c.work_j, c.i, c.j, sum(a.w * b.w) AS dot FROM cand c JOIN wv a ON a.work_id = c.work_i AND a.unit_pos = c.i AND a.other = c.work_j JOIN wv b ON b.work_id = c.work_j AND b.unit_pos = c.j AND b.other = c.work_i AND b.gram = a.gram GROUP BY ALL)
SELECT c.work_i, c.work_j, c.i, c.j, round(coalesce(dot / nullif(a.norm * b.norm, 0), 0), 6) AS score FROM cand c LEFT JOIN dt USING (work_i, work_j, i, j) LEFT JOIN ln a ON a.work_id = c.work_i AND a.unit_pos = c.i AND a.other = c.work_j LEFT JOIN ln b ON b.work_id = c.work_j AND b.unit_pos = c.j AND b.other = c.work_i""",
    "auto_threshold": f"WITH {SCORES} SELECT work_i, work_j, count(*) AS n, round(avg(score), 6) AS mean, round(CASE WHEN count(*) < 2 THEN 0 ELSE avg(score) + 1.2 * stddev_pop(score) END, 6) AS threshold FROM sc GROUP BY work_i, work_j",
    "match_cells": f"WITH {CELLS} SELECT work_i, work_j, i, j, count(*) AS cells, count(DISTINCT d) AS diagonals FROM cell GROUP BY ALL",
    "diagonal_runs": f"WITH {CELLS} SELECT work_i, work_j, i, j, max(length) AS longest, count(*) AS runs FROM runs GROUP BY ALL",
    "kept_blocks": f"WITH {CELLS} SELECT work_i, work_j, i, j, block, a, a + d AS b, n, core FROM kept",
    "bridges": f"""WITH {CELLS}, ga AS (SELECT work_i, work_j, i, j, block, d, wi - step + 1 AS g0, wi AS g1 FROM rn JOIN kept USING (work_i, work_j, i, j, d, blk) WHERE step = 2),
gw AS (SELECT ga.*, ui.norm[g0 + 1] AS a, uj.norm[g0 + d + 1] AS b FROM ga JOIN un ui ON ui.work_id = work_i AND ui.unit_pos = i JOIN un uj ON uj.work_id = work_j AND uj.unit_pos = j),
fz AS (SELECT *, round(100 * (1 - levenshtein({one_byte('a')}, {one_byte('b')}) / (length(a) + length(b))::DOUBLE), 1) AS fuzz FROM gw)
SELECT work_i, work_j, i, j, 'i' AS side, g0 AS word, arg_max(fuzz, block) AS fuzz FROM fz GROUP BY ALL UNION ALL SELECT work_i, work_j, i, j, 'j', g0 + d, arg_max(fuzz, block) FROM fz GROUP BY ALL""",
    "match_records": f"WITH {RECORDS} SELECT {RECORD_COLUMNS} FROM rec",
    "sweep_diagnostics": f"""WITH {CANDIDATES}, n AS (SELECT work_id, count(*) AS n FROM un GROUP BY work_id), me AS (SELECT work_i, work_j, count(*) AS before_cap FROM hits GROUP BY work_i, work_j)
SELECT (SELECT count(*) FROM wo) AS works, (SELECT count(*) * (count(*) - 1) // 2 FROM wo) AS work_pairs, (SELECT count(*) FROM un) AS units, (SELECT count(*) FROM win WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) > 400) AS units_truncated, (SELECT count(*) FROM un WHERE unit_pos >= 20000) AS units_dropped,
count(*) AS pairs_with_candidates, coalesce(sum(before_cap), 0)::BIGINT AS before_cap, coalesce(sum(least(before_cap, 4000)), 0)::BIGINT AS after_cap, count(*) FILTER (WHERE before_cap > 4000) AS pairs_at_cap, arg_max(work_i || ' ' || work_j, (before_cap, work_i, work_j)) AS worst_pair, 'corpus' AS idf_scope, false AS trained FROM me""",
    "record_gaps": rf"""WITH {RECORDS}, c AS (SELECT *, replace(array_to_string(list_filter(regexp_split_to_array(snippet_i, '{SPACE}'), lambda w: w <> ''), ' '), '|', '/') AS ti, replace(array_to_string(list_filter(regexp_split_to_array(snippet_j, '{SPACE}'), lambda w: w <> ''), ' '), '|', '/') AS tj FROM rec),
k AS (SELECT *, {_clipped('ti', 120)} AS ci, {_clipped('tj', 120)} AS cj FROM c)
SELECT match_id, greatest(0, hi_i - lo_i + 1 - matched_words) AS gap_i, greatest(0, hi_j - lo_j + 1 - matched_words_j) AS gap_j,
length(printf('%s | %s %s ↔ %s %s | chain %d, score %.4f | %s ↔ %s', match_id::VARCHAR, work_i, ref_i, work_j, ref_j, chain_len, score, ci, cj)) AS line_length FROM k""",
    "passage_clusters": f"WITH {PLACED} SELECT work_i, unit_i, work_j, unit_j, cluster::BIGINT AS cluster, count(*) AS size, min(lo_i) AS i_lo, max(hi_i) AS i_hi, min(lo_j) AS j_lo, max(hi_j) AS j_hi FROM cs GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1",
    "distinct_passages": f"WITH {PLACED}, c AS (SELECT count(*) AS size FROM cs GROUP BY work_i, unit_i, work_j, unit_j, cluster) SELECT coalesce(sum(size), 0)::BIGINT AS records, count(*) FILTER (WHERE size > 1) AS clusters, coalesce(sum(size - 1), 0)::BIGINT AS redundant, (coalesce(sum(size), 0) - coalesce(sum(size - 1), 0))::BIGINT AS passages FROM c",
    "topos_tag_global": f"WITH {TAGGED} SELECT match_id, work_i, work_j, tag, tag_origin FROM tg",
    "topos_per_work": f"WITH {TAGGED}, e AS (SELECT unnest([work_i, work_j]) AS work_id, tag FROM tg) SELECT work_id, count(*) AS total, count(*) FILTER (WHERE tag <> '') AS tagged, count(*) FILTER (WHERE tag = '') AS clean FROM e GROUP BY work_id",
    "topos_partner": f"WITH {FOCUS} SELECT partner, count(*) AS total, count(h.match_id) AS tagged, count(*) - count(h.match_id) AS clean, 100.0 * count(h.match_id) / count(*) AS tagged_pct FROM own LEFT JOIN hit_a h ON h.match_id = own.match_id GROUP BY partner",
    "control_compare": f"WITH {FOCUS}, p AS (SELECT partner, 100.0 * count(a.match_id) / count(*) AS pct_a, 100.0 * count(b.match_id) / count(*) AS pct_b FROM own LEFT JOIN hit_a a ON a.match_id = own.match_id LEFT JOIN hit_b b ON b.match_id = own.match_id GROUP BY partner) SELECT partner, pct_a, pct_b, 100.0 - pct_a AS independence_a, 100.0 - pct_b AS independence_b FROM p",
    "passage_neighbours": f"""WITH {PLACED}, sz AS (SELECT work_i, unit_i, work_j, unit_j, cluster, count(*) AS size, min(lo_i) AS i_lo, max(hi_i) AS i_hi, any_value(match_id) AS match_id, any_value(chain_len) AS chain_len FROM cs GROUP BY 1, 2, 3, 4, 5),
nb AS (SELECT c.work_i, c.unit_i, c.work_j, c.unit_j, c.cluster, l.match_id, l.chain_len, greatest(0, greatest(l.i_lo - c.i_hi, c.i_lo - l.i_hi) - 1) AS between FROM sz c JOIN sz l USING (work_i, unit_i, work_j, unit_j) WHERE c.size > 1 AND l.size = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY work_i, unit_i, work_j, unit_j, cluster ORDER BY between, chain_len DESC, match_id) AS rank FROM nb)
SELECT work_i, unit_i, work_j, unit_j, cluster::BIGINT AS cluster, match_id, between, rank FROM rk WHERE rank <= 6""",
    "table_neighbours": f"""WITH {_TABLE_PLACED}, sz AS (SELECT work_i, unit_i, work_j, unit_j, cluster, count(*) AS size, min(lo_i) AS i_lo, max(hi_i) AS i_hi, any_value(match_id) AS match_id, any_value(chain_len) AS chain_len FROM cs GROUP BY 1, 2, 3, 4, 5),
nb AS (SELECT c.work_i, c.unit_i, c.work_j, c.unit_j, c.cluster, l.match_id, l.chain_len, greatest(0, greatest(l.i_lo - c.i_hi, c.i_lo - l.i_hi) - 1) AS between FROM sz c JOIN sz l USING (work_i, unit_i, work_j, unit_j) WHERE c.size > 1 AND l.size = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY work_i, unit_i, work_j, unit_j, cluster ORDER BY between, chain_len DESC NULLS LAST, match_id) AS rank FROM nb)
SELECT work_i, unit_i, work_j, unit_j, cluster::BIGINT AS cluster, match_id, between, rank FROM rk WHERE rank <= 6""",
    "table_clusters": f"WITH {_TABLE_PLACED} SELECT work_i, unit_i, work_j, unit_j, cluster::BIGINT AS cluster, count(*) AS size, min(lo_i) AS i_lo, max(hi_i) AS i_hi, min(lo_j) AS j_lo, max(hi_j) AS j_hi FROM cs GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1",
    "event_blocks": f"WITH {CELLS} SELECT work_i, work_j, i, j, 'i' AS side, wi AS word, max(block) AS block FROM rn JOIN kept USING (work_i, work_j, i, j, d, blk) GROUP BY ALL UNION ALL SELECT work_i, work_j, i, j, 'j', wj, max(block) FROM rn JOIN kept USING (work_i, work_j, i, j, d, blk) GROUP BY ALL",
    "folio_segments": rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, 'f[ \t\n\x0b\f\r]+([0-9]+[rv]+)\b', 1) AS marks, regexp_split_to_array(text, 'f[ \t\n\x0b\f\r]+[0-9]+[rv]+\b') AS parts FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, marks, unnest(range(0, len(parts)))::INT AS pos, unnest(parts) AS part FROM p)
SELECT doc_id, pos, CASE WHEN len(marks) = 0 THEN '' WHEN pos = 0 THEN 'prefatio' ELSE marks[pos] END AS page, {_squeeze('part')} AS text FROM r WHERE {_squeeze('part')} <> ''""",
    "tail_trim": rf"""WITH d AS (SELECT doc_id, text, coalesce(length(text), 0) AS n FROM documents),
w AS (SELECT doc_id, k, substr(text, k * 100 + 1, 500) AS t FROM (SELECT doc_id, text, unnest(range(0, (greatest(n - 500, 0) + 99) // 100)) AS k FROM d)),
s AS (SELECT doc_id, k, length(regexp_replace(t, '[^{_TAIL_GREEK}]', '', 'g')) AS g, length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) AS l FROM w),
m AS (SELECT doc_id, k, avg(g / (g + l + 1)::DOUBLE) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) < 0.2 AS low FROM s),
i AS (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS island FROM m WHERE low),
c AS (SELECT doc_id, min(k) AS k FROM (SELECT doc_id, min(k) AS k, count(*) AS n FROM i GROUP BY doc_id, island) WHERE n * 100 >= 3000 GROUP BY doc_id),
a AS (SELECT doc_id, text, n, k * 100 AS cut FROM d LEFT JOIN c USING (doc_id)),
e AS (SELECT *, length(regexp_extract(text[1:cut], '(?s)^.*[·.;]')) AS fin FROM a),
f AS (SELECT *, CASE WHEN fin - 1 > cut - 1500 THEN fin ELSE cut END AS c1 FROM e),
h AS (SELECT *, CASE WHEN regexp_matches(text[1:c1], '{_HEADING_SQL}') THEN length(regexp_extract(text[1:c1], '(?s)^(.*?)(?:{_HEADING_SQL})', 1)) END AS head FROM f)
SELECT doc_id, n::INT AS length, CASE WHEN cut IS NULL THEN n ELSE length(regexp_replace(text[1:CASE WHEN head > c1 - 1500 THEN head ELSE c1 END], '{SPACE}$', '')) END::INT AS cut FROM h""",
    "wp1": f"WITH {BASE} SELECT match_id, work_i, work_j, chain_len, score FROM ba WHERE {_pair('7th_8th')} AND chain_len >= 6",
    "wp2": f"WITH {BASE} SELECT match_id, work_i, work_j, chain_len, score FROM ba WHERE {_pair('9th_10th')} AND chain_len >= 6 AND score >= 0.001",
    "wp3": f"WITH {BASE} SELECT match_id, work_i, work_j, chain_len, score FROM ba WHERE {_pair('11th_12th')} AND chain_len >= 8 AND score >= 0.01",
    "wp4": f"WITH {M} SELECT match_id, work_i, work_j, chain_len, score FROM m WHERE {CROSS} AND chain_len >= 6",
    "wp_percentile": f"WITH {BASE}, b AS (SELECT * FROM ba WHERE {_pair('9th_10th')} AND chain_len >= 6), p AS (SELECT *, CASE WHEN score IS NOT NULL THEN {_PCT} END AS pct FROM b) SELECT match_id, score FROM p WHERE pct >= 0.25",
    "percentile_ranks": f"WITH {M} SELECT match_id, round(CASE WHEN score IS NOT NULL THEN {_PCT} END, 9) AS pct FROM m",
    "control_set": f"WITH {BASE} SELECT match_id, era_i, era_j FROM ba WHERE {CTRL}",
    "wp_report": f"WITH {BASE} " + " UNION ALL ".join(f"SELECT '{k}' AS wp_key, count(*) FILTER (WHERE {_pair(e)}) AS n_era, count(*) FILTER (WHERE {_pair(e)} AND chain_len >= {c}) AS n_wp, 100.0 * count(*) FILTER (WHERE {_pair(e)} AND chain_len >= {c}) / nullif(count(*) FILTER (WHERE {_pair(e)}), 0) AS pct, max(score) FILTER (WHERE {_pair(e)} AND chain_len >= {c}) AS best_score, max(chain_len) FILTER (WHERE {_pair(e)} AND chain_len >= {c}) AS longest FROM ba" for k, e, c in (("wp1", "7th_8th", 6), ("wp2", "9th_10th", 6), ("wp3", "11th_12th", 8))),
    "wp_composition": f"WITH {M} SELECT count(*) AS total, count(*) FILTER (WHERE {CTRL}) AS control, count(*) FILTER (WHERE era_i = 'ancient_classical' AND era_j = 'ancient_classical') AS control_control, count(*) FILTER (WHERE NOT {CTRL} AND coalesce(tag, '') = 'ancient_commonplace') AS tagged, count(*) FILTER (WHERE NOT {CTRL} AND coalesce(tag, '') <> 'ancient_commonplace') AS clean FROM m WHERE {CROSS} AND chain_len >= 6",
    "wp_delta": f"WITH {ALL}, s(wp_key, shipped) AS (VALUES ('wp1', 7), ('wp2', 14), ('wp3', 678), ('wp4', 4561)) SELECT wp_key, count(*) AS n, any_value(shipped)::BIGINT AS shipped, (count(*) - any_value(shipped))::BIGINT AS delta FROM wp JOIN s USING (wp_key) GROUP BY wp_key",
    "partition_counts": f"WITH {M} SELECT CASE WHEN {CTRL} THEN 'control' WHEN {SAME} THEN 'same_author' ELSE 'diff_author' END AS part, count(*) AS n FROM m GROUP BY 1",
    "tag_analysis": f"""WITH {M}, n AS (SELECT count(*) FILTER (WHERE NOT {CTRL} AND {SAME}) AS same, count(*) FILTER (WHERE NOT {CTRL} AND NOT {SAME}) AS diff, count(*) FILTER (WHERE tag = 'ancient_commonplace' AND {SAME}) AS ts, count(*) FILTER (WHERE tag = 'ancient_commonplace' AND NOT {SAME}) AS td FROM m)
SELECT ts + td AS tagged, ts AS tagged_same, td AS tagged_diff, same - ts AS clean_same, diff - td AS clean_diff, 100.0 * (ts + td) / nullif(same + diff, 0) AS pct_all, 100.0 * td / nullif(diff, 0) AS pct_diff FROM n""",
    "era_base": f"WITH {BASE} SELECT CASE WHEN era_i = 'ancient_classical' THEN era_j ELSE era_i END AS era, count(*) AS n FROM ba WHERE {CTRL} AND CASE WHEN era_i = 'ancient_classical' THEN era_j ELSE era_i END IN ('7th_8th', '9th_10th', '11th_12th') GROUP BY 1",
    "chain_distribution": f"WITH {M} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(chain_len, 0) < 6) AS below, count(*) FILTER (WHERE coalesce(chain_len, 0) >= 6) AS above, 100.0 * count(*) FILTER (WHERE coalesce(chain_len, 0) < 6) / nullif(count(*), 0) AS pct_below FROM m WHERE NOT {CTRL} AND NOT {SAME}",
    "era_pair_top": f"WITH {ORDERED}, r AS (SELECT *, row_number() OVER (PARTITION BY era_first, era_second ORDER BY chain_len DESC, match_id) AS rank FROM eo WHERE chain_len >= 6 AND NOT {SAME}) SELECT era_first, era_second, match_id, chain_len, rank FROM r WHERE rank <= 10",
    "leaders": f"WITH {M} SELECT * FROM (SELECT 'chain_len' AS kind, match_id, chain_len::DOUBLE AS value FROM m WHERE chain_len IS NOT NULL ORDER BY chain_len DESC, match_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'matched_words', match_id, matched_words::DOUBLE FROM m WHERE matched_words IS NOT NULL ORDER BY matched_words DESC, match_id LIMIT 1) UNION ALL SELECT * FROM (SELECT 'score', match_id, score FROM m WHERE score IS NOT NULL ORDER BY score DESC, match_id LIMIT 1)",
    "longest_by_package": f"WITH {ALL}, r AS (SELECT *, row_number() OVER (PARTITION BY wp_key ORDER BY chain_len DESC, match_id) AS rank FROM wp) SELECT wp_key, match_id, chain_len, rank FROM r WHERE rank <= 3",
    "report_split": f"WITH {M} SELECT CASE WHEN {SAME} THEN 'intra' ELSE 'cross' END AS relation, count(*) AS n, max(chain_len) AS longest FROM m WHERE chain_len >= 6 GROUP BY 1",
    "saturation": f"WITH {M} SELECT work_i, work_j, count(*) AS n FROM m GROUP BY work_i, work_j ORDER BY n DESC, work_i, work_j LIMIT 2",
    "verdict_rules": f"WITH {RULED} SELECT wp_key, match_id, status FROM ru",
    "verdict_stats": f"""WITH {RULED}, e AS (SELECT unnest([{{'d': 'status', 'b': status}}, {{'d': 'wp', 'b': wp_key}}, {{'d': 'chain', 'b': CASE WHEN coalesce(chain_len, 0) < 6 THEN '<6' WHEN chain_len < 10 THEN '6–9' WHEN chain_len < 20 THEN '10–19' ELSE '20+' END}}, {{'d': 'score', 'b': CASE WHEN coalesce(score, 0) < 0.001 THEN '<0.001' WHEN score < 0.01 THEN '0.001–0.01' WHEN score < 0.05 THEN '0.01–0.05' ELSE '0.05+' END}}]) AS x FROM ru)
SELECT x.d AS dimension, x.b AS bucket, count(*) AS n FROM e GROUP BY ALL""",
    "verdict_decided": f"""WITH {RULED}, v AS (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY decided_at DESC NULLS LAST, given) AS n FROM (SELECT rel_id, lower(trim(status)) AS given, decided_at FROM verdicts) WHERE given IN ('unverified', 'verified', 'false_positive'))
SELECT wp_key, match_id, coalesce(given, status) AS status FROM ru LEFT JOIN (SELECT rel_id, given FROM v WHERE n = 1) USING (rel_id)""",
    "review_filter": f"WITH {M} SELECT match_id, chain_len, score FROM m WHERE chain_len BETWEEN 6 AND 20 AND score >= 0.01 AND (coalesce(contains(lower(author_i), 'younger'), false) OR coalesce(contains(lower(author_j), 'younger'), false))",
    "reference_parts": f"WITH {M} SELECT match_id, split_part(ref_i, '#', 1) AS page_i, {_unit('i')} AS unit_i, {_abs('i')} AS base_i FROM m WHERE ref_i IS NOT NULL",
    "clipped_snippets": f"""WITH {M}, t AS (SELECT match_id, replace(array_to_string(list_filter(regexp_split_to_array(snippet_i, '{SPACE}'), lambda w: w <> ''), ' '), '|', '/') AS t FROM m WHERE snippet_i IS NOT NULL)
SELECT match_id, CASE WHEN length(t) <= 70 THEN t WHEN regexp_matches(t[1:70], '.+ [^ ]*$') THEN rtrim(regexp_extract(t[1:70], '^(.+) [^ ]*$', 1)) || ' …' WHEN strpos(t[71:], ' ') = 0 THEN t ELSE rtrim(t[1:70 + strpos(t[71:], ' ') - 1]) || ' …' END AS snippet FROM t""",
    "author_lookup": "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rel_id ORDER BY loaded_at DESC NULLS LAST, match_id DESC) AS rn FROM wp2_canon_clean) WHERE rn = 1), s AS (SELECT work_i AS w, author_i AS a, title_i AS t, 2 * match_id AS p FROM r UNION ALL SELECT work_j, author_j, title_j, 2 * match_id + 1 FROM r), k AS (SELECT w, arg_max(a, p) FILTER (WHERE a <> '') AS a, arg_max(t, p) FILTER (WHERE t <> '') AS t FROM s GROUP BY w) SELECT r.match_id, x.a AS author_i, y.a AS author_j, x.t AS title_i, y.t AS title_j FROM r LEFT JOIN k x ON x.w = r.work_i LEFT JOIN k y ON y.w = r.work_j",
    "word_similarity": f"WITH {CELLS} SELECT DISTINCT least(a.w, b.w) AS a, greatest(a.w, b.w) AS b, round(1.0 - levenshtein({one_byte('a.w')}, {one_byte('b.w')}) / (length(a.w) + length(b.w))::DOUBLE, 9) AS ratio, {agree('a.w', 'b.w')} AS agree FROM ti a JOIN tj b USING (work_i, work_j, i, j)",
    "character_subwords": f"WITH {UNITS}, w AS (SELECT w, count(*) AS n FROM (SELECT unnest(norm) AS w FROM un) GROUP BY w), e AS (SELECT unnest(list_transform(range(1, length(w) + 1), lambda p: w[p] || CASE WHEN p = length(w) THEN '</w>' ELSE '' END)) AS sub, n FROM w) SELECT sub, sum(n)::BIGINT AS n FROM e GROUP BY sub",
    "stop_subwords": f"WITH {UNITS}, w AS (SELECT w, count(*) AS n FROM (SELECT unnest(norm) AS w FROM un) GROUP BY w) SELECT w[length(w)] || '</w>' AS sub, sum(n)::BIGINT AS n FROM w GROUP BY 1 ORDER BY n DESC, sub DESC LIMIT 50",
    "text_fingerprints": "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL",
}
