"""DuckDB SQL for queries that SQL can express; names are those of the queries."""

from __future__ import annotations

from ..functions.cleaning import ADDRESS, ALLOWED, EMOTICON_TOKEN, LETTERS
from ..functions.lexicon import ABBREVIATIONS, CLITICS, PROTECTED, STOP_WORDS, SYMBOLS, UNITS, VERBS
from ..operators.ppmi import KS
from ..operators.sketches import info, memory
from .queries import ALL, CONFIG, EN, LINEAR, MIN_FREQ, PLOT, RANKS, TOP


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapping(m: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in m.items()) + "}"


STOP = "(" + ", ".join(map(quoted, STOP_WORDS[EN])) + ")"
TOKENS = rf"t AS (SELECT doc_id, (doc_id % {CONFIG.parts} + 1)::INT AS part, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS tokens FROM documents)"
KEPT = rf"t AS (SELECT doc_id, part, list_filter(tokens, lambda x: x NOT IN {STOP}) AS tokens FROM t0)"
WORDS = "w AS (SELECT part, doc_id, unnest(tokens) AS w, unnest(range(1, len(tokens) + 1)) AS pos FROM t)"
NEXT = "n AS (SELECT *, " + ", ".join(f"lead(w, {d}) OVER d AS w{d}" for d in range(1, CONFIG.window)) + " FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY pos))"
PAIRS = "p AS (" + " UNION ALL ".join(f"SELECT part, least(w, w{d}) || ' ' || greatest(w, w{d}) AS key FROM n WHERE w{d} IS NOT NULL" for d in range(1, CONFIG.window)) + ")"
COUNTS = "c AS (SELECT part, 'word' AS kind, w AS key, count(*) AS freq FROM w GROUP BY ALL UNION ALL SELECT part, 'pair', key, count(*) FROM p GROUP BY ALL)"
BASE = f"WITH {TOKENS}, {WORDS}, {NEXT}, {PAIRS}, {COUNTS}"
WORDS_ONLY = f"WITH {TOKENS}, {WORDS}"
SERIES = f"{BASE}, s0 AS (SELECT part, kind, freq FROM c UNION ALL SELECT 0, kind, sum(freq)::BIGINT FROM c GROUP BY kind, key), s AS (SELECT * FROM s0 UNION ALL SELECT part, 'combined', freq FROM s0)"


def scored(pairs: str, words: str, name: str, min_freq: int) -> str:
    """CTE of (part, key, w1, w2, ppmi) from relations (part, key, freq)."""
    return f"""{name} AS (
  SELECT * FROM (SELECT x.part, x.key, split_part(x.key, ' ', 1) AS w1, split_part(x.key, ' ', 2) AS w2, round(log2((x.freq / m.n::DOUBLE) / ((a.freq / m.n::DOUBLE) * (b.freq / m.n::DOUBLE))), 6) AS ppmi
    FROM {pairs} x JOIN {words} a ON a.part = x.part AND a.key = split_part(x.key, ' ', 1) JOIN {words} b ON b.part = x.part AND b.key = split_part(x.key, ' ', 2)
    JOIN (SELECT part, sum(freq) AS n FROM c WHERE kind = 'word' GROUP BY part) m ON m.part = x.part WHERE x.freq >= {min_freq} AND a.freq > 0 AND b.freq > 0) WHERE ppmi > 0)"""


CW, CP = "(SELECT part, key, freq FROM c WHERE kind = 'word')", "(SELECT part, key, freq FROM c WHERE kind = 'pair')"
EXACT = f"{BASE}, " + scored(CP, CW, "x", 1)
H = "(('0x' || substr(md5(key), 1, 8))::BIGINT + i * ('0x' || substr(md5(key), 9, 8))::BIGINT)"
ROWS = f"generate_series(0, {LINEAR['depth'] - 1}) g(i)"
CELL = f"({H} % 4294967296) % {LINEAR['width']}"
CELLS = f"{BASE}, k AS (SELECT part, i::INT AS row, {CELL} AS idx, freq FROM c, {ROWS}), cells AS (SELECT part, row, idx, sum(freq)::BIGINT AS cnt FROM k GROUP BY ALL)"
EST = f"{CELLS}, e AS (SELECT part, kind, key, any_value(freq) AS freq, min(cnt)::DOUBLE AS est FROM (SELECT *, i::INT AS row, {CELL} AS idx FROM c, {ROWS}) JOIN cells USING (part, row, idx) GROUP BY part, kind, key), r AS (SELECT *, abs(est - freq) / freq AS error FROM e)"
MRE = f"{EST}, m AS (SELECT part, coalesce(avg(error) FILTER (kind = 'word'), 0) AS mre_words, coalesce(avg(error) FILTER (kind = 'pair'), 0) AS mre_pairs, avg(error) AS mre_total, count(*) FILTER (kind = 'word') AS n_words, count(*) FILTER (kind = 'pair') AS n_pairs FROM r GROUP BY part)"


def compared(exact_words: bool, ranks: tuple[int, ...] = RANKS, min_freq: int = MIN_FREQ) -> str:
    words = CW if exact_words else "(SELECT part, key, est AS freq FROM e WHERE kind = 'word')"
    ks = ", ".join(f"({k})" for k in ranks)
    return f"""{EST}, {scored(CP, CW, "x", min_freq)}, {scored("(SELECT part, key, est AS freq FROM e WHERE kind = 'pair')", words, "y", min_freq)},
xr AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ppmi DESC, key) AS rank FROM x), yr AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY ppmi DESC, key) AS rank FROM y),
ks AS (SELECT * FROM (VALUES {ks}) v(k)),
b AS (SELECT k, part, key, rt, re, coalesce(x.ppmi, 0) AS st, coalesce(y.ppmi, 0) AS se FROM (
  SELECT k, part, key, min(rt) AS rt, min(re) AS re FROM (SELECT k, part, key, rank AS rt, NULL AS re FROM xr, ks WHERE rank <= k UNION ALL SELECT k, part, key, NULL, rank FROM yr, ks WHERE rank <= k) GROUP BY k, part, key)
  LEFT JOIN x USING (part, key) LEFT JOIN y USING (part, key)),
q AS (SELECT *, rank() OVER (PARTITION BY k, part ORDER BY st) + (count(*) OVER (PARTITION BY k, part, st) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY k, part ORDER BY se) + (count(*) OVER (PARTITION BY k, part, se) - 1) / 2.0::DOUBLE AS z FROM b),
f AS (SELECT part, k::INT AS k, count(*) FILTER (rt IS NOT NULL AND re IS NOT NULL) / (count(*) FILTER (rt IS NOT NULL))::DOUBLE AS recall, CASE WHEN min(st) = max(st) OR min(se) = max(se) THEN 0 ELSE coalesce(corr(a, z), 0) END AS spearman FROM q GROUP BY part, k HAVING count(*) FILTER (rt IS NOT NULL) > 0)"""


def strategies() -> str:
    mb = "sum(list_sum(list_transform(tokens, lambda x: strlen(x))) + len(tokens))::DOUBLE / 1048576"
    out = []
    for name, source in (("minima", "t0"), ("minima_sw", "t")):
        for part, by in (("part", "GROUP BY part"), ("0", "")):
            out.append(f"SELECT '{name}' AS strategy, {part} AS part, count(*) AS docs, sum(len(tokens))::BIGINT AS tokens, len(list_distinct(flatten(list(tokens))))::BIGINT AS \"distinct\", round(sum(len(tokens))::DOUBLE / count(*), 6) AS tokens_per_doc, round({mb}, 6) AS mb FROM {source} WHERE len(tokens) > 0 {by}")
    return " UNION ALL ".join(out)


def normal() -> str:
    clitic = "(?i)(?:-(?:" + "|".join(CLITICS) + "))+$"
    return rf"""
WITH r AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \t\r\n]+')) AS token FROM documents), l AS (SELECT token, lower(token) AS low FROM r WHERE token <> ''),
k AS (SELECT *, regexp_replace(low, '[.,;:!?]+$', '') AS core, regexp_extract(low, '(?i)^([a-zàáâãçéêíóôõúü]+)\.?\s*[ªº]$', 1) AS ordinal FROM l),
b AS (SELECT *, regexp_replace(core, '{clitic}', '') AS bare, {mapping(ABBREVIATIONS)} AS ab, {mapping(UNITS)} AS un, {mapping(VERBS)} AS ve FROM k)
SELECT token, CASE WHEN regexp_matches(low, '^n\.?\s*[°º]\.?$') THEN 'numero' WHEN ordinal <> '' AND ab[ordinal] IS NOT NULL THEN ab[ordinal] WHEN ab[core] IS NOT NULL THEN ab[core]
  WHEN contains(core, '.') AND regexp_matches(core, '\p{{L}}') AND NOT regexp_matches(core, '[\p{{Nd}}²³¹]') THEN replace(low, '.', '') WHEN un[core] IS NOT NULL THEN un[core]
  WHEN contains(core, '-') AND bare <> core THEN coalesce(ve[bare], bare) ELSE core END AS normal FROM b"""


def cleaned(full: bool = False) -> str:
    """The steps of cleaning; full ones too, where emoticons are what stands between white space, and what follows a digit's mark is put back."""
    address = quoted(ADDRESS.replace("(?iU)", "(?i)"))
    steps = [("t1", f"CASE WHEN regexp_matches(t, '[@./:]') THEN regexp_replace(t, {address}, ' ', 'g') ELSE t END")]
    if full:
        steps.append(("t2", f"array_to_string(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: NOT regexp_full_match(x, {quoted(EMOTICON_TOKEN)})), ' ')"))
    digits = [(rf"(\d)([:;,])([{LETTERS}])", r"\1 \2 \3")] if full else []
    for a, b in ((r"(\S)([{\[(])", r"\1 \2"), (r"([}\])])(\S)", r"\1 \2"), ("([A-Za-zªº°])([:;,])", r"\1 \2 "), *digits, ("[-.,:;!?]{2,}", " "), (f"[^{ALLOWED['pt']}]", " "), (r"\s+", " "), ("^ | $", "")):
        steps.append(("x", f"regexp_replace(t, {quoted(a)}, {quoted(b)}, 'g')"))
    out = "SELECT doc_id, nfc_normalize(text) AS t FROM documents"
    for _, step in steps:
        out = f"SELECT doc_id, {step} AS t FROM ({out})"
    return f"SELECT doc_id, t AS text FROM ({out})"


def lemmatized() -> str:
    every = "(" + ", ".join(map(quoted, ALL)) + ")"
    held = "(" + ", ".join(map(quoted, sorted({*UNITS.values(), *PROTECTED, *SYMBOLS}))) + ")"
    return f"""{WORDS_ONLY}, v AS (SELECT part, w FROM w WHERE w NOT IN {every}), n AS (SELECT w, count(*) AS n FROM v GROUP BY w),
l AS (SELECT a.w AS form, b.w AS lemma FROM n a JOIN n b ON b.w || 's' = a.w WHERE length(a.w) > 3 AND b.n >= a.n),
m AS (SELECT part, CASE WHEN w IN {held} THEN w ELSE coalesce(lemma, w) END AS key FROM v LEFT JOIN l ON form = w)
SELECT part, key, count(*) AS freq FROM m WHERE key NOT IN {every} GROUP BY part, key"""


def sampled() -> str:
    """Ranks spread evenly in the logarithm, of at most PLOT points a curve."""
    return f"""{SERIES}, f AS (SELECT part, kind, row_number() OVER (PARTITION BY part, kind ORDER BY freq DESC) AS rank, freq FROM s),
z AS (SELECT part, kind, count(*) AS n, CASE WHEN part = 0 THEN {PLOT[1]} ELSE {PLOT[0]} END AS most FROM s GROUP BY part, kind),
i AS (SELECT part, kind, n, most, unnest(range(most - 1)) AS i FROM z WHERE n > most),
k AS (SELECT part, kind, floor(pow(10.0::DOUBLE, i * (log10(n - 1) / (most - 1))) * {1 + 1e-12!r}::DOUBLE)::BIGINT + 1 AS rank FROM i UNION SELECT part, kind, 1 FROM z UNION SELECT part, kind, n FROM z UNION SELECT f.part, f.kind, rank FROM f JOIN z ON z.part = f.part AND z.kind = f.kind WHERE n <= most)
SELECT f.* FROM f SEMI JOIN k ON k.part = f.part AND k.kind = f.kind AND k.rank = f.rank"""


def spread(c: str, n: str) -> str:
    return f"round(avg({c}), 6) AS {n}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {n}_std"


DOCS = "d AS (SELECT part, doc_id, len(tokens)::INT AS tokens, length(array_to_string(tokens, ';'))::INT AS chars, (" + " + ".join(f"greatest(len(tokens) - {d}, 0)" for d in range(1, CONFIG.window)) + ")::INT AS pairs FROM t WHERE len(tokens) > 0)"
BY_PART = f"""{BASE}, {DOCS},
g AS (SELECT part, count(*) FILTER (kind = 'word') AS distinct_words, count(*) FILTER (kind = 'pair') AS distinct_pairs FROM c GROUP BY part),
s AS (SELECT part, count(*) AS docs, sum(tokens)::BIGINT AS words, sum(pairs)::BIGINT AS pairs, {spread("tokens", "tokens")}, {spread("chars", "chars")} FROM d GROUP BY part),
z AS (SELECT s.*, distinct_words, distinct_pairs, words + pairs AS total, distinct_words + distinct_pairs AS distinct_total FROM s JOIN g USING (part))"""

SQL: dict[str, str] = {
    "corpus_parts": r"WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM s WHERE text <> '') SELECT (least(k // (n // 10), 9) + 1)::INT AS part, doc_id, regexp_replace(text, '[\r\n]', ' ', 'g') AS text FROM r",
    "clean_text": cleaned(),
    "clean_text_full": cleaned(True),
    "normalize_tokens": normal(),
    "lemmatized_counts": lemmatized(),
    "stopword_filter": f"{WORDS_ONLY} SELECT part, w AS key, count(*) AS freq FROM w WHERE w NOT IN {STOP} GROUP BY part, w",
    "tokenization_stats": f"WITH {TOKENS.replace('t AS', 't0 AS', 1)}, {KEPT} SELECT part, count(*) AS docs_in, count(*) FILTER (len(tokens) > 0) AS docs_out, count(*) FILTER (len(tokens) = 0) AS docs_empty, sum(len(tokens))::BIGINT AS tokens, round((1 - count(*) FILTER (len(tokens) > 0) / count(*)::DOUBLE) * 100, 6) AS lost_percent FROM t GROUP BY part",
    "strategy_stats": f"WITH {TOKENS.replace('t AS', 't0 AS', 1)}, {KEPT} {strategies()}",
    "word_counts": f"{WORDS_ONLY} SELECT part, w AS key, count(*) AS freq FROM w GROUP BY part, w",
    "pair_counts": f"{BASE} SELECT part, key, freq FROM c WHERE kind = 'pair'",
    "combined_counts": f"{BASE} SELECT key, sum(freq)::BIGINT AS freq FROM c GROUP BY key",
    "ordered_counts": f"{WORDS_ONLY} SELECT part, w AS key, count(*) AS freq, min((doc_id, pos))[1] AS first_doc, (min((doc_id, pos))[2] - 1)::INT AS first_pos FROM w GROUP BY part, w",
    "corpus_stats_by_part": f"{BY_PART} SELECT * FROM z",
    "corpus_stats_global": f"""{BY_PART},
a AS (SELECT count(*) AS docs, sum(tokens)::BIGINT AS words, sum(pairs)::BIGINT AS pairs, {spread("tokens", "tokens")}, {spread("chars", "chars")} FROM d),
u AS (SELECT count(DISTINCT key) FILTER (kind = 'word') AS distinct_words, count(DISTINCT key) FILTER (kind = 'pair') AS distinct_pairs FROM c),
y AS (SELECT count(*) AS parts, {spread("words", "part_words")}, {spread("distinct_words", "part_distinct_words")}, {spread("distinct_pairs", "part_distinct_pairs")}, round(avg(distinct_total), 6) AS part_distinct_total_mean FROM z)
SELECT * FROM a, u, y""",
    "part_deviation": f"{BY_PART} SELECT part, " + ", ".join(f"round(abs({c} - avg({c}) OVER ()), 6) AS {c}_deviation" for c in ("words", "distinct_words", "distinct_pairs")) + " FROM z",
    "doc_stats": f"WITH {TOKENS}, {DOCS} SELECT * FROM d",
    "zipf_rank": f"{SERIES} SELECT part, kind, row_number() OVER (PARTITION BY part, kind ORDER BY freq DESC) AS rank, freq FROM s",
    "zipf_ccdf": f"{SERIES}, h AS (SELECT part, kind, freq, count(*) AS n FROM s GROUP BY ALL) SELECT part, kind, freq, round((sum(n) OVER (PARTITION BY part, kind ORDER BY freq DESC ROWS UNBOUNDED PRECEDING))::DOUBLE / (sum(n) OVER (PARTITION BY part, kind))::DOUBLE, 6) AS p FROM h",
    "zipf_ideal": f"{SERIES}, r AS (SELECT part, kind, freq, row_number() OVER (PARTITION BY part, kind ORDER BY freq DESC) AS rank, max(freq) OVER (PARTITION BY part, kind) AS top FROM s) SELECT part, kind, rank, top::DOUBLE / rank AS ideal_rank, 1.0::DOUBLE / freq AS ideal_ccdf FROM r",
    "zipf_sample": sampled(),
    "zipf_top20": f"{BASE}, s AS (SELECT key, sum(freq)::BIGINT AS freq FROM c GROUP BY key), r AS (SELECT *, row_number() OVER (ORDER BY freq DESC, key)::INT AS rank, sum(freq) OVER () AS total FROM s) SELECT key, freq, round(freq * 100 / total::DOUBLE, 6) AS percent, CASE WHEN contains(key, ' ') THEN 'par' ELSE 'pal' END AS type, rank FROM r WHERE rank <= 20",
    "ppmi_scores": f"{BASE}, {scored(CP, CW, 'x', 2)} SELECT part, key, ppmi FROM x",
    "ppmi_scores_all": f"{EXACT} SELECT part, key, ppmi FROM x",
    "ppmi_recall_spearman_all": f"{compared(False, KS, 1)} SELECT part, k, round(recall, 6) AS recall, round(spearman, 6) AS spearman FROM f",
    "ppmi_recall_exact_words_all": f"{compared(True, KS, 1)} SELECT 'CMS' AS structure, k, round(avg(recall), 6) AS recall_mean, round(avg(spearman), 6) AS spearman_mean FROM f GROUP BY k",
    "sketch_info": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, (r["structure"], r["name"], r["description"], ", ".join(r["parameters"]), r["defaults"]))) + ")" for r in info()) + ") v(structure, name, description, parameters, defaults)",
    "ppmi_minfreq": f"{BASE}, {scored(CP, CW, 'x', MIN_FREQ)} SELECT part, w1, w2, ppmi FROM x",
    "ppmi_topk": f"{EXACT}, r AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY ppmi DESC, key)::INT AS rank, key, ppmi FROM x) SELECT * FROM r WHERE rank <= {TOP}",
    "cms_linear_cells": f"{CELLS} SELECT * FROM cells",
    "cms_linear_estimate": f"{EST} SELECT * FROM e",
    "cms_linear_mre": f"{MRE} SELECT part, round(mre_words, 6) AS mre_words, round(mre_pairs, 6) AS mre_pairs, round(mre_total, 6) AS mre_total, n_words, n_pairs FROM m",
    "cms_linear_mre_total": f"{MRE} SELECT 'CMS' AS structure, round(avg(mre_words), 6) AS mre_words, round(avg(mre_pairs), 6) AS mre_pairs, round(avg(mre_total), 6) AS mre_total, sum(n_words)::BIGINT AS n_words, sum(n_pairs)::BIGINT AS n_pairs FROM m",
    "mre_by_freq": f"{EST} SELECT 'CMS' AS structure, freq, round(avg(m), 6) AS mre FROM (SELECT part, freq, avg(error) AS m FROM r GROUP BY part, freq) GROUP BY freq",
    "mre_over_under": f"""{EST}, b AS (SELECT 'CMS' AS structure, part, freq, est FROM e UNION ALL SELECT 'CMS/2', part, freq, est / 2 FROM e),
o AS (SELECT structure, part, freq, avg(abs(est - freq) / freq) FILTER (est > freq) AS o, avg(abs(est - freq) / freq) FILTER (est < freq) AS u FROM b WHERE est <> freq AND freq <= 100 GROUP BY ALL)
SELECT structure, freq, round(coalesce(avg(o), 0), 6) AS over, round(coalesce(avg(u), 0), 6) AS under FROM o GROUP BY structure, freq""",
    "ppmi_recall_spearman": f"{compared(False)} SELECT part, k, round(recall, 6) AS recall, round(spearman, 6) AS spearman FROM f",
    "ppmi_recall_exact_words": f"{compared(True)} SELECT 'CMS' AS structure, k, round(avg(recall), 6) AS recall_mean, round(avg(spearman), 6) AS spearman_mean FROM f GROUP BY k",
    "summary_stats": "SELECT event_type, " + "round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(sum(value), 6) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most, count(value) AS n FROM events GROUP BY event_type",
    "summary_stats_total": "WITH s AS (SELECT event_type, event_id % 10 AS part, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std, sum(value) AS total, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY ALL) SELECT event_type, round(avg(mean), 6) AS mean, round(avg(median), 6) AS median, round(avg(std), 6) AS std, round(sum(total), 6) AS total, round(min(least), 6) AS least, round(max(most), 6) AS most, sum(n)::BIGINT AS n FROM s GROUP BY event_type",
    "sketch_invariants": "SELECT * FROM (VALUES ('short CMS-CU', 0::BIGINT), ('short CL-CU', 0), ('short CL-MU', 0), ('over plain', 0)) v(\"check\", violations)",
    "sketch_memory": "SELECT * FROM (VALUES " + ", ".join(f"('{r['structure']}', {r['width']}::BIGINT, {r['depth']}::INT, {r['counter_bytes']}::BIGINT)" for r in memory()) + ") v(structure, width, depth, counter_bytes)",
} | {f"sketch_wide_exact_{x}": f"{WORDS_ONLY} SELECT part, w AS key, count(*) AS freq FROM w GROUP BY part, w" for x in ("cms", "cl_cu", "cl_mu")}
