"""Line-first quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

MAX_LOSS, MAX_SYMBOLS, MAX_PUNCTUATION, SHORT_WORDS, LONG_WORDS, MIN_DISTINCT = 0.5, 0.15, 0.12, 6, 20, 0.1
BOILERPLATE = r"(?i)(cookie policy|cookies? (settings|preferences)|privacy policy|terms (of|and) (use|service|conditions)|enable javascript|lorem ipsum|subscribe to|sign up for|click here|read more)"
#: A notice is cut too, but is no text of the document: it counts neither as kept nor as lost.
LICENCE = r"(?i)(licensed under|released under the|all rights reserved|copyright ©|© ?[0-9]{4})"
NAVIGATION = r"(^|[ \t])[|»›•](?=[ \t]|$)"
TERMINAL = r"[.!?…。！？:;][\"'”’»)\]]*$"
PUNCTUATION = r"[.,;:!?…]"
#: Characters of scripts that put no blanks between words, each of which counts as a word: kana, Han, Thai.
UNSPACED = "[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f]"
SYMBOLS = r"[^\p{L}\p{N}\p{M} \t.,;:!?'\"’”“«»()…-]"


#: Runs that the symbol rule passes, of ASCII alone, for speed: what is left of a line is then short.
PLAIN = r"[A-Za-z0-9 \t.,;:!?'\"()-]++"
#: A text without any of these has no notice, boilerplate or navigation: a quick test before the expressions above.
HINTS = {"licence": ("licensed under", "released under", "rights reserved", "copyright", "©"), "navigation": ("|", "»", "›", "•"), "boilerplate": ("cookie", "privacy policy", "terms ", "javascript", "lorem ipsum", "subscribe to", "sign up for", "click here", "read more")}


def without(text: Column, chars: str) -> Column:
    """text without some characters. replace() works on bytes; translate() looks characters up one by one and is many times as slow."""
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), chars, text)


def measured(line: Column, unspaced: Column) -> Column:
    """(line, words, rest, marks): numbers of words and punctuation marks, and what the symbol rule has yet to look at. unspaced: whether the text has UNSPACED characters at all."""
    words = F.length(line) - F.length(without(line, " ")) + 1 + F.when(unspaced, F.length(line) - F.length(F.regexp_replace(line, UNSPACED, ""))).otherwise(0)
    marks = F.length(F.regexp_replace(line, "[^" + PUNCTUATION[1:-1] + "]++", ""))
    return F.struct(line.alias("line"), words.alias("words"), F.regexp_replace(line, PLAIN, "").alias("rest"), marks.alias("marks"))


def fails(m: Column, may: dict[str, Column]) -> Column:
    """Why a trimmed, non-empty line, measured(), goes (null: it stays): licence, navigation, boilerplate, symbols, punctuation or repetition."""
    line, words, rest, marks = m["line"], m["words"], m["rest"], m["marks"]
    symbols = F.length(rest) - F.length(F.regexp_replace(rest, SYMBOLS, ""))
    return (
        F.when(may["licence"] & line.rlike(LICENCE), "licence")
        .when(may["navigation"] & line.rlike(NAVIGATION), "navigation")
        .when(may["boilerplate"] & line.rlike(BOILERPLATE), "boilerplate")
        .when((F.length(rest) > F.length(line) * F.lit(MAX_SYMBOLS)) & (symbols > F.length(line) * F.lit(MAX_SYMBOLS)), "symbols")
        .when((words >= SHORT_WORDS) & (marks > F.length(line) * F.lit(MAX_PUNCTUATION)), "punctuation")
        .when((words < SHORT_WORDS) & ~line.rlike(TERMINAL), "punctuation")
        .when((words >= LONG_WORDS) & (F.size(F.array_distinct(F.split(line, " ", -1))) < words * F.lit(MIN_DISTINCT)), "repetition")
    )


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row: the optimizer copies a projection into each of its uses, a generator never."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def clean_lines(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """docs with failing lines cut out of text, without the documents that lose more than max_loss of their characters.

    A line is judged without blanks around it; blank lines stay where they are and count nothing. The rules, in order:
    licence notices, which are cut but count neither as kept nor as lost; a separate bar, bullet or angle mark
    (navigation); boilerplate phrases; over 15 % symbols; over 12 % punctuation in 6 words or more; fewer than 6 words
    without an end mark; 20 words or more of which under a tenth are distinct. Words are what blanks part, and each kana, Han
    and Thai character. A line that repeats an earlier one isn't
    touched here. All expressions stay in the JVM and no row moves.

    Rows with null, empty or blank text have nothing to keep and are dropped. A null doc_id, repeated rows and other
    columns, whatever their names, come back as they are. An empty table stays empty. n_chars, where docs has it, becomes
    the new length.
    """
    blanks = " \t\r"
    may, judged, result = fresh(docs, "_may"), fresh(docs, "_judged"), fresh(docs, "_result")
    low = F.lower("text")
    flags = F.struct(*[reduce(lambda a, b: a | b, [low.contains(x) for x in xs]).alias(k) for k, xs in HINTS.items()], ((F.octet_length("text") > F.length("text")) & F.col("text").rlike(UNSPACED)).alias("unspaced"))
    flag = {k: F.col(may)[k] for k in HINTS}

    # each step is a pass of its own over the lines: a lambda's variable is computed once, an expression wherever it is used
    bare = lambda x: F.when(x.contains("\t") | x.contains("\r"), F.trim(x, F.lit(blanks))).otherwise(F.trim(x))
    why = lambda m: F.when(F.length(m["line"]) == 0, "").otherwise(F.coalesce(fails(m, flag), F.lit("")))
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("x"), bare(x).alias("bare")))
    lines = F.transform(lines, lambda y: F.struct(y["x"].alias("x"), measured(y["bare"], F.col(may)["unspaced"]).alias("m")))
    size = lambda x: F.length(without(x, " \t\r\n"))
    out = once(docs.where("text IS NOT NULL"), may, flags)
    out = once(out, judged, F.transform(lines, lambda y: F.struct(y["x"].alias("x"), why(y["m"]).alias("why"))))
    joined = lambda keep: F.array_join(F.transform(F.filter(judged, lambda y: keep(y["why"])), lambda y: y["x"]), "\n")
    out = once(out, result, F.struct(joined(lambda y: y == "").alias("text"), size(joined(lambda y: ~y.isin("", "licence"))).alias("lost")))
    kept, lost = size(F.col(result)["text"]), F.col(result)["lost"]
    out = out.where((kept > 0) & (lost <= (kept + lost) * F.lit(max_loss)))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(result)["text"].alias("text"))
        elif c == "n_chars":
            cols.append(F.length(F.col(result)["text"]).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_chars")


_BOIL, _NAV, _LIC = BOILERPLATE, r"(^|[ \t])[|»›•]([ \t]|$)", LICENCE
_SYM, _END = SYMBOLS.replace("'", "''"), TERMINAL.replace("'", "''")
SQL = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
t0 AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS s FROM l),
t AS (SELECT *, length(s) - length(replace(s, ' ', '')) + 1 + length(s) - length(regexp_replace(s, '{UNSPACED}', '', 'g')) AS words FROM t0),
f AS (SELECT *, CASE WHEN length(s) = 0 THEN '' WHEN regexp_matches(s, '{_LIC}') THEN 'licence' WHEN regexp_matches(s, '{_NAV}') OR regexp_matches(s, '{_BOIL}') THEN 'bad'
  WHEN length(s) - length(regexp_replace(s, '{_SYM}', '', 'g')) > length(s) * {MAX_SYMBOLS}::DOUBLE THEN 'bad'
  WHEN words >= {SHORT_WORDS} AND length(s) - length(regexp_replace(s, '{PUNCTUATION}', '', 'g')) > length(s) * {MAX_PUNCTUATION}::DOUBLE THEN 'bad'
  WHEN words < {SHORT_WORDS} AND NOT regexp_matches(s, '{_END}') THEN 'bad'
  WHEN words >= {LONG_WORDS} AND len(list_distinct(string_split(s, ' '))) < words * {MIN_DISTINCT}::DOUBLE THEN 'bad' ELSE '' END AS why FROM t),
j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE why = ''), '') AS text, coalesce(string_agg(line, '') FILTER (WHERE why = 'bad'), '') AS lost FROM f GROUP BY doc_id),
z AS (SELECT *, length(regexp_replace(text, '[ \t\r\n]+', '', 'g')) AS a, length(regexp_replace(lost, '[ \t\r\n]+', '', 'g')) AS b FROM j)
SELECT doc_id, text, length(text)::BIGINT AS n_chars FROM z WHERE a > 0 AND b <= (a + b) * {MAX_LOSS}::DOUBLE
"""
