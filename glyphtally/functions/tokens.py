"""Tokens: splitting, normalization, stop words, lemmas and run statistics, as column expressions."""

from __future__ import annotations

import time
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS, CLITICS, PROTECTED, SYMBOLS, UNITS, VERBS

_TITLES = r"(?:Ph|ph)\.[Dd]\.?|(?:[MB]\.S|[mb]\.s)c\."
_NUMBER = r"n\.[º°]|n\.(?=\s*\d)"
_DOTTED = r"\p{L}(?:\.\p{L})+\.?"
_WORD = r"[\p{L}\p{N}_]+(?:[-.'’][\p{L}\p{N}_]+)*[²³ªº°]*"
#: A portable stand-in for affix rules of a tokenizer library: titles, n.º, acronyms, numbers with marks inside, words with inner hyphens and dots, and every other character by itself.
TOKEN = rf"(?U)({_TITLES}|{_NUMBER}|{_DOTTED}|\d+(?:[.,:;/]\d+)*[\p{{L}}²³ªº°]*|{_WORD}\.?[ªº°]|(?i:{'|'.join(sorted((a for a in ABBREVIATIONS if len(a) > 1 and a.isalpha()), key=len, reverse=True))})\.(?=\s|$)|{_WORD}|[^\s])"
_CLITIC = rf"(?iU)(?:-(?:{'|'.join(CLITICS)}))+$"


def words(text: Column) -> Column:
    """Runs of letters in lower case: the portable tokens that SQL engines agree on."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+", -1), lambda x: x != "")


def tokenize(text: Column) -> Column:
    """Tokens of cleaned text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), 1)


def is_punct(token: Column) -> Column:
    """All characters are punctuation (currency and other symbols aren't) or white space."""
    return token.rlike(r"(?U)^(?:\p{P}+|\s+)$")


def _mapped(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def normalize(token: Column) -> Column:
    """A token's normal form: number signs, ordinals, abbreviations, acronyms, units, clitics, or the token in lower case without end marks."""
    low = F.lower(F.regexp_replace(token, r"(?U)^\s+|\s+$", ""))
    core = F.regexp_replace(low, "[.,;:!?]+$", "")
    short, units, verbs = _mapped(ABBREVIATIONS), _mapped(UNITS), _mapped(VERBS)
    ordinal = F.regexp_extract(low, r"(?iU)^([a-zàáâãçéêíóôõúü]+)\.?\s*[ªº]$", 1)
    bare = F.regexp_replace(core, _CLITIC, "")
    return (
        F.when(low.rlike(r"(?U)^n\.?\s*[°º]\.?$"), "numero")
        .when((ordinal != "") & F.element_at(short, ordinal).isNotNull(), F.element_at(short, ordinal))
        .when(F.element_at(short, core).isNotNull(), F.element_at(short, core))
        .when(core.contains(".") & core.rlike(r"(?U)\p{L}") & ~core.rlike(r"(?U)[\d²³¹]"), F.regexp_replace(low, r"\.", ""))
        .when(F.element_at(units, core).isNotNull(), F.element_at(units, core))
        .when(core.contains("-") & (bare != core), F.coalesce(F.element_at(verbs, bare), bare))
        .otherwise(core)
    )


def normalized(tokens: Column, stop: list[str] = ()) -> Column:
    """Tokens without punctuation, normalized, without stop words; useful symbols stay in lower case."""
    keep = F.filter(tokens, lambda t: t.isin(*SYMBOLS) | ~is_punct(t))
    out = F.transform(keep, lambda t: F.when(t.isin(*SYMBOLS), F.lower(t)).otherwise(normalize(t)))
    return without(out, stop)


def without(tokens: Column, stop: list[str] = ()) -> Column:
    """Tokens that aren't empty or stop words, as often as they come."""
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(*stop)) if len(stop) else F.filter(tokens, lambda t: t != "")


def minimal(text: Column, lang: str = "pt", compose: bool = True) -> Column:
    """The least that is done to text: cleaned and tokenized, in lower case, without punctuation."""
    from .affixes import tokenize as split
    from .cleaning import clean

    return F.transform(F.filter(split(clean(text, lang, compose)), lambda t: ~is_punct(t)), lambda t: F.lower(t))


def plural_lemmas(docs: DataFrame) -> DataFrame:
    """(form, lemma) for words in s whose rest, three letters or more, is a word of docs (tokens) as frequent at least: a table from the corpus itself, where no dictionary is at hand."""
    words = docs.select(F.explode("tokens").alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    stems = words.select(F.col("form").alias("lemma"), F.col("n").alias("m"))
    forms = words.where("endswith(form, 's') AND length(form) > 3").select("form", "n", F.expr("left(form, length(form) - 1)").alias("lemma"))
    return forms.join(stems, "lemma").where("m >= n").select("form", "lemma")


def is_protected(token: Column) -> Column:
    return token.isin(*sorted(set(UNITS.values()) | PROTECTED))


def lemmatize(docs: DataFrame, lemmas: DataFrame | None = None, stop: list[str] = (), key: str = "doc_id") -> DataFrame:
    """docs with tokens replaced by their lemmas, from a table (form, lemma); words without a lemma, protected words and symbols stay.

    Without a table tokens stay as they are. With one, only distinct words meet the table, and stop words go once more.
    """
    if lemmas is None:
        return docs.withColumn("tokens", without(F.col("tokens"), stop))
    forms = lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
    flat = docs.select(key, F.posexplode("tokens").alias("pos", "form")).join(forms, "form", "left")
    lemma = F.when(is_protected(F.col("form")) | F.col("form").isin(*SYMBOLS), F.col("form")).otherwise(F.coalesce("lemma", "form"))
    back = flat.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", lemma.alias("lemma")))), lambda x: x["lemma"]).alias("tokens"))
    out = docs.drop("tokens").join(back, key, "left")
    return out.withColumn("tokens", without(F.coalesce("tokens", F.array().cast("array<string>")), stop))


def process(docs: DataFrame, lang: str = "pt", stop: list[str] = (), lemmas: DataFrame | None = None, affixes: bool = True) -> DataFrame:
    """docs with tokens: cleaned, tokenized, normalized, lemmatized. affixes: by affix rules; else by tokenize(), which stays in the JVM."""
    from .affixes import tokenize as split
    from .cleaning import clean

    found = (split if affixes else tokenize)(clean(F.col("text"), lang))
    return lemmatize(docs.withColumn("tokens", normalized(found, stop)), lemmas, stop)


def timed_stats(spark, make, path: str) -> tuple[DataFrame, float]:
    """run_stats() of the tokens that make() gives, written to path and read back, and tokens a second: what a run reports of its speed."""
    began = time.perf_counter()
    make().write.mode("overwrite").parquet(path)
    took = time.perf_counter() - began
    stats = run_stats(spark.read.parquet(path))
    return stats, (stats.agg(F.sum("tokens")).first()[0] or 0) / max(took, 1e-9)


def run_stats(docs: DataFrame, by: tuple[str, ...] = ("part",)) -> DataFrame:
    """Documents in and out, empty ones, tokens, and the share of documents lost in per cent."""
    some = F.count(F.when(F.size("tokens") > 0, 1))
    return docs.groupBy(*by).agg(
        F.count("*").alias("docs_in"), some.alias("docs_out"), F.count(F.when(F.size("tokens") <= 0, 1)).alias("docs_empty"),
        F.sum(F.greatest(F.size("tokens"), F.lit(0)).cast("long")).alias("tokens"), ((1 - some / F.count("*")) * 100).alias("lost_percent"),
    )
