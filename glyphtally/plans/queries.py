"""One query for each operator, over whole tables. Doubles are rounded to six digits, so that engines agree on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import cleaning, hashing, tokens
from ..functions.lexicon import STOP_WORDS
from ..operators import accuracy, ngrams, ppmi, reports, sketches, tallies, zipf
from ..sources import corpus
from . import benchmark

#: SEED, JANELA and PARTES of the environment hold for queries and their SQL.
CONFIG = Config.from_env()
#: Of the linear sketch that SQL can follow; bytes of a sketch where all six are built; floor and ranks of rankings; points of a plot, for a part and for the whole.
LINEAR = {"width": 4096, "depth": 3, "strategy": "md5"}
PART_BUDGET, MIN_FREQ, TOP, RANKS, PLOT = 65_536, 5, 100, (10, 100), (50_000, 200_000)
#: Wide enough that no key of the words of a part at the sizes tested shares all its cells.
WIDE = {"CMS-CU": {"width": 1 << 18, "depth": 5}, "CL-CU": {"width": 1 << 18, "depth": 3, "expansion": 4, "mode": 0}, "CL-MU": {"width": 1 << 18, "depth": 3, "expansion": 4, "mode": 1}}
EN, ALL = "en", [w for words in STOP_WORDS.values() for w in words]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, part): over all cores, in as many parts as the size of the table takes."""
    docs = corpus.spread(corpus.documents(spark, sf_dir).select("doc_id", "text"))
    return corpus.hashed_parts(docs, CONFIG.parts_of(corpus.size_of(spark, f"{sf_dir}/documents.parquet")))


def portable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, tokens) with the tokens that SQL engines agree on."""
    return texts(spark, sf_dir).select("doc_id", "part", tokens.words(F.col("text")).alias("tokens"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.counts(portable(spark, sf_dir), CONFIG.window)


def scored(spark: SparkSession, sf_dir: str, min_freq: int = 1, best: int | None = None) -> DataFrame:
    return ppmi.of_rows(tallies.scored(portable(spark, sf_dir), CONFIG.window, min_freq, best), 6)


def linear(spark: SparkSession, sf_dir: str, **best) -> DataFrame:
    """Counts and their estimates from the linear sketch, with those of their words; best is for rankings."""
    return tallies.linear(portable(spark, sf_dir), **LINEAR, window=CONFIG.window, **best).withColumn("structure", F.lit("CMS"))


def compared(spark: SparkSession, sf_dir: str, min_freq: int, ks: tuple[int, ...], exact_words: bool = False) -> DataFrame:
    best = linear(spark, sf_dir, best=max(ks), min_freq=min_freq, exact_words=exact_words)
    return ppmi.compare_rows(best, min_freq, exact_words, 6, ks)


def buckets(spark: SparkSession, sf_dir: str) -> int:
    return tallies.buckets_of(corpus.size_of(spark, f"{sf_dir}/documents.parquet"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, key, freq) over all parts; no pair is a word, so these are the counts of combined keys too."""
    return tallies.whole(portable(spark, sf_dir), buckets(spark, sf_dir), CONFIG.window)


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words and pairs have a frequency, by part and over all (part 0)."""
    return tallies.series(portable(spark, sf_dir), buckets(spark, sf_dir), CONFIG.window)


def stats(spark: SparkSession, sf_dir: str, f: Callable) -> DataFrame:
    """f of the numbers of each document and of histograms, both written once: they are small, and are read several times."""
    return f(corpus.materialized(ngrams.doc_stats(portable(spark, sf_dir), CONFIG.window)), corpus.materialized(histograms(spark, sf_dir)), CONFIG.window)


def stats_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = portable(spark, sf_dir)
    return ngrams.stats_by_part(d, tallies.histogram(d, CONFIG.window), CONFIG.window)


@query
def corpus_parts(spark, sf_dir):
    docs = corpus.non_blank(corpus.spread(corpus.documents(spark, sf_dir).select("doc_id", "text")))
    return corpus.contiguous_parts(docs, CONFIG.parts).select("part", "doc_id", corpus.one_line(F.col("text")).alias("text"))


@query
def corpus_parts_seeded(spark, sf_dir):
    docs = corpus.seeded_order(corpus.non_blank(corpus.documents(spark, sf_dir).select("doc_id", "text")), CONFIG.seed)
    return corpus.contiguous_parts(docs, CONFIG.parts, "position").select("part", "position", "doc_id")


@query
def clean_text(spark, sf_dir):
    """The cleaning steps whose expressions need no lookaround."""
    c = cleaning
    t = F.col("text")
    for step in (c.nfc, c.drop_addresses, c.space_brackets, c.space_after_letters, c.drop_repeated_marks, c.keep_allowed, c.squeeze):
        t = step(t)
    return corpus.spread(corpus.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", t.alias("text"))


@query
def clean_text_full(spark, sf_dir):
    return corpus.spread(corpus.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", cleaning.clean(F.col("text")).alias("text"))


@query
def normalize_tokens(spark, sf_dir):
    """Normal forms of the distinct tokens between white space."""
    raw = corpus.spread(corpus.documents(spark, sf_dir).select("doc_id", "text")).select(F.explode(F.split("text", r"[ \t\r\n]+", -1)).alias("token")).where("token <> ''").distinct()
    return raw.select("token", tokens.normalize(F.col("token")).alias("normal"))


@query
def tokenize_full(spark, sf_dir):
    return tokens.process(texts(spark, sf_dir), "any", ALL).select("doc_id", "part", F.array_join("tokens", ";").alias("tokens"))


@query
def stopword_filter(spark, sf_dir):
    d = portable(spark, sf_dir)
    kept = d.select("part", F.explode(tokens.without(F.col("tokens"), STOP_WORDS[EN])).alias("key"))
    return kept.groupBy("part", "key").agg(F.count("*").alias("freq"))


@query
def tokenization_stats(spark, sf_dir):
    d = portable(spark, sf_dir).withColumn("tokens", tokens.without(F.col("tokens"), STOP_WORDS[EN]))
    return rounded(tokens.run_stats(d))


@query
def strategy_stats(spark, sf_dir):
    d = portable(spark, sf_dir)
    return rounded(ngrams.strategy_stats({"minima": d, "minima_sw": d.withColumn("tokens", tokens.without(F.col("tokens"), STOP_WORDS[EN]))}))


@query
def strategy_stats_full(spark, sf_dir):
    """The least, the least without stop words, and all that is done to text; the first two are cleaned and tokenized like the third."""
    t = texts(spark, sf_dir)
    # each text is cleaned and tokenized once; what is counted reads the tokens
    d = corpus.materialized(t.select("doc_id", "part", tokens.minimal(F.col("text"), "any").alias("tokens")))
    full = corpus.materialized(tokens.process(t, "any", ALL).select("doc_id", "part", "tokens"))
    stats = ngrams.strategy_stats({"minima": d, "minima_sw": d.withColumn("tokens", tokens.without(F.col("tokens"), ALL)), "completa": full})
    return rounded(stats.join(ngrams.relative_to_first(stats, "minima"), ["strategy", "part"]))


@query
def lemmatized_counts(spark, sf_dir):
    """Counts of lemmas: stop words go, plurals in s become their stems, and what becomes a stop word goes too."""
    d = portable(spark, sf_dir).withColumn("tokens", tokens.without(F.col("tokens"), ALL))
    return ngrams.count(ngrams.keys(tokens.lemmatize(d, tokens.plural_lemmas(d), ALL), CONFIG.window, both=False)).select("part", "key", "freq")


@query
def word_counts(spark, sf_dir):
    return tallies.counts(portable(spark, sf_dir), CONFIG.window, both=False).select("part", "key", "freq")


@query
def pair_counts(spark, sf_dir):
    return tallies.counts(portable(spark, sf_dir), CONFIG.window, words=False).select("part", "key", "freq")


@query
def combined_counts(spark, sf_dir):
    return whole(spark, sf_dir).select("key", "freq")


@query
def ordered_counts(spark, sf_dir):
    """Word counts with the place where each was seen first."""
    s = ngrams.stream(portable(spark, sf_dir), 1)
    return ngrams.count_ordered(s).select("part", "key", "freq", F.col("first_seq.doc").alias("first_doc"), F.col("first_seq.pos").alias("first_pos"))


@query
def corpus_stats_by_part(spark, sf_dir):
    return rounded(stats_of_parts(spark, sf_dir))


@query
def corpus_stats_global(spark, sf_dir):
    return rounded(stats(spark, sf_dir, ngrams.stats_global))


@query
def part_deviation(spark, sf_dir):
    return rounded(ngrams.deviation(stats_of_parts(spark, sf_dir)))


@query
def doc_stats(spark, sf_dir):
    return ngrams.doc_stats(portable(spark, sf_dir), CONFIG.window)


@query
def zipf_rank(spark, sf_dir):
    return zipf.rank_frequency(zipf.with_combined(histograms(spark, sf_dir)))


@query
def zipf_ccdf(spark, sf_dir):
    return rounded(zipf.ccdf(zipf.with_combined(histograms(spark, sf_dir))))


@query
def zipf_ideal(spark, sf_dir):
    """The ideal lines beside each curve's ranks."""
    ranks = zipf.rank_frequency(corpus.materialized(zipf.with_combined(histograms(spark, sf_dir))))
    return zipf.ideal_ccdf(zipf.with_ideal_rank(ranks)).select("part", "kind", "rank", "ideal_rank", F.col("ideal").alias("ideal_ccdf"))


@query
def zipf_sample(spark, sf_dir):
    most = F.when(F.col("part") == 0, PLOT[1]).otherwise(PLOT[0])
    return zipf.sample_of(corpus.materialized(zipf.with_combined(histograms(spark, sf_dir))), most)


@query
def zipf_top20(spark, sf_dir):
    total = ngrams.doc_stats(portable(spark, sf_dir), CONFIG.window).agg(F.sum(F.col("tokens") + F.col("pairs")))
    return rounded(ngrams.top(whole(spark, sf_dir).select("key", "freq"), total=total))


@query
def ppmi_scores(spark, sf_dir):
    """Of pairs seen at least twice; ppmi_scores_all has every pair."""
    return scored(spark, sf_dir, 2).select("part", "key", "ppmi")


@query
def ppmi_scores_all(spark, sf_dir):
    """Of every pair, those seen once in their part too."""
    return scored(spark, sf_dir).select("part", "key", "ppmi")


@query
def ppmi_minfreq(spark, sf_dir):
    return scored(spark, sf_dir, MIN_FREQ).select("part", "w1", "w2", "ppmi")


@query
def ppmi_topk(spark, sf_dir):
    return ppmi.top_k(scored(spark, sf_dir, best=TOP), TOP).select("part", "rank", "key", "ppmi")


@query
def cms_linear_cells(spark, sf_dir):
    return sketches.linear_cells(ngrams.keys(portable(spark, sf_dir), CONFIG.window), **LINEAR)


@query
def cms_linear_estimate(spark, sf_dir):
    return linear(spark, sf_dir).select("part", "kind", "key", "freq", "est")


@query
def cms_linear_mre(spark, sf_dir):
    return rounded(accuracy.mre(linear(spark, sf_dir)).drop("structure"))


@query
def cms_linear_mre_total(spark, sf_dir):
    return rounded(accuracy.mre_total(accuracy.mre(linear(spark, sf_dir))))


@query
def mre_by_freq(spark, sf_dir):
    return rounded(accuracy.mre_by_freq(linear(spark, sf_dir)))


@query
def mre_over_under(spark, sf_dir):
    """Over- and underestimates at frequencies up to 100; the linear sketch has the former alone, half of it the latter too."""
    each = F.array(F.struct("structure", "est"), F.struct(F.lit("CMS/2").alias("structure"), (F.col("est") / 2).alias("est")))
    e = linear(spark, sf_dir).where("freq <= 100").select("part", "kind", "key", "freq", F.inline(each))
    return rounded(accuracy.over_under(e, ("CMS", "CMS/2"), 100))


@query
def ppmi_recall_spearman(spark, sf_dir):
    return rounded(compared(spark, sf_dir, MIN_FREQ, RANKS).drop("structure"))


@query
def ppmi_recall_exact_words(spark, sf_dir):
    """As above with true counts of words, averaged over parts."""
    return rounded(ppmi.compare_mean(compared(spark, sf_dir, MIN_FREQ, RANKS, True)))


@query
def ppmi_recall_spearman_all(spark, sf_dir):
    """Over every pair and all ranks of ppmi.KS."""
    return rounded(compared(spark, sf_dir, 1, ppmi.KS).drop("structure"))


@query
def ppmi_recall_exact_words_all(spark, sf_dir):
    """As above with true counts of words, averaged over parts."""
    return rounded(ppmi.compare_mean(compared(spark, sf_dir, 1, ppmi.KS, True)))


@query
def summary_stats(spark, sf_dir):
    """The summary of times, over values of events by type."""
    return rounded(accuracy.summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ("event_type",)))


@query
def summary_stats_total(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("part", F.pmod("event_id", F.lit(10)))
    return rounded(accuracy.summary_total(accuracy.summary(e, "value", ("event_type", "part")), ("event_type",)))


def _wide(name):
    def run(spark, sf_dir):
        d = portable(spark, sf_dir)
        built = sketches.build_docs(d, {name: WIDE[name]}, 1)
        return sketches.estimate(ngrams.count(ngrams.keys(d, both=False)), built).select("part", "key", F.col("est").cast("long").alias("freq"))

    return run


for _name, _short in (("CMS-CU", "cms"), ("CL-CU", "cl_cu"), ("CL-MU", "cl_mu")):
    QUERIES[f"sketch_wide_exact_{_short}"] = _wide(_name)


def six(spark, sf_dir, names=None):
    specs = {n: sketches.params_for(n, PART_BUDGET) for n in names or sketches.KINDS}
    return sketches.build_docs(portable(spark, sf_dir), specs, CONFIG.window)


def asked(spark, sf_dir, names=None, **best):
    """Estimates of six(), each part's made by the task that fills its sketches."""
    specs = {n: sketches.params_for(n, PART_BUDGET) for n in names or sketches.KINDS}
    return tallies.sketched(portable(spark, sf_dir), specs, CONFIG.window, **best)


def _build(name):
    def run(spark, sf_dir):
        return six(spark, sf_dir, [name]).select("part", "structure", "params", "n", F.length("blob").alias("bytes"), F.md5("blob").alias("digest"))

    return run


def _mre(name):
    def run(spark, sf_dir):
        return rounded(accuracy.mre(asked(spark, sf_dir, [name])))

    return run


for _name in sketches.KINDS:
    _short = _name.lower().replace("-", "_")
    QUERIES[f"sketch_build_{_short}"], QUERIES[f"sketch_mre_{_short}"] = _build(_name), _mre(_name)


@query
def sketch_invariants(spark, sf_dir):
    """Violations of what holds for any input: estimates that never fall short, and conservative ones never over the plain sketch."""
    d = portable(spark, sf_dir)
    counts = ngrams.count(ngrams.keys(d, both=False))
    specs = {n: sketches.params_for(n, 16_384) for n in ("CMS-CU", "CL-CU", "CL-MU")}
    est = sketches.estimate(counts, sketches.build_docs(d, specs, 1))
    size = {k: specs["CMS-CU"][k] for k in ("width", "depth", "seed")}
    plain = sketches.linear_estimate(counts, sketches.linear_cells(counts, strategy="city64", **size), strategy="city64", **size).select("part", "key", F.col("est").alias("plain"))
    short = est.groupBy("structure").agg(F.sum(F.when(F.col("est") < F.col("freq"), 1).otherwise(0)).alias("violations")).select(F.concat(F.lit("short "), "structure").alias("check"), "violations")
    over = est.where("structure = 'CMS-CU'").join(plain, ["part", "key"]).agg(F.sum(F.when(F.col("est") > F.col("plain"), 1).otherwise(0)).alias("violations")).select(F.lit("over plain").alias("check"), "violations")
    return short.unionByName(over)


@query
def sketch_memory(spark, sf_dir):
    return spark.createDataFrame(sketches.memory(), "structure string, width long, depth int, counter_bytes long")


@query
def sketch_info(spark, sf_dir):
    """The registry in words."""
    return spark.createDataFrame(sketches.info(), "structure string, name string, description string, parameters array<string>, defaults string").withColumn("parameters", F.array_join("parameters", ", "))


@query
def log_over_under(spark, sf_dir):
    """Errors of the logarithmic sketches over and under the truth, by frequency."""
    return rounded(accuracy.over_under(asked(spark, sf_dir, ["CML8S-CU", "CML8HS-CU"])))


@query
def ppmi_sketches(spark, sf_dir):
    """Recall and correlation of all six sketches' rankings with the exact one, over every pair and all ranks, averaged over parts."""
    return rounded(ppmi.compare_mean(ppmi.compare_rows(asked(spark, sf_dir, best=max(ppmi.KS)), digits=6)))


@query
def corpus_report(spark, sf_dir):
    return stats(spark, sf_dir, reports.corpus_report)


@query
def benchmark_run(spark, sf_dir):
    """The whole benchmark in a new folder: errors and rankings of each structure, with the times that it took."""
    done = benchmark.run(spark, portable(spark, sf_dir), corpus.shared_folder(spark), CONFIG, PART_BUDGET)
    ranks = done.rankings.groupBy("structure").pivot("k", list(ppmi.KS)).agg(F.avg("recall"))
    ranks = ranks.select("structure", *[F.col(str(k)).alias(f"recall_{k}") for k in ppmi.KS])
    return done.report.select("structure", "mre_totais.*", F.col("estatisticas_insercao_totais.media").alias("insert_seconds"), F.col("estatisticas_consulta_totais.media").alias("query_seconds")).join(ranks, "structure", "left")


@query
def hash_cells(spark, sf_dir):
    """Cells of distinct words by the byte-string hash, in rows of 1,000 cells."""
    h1, h2 = hashing.halves(F.col("key"), "city64", CONFIG.seed)
    keys = ngrams.merge(ngrams.count(ngrams.keys(portable(spark, sf_dir), both=False))).select("key")
    return keys.select("key", h1.alias("h1"), h2.alias("h2")).select("key", *[hashing.cell(F.col("h1"), F.col("h2"), i, 1000).alias(f"cell{i}") for i in range(3)])
