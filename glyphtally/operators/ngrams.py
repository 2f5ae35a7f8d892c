"""Words, windowed pairs and their exact counts; corpus and strategy statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pairs(tokens: Column, window: int = 3) -> Column:
    """Pairs of tokens at distances 1 to window - 1, each as "lower higher" in code-point order, within the array: no join."""
    n = F.size(tokens)

    def at(d):
        k = F.greatest(n - d, F.lit(0))
        return F.zip_with(F.slice(tokens, 1, k), F.slice(tokens, d + 1, k), lambda a, b: F.concat_ws(" ", F.least(a, b), F.greatest(a, b)))

    return F.flatten(F.array(*[at(d) for d in range(1, window)]))


def keys(docs: DataFrame, window: int = 3, words: bool = True, both: bool = True) -> DataFrame:
    """(part, kind, key): every word and, in both, every pair, of docs (part, tokens); order isn't kept."""
    kinds = []
    if words:
        kinds.append(F.transform("tokens", lambda t: F.struct(F.lit("word").alias("kind"), t.alias("key"))))
    if both:
        kinds.append(F.transform(pairs(F.col("tokens"), window), lambda t: F.struct(F.lit("pair").alias("kind"), t.alias("key"))))
    return docs.select("part", F.explode(F.concat(*kinds)).alias("k")).select("part", "k.kind", "k.key")


def stream(docs: DataFrame, window: int = 3, key: str = "doc_id") -> DataFrame:
    """(part, doc, pos, offset, kind, key): keys with the place that fixes the order of insertion: a word, its pairs, the next word."""
    t = F.col("tokens")
    n = F.size(t)

    def at(i):
        word = F.struct(F.lit(0).alias("offset"), F.lit("word").alias("kind"), t[i].alias("key"))
        follow = [F.when(i + d < n, F.struct(F.lit(d).alias("offset"), F.lit("pair").alias("kind"), F.concat_ws(" ", F.least(t[i], F.get(t, i + d)), F.greatest(t[i], F.get(t, i + d))).alias("key"))) for d in range(1, window)]
        return F.struct(i.alias("pos"), F.filter(F.array(word, *follow), lambda x: x.isNotNull()).alias("ks"))

    rows = docs.where(n > 0).select("part", F.col(key).alias("doc"), F.inline(F.transform(F.sequence(F.lit(0), n - 1), at)))
    return rows.select("part", "doc", "pos", F.inline("ks"))


def count(keys: DataFrame) -> DataFrame:
    """(part, kind, key, freq)"""
    return keys.groupBy("part", "kind", "key").agg(F.count("*").alias("freq"))


def count_ordered(stream: DataFrame) -> DataFrame:
    """count() with first_seq, where a key was seen first: what breaks ties."""
    return stream.groupBy("part", "kind", "key").agg(F.count("*").alias("freq"), F.min(F.struct("doc", "pos", "offset")).alias("first_seq"))


def merge(counts: DataFrame) -> DataFrame:
    """Counts of the whole corpus from those of its parts."""
    return counts.groupBy("kind", "key").agg(F.sum("freq").alias("freq"))


def combine(counts: DataFrame) -> DataFrame:
    """Counts of words and pairs as one kind of key."""
    by = [c for c in ("part",) if c in counts.columns]
    return counts.groupBy(*by, "key").agg(F.sum("freq").alias("freq"))


def doc_stats(docs: DataFrame, window: int = 3, key: str = "doc_id") -> DataFrame:
    """(part, key, tokens, chars, pairs) of each document with a token; chars: of the tokens joined by semicolons."""
    n = F.size("tokens")
    n_pairs = sum((F.greatest(n - d, F.lit(0)) for d in range(1, window)), F.lit(0))
    return docs.where(n > 0).select("part", key, n.alias("tokens"), F.length(F.array_join("tokens", ";")).alias("chars"), n_pairs.alias("pairs"))


def _spread(column: str, name: str) -> list[Column]:
    return [F.avg(column).alias(f"{name}_mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias(f"{name}_std")]


def distinct(counts: DataFrame) -> DataFrame:
    """(part, distinct_words, distinct_pairs) of counts or of their histograms, which have keys."""
    is_word = F.col("kind") == "word"
    n = lambda c: F.sum(F.when(c, F.col("keys")).otherwise(0)) if "keys" in counts.columns else F.count(F.when(c, 1))
    return counts.groupBy("part").agg(n(is_word).alias("distinct_words"), n(~is_word).alias("distinct_pairs"))


def stats_by_part(docs: DataFrame, counts: DataFrame, window: int = 3) -> DataFrame:
    """Documents, words, pairs, distinct ones, and mean and sample deviation of tokens and characters a document, by part.

    Distinct numbers come from the counts, which are there already, or from their histograms; docs may be doc_stats() of them.
    """
    each = docs if "pairs" in docs.columns else doc_stats(docs, window)
    per = each.groupBy("part").agg(F.count("*").alias("docs"), F.sum("tokens").alias("words"), F.sum("pairs").alias("pairs"), *_spread("tokens", "tokens"), *_spread("chars", "chars"))
    return per.join(distinct(counts), "part").withColumn("total", F.col("words") + F.col("pairs")).withColumn("distinct_total", F.col("distinct_words") + F.col("distinct_pairs"))


def stats_global(docs: DataFrame, counts: DataFrame, window: int = 3) -> DataFrame:
    """One row for the corpus: totals, distinct keys over all parts (of histograms, those of part 0), spread over documents and over parts."""
    per = (docs if "pairs" in docs.columns else doc_stats(docs, window)).agg(F.count("*").alias("docs"), F.sum("tokens").alias("words"), F.sum("pairs").alias("pairs"), *_spread("tokens", "tokens"), *_spread("chars", "chars"))
    one = counts.where("part = 0") if "keys" in counts.columns else merge(counts).withColumn("part", F.lit(0))
    parts = stats_by_part(docs, counts, window).agg(F.count("*").alias("parts"), *_spread("words", "part_words"), *_spread("distinct_words", "part_distinct_words"), *_spread("distinct_pairs", "part_distinct_pairs"), F.avg("distinct_total").alias("part_distinct_total_mean"))
    return per.crossJoin(distinct(one).drop("part")).crossJoin(parts)


def deviation(by_part: DataFrame, columns: tuple[str, ...] = ("words", "distinct_words", "distinct_pairs")) -> DataFrame:
    """(part, <column>_deviation): how far each part is from the mean of the parts. by_part has a row a part."""
    means = by_part.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    return by_part.crossJoin(F.broadcast(means)).select("part", *[F.abs(F.col(c) - F.col(f"_{c}")).alias(f"{c}_deviation") for c in columns])


def strategy_stats(strategies: dict[str, DataFrame]) -> DataFrame:
    """(strategy, part, docs, tokens, distinct, tokens_per_doc, mb) of docs (part, tokens) by strategy; part 0 is the whole corpus."""
    rows = [d.where(F.size("tokens") > 0).select(F.lit(k).alias("strategy"), "part", "tokens") for k, d in strategies.items()]
    every = reduce(DataFrame.unionByName, rows)
    size = F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, t: acc + F.octet_length(t)) + F.size("tokens")
    totals = every.rollup("strategy", "part").agg(F.count("*").alias("docs"), F.sum(F.size("tokens")).alias("tokens"), F.sum(size).alias("bytes")).where("strategy IS NOT NULL")
    words = every.select("strategy", "part", F.explode("tokens").alias("w")).distinct()
    # one pass over distinct (part, word) serves both the parts and the whole
    by_part = words.groupBy("strategy", "part").agg(F.count("*").alias("distinct"))
    whole = words.select("strategy", "w").distinct().groupBy("strategy").agg(F.count("*").alias("distinct")).select("strategy", F.lit(0).alias("part"), "distinct")
    out = totals.withColumn("part", F.coalesce("part", F.lit(0))).join(by_part.unionByName(whole), ["strategy", "part"])
    per_doc = F.when(F.col("docs") > 0, F.col("tokens") / F.col("docs")).otherwise(0.0)
    return out.select("strategy", "part", "docs", "tokens", "distinct", per_doc.alias("tokens_per_doc"), (F.col("bytes") / 1048576).alias("mb"))


def relative_to_first(stats: DataFrame, first: str, columns: tuple[str, ...] = ("docs", "tokens", "distinct", "tokens_per_doc")) -> DataFrame:
    """(strategy, part, <column>_percent): stats as a percentage of those of the strategy named first."""
    base = stats.where(F.col("strategy") == first).select("part", *[F.col(c).alias(f"_{c}") for c in columns])
    return stats.join(base, "part").select("strategy", "part", *[(F.col(c) / F.col(f"_{c}") * 100).alias(f"{c}_percent") for c in columns])


def top(counts: DataFrame, n: int = 20, total: DataFrame | None = None) -> DataFrame:
    """The n most frequent keys with their share in per cent and their type: pal (word) or par (pair, told by its blank). total: a row with the sum of all counts, where it is known without them."""
    total = (counts.agg(F.sum("freq")) if total is None else total).toDF("_total")
    best = counts.orderBy(F.desc("freq"), "key").limit(n)
    return best.crossJoin(F.broadcast(total)).select("key", "freq", (F.col("freq") * 100 / F.col("_total")).alias("percent"), F.when(F.col("key").contains(" "), "par").otherwise("pal").alias("type")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("freq"), "key")))
