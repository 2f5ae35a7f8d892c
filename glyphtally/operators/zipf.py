"""Rank-frequency and complementary cumulative distributions of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranks that are made at once.
BLOCK = 1 << 20


def histogram(counts: DataFrame, by: tuple[str, ...] = ("part", "kind")) -> DataFrame:
    """(by, freq, keys): how many keys have a frequency. As long as there are distinct frequencies, which is short. What has keys already is left as it is."""
    if "keys" in counts.columns:
        return counts
    return counts.groupBy(*by, "freq").agg(F.count("*").alias("keys"))


def with_combined(histograms: DataFrame) -> DataFrame:
    """Histograms (part, kind, freq, keys) with those of words and pairs together, as the kind combined."""
    both = histograms.select("part", F.explode(F.array("kind", F.lit("combined"))).alias("kind"), "freq", "keys")
    return both.groupBy("part", "kind", "freq").agg(F.sum("keys").alias("keys"))


def series(counts: DataFrame) -> DataFrame:
    """(part, kind, freq) for parts and the whole (part 0), by words, pairs and both (combined): what the distributions are made of."""
    whole = counts.groupBy("kind", "key").agg(F.sum("freq").alias("freq")).select(F.lit(0).alias("part"), "kind", "freq")
    return counts.select("part", "kind", "freq").unionByName(whole).select("part", F.explode(F.array("kind", F.lit("combined"))).alias("kind"), "freq")


def rank_frequency(counts: DataFrame, by: tuple[str, ...] = ("part", "kind"), block: int = BLOCK) -> DataFrame:
    """(by, rank, freq): frequencies in falling order. Equal ones share a block of ranks, which comes from the histogram: no global sort of keys.

    The ranks of a frequency are made block by block, blocks dealt to tasks: there may be more keys seen once than an array holds.
    """
    w = Window.partitionBy(*by).orderBy(F.desc("freq"))
    h = histogram(counts, by).withColumn("last", F.sum("keys").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = h.select(*by, "freq", "last", F.explode(F.sequence(F.col("last") - F.col("keys") + 1, F.col("last"), F.lit(block).cast("long"))).alias("start"))
    dealt = starts.repartition(n, *by, "start")
    return dealt.select(*by, F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (block - 1), F.col("last")))).alias("rank"), "freq")


def ccdf(counts: DataFrame, by: tuple[str, ...] = ("part", "kind")) -> DataFrame:
    """(by, freq, p): the share of keys that are at least so frequent."""
    w = Window.partitionBy(*by)
    up = w.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, 0)
    return histogram(counts, by).select(*by, "freq", (F.sum("keys").over(up) / F.sum("keys").over(w)).alias("p"))


def with_ideal_rank(ranks: DataFrame, by: tuple[str, ...] = ("part", "kind")) -> DataFrame:
    """ranks with ideal_rank, the first frequency over the rank. The first ranks are a row for each curve."""
    first = ranks.where("rank = 1").select(*by, F.col("freq").alias("_first"))
    return ranks.join(F.broadcast(first), list(by)).select(*by, "rank", "freq", (F.col("_first") / F.col("rank")).alias("ideal_rank"))


def ideal_ccdf(curve: DataFrame, alpha: float = 2.0) -> DataFrame:
    """curve with ideal, x^(1 - alpha)."""
    return curve.withColumn("ideal", F.pow(F.col("freq"), F.lit(1 - alpha)))


def log_ranks(n: Column, most: Column) -> Column:
    """Ranks of at most so many points of n, as an array: evenly spread in the logarithm, first and last among them; all if n allows.

    A point just under a whole number counts as that number, so that engines agree on it.
    """
    at = lambda i: F.floor(F.pow(F.lit(10.0), i * (F.log10(n - 1) / (most - 1))) * F.lit(1 + 1e-12)) + 1
    spread = F.concat(F.array(F.lit(1).cast("long")), F.transform(F.sequence(F.lit(0).cast("long"), most.cast("long") - 2), at), F.array(n))
    return F.array_distinct(F.when(n <= most, F.sequence(F.lit(1).cast("long"), n)).otherwise(spread))


def sample_of(histograms: DataFrame, most: Column | int, by: tuple[str, ...] = ("part", "kind")) -> DataFrame:
    """sample() of rank_frequency(histograms), without the ranks that aren't wanted: a rank has the frequency whose last rank comes next."""
    most = most if isinstance(most, Column) else F.lit(most)
    last = F.sum("keys").over(Window.partitionBy(*by).orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, 0))
    h = histogram(histograms, by).select(*by, last.alias("rank"), "freq")
    sizes = h.groupBy(*by).agg(F.max("rank").alias("n"))
    wanted = sizes.select(*by, F.explode(log_ranks(F.col("n"), most)).alias("rank"), F.lit(None).cast("long").alias("freq"))
    # in falling order, for a frame that goes on to the end is made anew for each row
    after = Window.partitionBy(*by).orderBy(F.desc("rank"), F.col("freq").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = wanted.withColumn("own", F.lit(True)).unionByName(h.withColumn("own", F.lit(False)))
    return rows.withColumn("freq", F.last("freq", ignorenulls=True).over(after)).where("own").select(*by, "rank", "freq")


def sample(ranks: DataFrame, most: Column | int, by: tuple[str, ...] = ("part", "kind")) -> DataFrame:
    """ranks thinned to log_ranks() for each curve; most is the size of a plot, so what is wanted is small."""
    most = most if isinstance(most, Column) else F.lit(most)
    sizes = ranks.groupBy(*by).agg(F.max("rank").alias("n"))
    wanted = sizes.select(*by, F.explode(log_ranks(F.col("n"), most)).alias("rank"))
    return ranks.join(wanted, [*by, "rank"], "left_semi")
