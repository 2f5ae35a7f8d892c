"""Errors of estimates and summaries of times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def errors(estimates: DataFrame) -> DataFrame:
    """estimates (part, structure, kind, key, freq, est) with error, the relative error; rows without a true count go."""
    return estimates.where("freq > 0").withColumn("error", F.abs(F.col("est") - F.col("freq")) / F.col("freq"))


def mre(estimates: DataFrame) -> DataFrame:
    """(part, structure, mre_words, mre_pairs, mre_total, n_words, n_pairs): means over distinct keys, 0 where there are none."""
    e, word = errors(estimates), F.col("kind") == "word"
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return e.groupBy("part", "structure").agg(
        mean(F.when(word, F.col("error"))).alias("mre_words"), mean(F.when(~word, F.col("error"))).alias("mre_pairs"), mean(F.col("error")).alias("mre_total"),
        F.count(F.when(word, 1)).alias("n_words"), F.count(F.when(~word, 1)).alias("n_pairs"),
    )


def mre_total(by_part: DataFrame) -> DataFrame:
    """Means of the parts' means, without weights, and summed numbers of keys."""
    return by_part.groupBy("structure").agg(*[F.avg(c).alias(c) for c in ("mre_words", "mre_pairs", "mre_total")], *[F.sum(c).alias(c) for c in ("n_words", "n_pairs")])


def mre_by_freq(estimates: DataFrame, most: int | None = None) -> DataFrame:
    """(structure, freq, mre): the parts' mean errors at a true frequency, averaged over parts; most keeps low frequencies only."""
    e = errors(estimates)
    e = e if most is None else e.where(F.col("freq") <= most)
    return e.groupBy("structure", "part", "freq").agg(F.avg("error").alias("m")).groupBy("structure", "freq").agg(F.avg("m").alias("mre"))


def over_under(estimates: DataFrame, structures: tuple[str, ...] = ("CML8S-CU", "CML8HS-CU"), most: int | None = None) -> DataFrame:
    """(structure, freq, over, under): errors of estimates that are too high and too low, apart; exact ones count in neither, a missing side is 0."""
    e = errors(estimates).where(F.col("structure").isin(*structures) & (F.col("est") != F.col("freq")))
    e = e if most is None else e.where(F.col("freq") <= most)
    high = F.col("est") > F.col("freq")
    parts = e.groupBy("structure", "part", "freq").agg(F.avg(F.when(high, F.col("error"))).alias("o"), F.avg(F.when(~high, F.col("error"))).alias("u"))
    zero = F.lit(0.0)
    return parts.groupBy("structure", "freq").agg(F.coalesce(F.avg("o"), zero).alias("over"), F.coalesce(F.avg("u"), zero).alias("under"))


def summary(times: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Mean, median, population deviation, sum, least, greatest and number of a column; zeros for a group without values."""
    c = F.col(value)
    stats = {"mean": F.avg(c), "median": F.median(c), "std": F.stddev_pop(c), "total": F.sum(c), "least": F.min(c), "most": F.max(c)}
    return times.groupBy(*by).agg(*[F.coalesce(x.cast("double"), F.lit(0.0)).alias(k) for k, x in stats.items()], F.count(c).alias("n"))


def summary_total(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Summaries of parts as one: means of means, medians and deviations, sums of totals, least of least, most of most."""
    return parts.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("mean", "median", "std")], F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
