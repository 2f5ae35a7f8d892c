"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, small, table

#: Weight of a source that isn't named; the total is that of the sources present.
DEFAULT_WEIGHT, SEED, STEP, TERMS = 1.0, 29, 16.0, 96
#: Target weights of the query: src0 gets thrice as much text as any other source, whatever they have.
WEIGHTS = {"src0": 3.0}


def uniform(*parts):
    """A double in [0, 1) from 52 bits of an MD5 hash of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: dict[str, float], epochs: float) -> DataFrame:
    """(src, rate, draws, cdf) per source: rate = epochs x all characters x weight share / the source's characters."""
    chars = docs.groupBy(F.col("source").cast("string").alias("src")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).alias("chars"))
    # one row per source from here on; a null source is a source
    weight = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        weight = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    chars = cut(chars.withColumn("weight", F.when(F.col("chars") > 0, weight).otherwise(F.lit(0.0))))
    totals = chars.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    rate = F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), F.lit(float(epochs)) * F.col("all_chars") * F.col("weight") / F.col("all_weight") / F.col("chars")).otherwise(F.lit(0.0))
    out = chars.crossJoin(totals).select("src", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int")))
    # the distribution function of a Poisson variable with mean rate / draws, by p(k) = p(k - 1) mean / k
    mean = F.col("rate") / F.col("draws")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def add(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return out.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, add, lambda acc: acc["c"]))


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """Each row of docs, as often as its Poisson count says, in a global pseudo-random order.

    A source's mean repetition rate is what brings its share of characters to its share of weight, at epochs times the
    corpus's characters in expectation. The count of a row inverts the Poisson distribution function at a hash of seed
    and doc_id; rates over 16 are a sum of equal smaller ones with a hash each, which is the same distribution. The
    shuffle sends a copy to the partition that a hash of doc_id and copy number falls in, and sorts within it by that
    hash, so the order is global without a sampling pass over the texts.

    A null source is a source of its own. A null doc_id is hashed as an empty string. Null and empty texts count no
    characters; they are repeated at their source's rate; a source without any characters has rate 0. Repeated rows get
    the same count each. An empty table stays empty. The columns of docs come back as they are, whatever their names.
    """
    weights = WEIGHTS if weights is None else weights
    src, rate, u, copy, key, pid = (fresh(docs, x) for x in ("_src", "_rate", "_u", "_copy", "_key", "_pid"))
    r = rates(docs, weights, epochs).select(F.col("src").alias(src), F.struct("draws", "cdf").alias(rate))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))

    def one(j):
        x = uniform(F.lit(str(seed)), ident, j.cast("string"))
        return F.size(F.filter(F.col(rate)["cdf"], lambda c: c <= x))

    count = F.aggregate(F.sequence(F.lit(1), F.col(rate)["draws"]), F.lit(0), lambda acc, j: acc + one(j))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    joined = docs.join(small(r), F.col("source").cast("string").eqNullSafe(F.col(src)), "inner")
    counted = joined.withColumn(u, count).where(F.col(u) > 0)
    copies = counted.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(u))).alias(copy))
    keyed = copies.withColumn(key, uniform(F.lit(f"{seed}-order"), ident, F.col(copy).cast("string"))).withColumn(pid, F.floor(F.col(key) * n).cast("int"))
    return keyed.repartitionById(n, F.col(pid)).sortWithinPartitions(key, copy).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(copy).alias(copy), F.col(key).alias(key))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """replicate() with the columns of docs alone."""
    return replicate(docs, weights, epochs, seed).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = replicate(docs)
    return out.select("doc_id", "source", "text", F.col(out.columns[-2]).alias("copy"), F.col(out.columns[-1]).alias("position"))


SQL = f"""
WITH chars AS (SELECT source, sum(length(text))::BIGINT AS chars, CASE WHEN source = 'src0' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM documents GROUP BY source),
totals AS (SELECT sum(chars)::BIGINT AS all_chars, sum(weight)::DOUBLE AS all_weight FROM chars),
rate AS (SELECT source, 1.0::DOUBLE * all_chars::DOUBLE * weight / all_weight / chars::DOUBLE AS rate FROM chars, totals),
draws AS (SELECT source, rate, greatest(1, ceil(rate / {STEP}))::INT AS draws FROM rate),
terms AS (
  WITH RECURSIVE t(source, draws, mean, k, p, c) AS (
    SELECT source, draws, rate / draws, 0, exp(-(rate / draws)), exp(-(rate / draws)) FROM draws
    UNION ALL SELECT source, draws, mean, k + 1, p * mean / (k + 1)::DOUBLE, c + p * mean / (k + 1)::DOUBLE FROM t WHERE k < {TERMS})
  SELECT source, draws, k, c FROM t),
u AS (
  SELECT doc_id, d.source, text, j, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN draws USING (source), range(1, 1000) r(j) WHERE j <= draws),
counts AS (SELECT doc_id, u.source, text, j, count(*) AS n FROM u JOIN terms t ON u.source = t.source AND t.c <= u.u GROUP BY ALL),
sums AS (SELECT doc_id, source, text, sum(n)::BIGINT AS n FROM counts GROUP BY ALL),
copies AS (SELECT doc_id, source, text, unnest(range(1, n + 1))::INT AS copy FROM sums)
SELECT doc_id, source, text, copy, ('0x' || substr(md5('{SEED}-order:' || doc_id || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS position FROM copies
"""
