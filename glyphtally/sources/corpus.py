"""Reading, splitting and writing corpora, counts, reports and sketches."""

from __future__ import annotations

import random
import tempfile
import uuid
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

COUNTS = "token string, freq long"
MODES = ("keep", "overwrite", "error")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of the files at a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def spread(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs over all cores, where its scan has fewer splits than there are cores: a small file is one row group, and so one task's.

    A large table has as many and stays as it is; no text moves there.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= max(2, cores) else docs.repartition(cores, key)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that executors share; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.gettempdir()}/glyphtally-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """df written to a new shared folder and read back: for what is read more than once and costs more than its rows."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def non_blank(docs: DataFrame) -> DataFrame:
    """docs with stripped texts, without those that are null or blank."""
    return docs.withColumn("text", strip(F.col("text"))).where("text <> ''")


def part_bounds(docs: DataFrame, parts: int = 10, key: str = "doc_id") -> list[int]:
    """The least key of parts 2, 3, ... when rows in the order of key are cut in contiguous parts, the last of which takes the remainder.

    A range shuffle of the keys alone and one number per partition find the ranks; no row is numbered on one machine.
    """
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = docs.select(F.col(key).alias("k")).where("k IS NOT NULL").repartitionByRange(n, "k").withColumn("p", F.spark_partition_id()).persist()
    try:
        sizes = {r["p"]: r["count"] for r in keys.groupBy("p").count().collect()}
        total = sum(sizes.values())
        size = total // parts
        if size == 0:
            return []
        wanted, before = [], 0
        for p in sorted(sizes):
            wanted += [(p, i * size - before + 1) for i in range(1, parts) if before <= i * size < before + sizes[p]]
            before += sizes[p]
        rank = F.row_number().over(Window.partitionBy("p").orderBy("k"))
        test = F.lit(False)
        for p, r in wanted:
            test = test | ((F.col("p") == p) & (F.col("r") == r))
        rows = keys.where(F.col("p").isin([p for p, _ in wanted])).withColumn("r", rank).where(test).collect()
        return sorted(r["k"] for r in rows)
    finally:
        keys.unpersist()


def contiguous_parts(docs: DataFrame, parts: int = 10, key: str = "doc_id") -> DataFrame:
    """docs with part: 1 to parts; fewer rows than parts are all in the last one. No text is shuffled."""
    bounds = part_bounds(docs, parts, key)
    if not bounds:
        return docs.withColumn("part", F.lit(parts))
    part = F.lit(1)
    for k, b in enumerate(bounds):
        part = F.when(F.col(key) >= b, k + 2).otherwise(part)
    return docs.withColumn("part", part)


def hashed_parts(docs: DataFrame, parts: int = 10, key: str = "doc_id") -> DataFrame:
    """docs with part by the key's remainder: no pass over the data is needed to place a row."""
    return docs.withColumn("part", (F.pmod(F.col(key), F.lit(parts)) + 1).cast("int"))


def seeded_order(docs: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """docs with position, the row's place in a shuffle that a Mersenne twister of that seed makes of them in key order.

    The permutation depends on the number of rows alone. It is made in the driver, so it is meant for corpora whose ids fit
    there (100 million take 1 GB); shuffled() is the one without that limit. Ranks come from a range shuffle of the keys and
    a running number in each range; no row is numbered on one machine. Keys are unique; rows without one are left out.
    """
    spark = docs.sparkSession
    n_tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(key).alias("_k")).where("_k IS NOT NULL")
    ranges = own.repartitionByRange(n_tasks, "_k").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.min("_k").alias("least")).collect()
    ranges = sorted(ranges, key=lambda r: r["least"])
    n, starts = 0, []
    for r in ranges:
        starts.append(n)
        n += r["n"]
    order = list(range(n))
    random.seed(seed)
    random.shuffle(order)
    place = array("q", bytes(8 * n))
    for k, i in enumerate(order):
        place[i] = k
    at = F.lit(0)
    for k, r in enumerate(ranges[1:], 1):
        at = F.when(F.col("_k") >= F.lit(r["least"]), k).otherwise(at)
    begin = F.get(F.array(*[F.lit(x).cast("long") for x in starts or [0]]), F.col("_p"))
    ranked = own.withColumn("_p", at).select("_k", (F.row_number().over(Window.partitionBy("_p").orderBy("_k")) - 1 + begin).alias("_rank"))
    places = spark.createDataFrame(pd.DataFrame({"_rank": np.arange(n), "position": np.array(place, np.int64)}), "_rank long, position long")
    return docs.join(ranked.join(places, "_rank").select("_k", "position"), F.col(key) == F.col("_k")).drop("_k")


def shuffled(docs: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """docs in a pseudo-random global order."""
    return docs.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def one_line(text: Column) -> Column:
    """text on one line, as parts hold it; a carriage return is white space too."""
    return strip(F.regexp_replace(text, "[\r\n]", " "))


def write_parts(docs: DataFrame, path: str, mode: str = "error") -> None:
    """A folder part=N of text for each part, one document a line."""
    save(docs.where("text IS NOT NULL").select("part", one_line(F.col("text")).alias("value")).where("value <> ''"), path, "text", mode)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, text) of what write_parts() wrote, without blank lines."""
    return spark.read.text(path).select(F.col("part").cast("int"), strip(F.col("value")).alias("text")).where("text <> ''")


def write_tokens(docs: DataFrame, path: str, mode: str = "error") -> None:
    """Tokens of each document with any, joined by semicolons, in a folder for each part."""
    save(docs.where(F.size("tokens") > 0).select("part", F.array_join("tokens", ";").alias("value")), path, "text", mode)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, tokens); a token that has a semicolon in it comes back as several."""
    return spark.read.text(path).select(F.col("part").cast("int"), strip(F.col("value")).alias("value")).where("value <> ''").select("part", F.split("value", ";", -1).alias("tokens"))


def write_counts(counts: DataFrame, path: str, mode: str = "error") -> None:
    """CSV files token,freq in a folder for each part and kind."""
    save(counts.select("part", "kind", F.col("key").alias("token"), "freq"), path, "csv", mode, ("part", "kind"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(part, kind, key, freq); a malformed line stops the query."""
    return spark.read.schema(COUNTS + ", part int, kind string").option("header", True).option("mode", "FAILFAST").csv(path).select("part", "kind", F.col("token").alias("key"), "freq")


def save(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", by: tuple[str, ...] = ("part",)) -> None:
    """Write df. mode says what holds if path has data: keep it, overwrite it, or stop (error)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode}")
    w = df.write.mode({"keep": "ignore", "overwrite": "overwrite", "error": "error"}[mode]).format(format)
    if format == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """JSON, one object a row."""
    save(report, path, "json", mode, ())


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def ranking_names(min_freq: int = 1) -> tuple[str, str]:
    """Names of the tables of rankings, by part and over parts; a floor of more than one occurrence is in the name."""
    suffix = f"_minfreq_{min_freq}" if min_freq > 1 else ""
    return f"ranking_ppmi_by_part{suffix}.csv", f"ranking_ppmi_mean{suffix}.csv"


def write_rankings(by_part: DataFrame, mean: DataFrame, folder: str, min_freq: int = 1, mode: str = "overwrite") -> None:
    for df, name in zip((by_part, mean), ranking_names(min_freq)):
        write_table(df, f"{folder}/{name}", mode)


def read_rankings(spark: SparkSession, folder: str, min_freq: int = 1) -> DataFrame:
    """The ranking by part that write_rankings() wrote, for plots without a new run; stops where there is none."""
    return read_table(spark, f"{folder}/{ranking_names(min_freq)[0]}", "part int, structure string, k int, recall double, spearman double")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header, for results such as those of ppmi.compare(); read_table() reads it again."""
    save(df, path, "csv", mode, ())


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_sketches(sketches: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet of (part, structure, params, blob), in a folder for each structure and part."""
    save(sketches, path, "parquet", mode, ("structure", "part"))


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
