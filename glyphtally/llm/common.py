"""Shared helpers: table access, checkpoints, fresh names, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest side that operators here broadcast by hint, in bytes of its rows; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Point checkpoint() at the shared folder that the session names; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="glyphtally-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder and drop its lineage."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = "_" + name
    return name


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, and where that is: for what is read more than once, each time some columns of it."""
    spark = df.sparkSession
    use_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/glyphtally-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that isn't needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def size_of(df: DataFrame) -> int:
    """Bytes of the rows of df, which must be cheap to read (checkpointed): 8 for each number, strings and arrays at their length."""

    def width(c: str, t: T.DataType) -> Column | None:
        c = f"`{c}`"
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 8
        if isinstance(t, T.ArrayType):
            return F.greatest(F.size(c), F.lit(0)) * 8 + 16
        return None

    known = [width(f.name, f.dataType) for f in df.schema]
    each = reduce(lambda a, b: a + b, [w for w in known if w is not None], F.lit(8 + 8 * sum(w is None for w in known)))
    return int(df.agg(F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()[0])


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows take at most so many bytes; see size_of()."""
    return F.broadcast(df) if size_of(df) <= most else df


def by_bucket(parts, most: int | None):
    """(crowded, columns) of numpy columns that come in parts, sorted by the first of them, the bucket.

    Crowded ones are rows of buckets of more than most rows, as they come; all others hold whole buckets. No more than a
    part and most rows are held.
    """
    held, crowded = None, None
    for cols in parts:
        if crowded is not None:
            k = int(np.searchsorted(cols[0], crowded, "right"))
            if k:
                yield True, tuple(c[:k] for c in cols)
            if k == len(cols[0]):
                continue
            crowded, cols = None, tuple(c[k:] for c in cols)
        if held is not None:
            cols = tuple(np.concatenate(x) for x in zip(held, cols))
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1], "left"))
        whole, held = tuple(c[:last] for c in cols), tuple(c[last:] for c in cols)
        if most is not None:
            if len(held[0]) > most:
                crowded = held[0][0]
                yield True, held
                held = None
            _, at, sizes = np.unique(whole[0], return_inverse=True, return_counts=True)
            if (sizes > most).any():
                over = (sizes > most)[at]
                yield True, tuple(c[over] for c in whole)
                whole = tuple(c[~over] for c in whole)
        if len(whole[0]):
            yield False, whole
    if held is not None and len(held[0]):
        yield False, held


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """rows (bucket, id) with task: buckets of more than most rows are cut in blocks, and each pair of blocks is a task of its own.

    So a task holds about twice most rows, and any two rows of a bucket meet in one. A bucket of q blocks is sent q times.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("q"))
    r = F.pmod(F.xxhash64("id"), F.col("q")).cast("int")
    pair = lambda s: F.concat_ws("-", F.least(r, s), F.greatest(r, s))
    return rows.join(sizes, "bucket").select("id", F.explode(F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda s: F.xxhash64("bucket", pair(s)))).alias("task"))


def text_key(text: Column) -> Column:
    """64 bits of the text, null only for null: tells rows apart that repeat an id."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of each node of edges (a, b); root is the least node of its connected component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until no edge changes, each round one
    checkpoint in the shared folder, so that neither lineage nor plans grow. Nulls and self-loops are ignored except
    that a self-loop's node is its own root. Rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    loops = e.where("a = b").select(F.col("a").alias("node"))
    e = e.where("a > b")
    before = None
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        e = cut(large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return cut(stars.union(e.select(F.col("b"), F.col("b"))).union(loops.select("node", F.col("node"))).groupBy("node").agg(F.min("root").alias("root")))
        before = now
    raise RuntimeError(f"components still change after {max_rounds} rounds")
