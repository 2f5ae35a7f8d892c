"""Embedding near-dedup by Euclidean p-stable hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, by_bucket, components, cut, small, table

#: Least cosine of near-duplicates; width of a quantised projection; least chance that a pair at the threshold shares a bucket; seed.
COSINE, WIDTH, RECALL, SEED = 0.95, 2.0, 0.98, 5
#: Bits of a vector's sketch, its signs along so many directions; bits that the sketches of near-duplicates differ in at most (a pair at the threshold by more with a chance of 0.00003); most vectors of a bucket in a task.
SKETCH, APART, BUCKET = 32, 11, 1024


def same_cell(distance: float, width: float) -> float:
    """The chance that two points at a distance fall in the same cell of one projection (Datar et al., 2004)."""
    r = width / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL) -> tuple[int, int]:
    """(projections in a table, tables) for n vectors.

    As many projections as bring the expected chance partners of a vector in a table to one, with vectors at right angles
    as the measure; as many tables as find a pair at the threshold with the chance wanted.
    """
    near, far = same_cell(math.sqrt(2 - 2 * cosine), width), same_cell(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(n, 2)) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-(near**k)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest element first, so that no square is lost."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(column):
    """(rows, matrix) for each length of the arrays in a column."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy().astype(np.int64)
    sizes, start = np.diff(ends), ends[:-1] - (ends[0] if len(ends) else 0)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        yield rows, values[start[rows][:, None] + np.arange(n)]


class Hashes:
    """The projections of a plan, drawn once for each length of vectors."""

    def __init__(self, k: int, tables: int, width: float, seed: int):
        self.k, self.tables, self.width, self.seed, self.drawn = k, tables, width, seed, {}

    def of(self, dim: int):
        if dim not in self.drawn:
            rng = np.random.default_rng([self.seed, dim])
            self.drawn[dim] = rng.standard_normal((dim, self.k * self.tables)), rng.uniform(0, self.width, self.k * self.tables), rng.standard_normal((dim, SKETCH))
        return self.drawn[dim]

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket keys of 48 bits: length and table and the table's quantised projections, hashed."""
        a, b, _ = self.of(x.shape[1])
        cells = np.floor((x @ a + b) / self.width).astype(np.int64).astype(np.uint64).reshape(len(x), self.tables, self.k)
        key = np.full((len(x), self.tables), (0x9E3779B97F4A7C15 + (x.shape[1] << 32)) & (2**64 - 1), np.uint64) + np.arange(self.tables, dtype=np.uint64)
        for j in range(self.k):
            key = (key ^ cells[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(29)
        return (key >> np.uint64(16)).view(np.int64)

    def sketches(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.of(x.shape[1])[2] > 0, axis=1).view(np.int32).reshape(-1)


def bucket_edges(x: np.ndarray, ids: np.ndarray, cosine: float):
    """Edges that connect what pairs of cosine or more connect in one bucket: a search from each component's first member on."""
    left, a, b = np.arange(len(ids)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            p = todo.pop()
            hit = x[left] @ x[p] >= cosine
            if hit.any():
                found, left = left[hit], left[~hit]
                todo += found.tolist()
                a += [ids[p]] * len(found)
                b += ids[found].tolist()
    return a, b


def alike(batches):
    """(bucket, node) of sorted (bucket, node, sketch) batches: members whose sketch is near to another's in the bucket, and all of a crowded bucket."""
    parts = (tuple(b.column(k).to_numpy() for k in range(3)) for b in batches if b.num_rows)
    for crowded, (bucket, node, sketch) in by_bucket(parts, BUCKET):
        hit = np.full(len(bucket), crowded)
        i = np.arange(0 if crowded else len(bucket))
        for lag in range(1, BUCKET):
            i = i[i + lag < len(bucket)]
            i = i[bucket[i] == bucket[i + lag]]
            if not len(i):
                break
            near = i[np.bitwise_count((sketch[i] ^ sketch[i + lag]).view(np.uint32)) <= APART]
            hit[near] = hit[near + lag] = True
        yield pa.RecordBatch.from_arrays([pa.array(bucket[hit]), pa.array(node[hit])], ["bucket", "node"])


def search(cosine: float):
    """(a, b) edges of sorted (task, node, x) batches."""

    def rows(b):
        x = np.empty(b.num_rows, object)
        for at, m in by_length(b.column(2)):
            for i, v in zip(at.tolist(), m):
                x[i] = v
        return b.column(0).to_numpy(), b.column(1).to_numpy(), x

    def run(batches):
        for _, (task, node, x) in by_bucket((rows(b) for b in batches if b.num_rows), None):
            start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
            a, z = [], []
            for s, e in zip(start.tolist(), [*start[1:].tolist(), len(task)]):
                sizes = np.array([len(v) for v in x[s:e]])
                for n in np.unique(sizes):
                    at = s + np.flatnonzero(sizes == n)
                    if len(at) > 1:
                        p, q = bucket_edges(unit(np.stack(x[at])), node[at], cosine)
                        a += p
                        z += q
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return run


def placed(own: DataFrame, hashes: Hashes) -> DataFrame:
    """(bucket, node, sketch): one row for each table of each vector of own (node, x). The vectors stay behind."""

    def run(batches):
        for b in batches:
            for at, m in by_length(b.column(1)) if b.num_rows else ():
                u, node = unit(m), b.column(0).to_numpy()[at]
                keys, sketch = hashes.buckets(u), hashes.sketches(u)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(node, keys.shape[1])), pa.array(np.repeat(sketch, keys.shape[1]))], ["bucket", "node", "sketch"])

    return own.mapInArrow(run, "bucket bigint, node bigint, sketch int")


def near_edges(own: DataFrame, n: int, fetch, cosine: float, width: float, recall: float, seed: int, most: int = BUCKET) -> DataFrame:
    """(a, b) nodes of vectors of own (node, x), n of them; their components are those of pairs of cosine or more that share a bucket.

    fetch(nodes) gives (node, x) of some nodes.
    """
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed(own, Hashes(*plan(n, cosine, width, recall), width, seed))
    near = cut(rows.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(alike, "bucket bigint, node bigint"))
    # what is near in one table often is in others too: of buckets with the same members one is enough
    mark = lambda salt: F.bit_xor(F.xxhash64("node", F.lit(salt)))
    members = near.groupBy("bucket").agg(F.count("*").alias("n"), mark(1).alias("s"), mark(2).alias("t")).groupBy("n", "s", "t").agg(F.min("bucket").alias("bucket"))
    kept = cut(near.join(members.where("n > 1").select("bucket"), "bucket", "left_semi"))
    x = fetch(kept.select("node").distinct())
    each = blocks(kept.withColumnRenamed("node", "id"), most).join(x.withColumnRenamed("node", "id"), "id").select("task", F.col("id").alias("node"), "x")
    return each.repartition(tasks, "task").sortWithinPartitions("task", "node").mapInArrow(search(cosine), "a bigint, b bigint").distinct()


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, width: float = WIDTH, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(vec_id, keep_id): each vector that goes because it is a near-duplicate, and the one of its group that stays.

    Vectors are normalised; two of cosine or more are near-duplicates, and groups are what such pairs connect; the least
    vec_id stays. Equal vectors are collapsed first. Each of the others is put in one bucket in each of several tables, by
    quantised Gaussian projections (plan() has how many of both; more vectors take longer keys and more tables, so that
    buckets stay small and the recall stays). Only keys and short sketches of the vectors move; members of a bucket whose
    sketches differ from all others' are dropped, of buckets with the same members one is looked at, and vectors are
    fetched for what is left. There exact cosines decide. A crowded bucket is cut in blocks, each two of which are a task's
    work, so no pair of it is left out.

    Rows with a null vec_id, and null, empty or zero vectors and those with a null or non-finite element, are in no group.
    Vectors of unlike lengths are in no group together. A row that repeats the kept vec_id isn't listed. Other columns
    aren't looked at. An empty table gives no rows.
    """
    kind = vectors.schema["embedding"].dataType.simpleString()
    x = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    v = vectors.select(F.col("vec_id").cast("bigint").alias("id"), x.alias("x")).where("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    high, low = F.array_max("x"), F.array_min("x")
    # null where there is a null element
    finite = ~F.array_contains("x", F.lit(float("nan")).cast(kind[6:-1] if kind == "array<float>" else "double"))
    v = v.where(finite & (high < float("inf")) & (low > float("-inf")) & ((high != 0) | (low != 0)))
    v = v.withColumn("h", F.xxhash64("x")).withColumn("k", F.xxhash64("x", F.lit(1)))
    ids = cut(v.select("id", "h", "k").distinct())
    # nodes are numbers of the rows as they are written: no two vectors share one
    reps = cut(ids.groupBy("h", "k").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()))
    own = v.select("h", "k", "x").dropDuplicates(["h", "k"]).join(reps.select("h", "k", "node"), ["h", "k"]).select("node", "x")

    def fetch(nodes):
        wanted = cut(reps.join(nodes, "node").select("h", "k", "node"))
        return v.select("h", "k", "x").join(small(wanted), ["h", "k"]).dropDuplicates(["node"]).select("node", "x")

    roots = components(near_edges(own, reps.count(), fetch, cosine, width, recall, seed))
    member = reps.join(small(roots.withColumnRenamed("root", "_root")), "node", "left").select("h", "k", "id", F.coalesce("_root", "node").alias("root"))
    keep = member.groupBy("root").agg(F.min("id").alias("keep_id"))
    groups = member.join(keep, "root").select("h", "k", "keep_id")
    return ids.join(groups, ["h", "k"]).where("id <> keep_id").select(F.col("id").alias("vec_id"), "keep_id").distinct()


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT node AS vec_id, min(root) AS keep_id FROM r GROUP BY node HAVING min(root) < node
"""
