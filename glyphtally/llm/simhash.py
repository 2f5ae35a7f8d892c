"""SimHash near-dedup with pivot distance tables."""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, by_bucket, components, cut, fresh, small, table, text_key

#: Bits of a fingerprint; largest Hamming distance of near-duplicates; pivots, first those that are tried on all pairs of a bucket.
BITS, DISTANCE, PIVOTS, FIRST_PIVOTS, SEED = 128, 18, 128, 16, 7
#: Least chance that a pair at the largest distance shares a bucket; least sampled bits; most fingerprints of a bucket in one task; of one in which all pairs are tried at once.
RECALL, LEAST_SAMPLED, BUCKET, FEW = 0.9, 16, 4096, 16
#: In the search across groups: most and least fingerprints of a block; pairs that are looked at at once; members of a cell from which those of one's own group are passed over.
BLOCK, LEAST_BLOCK, PAIRS, CELL = 1 << 18, 1000, 1 << 20, 64


def plan(n: int, distance: int = DISTANCE, recall: float = RECALL) -> tuple[int, int]:
    """(tables, sampled bits) for n distinct fingerprints.

    As many bits as there are in n, so that a fingerprint has one chance partner in a table, and pair work grows with the
    tables, not with the square of n. The bits of a table are drawn without replacement; there are as many tables as let a
    pair at the largest distance share a bucket with the chance wanted: about n^0.22 of them.
    """
    sampled = max(LEAST_SAMPLED, math.ceil(math.log2(max(n, 2))))
    one = math.comb(BITS - distance, sampled) / math.comb(BITS, sampled)
    return math.ceil(math.log(1 - recall) / math.log1p(-one)), sampled


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """The finaliser of SplitMix64, on uint64."""
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A byte's bits, one to a byte, as a 64-bit number: eight counters that are added at once.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).reshape(-1)


def fingerprints_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 16) bytes: for each row, the majority of each bit over its hashes values[offsets[i]:offsets[i + 1]]; a tie is 1."""
    n = np.diff(offsets)
    total = np.zeros((len(n), BITS), np.int64)
    # runs of 255 hashes at most, so that no counter of a byte overflows
    per = -(-n // 255)
    row = np.repeat(np.arange(len(n)), per)
    start = offsets[:-1][row] + 255 * (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per))
    end = np.minimum(start + 255, offsets[1:][row])
    i, step = 0, 1 << 16  # hashes at a time
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, "right")))
        v = values[start[i] : end[j - 1]].view(np.uint64)
        lanes = LANES[np.stack([mix(v, 1), mix(v, 2)], 1).view(np.uint8)]
        sums = np.add.reduceat(lanes, start[i:j] - start[i], axis=0).view(np.uint8)
        first = np.flatnonzero(np.r_[True, np.diff(row[i:j]) > 0])
        total[row[i:j][first]] += np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        i = j
    return np.packbits(2 * total >= n[:, None], axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, hi, lo) per row with a doc_id and a word; key is text_key(). The features are the distinct lower-case words."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", -1)), lambda w: F.length(w) > 0)
    src = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))

    def run(batches):
        for b in batches:
            h = b.column(2)
            off = h.offsets.to_numpy().astype(np.int64)
            values = h.values.to_numpy(zero_copy_only=False)
            fp = fingerprints_of(values, off).view(np.int64).reshape(-1, 2)
            some = pa.array(np.diff(off) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp[:, 0]), pa.array(fp[:, 1])], ["doc_id", "key", "hi", "lo"]).filter(some)

    return src.mapInArrow(run, "doc_id bigint, key bigint, hi bigint, lo bigint")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """(n, 128) reference fingerprints as 0/1: rows of a Hadamard matrix, columns flipped at random, so that their distances vary independently."""
    h = np.ones((1, 1), np.int8)
    while len(h) < BITS:
        h = np.block([[h, h], [h, -h]])
    flip = np.random.default_rng(SEED).integers(0, 2, BITS) * 2 - 1
    rows = np.random.default_rng(SEED + 1).permutation(BITS)[:n]
    return (h[rows] * flip > 0).astype(np.uint8)


def distance_table(bits: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances (rows, pivots) of fingerprints, given as 0/1."""
    a, b = bits.astype(np.float32), refs.astype(np.float32)
    return (a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int16)


def close(seed: int, rest: np.ndarray, dist: np.ndarray, packed: np.ndarray, distance: int) -> np.ndarray:
    """Which of rest lie within distance of seed: pivots discard by the triangle inequality, survivors are verified."""
    for a, b in ((0, FIRST_PIVOTS), (FIRST_PIVOTS, dist.shape[1])):
        if len(rest):
            rest = rest[np.abs(dist[rest, a:b] - dist[seed, a:b]).max(1, initial=0) <= distance]
    return rest[np.bitwise_count(packed[rest] ^ packed[seed]).sum(1) <= distance]


def bucket_edges(packed: np.ndarray, ids: np.ndarray, distance: int, refs: np.ndarray):
    """Edges that connect what pairs within distance connect in one bucket: a search from each component's first member on."""
    dist = distance_table(np.unpackbits(packed.view(np.uint8), axis=1), refs)
    left = np.arange(len(ids))
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            found = close(x, left, dist, packed, distance)
            if len(found):
                left = left[~np.isin(left, found, assume_unique=True)]
                todo += found.tolist()
                a.append(np.full(len(found), ids[x]))
                b.append(ids[found])
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def few_edges(bucket: np.ndarray, packed: np.ndarray, ids: np.ndarray, distance: int, refs: np.ndarray):
    """Edges of many buckets of FEW members at most, all at once: each member against the next, the one after that, and so on."""
    dist = distance_table(np.unpackbits(packed.view(np.uint8), axis=1), refs)
    a, b, i = [], [], np.arange(len(bucket))
    for lag in range(1, FEW):
        i = i[i + lag < len(bucket)]
        i = i[bucket[i] == bucket[i + lag]]
        if not len(i):
            break
        x = i
        for p, q in ((0, FIRST_PIVOTS), (FIRST_PIVOTS, dist.shape[1])):
            x = x[np.abs(dist[x, p:q] - dist[x + lag, p:q]).max(1, initial=0) <= distance]
        x = x[np.bitwise_count(packed[x] ^ packed[x + lag]).sum(1) <= distance]
        a.append(ids[x])
        b.append(ids[x + lag])
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


EDGES = "a bigint, b bigint, crowded boolean"


def searching(distance: int, most: int | None):
    """EDGES of batches (bucket, id, hi, lo) sorted by bucket; rows of crowded buckets come back as (id, bucket)."""

    def out(a, b, crowded):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), crowded))], ["a", "b", "crowded"])

    def run(batches):
        refs = pivots()
        parts = (tuple(b.column(k).to_numpy() for k in range(4)) for b in batches if b.num_rows)
        for crowded, (bucket, ids, hi, lo) in by_bucket(parts, most):
            if crowded:
                yield out(ids, bucket, True)
                continue
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            size = np.diff(np.r_[start, len(bucket)])
            each = np.repeat(size, size)
            packed = np.stack([hi, lo], 1).view(np.uint64)  # bits of signed numbers aren't counted as they are
            at = np.flatnonzero((each > 1) & (each <= FEW))
            yield out(*few_edges(bucket[at], packed[at], ids[at], distance, refs), False)
            for s, n in zip(start[size > FEW].tolist(), size[size > FEW].tolist()):
                yield out(*bucket_edges(np.ascontiguousarray(packed[s : s + n]), ids[s : s + n], distance, refs), False)

    return run


def bucket_pairs(fps: DataFrame, distance: int = DISTANCE, tables: int | None = None, sampled: int | None = None, most: int = BUCKET) -> DataFrame:
    """(a, b) ids of distinct fingerprints (id, hi, lo); their components are those of the pairs within distance that share a bucket of sampled bits."""
    if tables is None or sampled is None:
        tables, sampled = plan(fps.count(), distance)
    rng = np.random.default_rng(SEED + 2)
    picks = [np.sort(rng.choice(BITS, sampled, replace=False)) for _ in range(tables)]

    def keys(batches):
        weights = 2.0 ** np.arange(sampled)
        for b in batches:
            if not b.num_rows:
                continue
            bits = np.unpackbits(np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1).view(np.uint8), axis=1).astype(np.float64)
            for t, pick in enumerate(picks):
                key = (bits[:, pick] @ weights).astype(np.int64) + (t << sampled)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1), b.column(2)], ["bucket", "id", "hi", "lo"])

    schema = "bucket bigint, id bigint, hi bigint, lo bigint"
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = fps.select("id", "hi", "lo").mapInArrow(keys, schema)
    found = cut(placed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(searching(distance, most), EDGES).distinct())
    edges, crowded = found.where("NOT crowded").select("a", "b"), found.where("crowded").select(F.col("a").alias("id"), F.col("b").alias("bucket"))
    if crowded.isEmpty():
        return edges
    rows = blocks(crowded, most).join(fps.select("id", "hi", "lo"), "id").select(F.col("task").alias("bucket"), "id", "hi", "lo")
    again = rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "id").mapInArrow(searching(distance, None), EDGES)
    return edges.union(again.select("a", "b").distinct())


@lru_cache
def masks(width: int, radius: int) -> np.ndarray:
    """Numbers of so many bits of which at most radius are 1."""
    return np.array([sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def pieces(distance: int, n: int) -> list[tuple[np.ndarray, int]]:
    """(bits, radius) of each piece of a fingerprint: two within distance are within the radius in one piece at least.

    Radii and ones of them add up to distance + 1, so two that are over the radius in all pieces are over distance.
    """
    return [(bits, (distance + 1 + k) // n - 1) for k, bits in enumerate(np.array_split(np.arange(BITS), n)) if distance + 1 + k >= n]


@lru_cache
def best_pieces(members: int, distance: int) -> int:
    """In how many pieces a search among so many members takes the least time: look-ups take 1.5 times that of a pair, and cells hold twice what chance would give them."""

    def cost(n: int) -> float:
        looked = [(sum(math.comb(len(bits), k) for k in range(radius + 1)), len(bits)) for bits, radius in pieces(distance, n)]
        return sum(1.5 * m + 2 * members * m / 2**width for m, width in looked)

    return min(range(6, 17), key=cost)


def spans(rows: np.ndarray, first: np.ndarray, size: np.ndarray):
    """(i, j), some PAIRS at a time: each of rows with first, first + 1 and so on, size of them."""
    end, k = np.cumsum(size), 0
    while k < len(rows):
        until = max(k + 1, int(np.searchsorted(end, end[k] - size[k] + PAIRS, "right")))
        n = size[k:until]
        yield np.repeat(rows[k:until], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[k:until], n)
        k = until


def across(a: np.ndarray, root_a: np.ndarray, b: np.ndarray, root_b: np.ndarray, distance: int = DISTANCE, n: int | None = None) -> np.ndarray:
    """(pairs, 2) roots, the less first, each pair once: those of a member of a and one of b, (rows, 2) uint64, that lie within distance.

    Members of b go by the value of a piece; a's look up every value within the radius of their own. Each pair within
    distance comes up in one piece at least, so none is left out. Pairs of one root are passed over.
    """
    roots, rank = np.unique(np.concatenate([root_a, root_b]), return_inverse=True)
    bits_a, bits_b = (np.unpackbits(x.view(np.uint8), axis=1) for x in (a, b))
    found = [np.zeros(0, np.int64)]
    for bits, radius in pieces(distance, n or best_pieces(len(b), distance)):
        weights = 2.0 ** np.arange(len(bits))
        ka, kb = ((x[:, bits] @ weights).astype(np.int64) for x in (bits_a, bits_b))
        at_a, at_b = np.argsort(ka, kind="stable"), np.lexsort((rank[len(a) :], kb))
        ka, kb, ra, rb = ka[at_a], kb[at_b], rank[: len(a)][at_a], rank[len(a) :][at_b]
        (ha, la), (hb, lb) = np.ascontiguousarray(a[at_a].T), np.ascontiguousarray(b[at_b].T)
        cell = np.concatenate([[0], np.cumsum(np.bincount(kb, minlength=1 << len(bits)))])
        by_root = kb * len(roots) + rb
        for mask in masks(len(bits), radius):
            key = ka ^ mask
            first, end = cell[key], cell[key + 1]
            few, many = np.flatnonzero((end > first) & (end - first <= CELL)), np.flatnonzero(end - first > CELL)
            own = key[many] * len(roots) + ra[many]
            own, past = np.searchsorted(by_root, own, "left"), np.searchsorted(by_root, own, "right")
            rows, start = np.concatenate([few, many, many]), np.concatenate([first[few], first[many], past])
            size = np.concatenate([end[few], own, end[many]]) - start
            for i, j in spans(rows, start, size):
                half = np.bitwise_count(ha[i] ^ hb[j])
                some = np.flatnonzero(half <= distance)
                i, j = i[some], j[some]
                some = (half[some] + np.bitwise_count(la[i] ^ lb[j]) <= distance) & (ra[i] != rb[j])
                x, y = ra[i[some]], rb[j[some]]
                found.append(np.unique(np.minimum(x, y) * len(roots) + np.maximum(x, y)))
    found = np.unique(np.concatenate(found))
    return np.stack([roots[found // len(roots)], roots[found % len(roots)]], 1)


def root_pairs(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(a, b): the unlike roots of each two fingerprints (id, hi, lo, root) within distance.

    Rows are cut in blocks by a hash of their id, and each two blocks, or one with itself, are a task's work: a row is sent
    once for each block. There are as many blocks as keep one at block rows, or as give every core work.
    """
    n, tasks = fps.count(), int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = max(1, math.ceil(n / block), min(math.ceil(math.sqrt(2 * tasks)), math.ceil(n / LEAST_BLOCK)))
    least, most = F.least("part", "other"), F.greatest("part", "other")
    rows = fps.select("id", "hi", "lo", "root", F.pmod(F.xxhash64("id"), F.lit(q)).alias("part"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q - 1).cast("bigint"))))
    rows = rows.select((most * (most + 1) / 2 + least).cast("bigint").alias("task"), (F.col("part") > F.col("other")).alias("second"), (F.col("part") == F.col("other")).alias("alone"), "hi", "lo", "root")

    def run(batches):
        parts = (tuple(b.column(k).to_numpy(zero_copy_only=False) for k in range(6)) for b in batches if b.num_rows)
        for _, (task, second, alone, hi, lo, root) in by_bucket(parts, None):
            packed = np.stack([hi, lo], 1).view(np.uint64)
            start = np.flatnonzero(np.r_[True, task[1:] != task[:-1]])
            for s, e in zip(start, np.r_[start[1:], len(task)]):
                x = second[s:e]
                one, two = ((packed[s:e][y], root[s:e][y]) for y in ((x | ~x,) * 2 if alone[s] else (~x, x)))
                got = across(*one, *two, distance)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], ["a", "b"])

    # one task to a partition, as long as there aren't too many
    pairs = min(q * (q + 1) // 2, 1 << 14)
    return rows.repartitionById(pairs, F.pmod("task", F.lit(pairs)).cast("int")).sortWithinPartitions("task").mapInArrow(run, "a bigint, b bigint").distinct()


def near_edges(fps: DataFrame, distance: int = DISTANCE, tables: int | None = None, sampled: int | None = None, most: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(a, b) ids of distinct fingerprints (id, hi, lo); their components are those of all pairs within distance.

    Buckets of sampled bits connect most of what is near, a pair at a time where it's cheap. What they left apart is
    searched in full by root_pairs(), which passes over pairs that are connected.
    """
    roots = components(bucket_pairs(fps, distance, tables, sampled, most))
    grouped = fps.join(small(roots), fps["id"] == roots["node"], "left").select("id", "hi", "lo", F.coalesce("root", "id").alias("root"))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(root_pairs(cut(grouped), distance, block))


def groups(fps: DataFrame) -> DataFrame:
    """(doc_id, key, keep_id, keep_key) for each (doc_id, key) of fingerprints() in a group of two or more; one row per pair."""
    fps = fps.select("doc_id", "key", "hi", "lo").distinct()
    # ids are numbers of the rows as they are written: no two fingerprints share one, and they order components only
    reps = cut(fps.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "key")).alias("rep"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    roots = components(near_edges(reps))
    member = reps.join(small(roots), reps["id"] == roots["node"], "left").select("hi", "lo", "n", "rep", F.coalesce("root", "id").alias("root"))
    best = member.groupBy("root").agg(F.min("rep").alias("keep"), F.sum("n").alias("size")).where("size > 1")
    keep = cut(member.join(best, "root").select("hi", "lo", F.col("keep.doc_id").alias("keep_id"), F.col("keep.key").alias("keep_key")))
    return fps.join(small(keep), ["hi", "lo"]).select("doc_id", "key", "keep_id", "keep_key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): each document that goes because it is a near-duplicate, and the one of its group that stays.

    A document's fingerprint is 128 bits, SimHash over its distinct lower-case words. Documents within Hamming distance
    18, directly or over others, form a group, of which the least doc_id stays. Equal fingerprints are collapsed first,
    so exact copies cost no search. Distinct ones meet in buckets of sampled bits; within a bucket, precomputed distances
    to reference fingerprints discard most pairs (no pair within 18 can differ by more than 18 in any of them) and exact
    Hamming distances decide. Tables and sampled bits follow the number of fingerprints, see plan(). A crowded bucket is cut
    in blocks, each two of which are a task's work, so that no pair of it is left out and no task holds it all. Pairs that
    share no bucket are found by root_pairs(), so that the groups are those of all pairs within 18.

    Rows with a null doc_id, and with null, empty or wordless text, are in no group. Of texts that share a doc_id, each
    counts on its own; a row whose doc_id is also the kept one isn't listed. Other columns aren't looked at. An empty
    table gives no rows.
    """
    fps = cut(fingerprints(docs))
    return groups(fps).where("doc_id <> keep_id").select("doc_id", "keep_id").distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of near-duplicates; see near_duplicates().

    Rows that have no fingerprint there all stay. Of rows that repeat the kept document's id and text, one stays.
    """
    fps = cut(fingerprints(docs))
    g = cut(groups(fps))
    i, k = fresh(docs, "_id"), fresh(docs, "_k")
    out = docs.withColumn(k, text_key(F.col("text")))
    gone = g.where("doc_id <> keep_id OR key <> keep_key").select(F.col("doc_id").alias(i), F.col("key").alias(i + "k")).distinct()
    out = out.join(small(gone), (F.col("doc_id").cast("bigint") == F.col(i)) & (F.col(k) == F.col(i + "k")), "left_anti")
    twice = cut(fps.groupBy("doc_id", "key").count().where("count > 1").select(F.col("doc_id").alias(i), F.col("key").alias(i + "k")))
    if not twice.isEmpty():
        twice = small(twice)
        same = (F.col("doc_id").cast("bigint") == F.col(i)) & (F.col(k) == F.col(i + "k"))
        # of rows that repeat, the first that a task sees goes on: no task gets all of them
        again = out.join(twice, same, "left_semi").dropDuplicates(["doc_id", k])
        out = out.join(twice, same, "left_anti").union(again)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
