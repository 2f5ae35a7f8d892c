"""Best-fit packing by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .repair import BATCH_BYTES, VOCABULARY, Words, encoding

#: Tokens of a bin; documents of a shard; islands of a shard, packings of an island, most children of an epoch, epochs; children without a gain after which an island rests; seed.
CAPACITY, SHARD_ITEMS, ISLANDS, POPULATION, GENERATIONS, EPOCHS, PATIENCE, SEED = 2048, 1500, 2, 6, 60, 3, 20, 17
#: Documents of a bin, the largest first, whose pairs are tried in exchange for displaced ones.
SWAPPED = 10
#: Stands for a null id within arrays, which pandas would turn to floats.
NO_ID = -(2**63)
STATE = "shard bigint, island int, ids array<bigint>, pieces array<int>, starts array<bigint>, sizes array<int>, population array<array<int>>"
BINS = "bin string, used int, n_docs int, doc_ids array<bigint>, pieces array<int>, starts array<bigint>, lengths array<int>"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n) of each row with text: its doc_id, NO_ID for null, and how many token ids the text has. The texts pass Arrow once."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        words = Words(encoding(shared.value))
        for b in batches:
            texts = b.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(texts)]
            n = np.concatenate([words.counts(texts.slice(a, z - a)) for a, z in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])

    src = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    return src.mapInArrow(run, "id bigint, n bigint")


def best_fit(order, sizes, bins, capacity):
    """Put the items of order into bins (lists), each where least room is left; opens bins as needed."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - sizes[i], k))
    return bins


def fitness(bins, sizes, capacity):
    """Mean square fill, Falkenauer's measure: fewer and unevenly filled bins score higher."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def exchange(bins, loose, sizes, capacity):
    """Fill bins better with loose documents in exchange for smaller ones of theirs, one or two for one or two, as long as a bin gains; the loose left.

    A bin takes what fills it most, or one large document for two that fill as much: what comes loose is smaller and easier
    to place.
    """
    free = sorted((sizes[i], i) for i in loose)

    def best(least, most):
        """The loose documents, one or two, that weigh most, from least on and no more than most."""
        k = bisect_right(free, (most, len(sizes))) - 1
        one = (free[k][0], (k,)) if k >= 0 and free[k][0] >= least else None
        for j in range(bisect_right(free, (most, len(sizes))) - 1, -1, -1):
            if 2 * free[j][0] < (one[0] + 1 if one else least):
                break  # no smaller partner makes up for it
            k = min(j, bisect_right(free, (most - free[j][0], len(sizes)))) - 1
            if k >= 0 and free[j][0] + free[k][0] >= (one[0] + 1 if one else least):
                one = (free[j][0] + free[k][0], (k, j))
        return one

    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        while room and free:
            large = sorted(b, key=lambda i: (-sizes[i], i))[:SWAPPED]
            found = None
            for out in (*((i,) for i in large), *combinations(large, 2)):
                own = sum(sizes[i] for i in out)
                hit = best(own + 1, own + room)
                if hit and (found is None or hit[0] - own > found[0]):
                    found = (hit[0] - own, out, hit[1])
                if found and found[0] == room:
                    break
            if found is None:
                break
            gain, out, taken = found
            b[:] = [i for i in b if i not in out] + [free[k][1] for k in taken]
            for k in sorted(taken, reverse=True):
                free.pop(k)
            for i in out:
                insort(free, (sizes[i], i))
            room -= gain
    return [i for _, i in reversed(free)]


def crossover(a, b, sizes, capacity, rng):
    """Inject well-filled bins of b into a: a's bins that share a document with them go, what they displace is exchanged and best-fitted again."""
    ranked = sorted(b, key=lambda x: (-sum(sizes[i] for i in x), x))
    best = ranked[: max(1, len(ranked) // 2)]
    chosen = [x for x in best if rng.random() < 0.5] or best[:1]
    injected = {i for x in chosen for i in x}
    kept, loose = [], []
    for x in a:
        if injected.isdisjoint(x):
            kept.append(x[:])
        else:
            loose += [i for i in x if i not in injected]
    bins = [x[:] for x in chosen] + kept
    return best_fit(exchange(bins, loose, sizes, capacity), sizes, bins, capacity)


def mutate(bins, sizes, capacity, rng):
    """Empty a few bins, badly filled ones rather, and exchange and best-fit their documents again."""
    ranked = sorted(bins, key=lambda x: (sum(sizes[i] for i in x), x))
    n = min(len(ranked), 2 + rng.randrange(3))
    gone = {min(rng.randrange(len(ranked)), rng.randrange(len(ranked))) for _ in range(n)} | {0}
    loose = [i for k in sorted(gone) for i in ranked[k]]
    rng.shuffle(loose)
    kept = [x[:] for k, x in enumerate(ranked) if k not in gone]
    rng.shuffle(kept)
    left = exchange(kept, loose, sizes, capacity)
    return best_fit(left, sizes, kept, capacity)


def as_vector(bins, n):
    v = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            v[i] = k
    return v


def as_bins(vector):
    bins = {}
    for i, k in enumerate(vector):
        bins.setdefault(int(k), []).append(i)
    return [bins[k] for k in sorted(bins)]


def evolve(population, sizes, capacity, generations, rng, size=POPULATION, patience=PATIENCE):
    """Steady-state evolution; the best of population never gets lost. population: lists of bins, may be empty.

    It ends after so many generations, after patience of them without a better best, or where no packing has fewer bins:
    as many as the documents' tokens fill.
    """
    pop = list(population)
    n = len(sizes)
    bound = -(-sum(sizes) // capacity)
    if not pop:
        order = sorted(range(n), key=lambda i: (-sizes[i], i))
        pop.append(best_fit(order, sizes, [], capacity))
        while len(pop) < size and len(pop[0]) > bound:
            noisy = sorted(range(n), key=lambda i: (-sizes[i] * (1 + 0.2 * rng.random()), i))
            pop.append(best_fit(noisy, sizes, [], capacity))
    scored = sorted(((len(b), -fitness(b, sizes, capacity), k, b) for k, b in enumerate(pop)), key=lambda x: x[:3])
    idle = 0
    for g in range(generations if n > 1 else 0):
        if scored[0][0] <= bound or idle >= patience:
            break
        first, second = (min(rng.sample(range(len(scored)), 2)) for _ in range(2)) if len(scored) > 1 else (0, 0)
        child = crossover(scored[first][3], scored[second][3], sizes, capacity, rng) if first != second else scored[first][3]
        if first == second or rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        top = scored[0][:2]
        scored.append((len(child), -fitness(child, sizes, capacity), len(pop) + g, child))
        scored = sorted(scored, key=lambda x: x[:3])[:size]
        idle = 0 if scored[0][:2] < top else idle + 1
    return [x[3] for x in scored[:size]]


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS, islands: int = ISLANDS, generations: int = GENERATIONS, epochs: int = EPOCHS, seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pack documents into bins of at most capacity tokens; one row per bin with its documents.

    Tokens are ids of the byte-level BPE vocabulary at the path given. Items are spread by hash over shards of about
    shard_items. Each shard is evolved by several islands, which between epochs send their best packing to the next island
    (a small shuffle); the best island's packing wins. An island rests where no packing can have fewer bins. Only ids and
    lengths move, never texts. A document longer than capacity is cut into full pieces, each a bin of its own, and a
    remainder that is packed; starts count tokens.

    Null and empty texts have no tokens and go in no bin. A null doc_id is packed and listed as null. Repeated rows are
    packed as often as they come. Equal sizes are ordered by id and piece. An empty table gives no bins. Columns other than
    doc_id and text are not looked at.
    """
    items = cut(token_counts(docs, vocabulary))
    full = items.where(F.col("n") >= capacity).select("id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / capacity) - 1).cast("int"))).alias("piece"))
    known = F.when(F.col("id") != NO_ID, F.col("id"))
    whole = full.select(
        F.concat_ws("-", F.lit("full"), F.coalesce(known.cast("string"), F.lit("null")), "piece").alias("bin"), F.lit(capacity).cast("int").alias("used"), F.lit(1).alias("n_docs"),
        F.array(known).alias("doc_ids"), F.array("piece").alias("pieces"), F.array((F.col("piece") * F.lit(capacity)).cast("bigint")).alias("starts"), F.array(F.lit(capacity).cast("int")).alias("lengths"),
    )
    rest = items.select("id", F.floor(F.col("n") / capacity).cast("int").alias("piece"), (F.col("n") % capacity).cast("int").alias("size")).where("size > 0")
    shards = max(1, -(-items.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "size", F.lit(seed)), F.lit(shards)))
    packed = F.sort_array(F.collect_list(F.struct("size", "id", "piece")), asc=False)
    state = rest.groupBy("shard").agg(packed.alias("x")).select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("x.id").alias("ids"), F.col("x.piece").alias("pieces"),
        F.transform("x.piece", lambda p: (p * F.lit(capacity)).cast("bigint")).alias("starts"), F.col("x.size").alias("sizes"), F.array().cast("array<array<int>>").alias("population"),
    )
    for epoch in range(epochs):

        def step(frames, epoch=epoch):
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    sizes = [int(x) for x in row.sizes]
                    rng = random.Random(seed * 1_000_003 + int(row.shard) * 1009 + int(row.island) * 31 + epoch)
                    start = [as_bins(v) for v in row.population]
                    out.append([as_vector(b, len(sizes)) for b in evolve(start, sizes, capacity, generations, rng)])
                yield frame.assign(population=out)

        # a fixed number of partitions: by its few bytes all of this would be coalesced to a task or two, and it is work for many
        spread = state.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "island")
        state = spread.mapInPandas(step, STATE)
        if epoch < epochs - 1 and islands > 1:
            # the elite replaces the worst of the next island
            state = cut(state)
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("population")[0].alias("elite"))
            state = state.join(elite, ["shard", "island"]).withColumn("population", F.concat(F.slice("population", 1, POPULATION - 1), F.array("elite"))).drop("elite")

    def bins(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                for k, b in enumerate(as_bins(row.best)):
                    rows.append((f"{row.shard}-{k}", int(sum(row.sizes[i] for i in b)), len(b), [None if row.ids[i] == NO_ID else int(row.ids[i]) for i in b], [int(row.pieces[i]) for i in b], [int(row.starts[i]) for i in b], [int(row.sizes[i]) for i in b]))
            yield pd.DataFrame(rows, columns=["bin", "used", "n_docs", "doc_ids", "pieces", "starts", "lengths"])

    # fewest bins first, then the lower island
    best = state.select("shard", "island", "ids", "pieces", "starts", "sizes", F.col("population")[0].alias("best"), F.array_max(F.col("population")[0]).alias("last"))
    top = best.groupBy("shard").agg(F.min_by(F.struct("ids", "pieces", "starts", "sizes", "best"), F.struct("last", "island")).alias("w")).select("shard", "w.*")
    return whole.unionByName(top.mapInPandas(bins, BINS))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
