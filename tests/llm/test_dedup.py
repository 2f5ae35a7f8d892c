from collections import Counter

import numpy as np
import pytest

from glyphtally.llm import embeddings, simhash
from glyphtally.llm.common import blocks, by_bucket, components

from . import messy


def groups(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 32), (32, 31), (40, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30, 40: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def hamming(x, y):
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(-1)


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = simhash.fingerprints(docs).collect()
    x = np.array([(r.hi, r.lo) for r in fps], np.int64)
    order = np.argsort([r.doc_id for r in fps])
    x, ids = x[order], np.array([fps[i].doc_id for i in order])
    pairs = [(i, j) for i in range(len(x)) for j in (i + 1 + np.flatnonzero(hamming(x[i + 1 :], x[i]) <= simhash.DISTANCE)).tolist()]
    want = {(int(ids[i]), int(ids[r])) for i, r in enumerate(groups(pairs, len(x))) if r != i}
    got = {(r.doc_id, r.keep_id) for r in simhash.near_duplicates(docs).collect()}
    assert len(want) > 20 and len({a for a, _ in got} & {a for a, _ in want}) >= 0.95 * len(want)
    assert {a for a, _ in got} <= {a for a, _ in want}
    # given the buckets, groups are exactly what pairs that share one connect, and the least id of each stays
    tables, sampled = simhash.plan(len({tuple(v) for v in x.tolist()}))
    rng = np.random.default_rng(simhash.SEED + 2)
    picks = [np.sort(rng.choice(simhash.BITS, sampled, replace=False)) for _ in range(tables)]
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    shared = [(i, j) for i, j in pairs if any((bits[i, p] == bits[j, p]).all() for p in picks)]
    assert got == {(int(ids[i]), int(ids[r])) for i, r in enumerate(groups(shared, len(x))) if r != i}


def test_simhash_plan():
    for n in (10, 250_000, 10**10):
        tables, sampled = simhash.plan(n)
        one = np.prod([(simhash.BITS - simhash.DISTANCE - k) / (simhash.BITS - k) for k in range(sampled)])
        assert 1 - (1 - one) ** tables >= simhash.RECALL and n <= 2**sampled * 1.01


def near_copies(n, clusters, seed):
    """Distinct fingerprints (id, hi, lo): n around so many centres, up to nine bits off."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (clusters, 128)).astype(np.uint8)[rng.integers(0, clusters, n)]
    for row in base:
        row[rng.choice(128, rng.integers(0, 10), replace=False)] ^= 1
    x = np.unique(np.packbits(base, axis=1).view(np.int64), axis=0)
    return [(i, int(a), int(b)) for i, (a, b) in enumerate(x)]


def test_simhash_crowded_bucket(spark):
    """A bucket with a third of all rows is cut in blocks: the same components, and no task holds the bucket."""
    rows = near_copies(900, 2, 5) + [(i + 10**6, a, b) for i, a, b in near_copies(200, 200, 6)]
    fps = spark.createDataFrame(rows, "id long, hi long, lo long").checkpoint()
    got = {r.node: r.root for r in components(simhash.near_edges(fps, most=40)).collect()}
    want = {r.node: r.root for r in components(simhash.near_edges(fps)).collect()}
    assert got == want and max(Counter(want.values()).values()) > 300
    crowded = spark.createDataFrame([(7, i) for i in range(100)] + [(8, 1), (8, 2)], "bucket long, id long")
    tasks = {}
    for r in blocks(crowded, 10).collect():
        tasks.setdefault(r.task, set()).add(r.id)
    assert max(map(len, tasks.values())) <= 50 and all(any({i, j} <= t for t in tasks.values()) for i in range(100) for j in range(i))


@pytest.mark.parametrize("most", [None, 3, 100])
def test_by_bucket(most):
    rng = np.random.default_rng(4)
    bucket = np.sort(rng.integers(0, 30, 200))
    cuts = np.sort(rng.integers(0, 200, 40))
    parts = [(b, b * 10) for b in np.split(bucket, cuts) if len(b)]
    got = list(by_bucket(iter(parts), most))
    whole = [np.concatenate([c[k] for crowded, c in got if not crowded] or [np.zeros(0)]) for k in (0, 1)]
    sizes = Counter(bucket.tolist())
    assert whole[0].tolist() == [b for b in bucket if most is None or sizes[b] <= most] and (whole[0] * 10 == whole[1]).all()
    assert sum(len(c[0]) for crowded, c in got if crowded) == len(bucket) - len(whole[0])
    for crowded, c in got:  # no bucket is torn
        assert crowded or all(sizes[b] == n for b, n in Counter(c[0].tolist()).items())


def test_pivots_discard_no_near_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, (300, 128)).astype(np.uint8)
    b = a.copy()
    for row in b:
        row[rng.choice(128, simhash.DISTANCE, replace=False)] ^= 1
    d = np.abs(simhash.distance_table(a, simhash.pivots()) - simhash.distance_table(b, simhash.pivots()))
    assert d.max() <= simhash.DISTANCE
    far = np.abs(simhash.distance_table(a[1:], simhash.pivots()) - simhash.distance_table(a[:-1], simhash.pivots())).max(1)
    assert (far > simhash.DISTANCE).mean() > 0.5


def test_simhash_messy(spark):
    d = messy.table(spark)
    out = simhash.drop_near_duplicates(d)
    assert out.columns == d.columns
    c = Counter(r.doc_id for r in out.collect())
    assert c[1] == 1 and c[2] == 0 and c[None] == 2 and c[3] == c[4] == c[5] == c[6] == c[7] == 1
    assert simhash.drop_near_duplicates(messy.empty(spark)).count() == 0 and simhash.near_duplicates(messy.empty(spark)).count() == 0


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], [float(y) for y in v] if v is not None else None, 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, bucket int")


def test_embeddings_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 64))
    x = np.concatenate([base, base[:200] + rng.standard_normal((200, 64)) * 0.28, base[:5].repeat(40, 0) + rng.standard_normal((200, 64)) * 0.1])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u.astype(np.float32).astype(float)
    s = s / np.linalg.norm(s, axis=1, keepdims=True)
    near = s @ s.T >= embeddings.COSINE
    pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    want = {i: r for i, r in enumerate(groups(pairs, len(x))) if r != i}
    got = {r.vec_id: r.keep_id for r in embeddings.near_duplicates(vectors(spark, u)).collect()}
    assert len(want) > 250 and len(set(got) & set(want)) >= 0.95 * len(want) and set(got) <= set(want)
    # given the buckets, groups are exactly what pairs that share one connect, and the least id of each stays
    h = embeddings.Hashes(*embeddings.plan(len(x)), embeddings.WIDTH, embeddings.SEED).buckets(embeddings.unit(u.astype(np.float32)))
    shared = [(i, j) for i, j in pairs if (h[i] == h[j]).any()]
    assert got == {i: r for i, r in enumerate(groups(shared, len(x))) if r != i}


def test_embeddings_crowded_bucket_and_lengths(spark):
    """A third of all vectors in one cluster, cut in blocks, and vectors of two lengths, give what one block gives."""
    rng = np.random.default_rng(9)
    x = [*(rng.standard_normal(16) * 0.05 + np.ones(16) for _ in range(150)), *rng.standard_normal((200, 16)), *(rng.standard_normal(8) * 0.05 + np.ones(8) for _ in range(60))]
    d = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "node long, x array<float>").checkpoint()
    more = (len(x), lambda nodes: d.join(nodes, "node"), embeddings.COSINE, embeddings.WIDTH, embeddings.RECALL, embeddings.SEED)
    got, want = ({r.node: r.root for r in components(embeddings.near_edges(d, *more, most=most)).collect()} for most in (20, 1000))
    assert got == want and Counter(want.values()) == {0: 150, 350: 60}


def test_embeddings_plan():
    k, tables = embeddings.plan(10**6)
    near = embeddings.same_cell(np.sqrt(2 - 2 * embeddings.COSINE), embeddings.WIDTH)
    assert 1 - (1 - near**k) ** tables >= embeddings.RECALL
    # the chance of the formula is what the hashes do
    rng = np.random.default_rng(3)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    h = embeddings.Hashes(1, 8, 2.0, 1)
    same = (h.buckets(a) == h.buckets(b)).mean()
    assert abs(same - near) < 0.02
    # sketches of near-duplicates are near, those of vectors at right angles mostly aren't
    apart = lambda x, y: np.bitwise_count((h.sketches(x) ^ h.sketches(y)).view(np.uint32))
    assert (apart(a, b) <= embeddings.APART).mean() > 0.999 and (apart(a, np.roll(a, 1, 0)) <= embeddings.APART).mean() < 0.1


def test_embeddings_messy(spark):
    v = [1.0] + [0.0] * 7
    x = [v, v, v, None, [], [0.0] * 8, [float("nan")] + [0.0] * 7, [1.0, 0.0], [2.0, 0.0], [0.0, 1.0] + [0.0] * 6]
    got = {(r.vec_id, r.keep_id) for r in embeddings.near_duplicates(vectors(spark, x, [5, 5, 9, 1, 2, 3, 4, 6, 7, None])).collect()}
    assert got == {(9, 5), (7, 6)}
    wide = [[1e-200] * 300, [2e-200] * 300, [None, 1.0], [1.0, None], [float("inf"), 1.0], [1e200, 1e200], [1.0, 1.0]]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(wide)] + [(None, [1.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.keep_id) for r in embeddings.near_duplicates(d).collect()} == {(1, 0), (6, 5)}
    assert embeddings.near_duplicates(vectors(spark, [v]).limit(0)).count() == 0


def test_very_long_row_of_hashes():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300_000)
    one = simhash.fingerprints_of(h, np.array([0, len(h)]))
    bits = np.unpackbits(np.stack([simhash.mix(h.view(np.uint64), 1), simhash.mix(h.view(np.uint64), 2)], 1).view(np.uint8), axis=1)
    assert (np.unpackbits(one, axis=1)[0] == (2 * bits.sum(0, dtype=int) >= len(h))).all()
