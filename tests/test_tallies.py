import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glyphtally.functions.hashing import cells, city64, city64_texts
from glyphtally.operators import ngrams, sketches, tallies
from glyphtally.plans import queries

WORDS = ["a", "bb", "é", "zz", "abc", "日本", "q", *[f"w{i}" for i in range(30)]]


def texts(n=60):
    rng = random.Random(1)
    return [[rng.choice(WORDS) for _ in range(rng.randint(0, 40))] for _ in range(n)]


def part(docs, window=3):
    p = tallies.Part(3, window)
    for i in range(0, len(docs), 20):
        p.add(pa.array([tallies.SEP.join(d) if d else None for d in docs[i : i + 20]], pa.string()))
    return p


@pytest.mark.parametrize("pairs, chunk", [(1 << 23, 1 << 20), (50, 7)])
def test_part_counts_in_passes(monkeypatch, pairs, chunk):
    monkeypatch.setattr(tallies, "PASS_PAIRS", pairs)
    monkeypatch.setattr(tallies, "CHUNK", chunk)
    docs, p = texts(), part(texts())
    assert p.close()
    assert dict(zip(p.words.to_pylist(), p.freq.tolist())) == Counter(x for d in docs for x in d)
    got = [(k, n) for home, other, f in p.pairs() for k, n in zip(p.text(home, other).to_pylist(), f.tolist())]
    assert len(dict(got)) == len(got)
    assert dict(got) == Counter(" ".join(sorted((d[i], d[i + k]))) for d in docs for k in (1, 2) for i in range(len(d) - k))
    assert not part([[], []]).close()


def test_md5_halves():
    rng = random.Random(2)
    keys = ["é" * rng.randint(0, 3) + "x" * rng.randint(0, 70) for _ in range(20_000)]
    want = [hashlib.md5(k.encode()).digest() for k in keys]
    one, two = tallies.md5_halves(pa.array(keys).slice(5))
    assert one.tolist() == [int.from_bytes(h[:4], "big") for h in want[5:]] and two.tolist() == [int.from_bytes(h[4:8], "big") for h in want[5:]]


def test_tallies_equal_dataframes(spark):
    d = spark.createDataFrame([(i % 3 + 1, i, t) for i, t in enumerate(texts())], "part int, doc_id long, tokens array<string>")
    counts = ngrams.count(ngrams.keys(d))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tallies.counts(d)) == rows(counts)
    assert rows(tallies.whole(d, 5)) == rows(ngrams.merge(counts))
    size = {"width": 64, "depth": 3, "strategy": "md5"}
    want = sketches.linear_estimate(counts, sketches.linear_cells(counts, **size), **size)
    assert rows(tallies.linear(d, **size).select("part", "kind", "key", "freq", "est")) == rows(want.select("part", "kind", "key", "freq", "est"))
    assert tallies.counts(d.limit(0)).count() == 0 and tallies.whole(d.limit(0), 5).count() == 0


@pytest.mark.parametrize("name", ["cms_linear_estimate", "cms_linear_mre", "mre_by_freq", "mre_over_under", "ppmi_recall_spearman", "ppmi_recall_exact_words_all", "pair_counts", "sketch_mre_cmts_cu", "log_over_under", "ppmi_sketches"])
def test_keys_are_neither_joined_nor_shuffled(spark, sf, name):
    """Pairs and their estimates stay in the task that made them; what is shuffled after it are sums or rankings."""
    plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_city64_texts():
    rng = random.Random(3)
    keys = ["".join(rng.choice("abc é'\\\"xyz\n日") for _ in range(rng.randint(0, 90))) for _ in range(2000)] + ["w" * i for i in range(150)]
    assert (city64_texts(pa.array(keys).slice(7)) == city64(keys[7:])).all() and len(city64_texts(pa.array([], pa.string()))) == 0


def naive_log(rows, at, chance, rng):
    """One draw for each insertion, each looked at."""
    for col, u in zip(zip(*at.tolist()), rng.random(at.shape[1]).tolist()):
        m = min(r[i] for r, i in zip(rows, col))
        if m < 255 and u < chance[m]:
            for r, i in zip(rows, col):
                if r[i] == m:
                    r[i] = m + 1


@pytest.mark.parametrize("width", [2, 40])
def test_fast_insertion_equals_one_by_one(monkeypatch, width):
    rng = np.random.default_rng(5)
    keys, hashes = rng.zipf(1.3, 60_000) % 500, rng.integers(0, 2**63, 500).astype(np.uint64)
    slow, fast = sketches.CML8S(width, 3), sketches.CML8S(width, 3)
    at = cells(hashes, fast.widths())[:, keys]
    naive_log(slow.rows, at, slow.chance, np.random.default_rng(42))
    fast.insert(at)
    assert fast.rows == slow.rows
    fast, slow = sketches.CMTS(width, 3, 8), sketches.CMTS(width, 3, 8)
    at = cells(hashes, fast.widths())[:, keys]
    fast.insert(at)
    monkeypatch.setattr(sketches, "HELD_LEAVES", 0)
    slow.insert(at)
    assert fast.to_bytes() == slow.to_bytes()
    assert fast.read(at[:, :99]).tolist() == [min(fast.get(r, i) for r, i in enumerate(col)) for col in at[:, :99].T.tolist()]


def test_sketched_equals_build_and_estimate(spark):
    d = spark.createDataFrame([(i % 3 + 1, i, t) for i, t in enumerate(texts())], "part int, doc_id long, tokens array<string>")
    specs = {n: sketches.params_for(n, 512) for n in sketches.KINDS}
    cols = ["structure", "part", "kind", "key", "freq", "est"]
    rows = lambda df: sorted(map(tuple, df.select(cols).collect()))
    assert rows(tallies.sketched(d, specs)) == rows(sketches.estimate(ngrams.count(ngrams.keys(d)), sketches.build_docs(d, specs)))
