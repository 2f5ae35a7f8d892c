import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphtally.config import Config
from glyphtally.operators import accuracy, ngrams, ppmi, zipf
from glyphtally.sources import corpus


def docs(spark, *texts):
    return spark.createDataFrame([(i, 1, t.split()) for i, t in enumerate(texts)], "doc_id long, part int, tokens array<string>")


@pytest.mark.parametrize("text, want", [("a b c d", ["a b", "a c", "b c", "b d", "c d"]), ("b a", ["a b"]), ("a a", ["a a"]), ("a", []), ("", [])])
def test_pairs(spark, text, want):
    got = docs(spark, text).select(ngrams.pairs(F.col("tokens"), 3)).first()[0]
    assert sorted(got) == want
    s = [r.key for r in ngrams.stream(docs(spark, text), 3).where("kind = 'pair'").collect()]
    assert sorted(s) == want


def test_stream_order(spark):
    rows = ngrams.stream(docs(spark, "c b a"), 3).orderBy("doc", "pos", "offset").collect()
    assert [r.key for r in rows] == ["c", "b c", "a c", "b", "a b", "a"]


@pytest.mark.parametrize("n, sizes", [(23, [2] * 9 + [5]), (7, [0] * 9 + [7]), (20, [2] * 10), (0, [0] * 10)])
def test_parts(spark, n, sizes):
    d = spark.createDataFrame([(i * 3, "x") for i in range(n)], "doc_id long, text string").repartition(3)
    c = Counter(r.part for r in corpus.contiguous_parts(d).collect())
    assert [c[i + 1] for i in range(10)] == sizes


def test_seeded_order(spark):
    d = spark.createDataFrame([(i * 7, "x") for i in range(101)], "doc_id long, text string").repartition(5)
    want = list(range(101))
    random.seed(42)
    random.shuffle(want)
    got = {r.position: r.doc_id for r in corpus.seeded_order(d).collect()}
    assert [got[k] // 7 for k in range(101)] == want
    assert corpus.seeded_order(d.limit(0)).count() == 0
    assert sorted(r.doc_id for r in corpus.shuffled(d).collect()) == [i * 7 for i in range(101)]


def test_spread_and_sizes(spark, sf):
    d = corpus.spread(spark.read.parquet(f"{sf}/documents.parquet"))
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and d.count() == 200
    many = d.repartition(50)
    assert corpus.spread(many) is many
    assert Config().parts_of(corpus.size_of(spark, f"{sf}/documents.parquet")) == 10 and Config().parts_of(100 << 40) == 409_600


def test_top_k_in_slices(spark):
    rng = random.Random(3)
    rows = [(p, f"k{i}", rng.randint(0, 50) / 10) for p in (1, 2) for i in range(3000)]
    d = spark.createDataFrame(rows, "part int, key string, ppmi double")
    got = {(r.part, r.rank): r.key for r in ppmi.top_k(d, ppmi.RANK_PUSHED + 500).collect()}
    for p in (1, 2):
        want = sorted((r for r in rows if r[0] == p), key=lambda r: (-r[2], r[1]))[: ppmi.RANK_PUSHED + 500]
        assert [got[p, k + 1] for k in range(len(want))] == [r[1] for r in want]


def test_rankings_read_back(spark, tmp_path):
    r = spark.createDataFrame([(1, "s", 10, 0.5, 0.25)], "part int, structure string, k int, recall double, spearman double")
    corpus.write_rankings(r, ppmi.compare_mean(r), str(tmp_path), 5)
    assert (tmp_path / "ranking_ppmi_by_part_minfreq_5.csv").exists() and (tmp_path / "ranking_ppmi_mean_minfreq_5.csv").exists()
    assert corpus.read_rankings(spark, str(tmp_path), 5).collect() == r.collect()
    with pytest.raises(Exception, match="ranking_ppmi_by_part.csv"):
        corpus.read_rankings(spark, str(tmp_path)).collect()


def test_round_trips(spark, tmp_path):
    d = spark.createDataFrame([(1, " a\nb "), (2, "c\rd"), (2, " "), (1, None)], "part int, text string")
    corpus.write_parts(d, f"{tmp_path}/p")
    assert sorted((r.part, r.text) for r in corpus.read_parts(spark, f"{tmp_path}/p").collect()) == [(1, "a b"), (2, "c d")]
    t = spark.createDataFrame([(1, ["a", "3;4"]), (2, [])], "part int, tokens array<string>")
    corpus.write_tokens(t, f"{tmp_path}/t")
    assert [r.tokens for r in corpus.read_tokens(spark, f"{tmp_path}/t").collect()] == [["a", "3", "4"]]
    c = ngrams.count(ngrams.keys(docs(spark, "a b a")))
    corpus.write_counts(c, f"{tmp_path}/c")
    corpus.write_counts(c.limit(0), f"{tmp_path}/c", "keep")
    assert sorted(map(tuple, corpus.read_counts(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, c.collect()))
    with pytest.raises(ValueError):
        corpus.write_counts(c, f"{tmp_path}/c", "ask")
    corpus.write_report(c.groupBy("kind").count(), f"{tmp_path}/r")
    assert corpus.read_report(spark, f"{tmp_path}/r").count() == 2


def test_config():
    assert Config.from_env({"SEED": "7"}) == Config(7, 3, 10)


def test_stats(spark):
    d = docs(spark, "a b a", "c")
    r = ngrams.stats_by_part(d, ngrams.count(ngrams.keys(d))).first()
    assert (r.docs, r.words, r.pairs, r.distinct_words, r.distinct_pairs, r.tokens_mean) == (2, 4, 3, 3, 2, 2.0)
    assert r.tokens_std == pytest.approx(math.sqrt(2)) and r.chars_mean == 3.0
    assert ngrams.stats_by_part(docs(spark, "a"), ngrams.count(ngrams.keys(docs(spark, "a")))).first() is not None


def test_zipf(spark):
    c = spark.createDataFrame([(1, "word", k, f) for k, f in zip("abcd", (5, 2, 2, 1))], "part int, kind string, key string, freq long")
    assert [(r.rank, r.freq) for r in zipf.rank_frequency(c).orderBy("rank").collect()] == [(1, 5), (2, 2), (3, 2), (4, 1)]
    assert {r.freq: r.p for r in zipf.ccdf(c).collect()} == {5: 0.25, 2: 0.75, 1: 1.0}
    blocks = c.withColumn("freq", F.lit(7).cast("long"))
    assert sorted((r.rank, r.freq) for r in zipf.rank_frequency(blocks, block=3).collect()) == [(k, 7) for k in (1, 2, 3, 4)]
    ranks = lambda n, most: spark.range(1).select(zipf.log_ranks(F.lit(n).cast("long"), F.lit(most))).first()[0]
    assert ranks(5, 10) == [1, 2, 3, 4, 5] and ranks(1000, 10)[:2] == [1, 2] and ranks(1000, 10)[-1] == 1000 and len(ranks(10**6, 50)) <= 51
    many = np.unique(np.insert(np.logspace(0, np.log10(10**6 - 1), 500, dtype=int), 0, 0)) + 1
    assert set(many.tolist()) - set(ranks(10**6, 500)) <= {10**6 - 1, 10**6}  # the last point may fall short of its number there
    got = zipf.sample(zipf.rank_frequency(blocks), 2).collect()
    assert sorted(r.rank for r in got) == [1, 2, 4]
    assert [r.key for r in ngrams.top(c.select("key", "freq"), 2).orderBy("rank").collect()] == ["a", "b"]


def test_ppmi(spark):
    c = spark.createDataFrame([(1, "word", "a", 2), (1, "word", "b", 4), (1, "word", "z", 10), (1, "pair", "a b", 2), (1, "pair", "a z", 1), (1, "pair", "a q", 1), (1, "pair", "x", 1)], "part int, kind string, key string, freq long")
    assert [(r.key, r.ppmi) for r in ppmi.exact(c).collect()] == [("a b", 2.0)]


def test_compare(spark):
    t = spark.createDataFrame([(1, k, v) for k, v in (("a", 3.0), ("b", 2.0), ("c", 1.0))], "part int, key string, ppmi double")
    e = spark.createDataFrame([(1, "s", k, v) for k, v in (("a", 3.0), ("c", 2.5), ("d", 1.0))], "part int, structure string, key string, ppmi double")
    r = {x.k: (x.recall, x.spearman) for x in ppmi.compare(t, e, (2, 5)).collect()}
    assert r[2][0] == 0.5 and r[5][0] == pytest.approx(2 / 3)
    # truth a3 b2 c1 d0 against a3 b0 c2.5 d1: ranks 4 3 2 1 against 4 1 3 2
    assert r[5][1] == pytest.approx(1 - 6 * (0 + 4 + 1 + 1) / (4 * 15))
    same = ppmi.compare(t, t.selectExpr("part", "'s' AS structure", "key", "1.0D AS ppmi"), (2,)).first()
    assert same.spearman == 0.0


def test_errors(spark):
    e = spark.createDataFrame([(1, "CML8S-CU", "word", "a", 2, 3.0), (1, "CML8S-CU", "pair", "a b", 4, 2.0), (1, "CML8S-CU", "word", "c", 0, 9.0), (2, "CML8S-CU", "word", "a", 2, 2.0)], "part int, structure string, kind string, key string, freq long, est double")
    m = {r.part: r for r in accuracy.mre(e).collect()}
    assert (m[1].mre_words, m[1].mre_pairs, m[1].mre_total, m[1].n_words) == (0.5, 0.5, 0.5, 1) and m[2].mre_pairs == 0.0
    assert accuracy.mre_total(accuracy.mre(e)).first().mre_total == 0.25
    assert {r.freq: r.mre for r in accuracy.mre_by_freq(e).collect()} == {2: 0.25, 4: 0.5}
    assert sorted((r.freq, r.over, r.under) for r in accuracy.over_under(e).collect()) == [(2, 0.5, 0.0), (4, 0.0, 0.5)]
