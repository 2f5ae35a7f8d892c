"""What the operators once left out."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from glyphtally.llm import pii, secrets, simhash, templates
from glyphtally.llm.common import components

LINE = "All rights of this fine site are reserved by us."
WORDS = "own words of this document alone and of no other one".split()


def own(i, k):
    return " ".join(f"{'abcdefghij'[i]}{w}{'qrstuv'[k]}" for w in WORDS)


def test_boilerplate_goes_in_short_documents_and_one_copy_stays(spark):
    long = [(i, f"{own(i, 0)}\n{LINE}\n{own(i, 1)}") for i in range(5)]
    copy = "\n".join(own(9, k) for k in range(3))
    # 7 recurs by more than half, but nobody else has its text; of the copies with changes the first keeps the text, and one that has nothing else goes
    d = spark.createDataFrame([*long, (7, f"{LINE}\nonly here"), (20, copy), (None, copy + "\n" + LINE), (21, copy + "\n\n"), (22, copy + "\nmore words")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in templates.drop_recurring_lines(d).collect()}
    assert out == {i: f"{own(i, 0)}\n{own(i, 1)}" for i in range(5)} | {7: "only here", None: copy, 22: "more words"}


@pytest.mark.parametrize(
    "text, want",
    [("Customer ID: 48291034", "48291034"), ("member Id 48291034", "48291034"), ("Tax ID: 12-3456789", "12-3456789"), ("Account number is currently: 12345678", "12345678"), ("account (checking): 12345678", "12345678"), ("account 1234 5678 9012 and", "1234 5678 9012"), ("İ Cuenta número: 12345678 2024", "12345678")],
)
def test_accounts_however_written(text, want):
    assert [(k, text[i:j]) for k, i, j in pii.scan(text)] == [("account", want)]
    assert not pii.scan("account 12 34") and not pii.scan("accounted 12345678")


def test_secrets_of_letters_alone():
    w, tr = secrets.model()
    secret = ['password: "SunshineBeach"', 'api_key = "HkqTzLwPvXoB"', 'db_password="SunshineBeach"']
    prose = ["password: required", "the password is required here", 'the "responsibility" of it']
    got = secrets.tag(pa.array(secret + prose), w, tr)
    assert [(r, v) for r, _, _, v in got] == [(0, "SunshineBeach"), (1, "HkqTzLwPvXoB"), (2, "SunshineBeach")]


def test_variety_counts_the_whole_value():
    # 3.3 bits: half of it is one letter, the other half 25 letters alike
    assert secrets.categories("a" * 5000 + "bcdefghijklmnopqrstuvwxyz" * 200)[2] == 3


def test_simhash_pairs_that_share_no_bucket(spark):
    """Every pair at the largest distance, and none beyond it, whatever buckets it shares; blocks and crowded cells don't matter."""
    rng = np.random.default_rng(11)
    one = rng.integers(0, 2, (400, 128)).astype(np.uint8)
    two = one.copy()
    for k, row in enumerate(two):
        row[rng.choice(128, simhash.DISTANCE + k % 2, replace=False)] ^= 1
    x = np.packbits(np.concatenate([one, two]), axis=1).view(np.int64)
    fps = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(x)], "id long, hi long, lo long").checkpoint()
    want = {i: i % 400 for i in range(800) if i % 2 == 0}
    assert len(components(simhash.bucket_pairs(fps)).collect()) < len(want)
    for block in (100, simhash.BLOCK):
        assert {r.node: r.root for r in components(simhash.near_edges(fps, block=block)).collect()} == want


def test_simhash_search_equals_brute_force(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 100)
    monkeypatch.setattr(simhash, "CELL", 3)
    rng = np.random.default_rng(12)
    base = rng.integers(0, 2, (20, 128)).astype(np.uint8)[rng.integers(0, 20, 300)]
    for row in base:
        row[rng.choice(128, rng.integers(0, 16), replace=False)] ^= 1
    x, root = np.packbits(base, axis=1).view(np.uint64), rng.integers(0, 60, 300)
    far = np.bitwise_count(x[:, None] ^ x[None]).sum(2)
    for distance in (0, 5, 18):
        want = {(min(root[i], root[j]), max(root[i], root[j])) for i in range(150) for j in range(150, 300) if far[i, j] <= distance and root[i] != root[j]}
        for n in (6, 9, 16):
            assert set(map(tuple, simhash.across(x[:150], root[:150], x[150:], root[150:], distance, n).tolist())) == want


def many_alike(n):
    """n documents, each with a line of its own and one of a leaf; all those of the leaf differ in their fourth token alone."""
    word = lambda i: "".join("abcdefghij"[i // 10**k % 10] for k in range(4))
    return [(i, f"{word(i)} has words of its own that nobody else has, {word(i)}\nit was the {word(i)} that came here to see us all today") for i in range(n)]


def test_line_dedup_is_the_same_in_a_large_leaf(spark):
    """A template that unlike texts share recurs, however many distinct lines its leaf has."""
    for n in (40, 4200):
        d = spark.createDataFrame(many_alike(n), "doc_id long, text string")
        got = {(r.doc_id, r.line_no, r.template, r.n_docs) for r in templates.gone_lines(d, copy_share=1.0).where("line_no = 1").collect()}
        assert got == {(i, 1, "it was the <*> that came here to see us all today", n) for i in range(n)}


def test_indexed_leaf_equals_one_without_index(monkeypatch):
    rng = np.random.default_rng(5)
    lines = set()
    for width in (6, 15):
        base = rng.zipf(1.4, (200, width)) % 500
        for _ in range(1500):
            row = base[rng.integers(0, 200)].copy()
            at = rng.integers(0, width, rng.integers(0, width))
            row[at] = rng.zipf(1.4, len(at)) % 500
            lines.add("it was the " + " ".join("<*>" if x % 17 == 5 else f"w{x}" for x in row))
        some = sorted(x for x in lines if x.count(" ") == width + 2)
        monkeypatch.setattr(templates, "INDEXED", 10**9)
        want = templates.parse_leaf(some)
        monkeypatch.setattr(templates, "INDEXED", 4)
        assert templates.parse_leaf(some) == want and len(set(want)) < len(some)


def test_pipeline_drops_lines_of_a_large_leaf(spark):
    """The pipeline's stage cuts the same lines out of many documents as out of few."""
    for n in (40, 4200):
        rows = many_alike(n)
        out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
        assert {r.doc_id: r.text for r in out.collect()} == {i: text.split("\n")[0] for i, text in rows}
