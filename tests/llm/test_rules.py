from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphtally.llm import mixing, quality, registry, templates

from ..conftest import same_as_sql
from . import messy


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, name):
    same_as_sql(spark, sf, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize(
    "line, why",
    [("Home | About | Contact us now", "navigation"), ("Please accept our cookie policy to go on.", "boilerplate"), ("Released under the MIT licence.", "licence"), ("#### $$$$ %%%% &&&&", "symbols"), ("a, b, c, d, e, f, g, h", "punctuation"), ("Three words only", "punctuation"), ("word " * 30, "repetition"), ("A plain sentence of seven words here.", None), ("这是一个没有句号的中文句子", None), ("你好", "punctuation"), ("Short one.", None)],
)
def test_line_rules(spark, line, why):
    yes = {k: F.lit(True) for k in quality.HINTS}
    assert spark.createDataFrame([(line.strip(),)], "x string").select(quality.measured(F.col("x"), F.lit(True)).alias("m")).select(quality.fails(F.col("m"), yes)).first()[0] == why


def test_quality_rejects_and_keeps(spark):
    good, bad = "This is a whole sentence with enough words.", "Home | About | Contact and more text here"
    d = spark.createDataFrame([(1, f"{good}\n{bad}\n\n{good}"), (2, f"{bad}\n{bad}\n{good}"), (3, good)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in quality.clean_lines(d).collect()} == {1: f"{good}\n\n{good}", 3: good}


def test_quality_ties_and_long_lines(spark):
    good, bad = "Eight letters in all the words of this.", "Home | About | Contact us now for more to see"
    size = lambda x: len(x.replace(" ", ""))
    even = good + "x" * (size(bad) - size(good))
    long = "one two three four five six seven eight " * 50_000
    d = spark.createDataFrame([(1, f"{even}\n{bad}"), (2, f"{even[:-1]}\n{bad}"), (3, long), (4, "这是一个没有句号的中文句子\n这是另外一个没有句号的句子")], "doc_id long, text string")
    # a loss of exactly half is kept, one character more isn't
    assert {r.doc_id: len(r.text) for r in quality.clean_lines(d).collect()} == {1: len(even), 4: 27}


def test_quality_messy(spark):
    d = messy.table(spark)
    out = quality.clean_lines(d)
    assert out.columns == d.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got[1] == 2 and not {3, 4, 5} & set(got) and got[None] == 1 and got[6] == 1
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert quality.clean_lines(messy.empty(spark)).count() == 0


def brute_lines(docs, min_docs=3, share=0.5):
    """(id, text, line number) of lines that go, by plain loops."""
    entries, hot = {}, defaultdict(set)
    for i, t in docs:
        if t is None:
            continue
        for n, raw in enumerate(t.split("\n")):
            parts = [p for p in raw.replace("\t", " ").replace("\r", " ").split(" ") if p]
            parts = ["<*>" if any("0" <= c <= "9" for c in p) else p for p in parts]
            if parts:
                leaf = (len(parts), tuple(parts[:3]))
                entries[i, t, n] = (leaf, " ".join(parts), len(raw))
                hot[leaf].add(t)
    by_leaf = defaultdict(set)
    for leaf, line, _ in entries.values():
        if len(hot[leaf]) >= min_docs:
            by_leaf[leaf].add(line)
    template = {}
    for leaf, lines in by_leaf.items():
        found, at = [], {}
        for line in sorted(lines, key=lambda x: x.encode()):
            words = line.split(" ")
            scores = [sum(a == b != "<*>" for a, b in zip(words, t)) for t in found]
            k = scores.index(max(scores)) if scores else -1
            fixed = max(1, sum(w != "<*>" for w in words))
            if k >= 0 and scores[k] >= max(0.7 * fixed, 4):
                found[k] = [a if a == b else "<*>" for a, b in zip(found[k], words)]
            else:
                found.append(words)
                k = len(found) - 1
            at[line] = k
        template |= {(leaf, line): (leaf, " ".join(found[k])) for line, k in at.items()}
    seen, lines = defaultdict(set), []
    for (i, t, n), (leaf, line, size) in entries.items():
        x = template.get((leaf, line))
        if x and sum(w != "<*>" for w in x[1].split(" ")) >= min(4, leaf[0]):
            seen[x].add(t)
            lines.append((i, t, n, x, size))
    lines = [x for x in lines if len(seen[x[3]]) >= min_docs]
    cut = Counter()
    for i, t, n, _, size in set(lines):
        cut[i, t] += size
    copies, most = defaultdict(dict), defaultdict(int)
    for i, t, _, (_, name), _ in lines:  # a template goes by its text from here on
        most[name] = max(most[name], *(len(seen[x]) for x in seen if x[1] == name))
        if cut[i, t] > len(t) * share:
            copies[name][t] = min(copies[name].get(t, (True, 10**9)), (i is not None, i or 0))
    stays = {(name, min(texts, key=lambda t: (texts[t], t))) for name, texts in copies.items() if len(texts) > most[name] * share}
    return {(i, t, n) for i, t, n, (_, name), _ in lines if (name, t) not in stays}


def found_lines(docs, texts, **more):
    return {(r.doc_id, texts[r.doc_id], r.line_no) for r in templates.gone_lines(docs, **more).collect()}


def test_templates_equal_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    own = lambda i, k: " ".join(f"{'abcdefgh'[i]}{w}{'qrstuv'[k]}" for w in "own words of this document alone and of no other one".split())
    extra = [(10**6 + i, f"{own(i, 0)}\nUser {i}{i} logged in from host {i} at noon today.\nRead more.\n{own(i, 1)}\nPart {i}\n{own(i, 2)}") for i in range(6)]
    # one text thrice, which isn't recurring lines, and one changed a little each time, which the first keeps
    same = [(2 * 10**6 + i, "\n".join(own(7, k) for k in range(4))) for i in range(3)]
    near = [(3 * 10**6 + i, "\n".join([own(6, k) for k in range(4)] + ["changed " + own(i, 4)])) for i in range(4)]
    every = docs + extra + same + near
    d = spark.createDataFrame(every, "doc_id long, text string")
    got = found_lines(d, dict(every))
    assert got == brute_lines(every)
    assert Counter(i // 10**6 for i, _, _ in got if i >= 10**6) == {1: 12, 3: 12} and not any(i == 3 * 10**6 for i, _, _ in got)


def test_templates_crowded_leaf(spark):
    """A third of all lines in one leaf: it branches, no task holds more than a leaf, and equal lines still meet."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    line = lambda i: "it was the " + " ".join(f"{words[i // 10**k % 10]}{'xyzw'[k % 4]}" for k in range(4)) + " end of it all"
    docs = [(i, line(i % 300) + "\n" + line((i + 1) % 300) + f"\nother {words[i // 300]} words {words[i % 7]} of {words[i % 9]} document") for i in range(1200)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = templates.lines_of(d).withColumn("h", F.xxhash64("line")).select("n", "p", "h", "line").distinct()
    leaves = templates.bounded(rows, 50)
    assert leaves.count() == rows.count() and leaves.groupBy("n", "leaf").count().agg(F.max("count")).first()[0] <= 50
    gone = templates.gone_lines(d, leaf_lines=50, copy_share=1.0).collect()
    assert sum(r.line_no < 2 for r in gone) == 2400 and all(r.n_docs >= 3 for r in gone)


def test_parse_leaf_ties_and_long_lines():
    assert templates.parse_leaf(["a b c d e f", "a b c d x f"]) == ["a b c d <*> f"] * 2
    # between two templates that are as like, the first found wins
    assert templates.parse_leaf(["a b c d e q r", "a b c z y x w", "a b c d e x w"])[2] == "a b c d e <*> <*>"
    long = " ".join(f"w{'abcdefghij'[i % 10]}" for i in range(50_000))
    assert templates.parse_leaf([long, long[:-1] + "z"])[0].endswith("<*>") and templates.parse_leaf([]) == []


def test_templates_messy(spark):
    d = messy.table(spark)
    out = templates.drop_recurring_lines(d)
    assert out.columns == d.columns and messy.ids(out) == messy.ids(d)
    assert {r.text for r in out.where("doc_id IN (1, 2)").collect()} == {messy.TEXT} and out.where("text IS NULL").count() == 2
    assert templates.drop_recurring_lines(messy.empty(spark)).count() == 0
    lines = "Terms of this site hold for all who come here.\n"
    long = "word " * 60_000
    some = [(i, lines + f"own text {'abc'[i]} of page" + long * (i == 0), "en", "a", 7, *["k", i, None, 3, "h", "s", None]) for i in range(3)]
    out = {r.doc_id: (r.text, r.n_chars) for r in templates.drop_recurring_lines(messy.table(spark, some + [(None, *some[0][1:])])).collect()}
    assert {i: (t[:15], n == len(t)) for i, (t, n) in out.items()} == {0: ("own text a of p", True), 1: ("own text b of p", True), 2: ("own text c of p", True), None: ("own text a of p", True)}


def test_mixing_shares(spark):
    d = spark.createDataFrame([(i, "abcd" * (1 + i % 3), "big" if i % 10 else "small") for i in range(6000)], "doc_id long, text string, source string")
    out = mixing.replicate(d, {"big": 1.0, "small": 1.0}, 1.0)
    chars = {r.source: r.c for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("c")).collect()}
    assert 0.9 < chars["big"] / chars["small"] < 1.1
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.replicate(d.repartition(7), {"big": 1.0, "small": 1.0}, 1.0).collect()))
    counts = np.array([r["count"] for r in out.where("source = 'small'").groupBy("doc_id").count().collect()])
    assert abs(counts.sum() / 600 - 5) < 0.4 and counts.max() > 8


def test_mixing_nulls(spark):
    """A null source is a source, a null doc_id is a document, equal rows repeat alike, and all of a null source's rows go by one rate."""
    rows = [(i if i % 2 else None, "abcd", None) for i in range(2000)] + [(9999, "abcd", "a")] * 2 + [(7, None, "b"), (8, "", "b")]
    out = mixing.replicate(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 1.0}, 1.0)
    c = Counter((r.doc_id, r.source) for r in out.select("doc_id", "source").collect())
    assert c[9999, "a"] % 2 == 0 and c[9999, "a"] > 100 and not any(s == "b" for _, s in c)
    assert c[None, None] % 1000 == 0 and sum(n for (i, s), n in c.items() if i is not None and s is None) > 300


def test_mixing_messy(spark):
    d = messy.table(spark)
    out = mixing.mixed(d, {"a": 2.0}, 3.0)
    assert out.columns == d.columns
    c = Counter((r.doc_id, r.text) for r in out.collect())
    assert c[1, messy.TEXT] % 2 == 0
    assert mixing.mixed(messy.empty(spark)).count() == 0
