import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphtally.llm import crf, pii, secrets, urls

from . import messy


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail a.b+c@sub.example.org.", [("email", "a.b+c@sub.example.org")]), ("x@@y.de @me a@b", []), ("one@a.com,two@b.org", [("email", "one@a.com"), ("email", "two@b.org")]),
        ("IBAN GB82 WEST 1234 5698 7654 32 is", [("iban", "GB82 WEST 1234 5698 7654 32")]), ("GB83 WEST 1234 5698 7654 32", []), ("see https://a.b/c?d=1).", []), ("www.example.com/x, and", []), ("ftp://me:pw@a.b/c", [("url", "ftp://me:pw@a.b/c")]), ("https://a.b/c?x=1&user=me).", [("url", "https://a.b/c?x=1&user=me")]), ("http://a.b/to/x@y.org/1", [("url", "http://a.b/to/x@y.org/1")]), ("https://a.b/4111111111111111", []),
        ("account no: 12345678 ok", [("account", "12345678")]), ("accounted 12345678", []), ("+1 (017) 555-7713%%%", [("phone", "+1 (017) 555-7713")]), ("(499) 555-6503", [("phone", "(499) 555-6503")]), ("+33 6 12 34 56 78", [("phone", "+33 6 12 34 56 78")]),
        ("card 4111 1111 1111 1111!", [("card", "4111 1111 1111 1111")]), ("4111111111111112", []), ("ip 10.0.0.255.", [("ip", "10.0.0.255")]), ("v1.2.3.4 and 1.2.3.4.5 and 300.1.1.1", []), ("ssn 123-45-6789", [("ssn", "123-45-6789")]), ("in 1999, 12 of 24 items", []), ("", []),
    ],
)
def test_pii(text, want):
    assert [(k, text[i:j]) for k, i, j in pii.scan(text)] == want


def test_pii_brute_force(spark, sf):
    """Every at-sign of the table is in an address, every Luhn number of 16 digits is a card; nothing else is."""
    import re

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.kind, r.value) for r in pii.find(docs).collect()}
    want = set()
    for r in docs.collect():
        want |= {(r.doc_id, "email", m) for m in re.findall(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", r.text)}
        want |= {(r.doc_id, "card", m) for m in re.findall(r"(?<!\d)\d{16}(?!\d)", r.text) if pii.luhn(m) and m[0] != "0"}
        want |= {(r.doc_id, "phone", m) for m in re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", r.text)}
        want |= {(r.doc_id, "ip", m) for m in re.findall(r"(?<![\d.])\d+\.\d+\.\d+\.\d+(?![\d])", r.text) if all(int(x) < 256 for x in m.split("."))}
    assert got == want and len(want) > 3


@pytest.mark.parametrize("text, want", [("see https://a.b/c?d=1).", "https://a.b/c?d=1"), ("www.example.com/x, and", "www.example.com/x"), ("(http://localhost:8080/a_(b)", "http://localhost:8080/a_(b"), ("x://y http://", None), ("a.www.b.c", None)])
def test_pii_every_url(text, want):
    assert [text[i:j] for k, i, j in pii.scan(text, True)] == ([want] if want else [])


def iban(rng):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int(body + "1314" + "00") % 97  # D is 13, E 14
    return f"DE{check:02d}{body}"


def test_pii_planted(spark):
    """Every planted piece is found where it is, and nothing else: ibans, numbers of persons, accounts, urls, cards, mail, in any company."""
    rng, rows, want = random.Random(6), [], set()
    digits = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    make = {
        "iban": lambda: iban(rng), "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "email": lambda: f"u{digits(2)}.x@mail{digits(1)}.example.com",
        "url": lambda: f"https://a{digits(2)}.example.org/p?q=1&email=u{digits(3)}", "ip": lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.1", "phone": lambda: f"+1 ({rng.randint(200, 999)}) 555-{digits(4)}",
    }
    decoys = ["in 1999", "12 of 24 items", "version 1.2.3", "id 000-12-3456", "GB83WEST12345698765432", "https://example.org/a/b?page=2", "call me @home", "3.14159", "a@b", "accounts of 1812", "999.1.1.1"]
    cues = ["Account number:", "IBAN or account no.", "customer ID #", "Konto", "cuenta número:", "MEMBER ID is"]
    for i in range(300):
        text = ""
        for _ in range(rng.randint(1, 6)):
            text += rng.choice(["und so ", "more words here, ", "élan ", "\n"])
            kind = rng.choice([*make, "account", "decoy", "decoy"])
            if kind == "decoy":
                text += rng.choice(decoys)
            else:
                if kind == "account":
                    text += rng.choice(cues) + " "
                value = digits(8) if kind == "account" else make[kind]()
                want.add((i, kind, len(text), value))
                text += value
            text += rng.choice([", ", "; ", " end. ", "\n"])
        rows.append((i, text))
    got = {(r.doc_id, r.kind, r.start, r.value) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and {k for _, k, _, _ in want} == {*make, "account"}


def test_pii_long_text_and_ties(spark):
    text = "word " * 200_000 + "a@b.org " + "x" * 300_000 + " a@b.org"
    d = spark.createDataFrame([(1, text), (1, text), (2, "9" * 100_000)], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in pii.find(d).orderBy("doc_id", "start").collect()] == [(1, 1_000_000)] * 2 + [(1, len(text) - 7)] * 2


def test_pii_redact_and_messy(spark):
    d = messy.table(spark, [(*r[:1], "write to a@b.com or +1 (017) 555-7713 now" if r[0] == 2 else r[1], *r[2:]) for r in messy.rows()])
    out = pii.redact(d)
    assert out.columns == d.columns and out.count() == d.count()
    assert [r.text for r in out.where("doc_id = 2").collect()] == ["write to <email> or <phone> now"]
    assert out.where("doc_id = 1").first().text == messy.TEXT and out.where("doc_id = 3").first().text is None
    assert {r.doc_id for r in pii.find(d).collect()} == {2} and pii.find(messy.empty(spark)).count() == 0


def test_crf_gradient_finds_the_pattern():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (200, 12, 1))
    y = (x[..., 0] == 2).astype(int)
    w, tr = crf.train(x, y, np.full(200, 12), 3, 2)
    assert all((crf.viterbi(crf.scores(w, a), tr) == b).all() for a, b in zip(x, y))


def test_decode_equals_viterbi():
    rng = np.random.default_rng(4)
    for _ in range(50):
        tr = rng.normal(0, 2, (3, 3))
        sizes = rng.integers(1, 40, 6)
        e = rng.normal(0, 3, (sizes.sum(), 3))
        e[rng.random(len(e)) < 0.6, 0] += 25
        starts = np.cumsum(sizes) - sizes
        want = np.concatenate([crf.viterbi(e[a : a + n], tr) for a, n in zip(starts, sizes)])
        assert (crf.decode(e, tr, starts) == want).all()


def test_viterbi_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(7)
    for n in range(1, 7):
        for _ in range(20):
            e, tr = rng.normal(0, 2, (n, 3)), rng.normal(0, 2, (3, 3))
            score = lambda y: sum(e[i, s] for i, s in enumerate(y)) + sum(tr[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            assert tuple(crf.viterbi(e, tr)) == max(product(range(3), repeat=n), key=score)
    assert crf.viterbi(np.zeros((4, 3)), np.zeros((3, 3))).tolist() == [0] * 4  # of equals the lower state


def test_training_follows_the_gradient():
    """The weights are where the penalised likelihood, by enumeration, has no slope."""
    from itertools import product

    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 3, (6, 4, 1)), rng.integers(0, 2, (6, 4))
    w, tr = crf.train(x, y, np.full(6, 4), 3, 2, steps=4000, rate=0.01, l2=0.1)

    def loss(w, tr):
        total = 0.0
        for a, b in zip(x[:, :, 0], y):
            score = lambda z: sum(w[i, s] for i, s in zip(a, z)) + sum(tr[p, q] for p, q in zip(z, z[1:]))  # noqa: B023, E731
            total += score(b) - np.log(sum(np.exp(score(z)) for z in product(range(2), repeat=4)))
        return total / len(x) - 0.05 * ((w**2).sum() + (tr**2).sum())

    for v in (w, tr):
        for at in np.ndindex(v.shape):
            old, slope = v[at], []
            for step in (1e-4, -1e-4):
                v[at] = old + step
                slope.append(loss(w, tr))
            v[at] = old
            assert abs(slope[0] - slope[1]) / 2e-4 < 5e-3


def test_secrets_held_out():
    w, tr = secrets.model()
    tp = fp = fn = 0
    for x, y in secrets.sequences(600, 4242):
        f = secrets.features(np.array([secrets.categories(a) for a in x]), np.zeros(len(x), int), np.ones(len(x), int))
        p = crf.viterbi(crf.scores(w, f).astype(float), tr.astype(float))
        y = np.array(y)
        tp, fp, fn = tp + ((y > 0) & (p > 0)).sum(), fp + ((y == 0) & (p > 0)).sum(), fn + ((y > 0) & (p == 0)).sum()
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


def test_secrets_tag_equals_whole_decoding():
    """Batches with their short cuts give what features and Viterbi over each whole text give."""
    w, tr = secrets.model()
    texts = [" ".join(x) for x, _ in secrets.sequences(150, 77)]
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCXYZ") for _ in range(n))
    texts += [f"{name} = {q}{letters(n)}{q} {rng.choice(('and so on', 'x', ''))}" for n in range(1, 16) for q in ('"', "'", "") for name in ("password", "the token", "word")]
    texts += [f'secret: "{letters(1) * 4100 + letters(3000)}" and text', "a" * 5000 + letters(4000), " ".join(letters(30) for _ in range(3000))]
    texts = [" ".join(rng.sample(texts, 3)) + " plain words here " * rng.randrange(9) for _ in range(40)] + texts[150:] + ["", "one"]
    got = [(r, v) for r, _, _, v in secrets.tag(pa.array(texts), w, tr)]
    want = []
    for r, t in enumerate(texts):
        x = t.split()
        if not x:
            continue
        cats = np.array([secrets.categories(a) for a in x])
        f = secrets.features(cats, np.zeros(len(x), int), np.full(len(x), secrets.file_category(int((cats != np.array(secrets.PLAIN_CATEGORIES)).any(1).sum()), len(x))))
        p = crf.viterbi(crf.scores(w, f).astype(float), tr.astype(float))
        want += [(r, secrets.value_of(x[i])[1]) for i in range(len(x)) if p[i] == secrets.BEGIN]
    assert len(got) == len(want) and sum(a[1].startswith(b[1]) for a, b in zip(got, want)) == len(want)


def test_secrets_on_documents(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r.doc_id, r.value) for r in secrets.find(docs).collect()}
    want = {(r.doc_id, m) for r in docs.collect() for m in re.findall(r'(?i)token\S* =\S* "([0-9a-f]{40})"', r.text)}
    assert want <= got and len(got - want) <= 0.02 * len(want) + 1


def test_secrets_messy(spark):
    d = messy.table(spark, [(*r[:1], 'api_key = "a81bc81bdeadbeef0123456789abcdef"\n' + r[1] if r[0] == 2 else r[1], *r[2:]) for r in messy.rows()])
    assert [(r.doc_id, r.start, r.value) for r in secrets.find(d).collect() if r.doc_id != 7] == [(2, 11, "a81bc81bdeadbeef0123456789abcdef")]
    assert secrets.find(messy.empty(spark)).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, root string, `bad` int")


def test_urls_propagate(spark):
    canon = lambda u: f'<head><link rel="canonical" href="{u}"></head>'
    p = pages(spark, [
        (1, "http://a.com/1", canon("http://b.com/2"), None, 1), (2, "http://b.com/2", '<meta http-equiv="refresh" content="0; url=/3">', None, 1), (3, "https://www.b.com/9", None, None, 1), (4, "https://b.com/3/", "", None, 1),
        (5, "http://evil.org/x", canon("http://a.com/1?utm_source=z#top"), None, 1), (6, "http://ok.com/", "<p>x</p>", None, 1), (7, None, canon("http://a.com/1"), None, 1), (8, "http://sub.evil.org/y", None, None, 1), (9, "http://c.com/good", canon("http://evil.org/x"), None, 1), (6, "http://ok.com/", "<p>x</p>", None, 1), (None, "", None, None, 1),
    ])
    out = urls.decide(p, None, ("evil.org",), (), (r"/good$",)).collect()
    got = {r.page_id: r.decision for r in out}
    assert len(out) == 11 and got == {1: "block", 2: "block", 3: "keep", 4: "block", 5: "block", 6: "keep", 7: "keep", 8: "block", 9: "allow", None: "keep"}
    assert len({r.root for r in out if r.page_id in (1, 2, 4, 5, 9)}) == 1
    more = spark.createDataFrame([("http://ok.com", "http://r.com/z"), ("http://r.com/z", "http://evil.org/x"), (None, "http://q.com")], "src string, dst string")
    assert {r.page_id: r.decision for r in urls.decide(p, more, ("evil.org",), (), ()).collect()}[6] == "block"


@pytest.mark.parametrize("a, b", [("HTTP://A.com:80/x/", "https://a.com/x"), ("http://a.com/x?utm_source=f&b=1&ref=x", "a.com/x?b=1"), ("http://u:p@a.com./#top", "a.com")])
def test_urls_normal(spark, a, b):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(a, b)], "a string, b string").select(urls.normal(F.col("a")), urls.normal(F.col("b"))).first()
    assert r[0] == r[1]


@pytest.mark.parametrize(
    "link, want",
    [("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"), ("//g", "http://g"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q"), ("g#s", "http://a/b/c/g"), (";x", "http://a/b/c/;x"), ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"), ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"), ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("mailto:x@y.z", "mailto:x@y.z"), ("https://e.f/a/../b", "https://e.f/b")],
)
def test_urls_resolve(spark, link, want):
    """The examples of RFC 3986, 5.4, without fragments."""
    assert spark.createDataFrame([(link, "http://a/b/c/d;p?q")], "l string, b string").select(urls.resolve(F.col("l"), F.col("b"))).first()[0] == want


def test_urls_implied_chains(spark, sf):
    art = lambda x: f"<body><article>{x}</article></body>"
    p = pages(spark, [(1, "http://www.a.com/x.html", art("one"), None, 1), (2, "https://a.com/x", art("two"), None, 1), (3, "https://m.a.com/x/?ref=x", art("three"), None, 1), (4, "https://b.com/y", art("three"), None, 1), (5, "https://m.b.com/y.html", None, None, 1), (6, "https://c.com/", art(""), None, 1), (7, None, art("one"), None, 1), (8, "https://bad.org/", art("five"), None, 1), (9, "https://zz.com/q", art("five"), None, 1)])
    out = {r.page_id: (r.root, r.decision) for r in urls.decide(p, urls.implied(p), ("bad.org",), (), (r"zz",)).collect()}
    assert {i: root for i, (root, _) in out.items()} == {1: "a.com/x", 2: "a.com/x", 3: "a.com/x", 4: "a.com/x", 5: "a.com/x", 6: "c.com", 7: None, 8: "bad.org", 9: "bad.org"}
    assert {i for i, (_, d) in out.items() if d == "block"} == {8} and out[9][1] == "allow"
    every = urls.op4_url_filters(spark, sf).collect()
    assert sum(r.root != r.node for r in every) > 5 and {r.decision for r in every} == {"allow", "block", "keep"}


def test_urls_hot_article(spark):
    """A third of all pages have one article: one component, and no page is lost."""
    p = pages(spark, [(i, f"https://h{i % 50}.com/{i}", f"<article>{'same' if i % 3 == 0 else i}</article>", None, 1) for i in range(900)])
    out = urls.decide(p, urls.implied(p), (), (), ()).collect()
    roots = {}
    for r in out:
        roots.setdefault(r.root, set()).add(r.page_id)
    assert len(out) == 900 and sorted(map(len, roots.values())) == [1] * 600 + [300]


def test_urls_empty(spark):
    none = pages(spark, [])
    assert urls.decide(none, urls.implied(none)).count() == 0
