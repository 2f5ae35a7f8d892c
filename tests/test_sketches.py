import random
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphtally.functions.hashing import city64
from glyphtally.operators import ngrams, sketches
from glyphtally.operators.sketches import CL, CML8HS, CML8S, CMS, CMTS, KINDS, BitVector, create, load, memory

KEYS = st.lists(st.sampled_from([f"k{i}" for i in range(40)]), max_size=200)


def naive(s, keys):
    """Conservative update of a Count-Min sketch, written out."""
    rows = [[0] * s.width for _ in range(s.depth)]
    for k in keys:
        at = s.where([k])[:, 0]
        m = min(r[i] for r, i in zip(rows, at))
        for r, i in zip(rows, at):
            if r[i] == m:
                r[i] += 1
    return rows


@settings(max_examples=40, deadline=None)
@given(KEYS, st.integers(1, 30), st.integers(1, 4))
def test_bounds(keys, width, depth):
    truth, names = Counter(keys), list(dict.fromkeys(keys))
    s = CMS(width, depth)
    s.insert(s.where(keys))
    assert [list(r) for r in s.rows] == naive(s, keys)
    for sk in (s, CL(width, depth, 2, 0), CL(width, depth, 2, 1)):
        if sk is not s:
            sk.insert(sk.where(keys))
        assert all(e >= truth[k] for k, e in zip(names, sk.read(sk.where(names)) if names else []))
    plain = np.zeros((depth, width))
    for k in keys:
        plain[np.arange(depth), s.where([k])[:, 0]] += 1
    for k in names:
        assert s.estimate(k) <= plain[np.arange(depth), s.where([k])[:, 0]].min()


@pytest.mark.parametrize("name", KINDS)
def test_bytes(name):
    rng = random.Random(3)
    keys = [f"k{int(rng.paretovariate(1)) % 300}" for _ in range(3000)]
    s = create(name, budget=20_000)
    s.insert(s.where(keys))
    t = load(name, s.to_bytes())
    assert t.to_bytes() == s.to_bytes() and (t.read(t.where(keys)) == s.read(s.where(keys))).all()
    assert len(s.body()) == s.counter_bytes() and s.sizeof() == len(s.to_bytes())
    truth = Counter(keys)
    error = np.mean([abs(s.estimate(k) - n) / n for k, n in truth.items()])
    assert error < 0.35
    assert name in sketches.available() and repr(s) in s.debug()


def test_tree_codec():
    s = CMTS(1, 1)
    for v, (b, c) in {0: (0, 0), 1: (0, 1), 2: (1, 0), 6: (2, 0), 510: (8, 0), 1022: (8, 512)}.items():
        assert c + 2 * (2**b - 1) == v
        s.put(0, 9, v)
        assert s.get(0, 9) == v
    t = CMTS(1, 1)
    for v in range(3000):
        assert t.get(0, 3) == v
        t.put(0, 3, v + 1)


def test_layers_and_logs():
    s = CL(1, 3, 1, 0)
    for n in range(1, 301):
        s.add("a")
        assert s.estimate("a") == n
    assert s.rows[2][0] == 255  # full, so no longer asked
    c = CML8S(4, 2, 2.0)
    assert c.value(np.array([3]))[0] == 7.0
    assert CML8HS(5, 3).widths() == [5, 20, 20]


@pytest.mark.parametrize("make", [lambda: CMS(0, 3), lambda: CMS(3, 0), lambda: CML8HS(3, 2, 3), lambda: CL(3, 3, 4, 2), lambda: CL(3, 7), lambda: CMTS(3, 3, 100), lambda: CMS.from_error(1e-11, 0.1), lambda: CMS.from_error(0.1, 1.0), lambda: create("none")])
def test_refused(make):
    with pytest.raises(ValueError):
        make()


def test_sizes():
    s = CMS.from_error(0.1, 0.01)
    assert (s.depth, s.width) == (5, 28)
    assert {r["structure"]: r["counter_bytes"] for r in memory()} == {"CMS-CU": 79_083_480, "CML8S-CU": 79_083_480, "CMTS-CU": 79_083_356, "CL-CU": 79_083_480, "CL-MU": 79_083_480, "CML8HS-CU": 79_083_480}


def test_bits():
    v = BitVector(10)
    assert len(v) == 16 and v.sizeof() == 2
    v[9] = True
    v.toggle(0)
    assert v.count() == 2 and v.to_bytes() == b"\x01\x02" and BitVector.from_bytes(v.to_bytes())[9]
    with pytest.raises(IndexError):
        v[16]
    with pytest.raises(ValueError):
        BitVector(0)


def test_hash():
    # one key at a time and many of unlike lengths give the same
    keys = ["", "a", "olá", "x" * 9, "y" * 20, "z" * 40, "w" * 64, "v" * 65, "u" * 200, b"bytes"]
    assert [int(city64([k])[0]) for k in keys] == [int(x) for x in city64(keys)]
    assert city64(["a"])[0] == city64([b"'a'"])[0] != city64([b"a"])[0]
    assert len({int(x) for x in city64([f"k{i}" for i in range(5000)])}) == 5000


class Plain:
    """The structures written out key by key, from their definitions, to hold the others against."""

    def __init__(self, s):
        self.s, self.widths = s, s.widths()
        self.rows = [[0] * w for w in self.widths]

    def cells(self, key):
        return [int(x) for x in self.s.where([key])[:, 0]]


class PlainLog(Plain):
    def __init__(self, s):
        super().__init__(s)
        self.rng, self.first = np.random.default_rng(s.seed), getattr(s, "linear", 0)

    def add(self, key):
        at, u = self.cells(key), self.rng.random()
        for lo, hi, log in ((0, self.first, False), (self.first, len(at), True)):
            seen = [self.rows[k][at[k]] for k in range(lo, hi)]
            if seen and (not log or (min(seen) < 255 and u < self.s.base ** -min(seen))):
                for k in range(lo, hi):
                    if self.rows[k][at[k]] == min(seen):
                        self.rows[k][at[k]] += 1

    def estimate(self, key):
        value = lambda k, c: float(c) if k < self.first else (self.s.base**c - 1) / (self.s.base - 1)
        return min(value(k, self.rows[k][i]) for k, i in enumerate(self.cells(key)))


class PlainLayers(Plain):
    def add(self, key):
        at, most = self.cells(key), [2 ** (32 >> k) - 1 for k in range(len(self.rows))]
        if self.s.mode == 0:
            free = [k for k, i in enumerate(at) if self.rows[k][i] < most[k]]
            if free:
                least = min(self.rows[k][at[k]] for k in free)
                for k in free:
                    if self.rows[k][at[k]] == least:
                        self.rows[k][at[k]] += 1
        else:
            running = 2**32 - 1
            for k in reversed(range(len(at))):
                v = self.rows[k][at[k]]
                if v < most[k] and v < running:
                    self.rows[k][at[k]] = running = v + 1

    def estimate(self, key):
        at = self.cells(key)
        return min([self.rows[k][i] for k, i in enumerate(at) if self.rows[k][i] < 2 ** (32 >> k) - 1], default=2**32 - 1)


class PlainTree(Plain):
    """Bits by (row, tree, level, node): counting and barrier ones, as sets; spires."""

    def __init__(self, s):
        super().__init__(s)
        self.count, self.barrier, self.spire = set(), set(), {}

    def get(self, row, i):
        t, leaf = divmod(i, self.s.leaves)
        b = 0
        while b < self.s.height and (row, t, b, leaf >> b) in self.barrier:
            b += 1
        c = sum(1 << k for k in range(min(b + 1, self.s.height)) if (row, t, k, leaf >> k) in self.count)
        if b == self.s.height:
            c += self.spire.get((row, t), 0) << b
        return c + 2 * (2**b - 1)

    def put(self, row, i, v):
        t, leaf = divmod(i, self.s.leaves)
        nb = min(self.s.height, ((v + 2) // 4).bit_length())
        nc = v - 2 * (2**nb - 1)
        for k in range(min(nb + 1, self.s.height)):
            (self.count.add if nc >> k & 1 else self.count.discard)((row, t, k, leaf >> k))
            if k < nb:
                self.barrier.add((row, t, k, leaf >> k))
        if nb == self.s.height:
            self.spire[row, t] = max(self.spire.get((row, t), 0), nc >> self.s.height)

    def add(self, key):
        at = self.cells(key)
        seen = [self.get(r, i) for r, i in enumerate(at)]
        for r, i in enumerate(at):
            if seen[r] == min(seen):
                self.put(r, i, min(seen) + 1)

    def estimate(self, key):
        return min(self.get(r, i) for r, i in enumerate(self.cells(key)))


PLAIN = [
    (lambda: CML8S(37, 3, 1.08), PlainLog), (lambda: CML8S(11, 2, 2.0), PlainLog), (lambda: CML8HS(9, 3, 1, 1.3), PlainLog), (lambda: CML8HS(9, 3, 2, 1.08), PlainLog),
    (lambda: CL(3, 4, 2, 0), PlainLayers), (lambda: CL(3, 4, 2, 1), PlainLayers), (lambda: CL(1, 6, 1, 0), PlainLayers), (lambda: CL(1, 6, 1, 1), PlainLayers), (lambda: CMTS(2, 3, 8), PlainTree), (lambda: CMTS(1, 2, 1), PlainTree), (lambda: CMTS(3, 2, 128), PlainTree),
]


@pytest.mark.parametrize("make, plain", PLAIN)
def test_equals_the_definition(make, plain):
    """Estimates after many collisions, full counters and barriers are those of the structure written out."""
    rng = random.Random(12)
    keys = [f"k{int(rng.paretovariate(0.8)) % 60}" for _ in range(4000)]
    s, p = make(), plain(make())
    names = sorted(set(keys))
    number = {k: i for i, k in enumerate(names)}
    if hasattr(s, "rng"):
        s.rng = np.random.default_rng(s.seed)
    s.insert_keys(s.where(names), np.array([number[k] for k in keys]))
    for k in keys:
        p.add(k)
    got, want = s.read(s.where(names)), [p.estimate(k) for k in names]
    assert np.allclose(got, want, rtol=1e-12, atol=0)
    if plain is PlainLayers:
        assert any(x == 2**b - 1 for r, b in zip(p.rows, s.bits) for x in r)  # some counter is full


def test_wide_sketch_inserts_at_once_what_shares_no_cell():
    rng = random.Random(4)
    keys = [f"k{int(rng.paretovariate(0.6)) % 30_000}" for _ in range(60_000)]
    names = sorted(set(keys))
    number = {k: i for i, k in enumerate(names)}
    a, b = CMS(1 << 16, 3), CMS(1 << 16, 3)
    at, codes = a.where(names), np.array([number[k] for k in keys])
    a.insert_keys(at, codes)
    b.insert(at[:, codes])
    assert a.to_bytes() == b.to_bytes() and max(a.rows[0]) > 100


def test_byte_formats_by_hand():
    """Headers, and counters where the format has them, packed here bit by bit."""
    s = CMS(2, 2, 7)
    for r, c in ((0, 5), (1, 9)):
        s.rows[r][1] = c
    assert s.to_bytes() == struct.pack("=IBQ", 2, 2, 7) + struct.pack("<4I", 0, 5, 0, 9)
    log = CML8HS(1, 2, 1, 1.5, 3)
    log.top.rows[0][0], log.rows[0][2] = 300, 8
    assert log.to_bytes() == struct.pack("=IBBdQ", 1, 2, 1, 1.5, 3) + struct.pack("<I", 300) + bytes([0, 0, 8, 0])
    assert CML8S(3, 1, 2.0, 5).to_bytes() == struct.pack("=IBdQ", 3, 1, 2.0, 5) + bytes(3)
    layers = CL(2, 3, 4, 1, 9)  # 2 of 32 bits, 8 of 16, 32 of 8
    layers.rows[0][1], layers.rows[1][3], layers.rows[2][30] = 2**31, 65535, 200
    words = [0, 2**31] + [0] * 4 + [0] * 8
    words[2 + 3 // 2] |= 65535 << 16 * (3 % 2)
    words[6 + 30 // 4] |= 200 << 8 * (30 % 4)
    assert layers.to_bytes() == struct.pack("=IBBBQ", 2, 3, 4, 1, 9) + struct.pack("<14I", *words)
    tree = CMTS(2, 1, 4, 1)  # height 3, 7 nodes of two bits and no padding but at the end
    tree.put(0, 4 + 2, 7)  # second tree, leaf 2: value 7 has two barriers and the rest 1
    bits = [0] * 28
    for level, node, count, barrier in ((0, 2, 1, 1), (1, 1, 0, 1), (2, 0, 0, 0)):
        at = 14 + {0: 0, 1: 8, 2: 12}[level] + 2 * node
        bits[at], bits[at + 1] = count, barrier
    want = bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, 28, 8))
    assert tree.to_bytes() == struct.pack("=IBBQ", 2, 1, 4, 1) + want + struct.pack("<2I", 0, 0)


# The 64-bit hash in plain integers, from its definition.
M = 2**64 - 1
H0, H1, H2, H3, HM = 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0x9DDFEA08EB382D69


def plain_hash(s, seed=42):
    rot = lambda x, n: x if n == 0 else ((x >> n) | (x << (64 - n))) & M
    mix = lambda x: x ^ (x >> 47)
    at = lambda i, k=8: int.from_bytes(s[i : i + k], "little")
    n = len(s)

    def pair(u, v):
        a = mix((u ^ v) * HM & M)
        b = mix((v ^ a) * HM & M)
        return b * HM & M

    def weak(i, a, b):
        w, x, y, z = (at(i + 8 * k) for k in range(4))
        a = (a + w) & M
        b = rot((b + a + z) & M, 21)
        c = a
        a = (a + x + y) & M
        b = (b + rot(a, 44)) & M
        return (a + z) & M, (b + c) & M

    if n == 0:
        h = H2
    elif n < 4:
        y, z = s[0] + (s[n >> 1] << 8), n + (s[n - 1] << 2)
        h = mix((y * H2 ^ z * H3) & M) * H2 & M
    elif n <= 8:
        h = pair(n + (at(0, 4) << 3), at(n - 4, 4))
    elif n <= 16:
        b = at(n - 8)
        h = pair(at(0), rot((b + n) & M, n)) ^ b
    elif n <= 32:
        a, b, c, d = at(0) * H1 & M, at(8), at(n - 8) * H2 & M, at(n - 16) * H0 & M
        h = pair((rot((a - b) & M, 43) + rot(c, 30) + d) & M, (a + rot(b ^ H3, 20) - c + n) & M)
    elif n <= 64:

        def half(z, a, i, j):
            b = rot((a + z) & M, 52)
            c = rot(a, 37)
            a = (a + at(i)) & M
            c = (c + rot(a, 7)) & M
            a = (a + at(j)) & M
            return (a + z) & M, (b + rot(a, 31) + c) & M

        vf, vs = half(at(24), (at(0) + (n + at(n - 16)) * H0) & M, 8, 16)
        wf, ws = half(at(n - 8), (at(16) + at(n - 32)) & M, n - 24, n - 16)
        r = mix(((vf + ws) * H2 + (wf + vs) * H0) & M)
        h = mix((r * H0 + vs) & M) * H2 & M
    else:
        x, y, z = at(n - 40), (at(n - 16) + at(n - 56)) & M, pair((at(n - 48) + n) & M, at(n - 24))
        v, w = weak(n - 64, n, z), weak(n - 32, (y + H1) & M, x)
        x = (x * H1 + at(0)) & M
        for i in range(0, (n - 1) & ~63, 64):
            x = rot((x + y + v[0] + at(i + 8)) & M, 37) * H1 & M
            y = rot((y + v[1] + at(i + 48)) & M, 42) * H1 & M
            x ^= w[1]
            y = (y + v[0] + at(i + 40)) & M
            z = rot((z + w[0]) & M, 33) * H1 & M
            v = weak(i, v[1] * H1 & M, (x + w[0]) & M)
            w = weak(i + 32, (z + w[1]) & M, (y + at(i + 16)) & M)
            z, x = x, z
        h = pair((pair(v[0], w[0]) + mix(y) * H1 + z) & M, (pair(v[1], w[1]) + x) & M)
    return pair((h - H2) & M, seed)


def test_hash_of_every_length():
    rng = random.Random(6)
    keys = [rng.randbytes(n) for n in [*range(140), 191, 192, 193, 500] for _ in range(2)]
    for seed in (42, 0, 7):
        assert [int(x) for x in city64(keys, seed)] == [plain_hash(k, seed) for k in keys]


def test_build_is_insertion_in_order(spark):
    rng = random.Random(5)
    rows = [(i, 1 + i % 3, [f"w{int(rng.paretovariate(1)) % 50}" for _ in range(rng.randint(0, 40))]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, part int, tokens array<string>").repartition(4)
    specs = {n: sketches.params_for(n, 600) for n in ("CMS-CU", "CL-MU", "CMTS-CU")}
    got = {(r.part, r.structure): bytes(r.blob) for r in sketches.build(ngrams.stream(d, 3), specs).collect()}
    docs = sketches.build_docs(d, specs, 3).collect()
    assert {(r.part, r.structure): bytes(r.blob) for r in docs} == got and all(r.seconds > 0 for r in docs)
    assert {r.part: r.n for r in docs} == {r["part"]: r["count"] for r in ngrams.stream(d, 3).groupBy("part").count().collect()}
    for part in (1, 2, 3):
        keys = []
        for _, _, t in sorted(r for r in rows if r[1] == part):
            for i in range(len(t)):
                keys += [t[i]] + [" ".join(sorted((t[i], t[j]))) for j in range(i + 1, min(i + 3, len(t)))]
        for n, p in specs.items():
            s = create(n, p)
            for k in keys:
                s.add(k)
            assert got[part, n] == s.to_bytes()
