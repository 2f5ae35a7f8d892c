"""Exact counts of words and windowed pairs by part, made as numbers: what is counted, estimated or scored of a part is one task's work.

Only texts of tokens move, to their part's task. The task holds a part's tokens as 4-byte numbers and counts its pairs in
passes of PASS_PAIRS, each with the pairs of some words, so that it never holds all pairs. What a pair needs beside its
count (counts of its words, estimates) is looked up by number there: no key is joined, and pairs are shuffled only where
parts are merged, as numbers too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.hashing import cells, city64_texts

#: Between tokens of a joined text; no token holds it.
SEP = "\0"
#: Pairs of a pass; tokens that are looked at once; rows of a batch that is handed on; input bytes of a bucket of whole().
PASS_PAIRS, CHUNK, BATCH, BUCKET_BYTES = 1 << 23, 1 << 20, 1 << 17, 4 << 20
COUNTS = "part int, kind string, key string, freq long"
SCORED = "part int, key string, freq long, c1 long, c2 long, n long"
ESTIMATES = "part int, kind string, key string, freq long, est double, c1 long, c2 long, e1 double, e2 double, n long"
HISTOGRAM = "part int, kind string, freq long, keys long"
PACKED = "bucket int, words binary, home binary, other binary, times binary, own binary, own_times binary"


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, SEP)


def by_part(docs: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """(part, text) of docs (part, tokens), the rows of a part in one partition and together, in order; text is null where there is no token."""
    # no filter here: Spark would move it down, and make tokens twice
    rows = docs.select("part", F.when(F.size("tokens") > 0, joined(F.col("tokens"))).alias("text"), *order)
    n = max(Config().parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int")).sortWithinPartitions("part", *order)


def text_order(words: pa.Array) -> np.ndarray:
    """The place of each word in code-point order."""
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    return rank


class Part:
    """A part's tokens as numbers: words in order of length, then text; documents lie apart by window - 1 places of -1."""

    def __init__(self, number: int, window: int):
        self.number, self.window, self.codes, self.dictionaries = number, window, [], []

    def add(self, texts: pa.Array) -> None:
        texts = texts.drop_null()
        lists = pc.split_pattern(texts, SEP)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = lists.flatten().dictionary_encode()
        gap = self.window - 1
        starts = np.cumsum(sizes + gap) - sizes - gap
        codes = np.full(int((sizes + gap).sum()), -1, np.int32)
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(tokens))
        codes[at] = tokens.indices.to_numpy()
        self.codes.append(codes)
        self.dictionaries.append(tokens.dictionary)

    def close(self) -> bool:
        """Number the words; False if there are none."""
        every = pa.concat_arrays(self.dictionaries).dictionary_encode()
        words = every.dictionary
        order = np.lexsort((text_order(words), pc.binary_length(words).to_numpy()))
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words))
        at, start = every.indices.to_numpy(), 0
        for k, (codes, d) in enumerate(zip(self.codes, self.dictionaries)):
            into = np.r_[place[at[start : start + len(d)]], np.int32(-1)]  # the last is where -1 leads
            start += len(d)
            self.codes[k] = into[codes]
        self.dictionaries = None
        self.words = words.take(pa.array(order))
        self.rank = text_order(self.words)
        self.freq = np.zeros(len(words), np.int64)
        for codes in self.codes:
            self.freq += np.bincount(codes[codes >= 0], minlength=len(words))
        self.n = int(self.freq.sum())
        return self.n > 0

    def word_hash(self) -> np.ndarray:
        return pd.util.hash_array(np.array(self.words.to_pylist(), object), categorize=False)

    def raw_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(home, other) of every pair, some at a time; home is the longer word, of equally long ones the greater: seldom a frequent one."""
        for codes in self.codes:
            for i in range(0, len(codes), CHUNK):
                for d in range(1, self.window):
                    a = codes[i : min(i + CHUNK, len(codes) - d)]
                    b = codes[i + d : i + d + len(a)]
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both], b[both]
                    yield np.maximum(a, b), np.minimum(a, b)

    def pairs(self, group: np.ndarray | None = None, groups: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(home, other, freq) of distinct pairs in order of both, the pairs of a home in one item; group says in which of so many passes a word's pairs come."""
        if group is None:
            groups = max(1, -(-self.n * (self.window - 1) // PASS_PAIRS))
            group = (np.arange(len(self.words)) * 2654435761 >> 7) % groups
        v = len(self.words)
        for g in range(groups):
            held, size, most = [], 0, 2 * PASS_PAIRS
            for home, other in self.raw_pairs():
                if groups > 1:
                    own = group[home] == g
                    home, other = home[own], other[own]
                held.append((home.astype(np.int64) * v + other, None))
                size += len(home)
                if size > most:  # a word with more pairs than a pass: count what is there
                    held = [_summed(held)]
                    size = len(held[0][0])
                    most = max(most, 2 * size)
            keys, freq = _summed(held)
            if len(keys):
                yield keys // v, keys % v, freq

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, home, other) in order of insertion, some at a time: keys are numbers of words, then, from len(words) on, of the pairs that come with them."""
        v = len(self.words)
        for codes in self.codes:
            for i in range(0, len(codes), CHUNK >> 2):
                own = codes[i : i + (CHUNK >> 2)]
                table = np.full((len(own), self.window), -1, np.int64)
                table[:, 0] = own
                for d in range(1, self.window):
                    b = codes[i + d : i + d + len(own)]
                    a = own[: len(b)]
                    table[: len(b), d] = np.where((a >= 0) & (b >= 0), v + np.maximum(a, b).astype(np.int64) * v + np.minimum(a, b), -1)
                keys = table[table >= 0]
                found, back = np.unique(keys, return_inverse=True)
                pairs = found[found >= v] - v
                number = np.where(found < v, found, v + np.arange(len(found)) - (len(found) - len(pairs)))
                yield number[back], pairs // v, pairs % v

    def text(self, home: np.ndarray, other: np.ndarray) -> pa.Array:
        first = self.rank[home] < self.rank[other]
        return pc.binary_join_element_wise(self.words.take(pa.array(np.where(first, home, other))), self.words.take(pa.array(np.where(first, other, home))), " ")

    def both(self, home: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and the second word of pairs, as their texts have them."""
        first = self.rank[home] < self.rank[other]
        return np.where(first, home, other), np.where(first, other, home)


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often they came, of (keys, times); times None is once each."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in held])
    if all(t is None for _, t in held):
        keys.sort()
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[cuts], np.diff(np.r_[cuts, len(keys)])
    times = np.concatenate([np.ones(len(k), np.int64) if t is None else t for k, t in held])
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(times, cuts) if len(cuts) else times


def _parts(batches, window: int) -> Iterator[Part]:
    """The parts of by_part(), one at a time."""
    part = None
    for b in batches:
        numbers = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else []
        for a, z in zip(cuts, cuts[1:]):
            if part is None or part.number != int(numbers[a]):
                if part and part.close():
                    yield part
                part = Part(int(numbers[a]), window)
            part.add(b.column(1).slice(a, z - a))
    if part and part.close():
        yield part


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _same(value, n: int, kind) -> pa.Array:
    return pa.repeat(pa.scalar(value, kind), n)


def _cut(*columns) -> Iterator[tuple]:
    for i in range(0, len(columns[0]), BATCH):
        yield tuple(c[i : i + BATCH] for c in columns)


def counts(docs: DataFrame, window: int = 3, words: bool = True, both: bool = True) -> DataFrame:
    """(part, kind, key, freq) as ngrams.count(ngrams.keys(docs, window, words, both)) gives it, of docs (part, tokens)."""

    def run(batches):
        for p in _parts(batches, window):
            if words:
                for w, f in _cut(p.words, p.freq):
                    yield _batch(COUNTS, _same(p.number, len(f), pa.int32()), _same("word", len(f), pa.string()), w, f)
            for found in p.pairs() if both else ():
                for home, other, f in _cut(*found):
                    yield _batch(COUNTS, _same(p.number, len(f), pa.int32()), _same("pair", len(f), pa.string()), p.text(home, other), f)

    return by_part(docs).mapInArrow(run, COUNTS)


class _Best:
    """Which of many values may be among the k greatest, as far as seen; slack is for rounding and ties by it."""

    def __init__(self, k: int, slack: float = 1e-5):
        self.k, self.slack, self.held = k, slack, np.zeros(0)

    def may(self, x: np.ndarray) -> np.ndarray:
        self.held = np.r_[self.held, x[x > 0]]
        if len(self.held) > self.k:
            self.held = np.partition(self.held, len(self.held) - self.k)[-self.k :]
            return x >= self.held.min() - self.slack
        return x > -self.slack


def _ppmi(c12: np.ndarray, c1: np.ndarray, c2: np.ndarray, n: float) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.log2((c12 / n) / ((c1 / n) * (c2 / n))), nan=-1.0, posinf=-1.0, neginf=-1.0)


def scored(docs: DataFrame, window: int = 3, min_freq: int = 1, best: int | None = None) -> DataFrame:
    """SCORED: pairs seen min_freq times or more with the counts of their first and second word and of all words of the part.

    best: pairs that can't be among so many with the greatest PPMI of their part may be left out.
    """

    def run(batches):
        for p in _parts(batches, window):
            top = _Best(best) if best else None
            for found in p.pairs():
                for home, other, f in _cut(*found):
                    a, b = p.both(home, other)
                    own = f >= min_freq
                    if top:
                        own &= top.may(np.where(own, _ppmi(f, p.freq[a], p.freq[b], p.n), -1.0))
                    if not own.any():
                        continue
                    a, b, f = a[own], b[own], f[own]
                    yield _batch(SCORED, _same(p.number, len(f), pa.int32()), p.text(a, b), f, p.freq[a], p.freq[b], _same(p.n, len(f), pa.int64()))

    return by_part(docs).mapInArrow(run, SCORED)


_SHIFT = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINE = [int(abs(x) * 2**32) for x in np.sin(np.arange(1, 65))]


def md5_halves(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first two 32-bit words of each key's MD5, as big-endian numbers: halves() of the strategy md5, many keys at once."""
    n = len(keys)
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    ends = np.frombuffer(keys.buffers()[1], np.int32, n + 1, keys.offset * 4).astype(np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(0, n, 1 << 14):  # some at a time, to stay in the cache
        z = min(n, i + (1 << 14))
        length = np.minimum(size[i:z], 55)
        block = np.zeros((z - i, 64), np.uint8)
        wide = int(length.max())
        at = ends[i:z, None] + np.arange(wide)
        inside = np.arange(wide) < length[:, None]
        block[:, :wide] = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))], 0) if wide else 0
        rows = np.arange(z - i)
        block[rows, length] = 0x80
        block[:, 56] = (length * 8) & 255
        block[:, 57] = (length * 8) >> 8
        m = np.ascontiguousarray(block.view("<u4").T)
        a0, b0, c0, d0 = (np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        a, b, c, d = (np.full(z - i, x, np.uint32) for x in (a0, b0, c0, d0))
        for k in range(64):
            if k < 16:
                f, g = d ^ (b & (c ^ d)), k
            elif k < 32:
                f, g = c ^ (d & (b ^ c)), (5 * k + 1) & 15
            elif k < 48:
                f, g = b ^ c ^ d, (3 * k + 5) & 15
            else:
                f, g = c ^ (b | ~d), (7 * k) & 15
            f = f + a + np.uint32(_SINE[k]) + m[g]
            s = np.uint32(_SHIFT[k])
            a, d, c, b = d, c, b, b + ((f << s) | (f >> np.uint32(32 - int(s))))
        one[i:z], two[i:z] = (a + a0).byteswap(), (b + b0).byteswap()
    for i in np.flatnonzero(size > 55).tolist():
        h = hashlib.md5(data[ends[i] : ends[i + 1]].tobytes()).digest()
        one[i], two[i] = int.from_bytes(h[:4], "big"), int.from_bytes(h[4:8], "big")
    return one, two


def _cells(keys: pa.Array, width: int, depth: int) -> list[np.ndarray]:
    h1, h2 = md5_halves(keys)
    return [((h1 + i * h2) & 0xFFFFFFFF) % width for i in range(depth)]


def linear(docs: DataFrame, width: int, depth: int, window: int = 3, strategy: str = "md5", best: int | None = None, min_freq: int = 1, exact_words: bool = False) -> DataFrame:
    """ESTIMATES of every key from the plain sketch of its part, as linear_estimate() gives them; of a pair also counts and estimates of its words, and n, of all words.

    The task counts a part's pairs twice: to fill the sketch, then to ask it. best: only pairs come that may be among so
    many with the greatest PPMI of their part, true (of counts of min_freq at least) or estimated (likewise; exact_words
    takes true counts of words); where neither is positive a pair has no rank.
    """
    if strategy != "md5":
        raise ValueError(f"keys are hashed by md5 here, not by {strategy}")

    def run(batches):
        for p in _parts(batches, window):
            held = np.zeros((depth, width), np.int64)

            def fill(keys, freq):
                for row, at in zip(held, _cells(keys, width, depth)):
                    row += np.bincount(at, freq, width).astype(np.int64)  # sums under 2^53 are exact

            def ask(keys):
                return np.min([row[at] for row, at in zip(held, _cells(keys, width, depth))], 0).astype(np.float64)

            for w, f in _cut(p.words, p.freq):
                fill(w, f)
            for found in p.pairs():
                for home, other, f in _cut(*found):
                    fill(p.text(home, other), f)
            words = np.concatenate([ask(w) for (w,) in _cut(p.words)])
            none = lambda m, t: pa.nulls(m, t)
            if not best:
                for w, f, e in _cut(p.words, p.freq, words):
                    m = len(f)
                    yield _batch(ESTIMATES, _same(p.number, m, pa.int32()), _same("word", m, pa.string()), w, f, e, none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), _same(p.n, m, pa.int64()))
            true, guess = (_Best(best), _Best(best)) if best else (None, None)
            for found in p.pairs():
                for home, other, f in _cut(*found):
                    a, b = p.both(home, other)
                    keys = p.text(a, b)
                    est = ask(keys)
                    if best:
                        e1, e2 = (p.freq[a], p.freq[b]) if exact_words else (words[a], words[b])
                        own = true.may(np.where(f >= min_freq, _ppmi(f, p.freq[a], p.freq[b], p.n), -1.0))
                        own |= guess.may(np.where(est >= min_freq, _ppmi(est, e1, e2, p.n), -1.0))
                        if not own.any():
                            continue
                        a, b, f, est, keys = a[own], b[own], f[own], est[own], keys.filter(pa.array(own))
                    m = len(f)
                    yield _batch(ESTIMATES, _same(p.number, m, pa.int32()), _same("pair", m, pa.string()), keys, f, est, p.freq[a], p.freq[b], words[a], words[b], _same(p.n, m, pa.int64()))

    return by_part(docs).mapInArrow(run, ESTIMATES)


def sketched(docs: DataFrame, specs: dict[str, dict], window: int = 3, best: int | None = None, min_freq: int = 1) -> DataFrame:
    """ESTIMATES with structure, of every key of the part's sketches as estimate(counts, build_docs(docs, specs, window)) gives them.

    The task fills a part's sketches in order of insertion, then counts its pairs and asks for each. best: as in linear().
    """
    from . import sketches

    schema = f"structure string, {ESTIMATES}"

    def run(batches):
        for p in _parts(batches, window):
            held = sketches._fresh(p.number, specs)
            seeds = {s.seed for s in held.values()}
            own_hash = {seed: city64_texts(p.words, seed) for seed in seeds}
            for keys, home, other in p.stream():
                text = p.text(home, other)
                hashes = {seed: np.r_[own_hash[seed], city64_texts(text, seed)] for seed in seeds}
                used, back = np.unique(keys, return_inverse=True)
                for s in held.values():
                    s.insert_keys(cells(hashes[s.seed][used], s.widths()), back)

            def ask(s, hashes):
                return s.read(cells(hashes[s.seed], s.widths()))

            words = {k: np.concatenate([ask(s, {s.seed: h}) for (h,) in _cut(own_hash[s.seed])]) for k, s in held.items()}
            none = lambda m, t: pa.nulls(m, t)
            for k in held if not best else ():
                for w, f, e in _cut(p.words, p.freq, words[k]):
                    m = len(f)
                    yield _batch(schema, _same(k, m, pa.string()), _same(p.number, m, pa.int32()), _same("word", m, pa.string()), w, f, e, none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), _same(p.n, m, pa.int64()))
            top = {k: (_Best(best), _Best(best)) for k in held} if best else {}
            for found in p.pairs():
                for home, other, freq in _cut(*found):
                    first, second = p.both(home, other)
                    text = p.text(first, second)
                    hashes = {seed: city64_texts(text, seed) for seed in seeds}
                    for k, s in held.items():
                        a, b, f, keys, est = first, second, freq, text, ask(s, hashes)
                        if best:
                            true, guess = top[k]
                            own = true.may(np.where(f >= min_freq, _ppmi(f, p.freq[a], p.freq[b], p.n), -1.0))
                            own |= guess.may(np.where(est >= min_freq, _ppmi(est, words[k][a], words[k][b], p.n), -1.0))
                            if not own.any():
                                continue
                            a, b, f, est, keys = a[own], b[own], f[own], est[own], keys.filter(pa.array(own))
                        m = len(f)
                        yield _batch(schema, _same(k, m, pa.string()), _same(p.number, m, pa.int32()), _same("pair", m, pa.string()), keys, f, est, p.freq[a], p.freq[b], words[k][a], words[k][b], _same(p.n, m, pa.int64()))

    return by_part(docs, ("doc_id",)).select("part", "text").mapInArrow(run, schema)


def _histogram(number: int, kind: str, freq: np.ndarray) -> pa.RecordBatch:
    f, keys = np.unique(freq, return_counts=True)
    return _batch(HISTOGRAM, _same(number, len(f), pa.int32()), _same(kind, len(f), pa.string()), f.astype(np.int64), keys.astype(np.int64))


def histogram(docs: DataFrame, window: int = 3) -> DataFrame:
    """(part, kind, freq, keys): how many words and pairs of a part have a frequency."""

    def run(batches):
        for p in _parts(batches, window):
            yield _histogram(p.number, "word", p.freq)
            for _, _, f in p.pairs():
                yield _histogram(p.number, "pair", f)

    return by_part(docs).mapInArrow(run, HISTOGRAM).groupBy("part", "kind", "freq").agg(F.sum("keys").alias("keys"))


def buckets_of(n_bytes: int) -> int:
    """Buckets of whole() for so many bytes of input: a bucket is one task's work."""
    return max(16, -(-n_bytes // BUCKET_BYTES))


def packed(docs: DataFrame, buckets: int, window: int = 3) -> DataFrame:
    """PACKED: each part's counts of words and pairs by bucket, as numbers of the words in that row; with the part's histogram, in rows of bucket -1 - part.

    A word's bucket is its hash, a pair's that of its home. A row holds the pairs of a bucket that a part has.
    """

    def run(batches):
        for p in _parts(batches, window):
            of = (p.word_hash() % np.uint64(buckets)).astype(np.int64)
            v, passes = len(p.words), max(1, -(-p.n * (window - 1) // PASS_PAIRS))
            held, seen = [], np.zeros(v, np.int64)

            def row(bucket, home, other, times, own):
                used = np.unique(np.r_[home, other, own])
                seen[used] = np.arange(len(used))
                words = SEP.join(p.words.take(pa.array(used)).to_pylist()).encode()
                return (bucket, words, *(seen[x].astype(np.uint32).tobytes() for x in (home, other)), times.astype(np.int64).tobytes(), seen[own].astype(np.uint32).tobytes(), p.freq[own].tobytes())

            per = -(-buckets // passes)
            alone = np.argsort(of, kind="stable")
            word_cuts = np.searchsorted(of[alone], np.arange(buckets + 1))
            done = np.zeros(buckets, bool)
            none = np.zeros(0, np.int64)

            def out(rows):
                kinds = (pa.int32(), *[pa.binary()] * 6)
                return _batch(PACKED, *(pa.array(c, t) for c, t in zip(zip(*rows), kinds)))

            hist: dict[str, list] = {"word": [np.unique(p.freq, return_counts=True)], "pair": []}
            for home, other, f in p.pairs(of // per, passes):
                hist["pair"].append(np.unique(f, return_counts=True))
                order = np.argsort(of[home], kind="stable")
                home, other, f = home[order], other[order], f[order]
                at = of[home]
                cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                for a, z in zip(cuts, cuts[1:]):
                    b = int(at[a])
                    done[b] = True
                    held.append(row(b, home[a:z], other[a:z], f[a:z], alone[word_cuts[b] : word_cuts[b + 1]]))
                    if len(held) >= 16:
                        yield out(held)
                        held = []
            for b in np.flatnonzero(~done & (np.diff(word_cuts) > 0)).tolist():
                held.append(row(b, none, none, none, alone[word_cuts[b] : word_cuts[b + 1]]))
            for kind, some in hist.items():
                if some:
                    freq, back = np.unique(np.concatenate([f for f, _ in some]), return_inverse=True)
                    keys = np.bincount(back, np.concatenate([n for _, n in some]), len(freq)).astype(np.int64)
                    held.append((-1 - p.number, kind.encode(), freq.tobytes(), keys.tobytes(), b"", b"", b""))
            if held:
                yield out(held)

    return by_part(docs).mapInArrow(run, PACKED)


def _buckets(batches) -> Iterator[tuple]:
    """(bucket, its rows) of packed rows that are sorted by bucket."""
    held, at = [], None
    for b in batches:
        for k, bucket in enumerate(b.column(0).to_pylist()):
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append([b.column(c)[k].as_py() for c in range(1, 7)])
    if held:
        yield at, held


def _merged(rows: list) -> tuple:
    """(words, their freq, which words those are, first and second word of pairs, freq) of a bucket's rows."""
    lists = [pa.array(r[0].decode().split(SEP)) for r in rows]
    every = pa.concat_arrays(lists).dictionary_encode()
    words, index, start = every.dictionary, every.indices.to_numpy().astype(np.int64), 0
    v, pairs, alone = len(words), [], np.zeros(len(words), np.int64)
    for r, own in zip(rows, lists):
        into = index[start : start + len(own)]
        start += len(own)
        home, other = (into[np.frombuffer(x, np.uint32)] for x in r[1:3])
        pairs.append((home * v + other, np.frombuffer(r[3], np.int64)))
        np.add.at(alone, into[np.frombuffer(r[4], np.uint32)], np.frombuffer(r[5], np.int64))
    keys, freq = _summed(pairs)
    which = np.flatnonzero(alone)
    return words, which, alone[which], keys // v, keys % v, freq


def whole(docs: DataFrame, buckets: int, window: int = 3) -> DataFrame:
    """(kind, key, freq) of the whole corpus, each key once."""
    schema = "kind string, key string, freq long"

    def run(batches):
        for bucket, rows in _buckets(batches):
            if bucket < 0:
                continue
            words, which, alone, home, other, freq = _merged(rows)
            for i, f in _cut(which, alone):
                yield _batch(schema, _same("word", len(f), pa.string()), words.take(pa.array(i)), f)
            rank = text_order(words)
            for a, b, f in _cut(home, other, freq):
                first = rank[a] < rank[b]
                text = pc.binary_join_element_wise(words.take(pa.array(np.where(first, a, b))), words.take(pa.array(np.where(first, b, a))), " ")
                yield _batch(schema, _same("pair", len(f), pa.string()), text, f)

    return _dealt(packed(docs, buckets, window), buckets).mapInArrow(run, schema)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """packed() rows, those of a bucket together; tasks take buckets in turn."""
    n = min(buckets, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartitionById(n, F.pmod(F.col("bucket"), F.lit(n)).cast("int")).sortWithinPartitions("bucket")


def series(docs: DataFrame, buckets: int, window: int = 3) -> DataFrame:
    """(part, kind, freq, keys): histogram() of parts and, as part 0, of the whole corpus."""

    def run(batches):
        for bucket, rows in _buckets(batches):
            if bucket < 0:
                for r in rows:
                    f, keys = (np.frombuffer(x, np.int64) for x in r[1:3])
                    yield _batch(HISTOGRAM, _same(-1 - bucket, len(f), pa.int32()), _same(r[0].decode(), len(f), pa.string()), f, keys)
                continue
            _, _, alone, _, _, freq = _merged(rows)
            yield _histogram(0, "word", alone)
            yield _histogram(0, "pair", freq)

    return _dealt(packed(docs, buckets, window), buckets).mapInArrow(run, HISTOGRAM).groupBy("part", "kind", "freq").agg(F.sum("keys").alias("keys"))
