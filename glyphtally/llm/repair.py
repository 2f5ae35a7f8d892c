"""Token-id output as Re-Pair grammars with random access."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Vocabulary of the tokenizer, as base64 ranks; its pattern; tokens of a shard; least occurrences of a pair that gets a rule; bytes of text that are tokenized at a time.
#: A rule is three numbers (two symbols and a length) and saves one for each use, so a pair that occurs three times or less doesn't pay.
VOCABULARY, SHARD_TOKENS, MIN_COUNT, BATCH_BYTES = "/opt/tokenizers/byte_bpe_50k.tiktoken", 1 << 20, 4, 1 << 23
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of PATTERN; a blank that more of it surrounds, or that ends a run of it and the text, is inside one match. First and last bytes that its characters may have.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INSIDE = re.compile(rf"[{WHITE}] (?:[{WHITE}]|\Z)")
OPENS, CLOSES = (np.isin(np.arange(256), x) for x in ([*range(9, 14), 32, 0xC2, 0xE1, 0xE2, 0xE3], [*range(9, 14), 32, *range(0x80, 0xB0)]))
SHARDS = "shard string, n_docs int, n_tokens bigint, vocabulary int, doc_ids array<bigint>, starts array<bigint>, symbols binary, rules binary, lengths binary"


@lru_cache(2)
def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Words:
    """Tokenizes batches by distinct words: a text without blanks inside white space falls apart before each blank without a change to its tokens."""

    def __init__(self, enc: tiktoken.Encoding, most: int = 1 << 20, most_bytes: int = 1 << 26):
        self.enc, self.most, self.most_bytes = enc, most, most_bytes
        self.blank = np.zeros(enc.n_vocab, bool)
        self.blank[[i for b, i in enc._mergeable_ranks.items() if b[:1] == b" "]] = True
        self.clear()

    def clear(self):
        self.known = pa.array([], pa.string())
        self.every, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, every: np.ndarray, size: np.ndarray) -> int:
        """Keep the ids of words; the number of the first one."""
        at = len(self.size)
        self.every, self.size = np.concatenate([self.every, every]), np.concatenate([self.size, size])
        return at

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of texts, one by one."""
        # Arrow's strings are sound, so what the wrapper of encode_ordinary() checks needs no check
        found = list(map(self.enc._core_bpe.encode_ordinary, texts))
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def joined(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of words with a blank before each, as one text: words have no blanks and no white space at their ends, so none of its tokens lies in two words, and those that begin with a blank begin a word."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.enc._core_bpe.encode_ordinary(" " + text), np.int32)
        return ids, np.diff(np.r_[np.flatnonzero(self.blank[ids]), len(ids)])

    def coded(self, texts: pa.Array):
        """(codes, first, n_words): words as numbers of what is kept, where each text's begin, how many they are."""
        if len(self.known) > self.most or self.known.nbytes > self.most_bytes:
            self.clear()
        texts = texts.cast(pa.string())
        whole = unsplit(texts) | pc.less(pc.binary_length(texts), 64).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        flat = lists.flatten()
        n_words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(n_words) - n_words
        coded = flat.dictionary_encode()
        words = coded.dictionary
        number = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(number < 0)
        words = words.take(pa.array(new))
        size = pc.binary_length(words)
        solid = pc.and_(pc.equal(pc.binary_length(pc.utf8_trim_whitespace(words)), size), pc.greater(size, 0)).to_numpy(zero_copy_only=False)
        for some, encoded in ((solid, self.joined), (~solid, lambda x: self.each([" " + w for w in x.to_pylist()]))):
            if some.any():
                found = words.filter(pa.array(some))
                at = self.add(*encoded(found))
                number[new[some]] = np.arange(at, at + len(found))
                self.known = pa.concat_arrays([self.known, found])
        codes = number[coded.indices.to_numpy()]
        # the first word of a text has no blank before it, and a text that isn't split is its own first word; these aren't kept
        at = self.add(*self.each([texts[k].as_py() if whole[k] else flat[i].as_py() for k, i in enumerate(first.tolist())]))
        codes[first] = np.arange(at, at + len(first))
        return codes, first, n_words

    def forget(self, n: int):
        """Drop the n words that were added last."""
        kept = len(self.size) - n
        self.size, self.every = self.size[:kept], self.every[: int(self.size[:kept].sum())]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, of texts without nulls."""
        if not len(texts):
            return np.zeros(0, np.int64)
        codes, first, _ = self.coded(texts)
        out = np.add.reduceat(self.size[codes], first)
        self.forget(len(first))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts without nulls."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes, first, _ = self.coded(texts)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(self.size)], pa.int32()), pa.array(self.every))
        ids = lists.take(pa.array(codes)).flatten().to_numpy()
        n_each = np.add.reduceat(self.size[codes], first)
        self.forget(len(first))
        return ids, n_each


def unsplit(texts: pa.Array) -> np.ndarray:
    """Whether a text, of texts without nulls, has doubled blanks or INSIDE: these may not be cut before each blank."""
    out = np.zeros(len(texts), bool)
    _, offsets, data = texts.buffers()
    if data is None:
        return out
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    k = np.flatnonzero(data[at[0] : at[-1]] == 32) + at[0]
    # what follows a blank may be white space by its first byte, or the text ends
    ends = at[1:][np.diff(at) > 0] - 1
    k = np.r_[k[OPENS[data[np.minimum(k + 1, len(data) - 1)]]], ends[data[ends] == 32]]
    row = np.searchsorted(at, k, "right") - 1
    two = (k + 1 < at[row + 1]) & (data[np.minimum(k + 1, len(data) - 1)] == 32)
    out[row[two]] = True
    for i in np.unique(row[~two & (k > at[row]) & CLOSES[data[k - 1]]]).tolist():
        out[i] = out[i] or INSIDE.search(texts[i].as_py()) is not None
    return out


def frequent(code: np.ndarray, least: int):
    """(pairs, counts, good, k): the values that code has least times or more, in order, where code has one, and which."""
    bits = max(10, len(code).bit_length())
    slot = lambda c: ((c.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
    slots = slot(code)
    # pairs whose slot is hit too seldom can't be frequent; only the others are sorted and counted
    good = np.flatnonzero((np.bincount(slots, minlength=1 << bits) >= least)[slots])
    code, slots = code[good], slots[good]
    s = np.sort(code)
    edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[edge, len(s)])
    some = counts >= least
    pairs, counts = s[edge[some]], counts[some]
    if not len(pairs):
        return pairs, counts, good[:0], good[:0]
    # a slot leads to one of its pairs; where that is another one, the pair is looked for
    to = np.full(1 << bits, -1, np.int32)
    to[slot(pairs)] = np.arange(len(pairs), dtype=np.int32)
    k = to[slots]
    hit = np.flatnonzero(k >= 0)
    code, good, k = code[hit], good[hit], k[hit].astype(np.int64)
    other = np.flatnonzero(pairs[k] != code)
    k[other] = np.minimum(np.searchsorted(pairs, code[other]), len(pairs) - 1)
    same = np.ones(len(k), bool)
    same[other] = pairs[k[other]] == code[other]
    return pairs, counts, good[same], k[same]


def chosen(pairs: np.ndarray, counts: np.ndarray, k: np.ndarray, near: np.ndarray, min_count: int):
    """(which of the pairs get rules, which occurrences are replaced), of occurrences k in order; near: whether one begins where the one before it ends.

    Where chosen pairs overlap the more frequent one wins (among equals the lower), and in a run of one symbol every
    second pair.
    """
    rank = np.empty(len(pairs), np.int64)
    rank[np.lexsort((pairs, -counts))] = np.arange(len(pairs))
    p = rank[k]
    same = near & np.r_[False, p[1:] == p[:-1]]
    if same.any():
        first = np.maximum.accumulate(np.where(~same, np.arange(len(k)), 0))
        use = np.flatnonzero((np.arange(len(k)) - first) % 2 == 0)
        near = near[use] & np.r_[False, np.diff(use) == 1]
        p = p[use]
    else:
        use = np.arange(len(k))
    near = near[1:]
    worse = np.zeros(len(use), bool)
    worse[1:] |= near & (p[:-1] < p[1:])
    worse[:-1] |= near & (p[1:] < p[:-1])
    use = use[~worse]
    ok = (np.bincount(k[use], minlength=len(pairs)) >= max(2, min_count // 2)) | (rank == 0)
    return ok, use[ok[k[use]]]


def replace_round(seq: np.ndarray, last: np.ndarray, next_id: int, least: int, min_count: int):
    """One round: pairs that occur least times or more become nonterminals; None if there is no such pair. A pair never goes over the end of a document.

    (seq, last, rules, where pairs may be frequent in the next round if least is min_count); seq and last as given are written over.
    """
    may = (np.bincount(seq) >= least)[seq]  # a pair is no more frequent than its symbols
    at = np.flatnonzero(may[:-1] & may[1:] & ~last[:-1])
    pairs, counts, good, k = frequent((seq[at].astype(np.int64) << 32) | seq[at + 1], least)
    if not len(pairs):
        return None
    at = at[good]
    ok, use = chosen(pairs, counts, k, np.r_[False, np.diff(at) == 1], min_count)
    hit = at[use]
    seq[hit] = next_id + (np.cumsum(ok) - 1)[k[use]]
    last[hit] = last[hit + 1]
    keep = np.ones(len(seq), bool)
    keep[hit + 1] = False
    again = np.zeros(0, np.int64)
    if least == min_count:
        place = np.cumsum(keep) - 1
        hit = place[hit]
        again = np.concatenate([place[at[keep[at]]], hit, hit[hit > 0] - 1])
    return seq[keep], last[keep], np.stack([pairs[ok] >> 32, pairs[ok] & 0xFFFFFFFF], 1), again


def finish(seq: np.ndarray, last: np.ndarray, next_id: int, least: int, at: np.ndarray):
    """(seq, last, rules of each round): rounds after one with the same least, until there is no such pair, as replace_round() makes them.

    at is where that round says that pairs may be frequent. A pair of symbols that were there before a round doesn't get
    more frequent by it, so of those only the ones that were frequent are counted again, and all that have a new symbol.
    Symbols that go are passed over by links, and what is left moves up once, in the end.
    """
    after, before = np.arange(1, len(seq) + 1, dtype=np.int32), np.arange(-1, len(seq) - 1, dtype=np.int32)
    keep, rules, mark = np.ones(len(seq), bool), [], np.zeros(len(seq), bool)
    while True:
        mark[at] = True
        at = np.flatnonzero(mark)  # in order, each once
        mark[at] = False
        at = at[~last[at] & (after[at] < len(seq))]
        pairs, counts, good, k = frequent((seq[at].astype(np.int64) << 32) | seq[after[at]], least)
        if not len(pairs):
            return seq[keep], last[keep], rules
        at = at[good]
        ok, use = chosen(pairs, counts, k, np.r_[False, after[at[:-1]] == at[1:]], least)
        hit = at[use]
        gone = after[hit]
        seq[hit] = next_id + (np.cumsum(ok) - 1)[k[use]]
        last[hit] = last[gone]
        keep[gone] = False
        after[hit] = beyond = after[gone]
        inside = beyond < len(seq)
        before[beyond[inside]] = hit[inside]
        rules.append(np.stack([pairs[ok] >> 32, pairs[ok] & 0xFFFFFFFF], 1))
        next_id += len(rules[-1])
        left = before[hit]
        at = np.concatenate([at[keep[at]], hit, left[left >= 0]])


def compress(seq: np.ndarray, ends: np.ndarray, vocabulary: int, min_count: int = MIN_COUNT):
    """(symbols, end of each document in symbols, rules (n, 2), expansion lengths of the rules) of token ids.

    ends has, increasing, where documents end in seq. Symbols under vocabulary are tokens; vocabulary + i is rule i.
    """
    seq = seq.astype(np.int32)
    last = np.zeros(len(seq), bool)
    some = np.diff(np.r_[0, ends]) > 0
    last[ends[some] - 1] = True
    rules: list[np.ndarray] = []
    n = vocabulary
    least = max(min_count, len(seq) >> 8)
    while len(seq) > 1:
        r = replace_round(seq, last, n, least, min_count)
        if r is not None:
            seq, last, found, again = r
            rules.append(found)
            n += len(found)
        if least == min_count:
            if r is not None:
                seq, last, found = finish(seq, last, n, least, again)
                rules += found
                n += sum(map(len, found))
            break
        least = max(min_count, least // 4)
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    size = np.ones(n, np.int64)
    at = vocabulary
    for r in rules:  # a round's rules refer to those of earlier rounds only
        size[at : at + len(r)] = size[r[:, 0]] + size[r[:, 1]]
        at += len(r)
    out = np.zeros(len(ends), np.int64)
    out[some] = np.flatnonzero(last) + 1
    return seq.astype(np.int64), np.maximum.accumulate(out) if len(out) else out, all_rules, size[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Tokens start to stop of what symbols stand for; only what overlaps is expanded, by the expansion lengths."""
    size = np.where(symbols < vocabulary, 1, lengths[np.maximum(symbols - vocabulary, 0)] if len(lengths) else 1)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    start, stop = max(0, start), total if stop is None else min(stop, total)
    if start >= stop:
        return np.zeros(0, np.int64)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
    skip, out = start - int(ends[a] - size[a]), []
    want = stop - start
    todo = [int(x) for x in symbols[a : b + 1][::-1]]
    while todo and len(out) < want:
        x = todo.pop()
        if x < vocabulary:
            if skip:
                skip -= 1
            else:
                out.append(x)
        elif skip >= (n := int(lengths[x - vocabulary])):
            skip -= n
        else:
            todo += [int(rules[x - vocabulary, 1]), int(rules[x - vocabulary, 0])]
    return np.array(out, np.int64)


def as_bytes(x: np.ndarray) -> bytes:
    """Little-endian ids of two bytes if they fit, else four; the first byte says how many."""
    kind = "<u2" if not len(x) or x.max() < 1 << 16 else "<u4"
    return bytes([int(kind[2])]) + np.ascontiguousarray(x, kind).tobytes()


def from_bytes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64)


def tokens_of(shard, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Token ids of the doc-th document of a row of grammars(), or of a range of it, without decoding the rest."""
    symbols = from_bytes(bytes(shard["symbols"]))[shard["starts"][doc] : shard["starts"][doc + 1]]
    return expand(symbols, from_bytes(bytes(shard["rules"])).reshape(-1, 2), from_bytes(bytes(shard["lengths"])), shard["vocabulary"], start, stop)


def grammars(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per shard of documents: their token ids as a grammar.

    Texts are tokenized with the byte-level BPE vocabulary at the path given, which the driver reads and broadcasts (a
    fixed size of a megabyte). Documents that come one after another in a partition make a shard, which ends with the
    document that brings it to shard_tokens; no row is shuffled. In rounds, the most frequent pairs of neighbouring
    symbols within documents are replaced by nonterminals, from a threshold that falls to min_count on, until none occurs min_count times. starts has where each
    document's symbols begin, and the end; symbols, rules (left, right) and lengths (tokens that a rule stands for) are
    ids of two or four bytes, see as_bytes(); tokens_of() decodes any range of any document. The shard's name is made of
    the partition and a running number. Shards depend on how the input is split; what they decode to doesn't.

    Rows with null text are left out; empty texts are documents without tokens; a null doc_id is listed as null. Repeated
    rows are listed each time. A text longer than a shard is in one shard, whole. Columns other than doc_id and text aren't
    looked at. An empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        from pyspark import TaskContext

        enc = encoding(shared.value)
        size, task, number = enc.n_vocab, TaskContext.get().partitionId(), 0
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal ids, parts, held, number
            seq = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            ends = np.cumsum([len(p) for p in parts])
            symbols, stops, rules, lengths = compress(seq, ends, size, min_count)
            row = [f"{task}-{number}"], [len(ids)], [len(seq)], [size], [ids], [[0, *stops.tolist()]], [as_bytes(symbols)], [as_bytes(rules.reshape(-1))], [as_bytes(lengths)]
            types = pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
            ids, parts, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], [c.split()[0] for c in SHARDS.split(", ")])

        words = Words(enc)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // BATCH_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):
                tokens, n_each = words.encode(texts.slice(a, z - a))
                for k, part in zip(keys[a:z], np.split(tokens, np.cumsum(n_each)[:-1])):
                    ids.append(k)
                    parts.append(part)
                    held += len(part)
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, SHARDS)


def op2_token_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grammars(table(spark, sf_dir, "documents"))
