"""Secret scans: a linear-chain conditional random field tags tokens as outside, begin or inside of a secret."""

from __future__ import annotations

import base64
import math
import random
import re
import string
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .crf import decode, scores, train

#: Labelled training sequences, made by sequences() below (none from a table); seed.
TRAIN_SEQUENCES, SEED = 2000, 11
OUT, BEGIN, INSIDE = 0, 1, 2
EDGE = "\"'`,;.()[]{}<>!?#$%&*|"
CUE = re.compile(r"(?i)(?:^|[^a-z])(?:[a-z0-9]*[_-])?(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|api[_-]?key|apikey|access[_-]?key|secret[_-]?key|private[_-]?key|auth|authorization|bearer|credentials?|client[_-]?secret)(?:[_-][a-z0-9]+)?$")
DECOY = re.compile(r"(?i)^(?:commit|sha\d*|md5|hash|checksum|etag|digest|uuid|guid|id|version|revision|order|invoice|isbn|serial|fingerprint)$")
PREFIX = re.compile(r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|pk_live|rk_live|xox[abprs]-|eyJ|AIza|ya29\.|SG\.|npm_|-----BEGIN)")
SHAPES = ("plain", "digits", "hex", "HEX", "mixed", "base64", "name", "marks", "assign", "numbers", "address", "uuid", "pem", "symbols")
#: Categories of a token: shape, length, variety of characters, cue. The numbers of values of each.
SIZES = (len(SHAPES), 8, 5, 8)
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")


def value_of(token: str) -> tuple[str, str, int]:
    """(key, value, offset of value) of a token: marks around it go, and what an = or : within it sets apart is the key."""
    if token.startswith("-----") or token.endswith("-----"):
        return "", token, 0
    m = re.match(r"^([\"'`{(\[<,]*[A-Za-z][\w.-]*[\"'`]?\s*)(?:=>|:=|=|:)(?!//)(.*[A-Za-z0-9].*)$", token, re.S)
    key, rest, at = (m.group(1), m.group(2), m.start(2)) if m else ("", token, 0)
    left = rest.lstrip(EDGE + ("=:" if m else ""))
    at += len(rest) - len(left)
    return key.strip(EDGE), left.rstrip(EDGE + ":"), at


@cache
def _shape(s: str) -> int:
    name = "symbols"
    if not s:
        name = "marks"
    elif s.startswith("-----") or s.endswith("-----"):
        name = "pem"
    elif s.isdigit():
        name = "digits"
    elif s.isalpha() and (len(s) < 24 or s[1:].islower() or s.isupper() or not s.isascii()):
        name = "plain"
    elif _UUID.match(s):
        name = "uuid"
    elif re.fullmatch(r"[0-9a-f]{16,}", s):
        name = "hex"
    elif re.fullmatch(r"[0-9A-F]{16,}", s):
        name = "HEX"
    elif "://" in s or re.match(r"^\S+@\S+\.\w+$", s):
        name = "address"
    elif re.fullmatch(r"[\d.,:/()+-]+", s):
        name = "numbers"
    elif re.fullmatch(r"[A-Za-z]+(?:[._-][A-Za-z]+)+", s):
        name = "name"
    elif re.fullmatch(r"[A-Za-z0-9]+", s):
        name = "mixed"
    elif re.fullmatch(r"[A-Za-z0-9+/_=.-]+", s):
        name = "base64"
    return SHAPES.index(name)


def categories(token: str) -> tuple[int, int, int, int]:
    key, value, _ = value_of(token)
    core = token.strip(EDGE.replace("=", ""))
    shape = SHAPES.index("assign") if not any(c.isalnum() for c in token) and ("=" in token or ":" in token) else _shape.__wrapped__(value)
    n = len(value)
    counts = Counter(value).values() if n > 7 else ()
    bits = -sum(c / n * math.log2(c / n) for c in counts)
    variety = 0 if n < 8 else 1 if bits < 2.5 else 2 if bits < 3.2 else 3 if bits < 4 else 4
    cue = 0
    if PREFIX.match(value):
        cue = 5
    elif key and CUE.search(key):
        cue = 4
    elif key:
        cue = 6
    elif CUE.search(core.rstrip("=: ")):
        cue = 2 if core[-1:] in "=:" or token[-1:] in "=:" else 1
    elif DECOY.match(core.rstrip("=: ")):
        cue = 3
    elif token[:1] in "\"'`":
        cue = 7
    return shape, min(7, max(0, n.bit_length() if n < 64 else 7)), variety, cue


PLAIN_CATEGORIES = (SHAPES.index("plain"), 3, 0, 0)
#: Where each group of features begins: categories here, one and two before, one after; shape with the cue one and two before; shape with cue; the file's.
_BLOCK = sum(SIZES)
_CROSS = SIZES[0] * SIZES[3]
FILE = 6
N_FEATS = 4 * (_BLOCK + 1) + 4 * _CROSS + FILE


def features(cats: np.ndarray, seq: np.ndarray, file: np.ndarray) -> np.ndarray:
    """(tokens, k) feature indices; cats: (tokens, 4); seq: the sequence of each token; file: its file's category."""
    out, at, n = [], 0, len(cats)

    def shifted(k):
        idx = np.clip(np.arange(n) + k, 0, max(0, n - 1))
        return idx, seq[idx] == seq if n else np.zeros(0, bool)

    near = {}
    for k in (0, -1, -2, 1):
        idx, same = shifted(k)
        same = same & (np.arange(n) + k >= 0) & (np.arange(n) + k < n)
        near[k] = (cats[idx], same)
        base = at
        for j, size in enumerate(SIZES):
            out.append(np.where(same, base + cats[idx, j], at + _BLOCK))
            base += size
        at += _BLOCK + 1
    shape, cue = cats[:, 0], cats[:, 3]
    for k in (-1, -2, 1):
        c, same = near[k]
        out.append(at + shape * SIZES[3] + np.where(same, c[:, 3], 0))
        at += _CROSS
    out.append(at + shape * SIZES[3] + cue)
    at += _CROSS
    out.append(at + file)
    return np.stack(out, 1).astype(np.int32)


def emissions(w: np.ndarray, table_: np.ndarray, codes: np.ndarray, row: np.ndarray, file: np.ndarray) -> np.ndarray:
    """(tokens, states) scores of the tokens table_[codes] of texts row, whose files have the categories file.

    What features() and scores() give, each distinct surrounding scored once: the categories of a token, of the two before
    it and the one after, where those belong to its text, and the file's.
    """
    kinds, own = np.unique(table_, axis=0, return_inverse=True)
    own, n = own.reshape(-1)[codes], len(codes)
    code = file[row].astype(np.int64)
    for k in (-2, -1, 0, 1):
        at = np.arange(n) + k
        idx = np.clip(at, 0, n - 1)
        code = code * (len(kinds) + 1) + np.where((at == idx) & (row[idx] == row), own[idx] + 1, 0)
    _, first, where = np.unique(code, return_index=True, return_inverse=True)
    out = np.empty((len(first), w.shape[1]))
    for a in range(0, len(first), 1 << 16):
        part = first[a : a + (1 << 16)]
        ctx = part[:, None] + np.array([-2, -1, 0, 1])
        idx = np.clip(ctx, 0, n - 1)
        # a window of four tokens for each, so that shifts stay within
        each = np.arange(len(part))[:, None]
        owner = np.where((ctx == idx) & (row[idx] == row[part][:, None]), each, -1 - each).reshape(-1)
        out[a : a + len(part)] = scores(w, features(table_[codes[idx]].reshape(-1, 4), owner, np.repeat(file[row[part]], 4))[2::4])
    return out[where.reshape(-1)]


def file_category(interesting: int, tokens: int) -> int:
    """How much of a file isn't prose, in six steps."""
    share = interesting / max(1, tokens)
    return int(np.searchsorted([0.01, 0.05, 0.15, 0.35, 0.7], share, "right"))


def _secret(rng: random.Random) -> list[str]:
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    kind = rng.randrange(13)
    if kind == 0:
        return [pick("0123456789abcdef", rng.choice((32, 40, 64)))]
    if kind == 1:
        return [pick("0123456789ABCDEF", rng.choice((32, 40, 64)))]
    if kind == 2:
        return [pick(alnum, rng.randint(16, 48))]
    if kind == 3:
        return [pick(b64, rng.choice((27, 39, 43, 63))) + "="]
    if kind == 4:
        return [pick(alnum, 4) + rng.choice("!@#-_") + pick(alnum, rng.randint(4, 10))]
    if kind == 5:
        return ["AKIA" + pick(string.ascii_uppercase + string.digits, 16)]
    if kind == 6:
        return [rng.choice(("ghp_", "gho_", "glpat-", "sk_live_", "npm_")) + pick(alnum, 36)]
    if kind == 7:
        return ["eyJ" + pick(alnum, 20) + ".eyJ" + pick(alnum, 40) + "." + pick(alnum + "_-", 43)]
    if kind == 8:
        return [rng.choice(("xoxb-", "xoxp-")) + pick("0123456789", 11) + "-" + pick(alnum, 24)]
    if kind == 9:
        return ["-----BEGIN", "RSA", "PRIVATE", "KEY-----", *(pick(b64, 64) for _ in range(rng.randint(2, 5))), pick(b64, 30) + "==", "-----END", "RSA", "PRIVATE", "KEY-----"]
    if kind == 10:
        return [base64.b64encode(rng.randbytes(rng.randint(15, 40))).decode()]
    if kind == 11:
        return [pick(alnum, rng.randint(8, 15))]
    return [pick(string.ascii_letters, rng.randint(8, 15)) if rng.random() < 0.5 else "".join(_syllables(rng, rng.randint(3, 5)).capitalize() for _ in range(2))[:15]]


def _syllables(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(("th", "an", "er", "de", "la", "ó", "ei", "st", "ti", "on", "ü", "re", "in", "é", "es")) for _ in range(n))


def _word(rng: random.Random) -> str:
    w = _syllables(rng, rng.randint(1, 5))
    w = w.capitalize() if rng.random() < 0.1 else w.upper() if rng.random() < 0.03 else w
    return w + rng.choice(("", "", "", "", "", ".", ",", ";", "!", "?", "%%%", "###", "!!", "***"))


def _decoy(rng: random.Random) -> list[str]:
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexs = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64))))
    return rng.choice([
        [rng.choice(("commit", "sha256", "md5:", "etag:", "checksum", "hash", "revision")), hexs], [digits(16)], ["+1", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}"], [f"{_word(rng).strip('.,;!?%#*')}.{digits(2)}@mail{digits(1)}.example.com"],
        [f"https://example.com/{digits(6)}?page={digits(1)}"], ["uuid", f"{hexs[:8]}-{hexs[:4]}-{hexs[4:8]}-{hexs[8:12]}-{hexs[12:24]}"], ["the", rng.choice(("token", "password", "secret", "key")), rng.choice(("is", "of", "was", "for")), _word(rng)], [rng.choice(("password:", "token:", "auth:")), rng.choice(("required", "none", "optional", "see"))],
        ["key", "=", _word(rng)], ["n", "=", digits(4)], [digits(3) + "."], ["order", digits(10)], [f"v{digits(1)}.{digits(1)}.{digits(2)}"], ["©", digits(4)], ["|", _word(rng), "|", digits(5), "|"], [f"snake_case_{_word(rng).strip('.,;!?%#*')}"], ["serial", "AB" + digits(10)], [f'"{_syllables(rng, rng.randint(2, 7))}"'], ["the", rng.choice(("token", "password", "secret", "key")), f'"{_syllables(rng, rng.randint(2, 3))}"', "is"],
    ])


def sequences(n: int, seed: int):
    """n labelled token sequences: prose with secrets in it, with decoys, or with neither."""
    rng, out = random.Random(seed), []
    names = ("token", "secret", "password", "passwd", "api_key", "apikey", "API_KEY", "access_key", "SECRET_KEY", "auth", "auth_token", "client_secret", "Authorization", "Bearer", "TOKEN", "Password", "db_password", "private_key", "credential", "pwd")
    for _ in range(n):
        tokens, labels = [], []

        def add(words, label=OUT):
            tokens.extend(words)
            labels.extend([label] * len(words))

        add([_word(rng) for _ in range(rng.randint(0, 9))])
        for _ in range(rng.choice((1, 1, 2))):
            noise = rng.choice(("", "", "", "", "%%%", "###", "&&&", "!!", "***", "$$$", ",", "."))
            if rng.random() < 0.55:
                secret, name, quote = _secret(rng), rng.choice(names), rng.choice(("", '"', '"', "'", "`"))
                if secret[0].isalpha():  # nothing but quotes tells letters from a word
                    quote = quote or '"'
                form = rng.randrange(6)
                strong = bool(PREFIX.match(secret[0]))
                if len(secret) > 1:
                    form = rng.choice((0, 1, 5))
                if form == 5 and strong:
                    pass  # stands by itself
                elif form in (0, 5):
                    add([name + rng.choice(("", "", noise)), rng.choice(("=", ":", ":=", "=>")) + rng.choice(("", noise))])
                elif form == 1:
                    add([name + rng.choice((":", "="))])
                elif form == 2 and len(secret) == 1:
                    secret = [rng.choice(("", "{", '"', "--")) + name + rng.choice(("=", ":", '":')) + quote + secret[0]]
                elif form == 3:
                    add(["Authorization:", "Bearer"])
                else:
                    add([name, "is:" if rng.random() < 0.5 else "="])
                if form != 2:
                    secret[0] = quote + secret[0]
                secret[-1] += quote + noise
                add(secret[:1], BEGIN)
                add(secret[1:], INSIDE)
            elif rng.random() < 0.85:
                d = _decoy(rng)
                d[-1] += noise
                add(d)
            add([_word(rng) for _ in range(rng.randint(0, 9))])
        if tokens:
            out.append((tokens, labels))
    return out


@cache
def model(n: int = TRAIN_SEQUENCES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions, trained once in a process."""
    data = sequences(n, seed)
    t = max(len(x) for x, _ in data)
    cats = np.array([categories(w) for x, _ in data for w in x])
    seq = np.repeat(np.arange(len(data)), [len(x) for x, _ in data])
    rng = random.Random(seed)
    file = np.repeat([rng.randrange(FILE) for _ in data], [len(x) for x, _ in data])  # the generator's sequences have no files
    for k, (x, y) in enumerate(data):
        if rng.random() < 0.5:
            plain = sum(categories(w) == PLAIN_CATEGORIES for w in x)
            file[seq == k] = file_category(len(x) - plain, len(x) * 6)
    f = features(cats, seq, file)
    feats = np.zeros((len(data), t, f.shape[1]), np.int32)
    labels = np.zeros((len(data), t), np.int64)
    lengths = np.array([len(x) for x, _ in data])
    at = np.concatenate([np.arange(k) for k in lengths])
    feats[seq, at] = f
    labels[seq, at] = [y for _, ys in data for y in ys]
    w, tr = train(feats, labels, lengths, N_FEATS)
    return w.astype(np.float32), tr.astype(np.float32)


def tag(texts: pa.Array, w: np.ndarray, tr: np.ndarray):
    """(row, start, end, value) of each secret in an array of texts without nulls."""
    lists = pc.utf8_split_whitespace(texts)
    flat, n_each = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    row = np.repeat(np.arange(len(texts)), n_each)
    full = pc.not_equal(pc.binary_length(flat), 0)
    flat, row = flat.filter(full), row[full.to_numpy(zero_copy_only=False)]
    if not len(flat):
        return []
    coded = flat.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy()
    table_ = np.array([categories(x) for x in words.to_pylist()])
    plain = (table_ == np.array(PLAIN_CATEGORIES)).all(1)
    odd = ~plain[codes]
    size = np.bincount(row, minlength=len(texts))
    share = np.bincount(row, odd, minlength=len(texts)) / np.maximum(1, size)
    file = np.searchsorted([0.01, 0.05, 0.15, 0.35, 0.7], share, "right")
    starts = np.flatnonzero(np.r_[True, np.diff(row) > 0])
    e = emissions(w, table_, codes, row, file)
    labels = decode(e, tr.astype(np.float64), starts)
    out = []
    at = np.flatnonzero(labels != OUT)
    begins = [int(i) for i in at if labels[i] == BEGIN or i == 0 or labels[i - 1] == OUT or row[i - 1] != row[i]]
    by_row: dict[int, list[int]] = {}
    for i in begins:
        by_row.setdefault(int(row[i]), []).append(i)
    first = dict(zip(row[starts].tolist(), starts.tolist()))
    for r, hits in by_row.items():
        text, pos, i = texts[r].as_py(), 0, first[r]
        for b in hits:
            end = b
            while end + 1 < len(row) and row[end + 1] == r and labels[end + 1] == INSIDE:
                end += 1
            while i <= end:
                word = flat[i].as_py()
                p = text.index(word, pos)
                if i == b:
                    _, value, off = value_of(word)
                    start = p + off
                    stop = start + len(value)
                elif i == end:
                    stop = p + len(word.rstrip(EDGE))
                pos, i = p + len(word), i + 1
            if stop > start:
                out.append((r, start, stop, text[start:stop]))
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, value) of each secret; start and end count characters from 0.

    Tokens are what white space parts. A conditional random field scores each as outside, begin or inside from its shape,
    length, variety and cues, those of two tokens before and one after, and how much of the file isn't prose; Viterbi
    decodes whole texts. Its weights are trained on TRAIN_SEQUENCES generated sequences in the driver, in a few seconds,
    and go to the executors with the function (a few kilobytes). No row moves.

    Null, empty and clean texts give no rows; a null doc_id gives rows with a null doc_id; repeated rows give theirs each
    time. Columns other than doc_id and text aren't looked at. An empty table gives no rows.
    """
    w, tr = model()

    def run(batches):
        for b in batches:
            some = pc.is_valid(b.column(1))
            ids, texts = b.column(0).filter(some), b.column(1).filter(some)
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False) if len(texts) else np.zeros(0)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // (16 << 20))) + 1).tolist(), len(texts)]
            for a, z in zip(cuts, cuts[1:]):
                found = tag(texts.slice(a, z - a), w, tr) if z > a else []
                own = ids.slice(a, z - a).take(pa.array([x[0] for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array([x[3] for x in found], pa.string())], ["doc_id", "start", "end", "value"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, start int, end int, value string")


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
