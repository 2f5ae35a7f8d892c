"""Hashes for sketches: CityHash64 (version 1.0) over numpy arrays, and JVM alternatives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

U = np.uint64
K0, K1, K2, K3 = U(0xC3A5C85C97CB3127), U(0xB492B66FBE98F273), U(0x9AE16A3B2F90404F), U(0xC949D7C7509E6557)
MUL = U(0x9DDFEA08EB382D69)
MASK = 0xFFFFFFFF


def _rot(x, n):
    n = np.asarray(n, U)
    return np.where(n == 0, x, (x >> n) | (x << ((U(64) - n) & U(63))))


def _mix(x):
    return x ^ (x >> U(47))


def _pair(u, v):
    a = _mix((u ^ v) * MUL)
    return _mix((v ^ a) * MUL) * MUL


class _Group:
    """Byte strings of one length as rows of a matrix; at(i) are 64-bit words from byte i on, negative from the end."""

    def __init__(self, rows: list[bytes], n: int):
        self.m, self.n = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), n), n

    def at(self, i: int, size: int = 8):
        i = i if i >= 0 else self.n + i
        return np.ascontiguousarray(self.m[:, i : i + size]).view(f"<u{size}").reshape(-1).astype(U)


def _weak(w, x, y, z, a, b):
    a = a + w
    b = _rot(b + a + z, 21)
    c = a
    a = a + x + y
    return a + z, b + _rot(a, 44) + c


def _weak_at(g, i, a, b):
    i = i if i >= 0 else g.n + i
    return _weak(g.at(i), g.at(i + 8), g.at(i + 16), g.at(i + 24), a, b)


def _one_length(g: _Group):
    n = U(g.n)
    if g.n == 0:
        return np.full(len(g.m), K2, U)
    if g.n < 4:
        a, b, c = (g.m[:, i].astype(U) for i in (0, g.n >> 1, g.n - 1))
        return _mix((a + (b << U(8))) * K2 ^ (n + (c << U(2))) * K3) * K2
    if g.n <= 8:
        return _pair(n + (g.at(0, 4) << U(3)), g.at(-4, 4))
    if g.n <= 16:
        b = g.at(-8)
        return _pair(g.at(0), _rot(b + n, g.n)) ^ b
    if g.n <= 32:
        a, b, c, d = g.at(0) * K1, g.at(8), g.at(-8) * K2, g.at(-16) * K0
        return _pair(_rot(a - b, 43) + _rot(c, 30) + d, a + _rot(b ^ K3, 20) - c + n)
    if g.n <= 64:

        def half(z, a, i):
            b, c = _rot(a + z, 52), _rot(a, 37)
            a = a + g.at(i)
            c = c + _rot(a, 7)
            a = a + g.at(i + 8)
            return a + z, b + _rot(a, 31) + c

        vf, vs = half(g.at(24), g.at(0) + (n + g.at(-16)) * K0, 8)
        wf, ws = half(g.at(-8), g.at(16) + g.at(-32), g.n - 24)
        r = _mix((vf + ws) * K2 + (wf + vs) * K0)
        return _mix(r * K0 + vs) * K2
    x, y = g.at(-40), g.at(-16) + g.at(-56)
    z = _pair(g.at(-48) + n, g.at(-24))
    v = _weak_at(g, -64, np.full(len(g.m), n, U), z)
    w = _weak_at(g, -32, y + K1, x)
    x = x * K1 + g.at(0)
    for i in range(0, (g.n - 1) & ~63, 64):
        x = _rot(x + y + v[0] + g.at(i + 8), 37) * K1 ^ w[1]
        y = _rot(y + v[1] + g.at(i + 48), 42) * K1 + v[0] + g.at(i + 40)
        z = _rot(z + w[0], 33) * K1
        v = _weak_at(g, i, v[1] * K1, x + w[0])
        w = _weak_at(g, i + 32, z + w[1], y + g.at(i + 16))
        z, x = x, z
    return _pair(_pair(v[0], w[0]) + _mix(y) * K1 + z, _pair(v[1], w[1]) + x)


def city64_bytes(keys: list[bytes], seed: int = 42) -> np.ndarray:
    """Seeded CityHash64 of byte strings, as uint64; strings of one length are hashed at once."""
    out = np.zeros(len(keys), U)
    by_length: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        by_length.setdefault(len(k), []).append(i)
    with np.errstate(over="ignore"):
        for n, where in by_length.items():
            out[where] = _pair(_one_length(_Group([keys[i] for i in where], n)) - K2, np.full(len(where), U(seed), U))
    return out


def as_key(x) -> bytes:
    """The bytes that are hashed: bytes as they are, anything else by its repr, so that a string has its quotes."""
    return x if isinstance(x, bytes) else repr(x).encode()


def city64(keys, seed: int = 42) -> np.ndarray:
    return city64_bytes([as_key(k) for k in keys], seed)


def city64_texts(keys: pa.Array, seed: int = 42) -> np.ndarray:
    """city64() of an Arrow array of strings, without a Python object for each: those whose repr is their ASCII characters in single quotes, the others by city64()."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    n, out = len(keys), np.zeros(len(keys), U)
    ends = np.frombuffer(keys.buffers()[1], np.int32, n + 1, keys.offset * 4).astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(keys.buffers()[2] or b"\0", np.uint8)[: max(1, int(ends[-1]))]
    odd = np.flatnonzero((data < 32) | (data > 126) | (data == 39) | (data == 92))  # quotes, escapes, and all beyond ASCII
    plain = np.searchsorted(odd, ends[:-1]) == np.searchsorted(odd, ends[1:])
    size = np.diff(ends)
    with np.errstate(over="ignore"):
        for length in np.unique(size[plain]).tolist():
            where = np.flatnonzero(plain & (size == length))
            g = _Group([], 1)
            g.n, g.m = length + 2, np.full((len(where), length + 2), 39, np.uint8)
            g.m[:, 1:-1] = data[np.minimum(ends[where][:, None] + np.arange(length), len(data) - 1)]
            out[where] = _pair(_one_length(g) - K2, np.full(len(where), U(seed), U))
    rest = np.flatnonzero(~plain)
    if len(rest):
        out[rest] = city64(keys.take(pa.array(rest)).to_pylist(), seed)
    return out


def city64_column(key: Column, seed: int = 42) -> Column:
    """city64() as a LONG column, by Arrow batches; meant for distinct keys."""

    @F.pandas_udf(LongType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(city64(s.tolist(), seed).view(np.int64))

    return run(key)


def md5_32(key: Column) -> Column:
    """32 bits that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def halves(key: Column, strategy: str = "xxhash64", seed: int = 42) -> tuple[Column, Column]:
    """Two 32-bit hashes of a key by strategy: city64, xxhash64 or md5."""
    if strategy == "md5":
        return md5_32(key), F.conv(F.substring(F.md5(key), 9, 8), 16, 10).cast("long")
    if strategy not in ("city64", "xxhash64"):
        raise ValueError(f"no hash strategy {strategy}")
    h = city64_column(key, seed) if strategy == "city64" else F.xxhash64(key, F.lit(seed))
    return h.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(h, 32)


def cell(h1: Column, h2: Column, row: int | Column, width: int) -> Column:
    """The cell of a row by double hashing, with 32-bit wrap-around before the remainder."""
    row = row if isinstance(row, Column) else F.lit(row)
    return (h1 + row * h2).bitwiseAND(F.lit(MASK)) % F.lit(width)


def cells(h: np.ndarray, widths: list[int]) -> np.ndarray:
    """(rows, keys) cells of uint64 hashes; widths has a row's width each."""
    h1, h2 = h & U(MASK), h >> U(32)
    return np.stack([((h1 + U(i) * h2) & U(MASK)) % U(w) for i, w in enumerate(widths)]).astype(np.int64)
