"""Six frequency sketches under one memory budget, their byte formats, and how they are built and asked over DataFrames.

Conservative updates depend on the order of insertion, so a part of the corpus is one sketch and one task's stream; parts
run in parallel. linear_cells() is the sketch without conservative update, which merges and needs no order.
"""

from __future__ import annotations

import json
import math
import struct
import time
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.hashing import cell, cells, city64, city64_texts, halves

U32 = 2**32 - 1
#: Leaves of a row up to which a tree sketch holds their values beside the trees while it is filled.
HELD_LEAVES = 1 << 20


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


class BitVector:
    """Bits, a byte multiple of them, bit k of a byte being its k-th lowest."""

    def __init__(self, n: int):
        _check(n >= 1, "a bit vector has at least one bit")
        self.bits = np.zeros(-(-n // 8) * 8, np.uint8)

    def __len__(self):
        return len(self.bits)

    def __getitem__(self, i: int) -> bool:
        if not 0 <= i < len(self.bits):
            raise IndexError(i)
        return bool(self.bits[i])

    def __setitem__(self, i: int, flag: bool) -> None:
        if not 0 <= i < len(self.bits):
            raise IndexError(i)
        self.bits[i] = bool(flag)

    def toggle(self, i: int) -> None:
        self[i] = not self[i]

    def clear(self) -> None:
        self.bits[:] = 0

    def count(self) -> int:
        return int(self.bits.sum())

    def sizeof(self) -> int:
        return len(self.bits) // 8

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> BitVector:
        v = cls(len(b) * 8)
        v.bits[:] = np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")
        return v

    def __repr__(self):
        return f"BitVector({len(self)} bits, {self.count()} set)"


class Sketch:
    """Common to all: widths of rows, hashing, one key at a time and many, bytes and sizes."""

    header = "=IBQ"
    names: tuple[str, ...] = ("width", "depth", "seed")

    def widths(self) -> list[int]:
        return [self.width] * self.depth

    def where(self, keys) -> np.ndarray:
        """(depth, keys) cells."""
        return cells(city64(keys, self.seed), self.widths())

    def insert_keys(self, at: np.ndarray, codes: np.ndarray) -> None:
        """insert() of the keys at[:, codes], in order; at has the cells of each distinct key."""
        for i in range(0, len(codes), 1 << 16):
            self.insert(at[:, codes[i : i + (1 << 16)]])

    def add(self, key) -> None:
        self.insert(self.where([key]))

    def estimate(self, key):
        return self.read(self.where([key]))[0].item()

    def params(self) -> dict:
        return {k: getattr(self, k) for k in self.names}

    def memory(self) -> dict:
        """Bytes of the counters and of the parameters."""
        fixed = struct.calcsize(self.header)
        return {"counters": self.counter_bytes(), "parameters": fixed, "total": self.counter_bytes() + fixed}

    def sizeof(self) -> int:
        return self.memory()["total"]

    def to_bytes(self) -> bytes:
        return struct.pack(self.header, *self.params().values()) + self.body()

    @classmethod
    def from_bytes(cls, b: bytes):
        n = struct.calcsize(cls.header)
        s = cls(**dict(zip(cls.names, struct.unpack(cls.header, b[:n]))))
        s.load(b[n:])
        return s

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(f'{k}={v}' for k, v in self.params().items())})"

    def debug(self) -> str:
        return f"{self!r}: {len(self)} counters, {self.sizeof()} bytes"


class CMS(Sketch):
    """Count-Min with conservative update, 32-bit counters."""

    def __init__(self, width: int, depth: int, seed: int = 42):
        _check(width >= 1 and depth >= 1, "width and depth are 1 at least")
        self.width, self.depth, self.seed = width, depth, seed
        self.rows = [array("I", bytes(4 * width)) for _ in range(depth)]

    @classmethod
    def from_error(cls, error: float, delta: float, seed: int = 42):
        """Sized so that an estimate is off by more than error times the insertions with a chance of delta at most."""
        error, delta = float(np.float32(error)), float(np.float32(delta))
        _check(error > 1e-10, "error is greater than 1e-10")
        _check(0 < delta < 1, "delta lies between 0 and 1")
        return cls(math.ceil(math.e / error), math.ceil(-math.log(delta)), seed)

    def __len__(self):
        return self.width * self.depth

    def counter_bytes(self) -> int:
        return 4 * len(self)

    def insert(self, at: np.ndarray) -> None:
        rows = self.rows
        if self.depth == 1:  # nothing is conserved: a sum
            r = np.frombuffer(rows[0], np.uint32)
            cells_, n = np.unique(at[0], return_counts=True)
            r[cells_] = np.minimum(r[cells_].astype(np.int64) + n, U32)
            return
        if self.depth == 3:  # the usual depth, unrolled
            a, b, c = rows
            for i, j, k in zip(*at.tolist()):
                x, y, z = a[i], b[j], c[k]
                m = x if x < y else y
                if z < m:
                    m = z
                if m < U32:
                    if x == m:
                        a[i] = m + 1
                    if y == m:
                        b[j] = m + 1
                    if z == m:
                        c[k] = m + 1
            return
        for col in zip(*at.tolist()):
            seen = [r[i] for r, i in zip(rows, col)]
            m = min(seen)
            if m < U32:
                for r, i, x in zip(rows, col, seen):
                    if x == m:
                        r[i] = m + 1

    def insert_keys(self, at: np.ndarray, codes: np.ndarray) -> None:
        """insert() of the keys at[:, codes], in order, by numpy where order doesn't matter.

        A key that shares no cell with another of the same run ends where so many insertions on their own would bring it:
        each of its cells at its least cell plus their number, or higher if it was. Only keys that share a cell go one by
        one. A run is short against the width, so that few do; narrow sketches gain nothing by it.
        """
        step = min(1 << 16, self.width >> 5)
        if step < 1024:
            return super().insert_keys(at, codes)
        rows = [np.frombuffer(r, np.uint32) for r in self.rows]
        for i in range(0, len(codes), step):
            keys, where, times = np.unique(codes[i : i + step], return_inverse=True, return_counts=True)
            own, alone = at[:, keys], np.ones(len(keys), bool)
            for cells_ in own:
                _, back, n = np.unique(cells_, return_inverse=True, return_counts=True)
                alone &= n[back] == 1
            seen = np.stack([r[c] for r, c in zip(rows, own[:, alone])])
            up = np.minimum(seen.min(0).astype(np.int64) + times[alone], U32)
            for r, c, x in zip(rows, own[:, alone], seen):
                r[c] = np.maximum(x, up)
            self.insert(own[:, where[~alone[where]]])

    def read(self, at: np.ndarray) -> np.ndarray:
        return np.min([np.frombuffer(r, np.uint32)[i] for r, i in zip(self.rows, at)], 0).astype(np.float64)

    def body(self) -> bytes:
        return b"".join(r.tobytes() for r in self.rows)

    def load(self, b: bytes) -> None:
        n = 4 * self.width
        self.rows = [array("I", b[i * n : (i + 1) * n]) for i in range(self.depth)]


class _Log:
    """Counters of a byte that stand for (base^c - 1) / (base - 1), bumped with a chance of base^-c."""

    def _start(self, base: float, seed: int) -> None:
        _check(base > 1, "the base is greater than 1")
        self.base = base
        self.chance = [base**-c for c in range(256)]
        self.rng = np.random.default_rng(seed)

    def value(self, c: np.ndarray) -> np.ndarray:
        return (self.base ** c.astype(np.float64) - 1) / (self.base - 1)

    def _bump(self, rows, at: np.ndarray) -> None:
        """Counters never fall, so a draw that is too high for the least counter of a key before a run is too high in it: only the others are looked at one by one."""
        draws = self.rng.random(at.shape[1])
        most, start = np.array(self.chance[:255] + [0.0]), 0
        while start < at.shape[1]:
            run = slice(start, start + (1 << 13))
            start = run.stop
            least = np.min([np.frombuffer(r, np.uint8)[i] for r, i in zip(rows, at[:, run])], 0)
            some = np.flatnonzero(draws[run] < most[least])
            self._bump_some(rows, at[:, run][:, some], draws[run][some])

    def _bump_some(self, rows, at: np.ndarray, draws: np.ndarray) -> None:
        chance = self.chance
        for col, u in zip(zip(*at.tolist()), draws.tolist()):
            seen = [r[i] for r, i in zip(rows, col)]
            m = min(seen)
            if m < 255 and u < chance[m]:
                for r, i, x in zip(rows, col, seen):
                    if x == m:
                        r[i] = m + 1


class CML8S(_Log, Sketch):
    """Count-Min-Log with conservative update, 8-bit counters."""

    header, names = "=IBdQ", ("width", "depth", "base", "seed")

    def __init__(self, width: int, depth: int, base: float = 1.08, seed: int = 42):
        _check(width >= 1 and depth >= 1, "width and depth are 1 at least")
        self.width, self.depth, self.seed = width, depth, seed
        self._start(base, seed)
        self.rows = [bytearray(width) for _ in range(depth)]

    def __len__(self):
        return self.width * self.depth

    def counter_bytes(self) -> int:
        return len(self)

    def insert(self, at: np.ndarray) -> None:
        self._bump(self.rows, at)

    def read(self, at: np.ndarray) -> np.ndarray:
        return self.value(np.min([np.frombuffer(r, np.uint8)[i] for r, i in zip(self.rows, at)], 0))

    def body(self) -> bytes:
        return b"".join(self.rows)

    def load(self, b: bytes) -> None:
        self.rows = [bytearray(b[i * self.width : (i + 1) * self.width]) for i in range(self.depth)]


class CML8HS(_Log, Sketch):
    """Linear rows of 32-bit counters, then logarithmic rows four times as wide; each kind has its own minimum."""

    header, names = "=IBBdQ", ("width", "depth", "linear", "base", "seed")

    def __init__(self, width: int, depth: int, linear: int = 1, base: float = 1.08, seed: int = 42):
        _check(width >= 1 and depth >= 1, "width and depth are 1 at least")
        _check(1 <= linear <= depth, "linear rows are 1 to depth")
        self.width, self.depth, self.linear, self.seed = width, depth, linear, seed
        self._start(base, seed)
        self.top = CMS(width, linear, seed)
        self.rows = [bytearray(4 * width) for _ in range(depth - linear)]

    def widths(self) -> list[int]:
        return [self.width] * self.linear + [4 * self.width] * (self.depth - self.linear)

    def __len__(self):
        return sum(self.widths())

    def counter_bytes(self) -> int:
        return 4 * self.width * self.depth

    def insert(self, at: np.ndarray) -> None:
        self.top.insert(at[: self.linear])
        if self.rows:
            self._bump(self.rows, at[self.linear :])

    def read(self, at: np.ndarray) -> np.ndarray:
        logs = [self.value(np.frombuffer(r, np.uint8)[i]) for r, i in zip(self.rows, at[self.linear :])]
        return np.min([self.top.read(at[: self.linear]), *logs], 0)

    def body(self) -> bytes:
        return self.top.body() + b"".join(self.rows)

    def load(self, b: bytes) -> None:
        n, w = 4 * self.width * self.linear, 4 * self.width
        self.top.load(b[:n])
        self.rows = [bytearray(b[n + i * w : n + (i + 1) * w]) for i in range(self.depth - self.linear)]


class CL(Sketch):
    """Count-Less: layers of 32, 16, 8 ... bits, each expansion times as wide; a full counter says nothing. mode 0: conservative, 1: minimum update."""

    header, names = "=IBBBQ", ("width", "depth", "expansion", "mode", "seed")

    def __init__(self, width: int, depth: int, expansion: int = 4, mode: int = 0, seed: int = 42):
        _check(width >= 1 and 1 <= depth <= 6, "width is 1 at least, depth 1 to 6")
        _check(expansion >= 1 and mode in (0, 1), "expansion is 1 at least, mode 0 or 1")
        self.width, self.depth, self.expansion, self.mode, self.seed = width, depth, expansion, mode, seed
        self.bits = [32 >> i for i in range(depth)]
        self.most = [2**b - 1 for b in self.bits]
        self.rows = [array("I", bytes(4 * w)) for w in self.widths()]

    def widths(self) -> list[int]:
        return [self.width * self.expansion**i for i in range(self.depth)]

    def __len__(self):
        return sum(self.widths())

    def _words(self) -> list[int]:
        return [-(-w * b // 32) for w, b in zip(self.widths(), self.bits)]

    def counter_bytes(self) -> int:
        return 4 * sum(self._words())

    def insert(self, at: np.ndarray) -> None:
        rows, most = self.rows, self.most
        if self.depth == 3:  # the usual depth, unrolled
            return self._insert_three(at)
        if self.mode == 0:
            for col in zip(*at.tolist()):
                seen = [r[i] for r, i in zip(rows, col)]
                m = min((x for x, top in zip(seen, most) if x < top), default=None)
                if m is not None:
                    for r, i, x, top in zip(rows, col, seen, most):
                        if x == m and x < top:
                            r[i] = x + 1
            return
        order = range(self.depth - 1, -1, -1)
        for col in zip(*at.tolist()):
            m = U32
            for k in order:
                x = rows[k][col[k]]
                if x < most[k] and x < m:
                    rows[k][col[k]] = m = x + 1

    def _insert_three(self, at: np.ndarray) -> None:
        a, b, c = self.rows
        if self.mode == 0:
            for i, j, k in zip(*at.tolist()):
                z, y, x = c[k], b[j], a[i]
                m = z if z < 255 else U32
                if y < m and y < 65535:
                    m = y
                if x < m:
                    m = x
                if m < U32:
                    if x == m:
                        a[i] = m + 1
                    if y == m and m < 65535:
                        b[j] = m + 1
                    if z == m and m < 255:
                        c[k] = m + 1
            return
        for i, j, k in zip(*at.tolist()):
            m, z, y = U32, c[k], b[j]
            if z < 255:
                c[k] = m = z + 1
            if y < 65535 and y < m:
                b[j] = m = y + 1
            x = a[i]
            if x < m:
                a[i] = x + 1

    def read(self, at: np.ndarray) -> np.ndarray:
        seen = np.array([np.frombuffer(r, np.uint32)[i] for r, i in zip(self.rows, at)])
        return np.where(seen < np.array(self.most)[:, None], seen, U32).min(0).astype(np.float64)

    def body(self) -> bytes:
        out = []
        for r, b, n in zip(self.rows, self.bits, self._words()):
            per = 32 // b
            x = np.zeros(n * per, np.uint64)
            x[: len(r)] = np.frombuffer(r, np.uint32)
            out.append((x.reshape(n, per) << (np.arange(per, dtype=np.uint64) * np.uint64(b))).sum(1).astype("<u4").tobytes())
        return b"".join(out)

    def load(self, b: bytes) -> None:
        at = 0
        for k, (w, bits, n) in enumerate(zip(self.widths(), self.bits, self._words())):
            per, x = 32 // bits, np.frombuffer(b, "<u4", n, at).astype(np.uint64)
            at += 4 * n
            x = (x[:, None] >> (np.arange(per, dtype=np.uint64) * np.uint64(bits))) & np.uint64(self.most[k])
            self.rows[k] = array("I", x.reshape(-1)[:w].astype(np.uint32).tobytes())


class CMTS(Sketch):
    """Count-Min trees: counters of a leaf share the upper bits of their tree, so an estimate can err either way."""

    header, names = "=IBBQ", ("width", "depth", "leaves", "seed")

    def __init__(self, width: int, depth: int, leaves: int = 128, seed: int = 42):
        _check(width >= 1 and depth >= 1, "width and depth are 1 at least")
        _check(leaves >= 1 and leaves & (leaves - 1) == 0, "the leaves of a tree are a power of two")
        self.width, self.depth, self.leaves, self.seed = width, depth, leaves, seed
        self.height = leaves.bit_length()
        self.nodes = 2 * leaves - 1
        self.level = [2 * leaves - 2 * (leaves >> k) for k in range(self.height)]
        #: A leaf's nodes from itself to the root of its tree.
        self.path = [[self.level[k] + (leaf >> k) for k in range(self.height)] for leaf in range(leaves)]
        # one byte a node: 1 counts, 2 is the barrier
        self.tree = [bytearray(width * self.nodes + width) for _ in range(depth)]  # a node of padding a tree
        self.spire = [array("I", bytes(4 * width)) for _ in range(depth)]
        self.held = None

    def widths(self) -> list[int]:
        return [self.width * self.leaves] * self.depth

    def __len__(self):
        return self.width * self.depth

    def _tree_bits(self) -> int:
        return 2 * (2**self.height - 1)

    def counter_bytes(self) -> int:
        return -(-self.depth * self.width * self._tree_bits() // 8) + 4 * self.width * self.depth

    def get(self, row: int, at: int) -> int:
        t, leaf = divmod(at, self.leaves)
        tree, base, c, bit = self.tree[row], t * self.nodes, 0, 1
        for i in self.path[leaf]:  # bit is two to the number of barriers so far
            x = tree[base + i]
            if x & 1:
                c += bit
            if x < 2:
                return c + 2 * (bit - 1)
            bit += bit
        return c + (self.spire[row][t] << self.height) + 2 * (bit - 1)

    def put(self, row: int, at: int, v: int) -> None:
        t, leaf = divmod(at, self.leaves)
        tree, base, path = self.tree[row], t * self.nodes, self.path[leaf]
        nb = min(self.height, ((v + 2) // 4).bit_length())
        nc = v - 2 * ((1 << nb) - 1)
        for i in path[:nb]:
            tree[base + i] = nc & 1 | 2
            nc >>= 1
        if nb < self.height:
            i = base + path[nb]
            tree[i] = tree[i] & 2 | nc & 1
        else:
            self.spire[row][t] = max(self.spire[row][t], min(U32, nc))

    def insert(self, at: np.ndarray) -> None:
        if self.width * self.leaves <= HELD_LEAVES:
            return self._insert_held(at)
        rows, raw, get, put = range(self.depth), at.tolist(), self.get, self.put
        if self.height < 3:
            for col in zip(*raw):
                seen = [get(r, i) for r, i in zip(rows, col)]
                m = min(seen)
                if m < U32:
                    for r, i, x in zip(rows, col, seen):
                        if x == m:
                            put(r, i, m + 1)
            return
        # most counters are small: values under 6 live on the two lowest levels, and are read and written here
        trees, level = self.tree, self.level[1]
        first = (at // self.leaves * self.nodes + at % self.leaves).tolist()
        second = (at // self.leaves * self.nodes + level + (at % self.leaves >> 1)).tolist()
        for j in range(at.shape[1]):
            seen, m = [], U32
            for r in rows:
                tree = trees[r]
                x = tree[first[r][j]]
                if not x & 2:
                    v = x & 1
                else:
                    y = tree[second[r][j]]
                    v = get(r, raw[r][j]) if y & 2 else 2 + (x & 1) + 2 * (y & 1)
                seen.append(v)
                if v < m:
                    m = v
            if m >= U32:
                continue
            for r in rows:
                if seen[r] != m:
                    continue
                if m == 0:
                    i = first[r][j]
                    trees[r][i] = trees[r][i] & 2 | 1
                elif m < 5:
                    i, c, tree = second[r][j], m - 1, trees[r]
                    tree[first[r][j]] = c & 1 | 2
                    tree[i] = tree[i] & 2 | c >> 1
                else:
                    put(r, raw[r][j], m + 1)

    def _insert_held(self, at: np.ndarray) -> None:
        """insert() with the values of leaves held in lists, -1 where a neighbour changed what they share.

        One more flips a node's bit and, while it was set, the next one's: half of all insertions change a leaf's own node alone.
        """
        if self.held is None:
            self.held = [[-1] * (self.width * self.leaves) for _ in range(self.depth)]
        held, trees, get, path, nodes, leaves, height = self.held, self.tree, self.get, self.path, self.nodes, self.leaves, self.height
        shift, mask, rows = leaves.bit_length() - 1, leaves - 1, range(self.depth)
        gone = [[-1] * (1 << k) for k in range(height)]
        for col in zip(*at.tolist()):
            m, seen = U32, []
            for r, i in zip(rows, col):
                v = held[r][i]
                if v < 0:
                    held[r][i] = v = get(r, i)
                seen.append(v)
                if v < m:
                    m = v
            if m >= U32:
                continue
            nb = min(height, (m + 2 >> 2).bit_length())
            c = m + 2 - (2 << nb)
            full = (1 << min(height, nb + 1)) - 1
            full = c & full == full
            k = (~c & c + 1).bit_length() - 1  # set bits at the end
            for r, i, v in zip(rows, col, seen):
                if v != m:
                    continue
                t = i >> shift
                if full:  # one more barrier, or a carry to the spire: what lies above may be set already
                    self.put(r, i, m + 1)
                    held[r][t << shift : t + 1 << shift] = gone[-1]
                    continue
                if k:
                    tree, base, up = trees[r], t * nodes, path[i & mask]
                    for n in up[:k]:
                        tree[base + n] = 2  # all below the last node have the barrier
                    tree[base + up[k]] |= 1
                    first = i >> k << k
                    held[r][first : first + (1 << k)] = gone[k]
                else:
                    trees[r][t * nodes + (i & mask)] |= 1
                held[r][i] = m + 1

    def read(self, at: np.ndarray) -> np.ndarray:
        return np.min([self._values(r, i) for r, i in enumerate(at)], 0).astype(np.float64)

    def _values(self, row: int, at: np.ndarray) -> np.ndarray:
        """get() of many leaves: level by level, as long as there is a barrier."""
        tree, (t, leaf) = np.frombuffer(self.tree[row], np.uint8), np.divmod(at, self.leaves)
        c, n, on = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(self.height):
            x = tree[t * self.nodes + self.level[k] + (leaf >> k)]
            c += np.where(on, (x & 1).astype(np.int64) << k, 0)
            on &= x >= 2
            n += on
        c += np.where(on, np.frombuffer(self.spire[row], np.uint32)[t].astype(np.int64) << self.height, 0)
        return c + 2 * ((np.int64(1) << n) - 1)

    def body(self) -> bytes:
        v = BitVector(self.depth * self.width * self._tree_bits())
        n = self.width * self.nodes
        for r, tree in enumerate(self.tree):
            x = np.frombuffer(tree, np.uint8)[:n]
            v.bits[2 * n * r : 2 * n * (r + 1)] = np.stack([x & 1, x >> 1], 1).reshape(-1)
        return v.to_bytes() + b"".join(s.tobytes() for s in self.spire)

    def load(self, b: bytes) -> None:
        size = -(-self.depth * self.width * self._tree_bits() // 8)
        v, n = BitVector.from_bytes(b[:size]), self.width * self.nodes
        for r in range(self.depth):
            x = v.bits[2 * n * r : 2 * n * (r + 1)].reshape(-1, 2)
            self.tree[r][:n] = (x[:, 0] | x[:, 1] << 1).tobytes()
            at = size + 4 * self.width * r
            self.spire[r] = array("I", b[at : at + 4 * self.width])
        self.held = None


#: Name: class, parameters beside the width, bytes of counters a unit of width.
KINDS = {
    "CMS-CU": (CMS, {"depth": 3}, 12),
    "CML8S-CU": (CML8S, {"depth": 3, "base": 1.08}, 3),
    "CMTS-CU": (CMTS, {"depth": 3, "leaves": 128}, 3 * (510 / 8 + 4)),
    "CL-CU": (CL, {"depth": 3, "expansion": 4, "mode": 0}, 28),
    "CL-MU": (CL, {"depth": 3, "expansion": 4, "mode": 1}, 28),
    "CML8HS-CU": (CML8HS, {"depth": 3, "linear": 1, "base": 1.08}, 12),
}
#: One exact 32-bit counter for each distinct key of the corpus that the sketches were first sized for.
BUDGET = 79_083_480


#: What each structure is.
ABOUT = {
    "CMS-CU": ("Count-Min Sketch with conservative update", "32-bit counters; only the least ones of a key grow"),
    "CML8S-CU": ("Count-Min-Log Sketch with conservative update", "8-bit counters that grow with a falling chance"),
    "CMTS-CU": ("Count-Min Tree Sketch with conservative update", "counters whose upper bits neighbours share"),
    "CL-CU": ("Count-Less Sketch with conservative update", "layers of fewer and fewer bits, more and more counters"),
    "CL-MU": ("Count-Less Sketch with minimum update", "the same layers, filled from the last to the first"),
    "CML8HS-CU": ("Count-Min-Log hybrid sketch with conservative update", "linear rows for what is frequent, logarithmic ones for the rest"),
}


def available() -> list[str]:
    return list(KINDS)


def info(budget: int = BUDGET, seed: int = 42) -> list[dict]:
    """Rows of (structure, name, description, parameters, defaults): the registry in words."""
    return [{"structure": n, "name": ABOUT[n][0], "description": ABOUT[n][1], "parameters": list(params_for(n, budget, seed)), "defaults": json.dumps(params_for(n, budget, seed))} for n in KINDS]


def kind(name: str):
    if name not in KINDS:
        raise ValueError(f"no structure {name}; there are {', '.join(KINDS)}")
    return KINDS[name]


def params_for(name: str, budget: int = BUDGET, seed: int = 42) -> dict:
    """Parameters whose counters take budget bytes at most."""
    _, more, unit = kind(name)
    return {"width": max(1, int(budget / unit)), **more, "seed": seed}


def budget_for(distinct: int) -> int:
    """Bytes of one exact 32-bit counter for each of so many distinct keys."""
    return max(4, 4 * distinct)


def create(name: str, params: dict | None = None, budget: int = BUDGET) -> Sketch:
    return kind(name)[0](**(params or params_for(name, budget)))


def create_all(budget: int = BUDGET, seed: int = 42) -> dict[str, Sketch]:
    return {n: create(n, params_for(n, budget, seed)) for n in KINDS}


def load(name: str, blob: bytes) -> Sketch:
    return kind(name)[0].from_bytes(bytes(blob))


def save_file(sketch: Sketch, path: str) -> None:
    with open(path, "wb") as f:
        f.write(sketch.to_bytes())


def load_file(name: str, path: str) -> Sketch:
    with open(path, "rb") as f:
        return load(name, f.read())


#: Tokens whose pairs are made at once.
SLICE_TOKENS = 1 << 18
SKETCHES = "part int, structure string, params string, n long, blob binary, seconds double"
ESTIMATES = "part int, structure string, kind string, key string, freq long, est double, seconds double"


def by_part(df: DataFrame) -> DataFrame:
    """df with the rows of a part in one partition, parts dealt evenly. A fixed number of partitions: by their bytes alone too few tasks would share the work."""
    n = max(Config().parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int"))


def _fresh(part: int, specs: dict[str, dict]) -> dict[str, Sketch]:
    held = {k: create(k, p | {"seed": p.get("seed", 42)}) for k, p in specs.items()}
    for s in held.values():  # the random numbers of a part are its own
        if hasattr(s, "rng"):
            s.rng = np.random.default_rng([s.seed, part])
    return held


class _Filling:
    """The sketches of one part at a time, and how long each took to fill."""

    def __init__(self, specs: dict[str, dict]):
        self.specs, self.part, self.n = specs, None, 0

    def turn(self, part: int):
        """Begin a part if it is another; a batch of the last part's sketches, if there was one."""
        if part == self.part:
            return None
        done = self.done()
        self.part, self.n, self.held = part, 0, _fresh(part, self.specs)
        self.seconds = dict.fromkeys(self.held, 0.0)
        return done

    def insert(self, words: pa.Array, codes: np.ndarray) -> None:
        hashes: dict[int, np.ndarray] = {}
        for name, s in self.held.items():
            if s.seed not in hashes:
                hashes[s.seed] = city64_texts(words, s.seed)
            began = time.perf_counter()
            s.insert_keys(cells(hashes[s.seed], s.widths()), codes)
            self.seconds[name] += time.perf_counter() - began
        self.n += len(codes)

    def done(self):
        if self.part is None:
            return None
        rows = [(self.part, k, json.dumps(s.params()), self.n, s.to_bytes(), self.seconds[k]) for k, s in self.held.items()]
        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "structure", "params", "n", "blob", "seconds"])


def _runs(parts: np.ndarray):
    """(first, last + 1, part) of each run of equal parts."""
    cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
    return [(a, z, int(parts[a])) for a, z in zip(cuts, cuts[1:])]


def build(stream: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """(part, structure, params, n, blob, seconds): sketches of each part of ngrams.stream(), by insertion in order.

    Rows are shuffled by part and sorted by place; tasks stream them through and hold the sketches of one part at a time.
    A part is one task's work, so a corpus takes as many parts as it has cores. Keys are hashed once for each batch in
    which they occur. For documents, build_docs() gives the same sketches and moves no pairs.
    """
    for name, p in specs.items():
        create(name, p | {"width": 1})  # wrong names and parameters stop here

    def run(batches):
        filling = _Filling(specs)
        for b in batches:
            for a, z, part in _runs(b.column(0).to_numpy()):
                if done := filling.turn(part):
                    yield done
                keys = b.column(1).slice(a, z - a).dictionary_encode()
                filling.insert(keys.dictionary, keys.indices.to_numpy())
        if done := filling.done():
            yield done

    place = ["part", "doc", "pos", "offset"]
    rows = by_part(stream.select(*place, "key")).sortWithinPartitions(*place).select("part", "key")
    return rows.mapInArrow(run, SKETCHES)


def stream_codes(codes: np.ndarray, ends: np.ndarray, n_words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(stream, pairs): the keys of documents in order of insertion, as numbers; pairs has (first, second) word of numbers from n_words on.

    codes are the documents' words one after another, as numbers in code-point order; ends says where documents end.
    """
    n = len(codes)
    stop = np.repeat(ends, np.diff(np.r_[0, ends]))
    table = np.full((n, window), -1, np.int64)
    table[:, 0] = codes
    at = np.arange(n)
    for d in range(1, window):
        i = at[at + d < stop]
        a, b = codes[i], codes[i + d]
        table[i, d] = n_words + np.minimum(a, b) * n_words + np.maximum(a, b)
    stream = table.reshape(-1)
    stream = stream[stream >= 0]
    found, back = np.unique(stream, return_inverse=True)
    pairs = found[found >= n_words] - n_words
    number = np.where(found < n_words, found, n_words + np.arange(len(found)) - (len(found) - len(pairs)))
    return number[back], np.stack([pairs // max(1, n_words), pairs % max(1, n_words)], 1)


def build_docs(docs: DataFrame, specs: dict[str, dict], window: int = 3, key: str = "doc_id") -> DataFrame:
    """build() of ngrams.stream(docs, window, key), straight from docs (part, key, tokens).

    Only token arrays move: documents are shuffled by part and sorted by key, and a task makes the pairs of a slice of them
    with numpy, as numbers, and their texts once for each distinct one.
    """
    for name, p in specs.items():
        create(name, p | {"width": 1})

    def run(batches):
        filling = _Filling(specs)
        for b in batches:
            for a, z, part in _runs(b.column(0).to_numpy()):
                if done := filling.turn(part):
                    yield done
                lists = b.column(1).slice(a, z - a)
                ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                flat = lists.flatten()
                i = 0
                while i < len(ends):  # slices of whole documents
                    start = int(ends[i - 1]) if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, start + SLICE_TOKENS, "right")))
                    tokens = flat.slice(start, int(ends[j - 1]) - start).dictionary_encode()
                    names = tokens.dictionary.to_pylist()
                    order = sorted(range(len(names)), key=names.__getitem__)
                    rank = np.empty(len(names), np.int64)
                    rank[order] = np.arange(len(names))
                    texts = tokens.dictionary.take(pa.array(order, pa.int64()))
                    codes, pairs = stream_codes(rank[tokens.indices.to_numpy()], ends[i:j] - start, len(names), window)
                    keys = [texts]
                    if len(pairs):
                        keys.append(pc.binary_join_element_wise(texts.take(pa.array(pairs[:, 0])), texts.take(pa.array(pairs[:, 1])), " "))
                    filling.insert(pa.concat_arrays(keys), codes)
                    i = j
        if done := filling.done():
            yield done

    rows = by_part(docs.where(F.size("tokens") > 0).select("part", F.col(key).alias("doc"), "tokens")).sortWithinPartitions("part", "doc").select("part", "tokens")
    return rows.mapInArrow(run, SKETCHES)


def estimate(counts: DataFrame, sketches: DataFrame) -> DataFrame:
    """ESTIMATES of every counted key, from every sketch of its part; seconds: those of its batch over its keys.

    Sketches and keys are shuffled by part, sketches sorted first; keys then stream by them. Parts without a sketch are
    left out; ppmi.missing() names them.
    """
    s = sketches.select("part", F.lit(0).alias("ord"), "structure", "blob", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("freq"))
    k = counts.select("part", F.lit(1).alias("ord"), F.lit(None).cast("string").alias("structure"), F.lit(None).cast("binary").alias("blob"), "kind", "key", "freq")

    def run(batches):
        part, held = None, {}
        for b in batches:
            parts, order = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(order) != 0)) + 1).tolist(), len(parts)] if len(parts) else []
            for a, z in zip(cuts, cuts[1:]):
                if part != int(parts[a]):
                    part, held = int(parts[a]), {}
                if order[a] == 0:
                    for i in range(a, z):
                        name = b.column(2)[i].as_py()
                        held[name] = load(name, b.column(3)[i].as_py())
                    continue
                kinds, keys, freq = (b.column(c).slice(a, z - a) for c in (4, 5, 6))
                hashes = {}
                for name, sk in held.items():
                    if sk.seed not in hashes:
                        hashes[sk.seed] = city64_texts(keys, sk.seed)
                    began, m = time.perf_counter(), z - a
                    est = sk.read(cells(hashes[sk.seed], sk.widths()))
                    took = np.full(m, (time.perf_counter() - began) / m)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array([name] * m), kinds, keys, freq, pa.array(est), pa.array(took)], ["part", "structure", "kind", "key", "freq", "est", "seconds"])

    return by_part(s.unionByName(k)).sortWithinPartitions("part", "ord").mapInArrow(run, ESTIMATES)


def memory(names: list[str] | None = None, budget: int = BUDGET) -> list[dict]:
    """Rows of (structure, width, depth, counter_bytes) at a budget, by arithmetic alone."""
    rows = []
    for n in names or KINDS:
        p, unit = params_for(n, budget), kind(n)[2]
        if n == "CMTS-CU":
            size = -(-p["depth"] * p["width"] * 510 // 8) + 4 * p["width"] * p["depth"]
        else:
            size = int(unit * p["width"])
        rows.append({"structure": n, "width": p["width"], "depth": p["depth"], "counter_bytes": size})
    return rows


def linear_cells(keys: DataFrame, width: int, depth: int, strategy: str = "xxhash64", seed: int = 42) -> DataFrame:
    """(part, row, idx, cnt): plain Count-Min as a sum over hashed cells, merged before and after the shuffle.

    keys has (part, key), or (part, key, freq) to insert counts at once, which gives the same cells.
    """
    n = F.col("freq") if "freq" in keys.columns else F.lit(1).cast("long")
    h1, h2 = halves(F.col("key"), strategy, seed)
    at = F.array(*[F.struct(F.lit(i).alias("row"), cell(F.col("h1"), F.col("h2"), i, width).alias("idx")) for i in range(depth)])
    rows = keys.select("part", h1.alias("h1"), h2.alias("h2"), n.alias("n")).select("part", "n", F.inline(at))
    return rows.groupBy("part", "row", "idx").agg(F.sum("n").alias("cnt"))


def linear_estimate(counts: DataFrame, cells_: DataFrame, width: int, depth: int, strategy: str = "xxhash64", seed: int = 42, structure: str = "CMS") -> DataFrame:
    """ESTIMATES of counts (part, kind, key, freq) from linear_cells(): the least cell of a key's rows."""
    h1, h2 = halves(F.col("key"), strategy, seed)
    at = F.array(*[F.struct(F.lit(i).alias("row"), cell(F.col("h1"), F.col("h2"), i, width).alias("idx")) for i in range(depth)])
    rows = counts.select("part", "kind", "key", "freq", h1.alias("h1"), h2.alias("h2")).select("part", "kind", "key", "freq", F.inline(at))
    found = rows.join(cells_, ["part", "row", "idx"]).groupBy("part", "kind", "key").agg(F.first("freq").alias("freq"), F.min("cnt").alias("est"))
    return found.select("part", F.lit(structure).alias("structure"), "kind", "key", "freq", F.col("est").cast("double").alias("est"))
