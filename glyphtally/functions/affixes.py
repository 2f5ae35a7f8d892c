"""Tokens by affix rules: what stands between white space loses prefixes and suffixes one by one, and falls apart at infixes.

The rules are those that a usual language library has for Portuguese without exceptions, for the characters that cleaned text
may have. It is no expression: a chunk's fate depends on what was taken off before. Batches go through Arrow, and each
distinct chunk is split once in a worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Chunks that stay whole.
SPECIAL = frozenset(f"{t}{dot}" for t, dots in (("Ph.D", ("", ".")), ("ph.d", ("", ".")), ("M.Sc", (".",)), ("m.sc", (".",)), ("B.Sc", (".",)), ("b.sc", (".",))) for dot in dots)
_LOWER, _UPPER = "a-zß-öø-ÿªºµ", "A-ZÀ-ÖØ-Þ"
_LETTER = _LOWER + _UPPER
_PUNCT = r"…,:;!?¿¡()\[\]{}<>_#*&"
_QUOTES = "'\"”“`‘´’‚„»«"
_CURRENCY = r"US\$|C\$|A\$|[$£€¥₹₽]"
_UNIT = "|".join(sorted("km km² km³ m m² m³ dm dm² dm³ cm cm² cm³ mm mm² mm³ ha µm nm yd in ft kg g mg µg t lb oz m/s km/h mph hPa Pa mbar mb MB kb KB gb GB tb TB T G M K %".split(), key=len, reverse=True))
#: In the order in which they are tried.
PREFIX = re.compile(rf"^(?:\w{{1,3}}\$|[§%=—–]|\+(?![0-9])|[{_PUNCT}]|\.\.+|[{_QUOTES}]|{_CURRENCY})")
SUFFIX = re.compile(rf"(?:[{_PUNCT}]|\.\.+|[{_QUOTES}]|['’][sS]|[—–]|(?<=[0-9])\+|(?<=°[FfCcKk])\.|(?<=[0-9])(?:{_CURRENCY})|(?<=[0-9])(?:{_UNIT})|(?<=[0-9{_LOWER}%²\-+{_PUNCT}|{_QUOTES}])\.|(?<=[{_UPPER}][{_UPPER}])\.)$")
INFIX = re.compile(rf"\w+-\w+(?:-\w+)*|\.\.+|…|(?<=[0-9])[+\-*^](?=[0-9-])|(?<=[{_LOWER}{_QUOTES}])\.(?=[{_UPPER}{_QUOTES}])|(?<=[{_LETTER}]),(?=[{_LETTER}])|(?<=[{_LETTER}])(?:--+|[-–—~])(?=[{_LETTER}])|(?<=[{_LETTER}0-9])[:<>=/](?=[{_LETTER}])")


@lru_cache(1 << 17)
def split(chunk: str) -> tuple[str, ...]:
    """The tokens of what stands between white space."""
    front, back = [], []
    while chunk and chunk not in SPECIAL:
        if m := PREFIX.search(chunk):
            front.append(chunk[: m.end()])
            chunk = chunk[m.end() :]
        elif m := SUFFIX.search(chunk):
            back.append(chunk[m.start() :])
            chunk = chunk[: m.start()]
        else:
            break
    if chunk in SPECIAL:
        front.append(chunk)
    elif chunk:
        at = 0
        for m in INFIX.finditer(chunk):
            if m.start() == 0:
                continue  # nothing stands before it, so it stays with what follows
            if m.start() > at:
                front.append(chunk[at : m.start()])
            front.append(m.group())
            at = m.end()
        if at < len(chunk):
            front.append(chunk[at:])
    return (*front, *reversed(back))


def tokens(text: str) -> list[str]:
    """The tokens of a text; an n with a dot before an ordinal sign or a number is one token, blanks between them included."""
    out, spaced = [], []
    for chunk in text.split():
        found = split(chunk)
        out += found
        spaced += [True] + [False] * (len(found) - 1)
    if "n" not in out:
        return out
    merged, i = [], 0
    while i < len(out):
        size = 1
        if i + 2 < len(out) and out[i] == "n" and out[i + 1] == ".":
            size = 3 if out[i + 2] in ("º", "°") else 2 if out[i + 2].isdigit() else 1
        merged.append(out[i] + "".join((" " if spaced[k] else "") + out[k] for k in range(i + 1, i + size)))
        i += size
    return merged


#: Texts whose tokens are Python objects at once.
TEXTS = 256


def token_lists(texts: pa.Array) -> pa.Array:
    """tokens() of each text; a batch's tokens are Arrow's, those of a few texts Python's."""
    some = (texts.slice(i, TEXTS).to_pylist() for i in range(0, max(1, len(texts)), TEXTS))
    return pa.concat_arrays([pa.array([None if t is None else tokens(t) for t in s], pa.list_(pa.string())) for s in some])


@F.arrow_udf(ArrayType(StringType()))
def _tokens(texts: pa.Array) -> pa.Array:
    return token_lists(texts)


def tokenize(text: Column) -> Column:
    """Tokens of cleaned text; null for null."""
    return _tokens(text)
