"""Personal data by anchor expansion: Aho-Corasick anchors, then local parsers."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

#: Words that announce an identifier, which up to CUE_GAP other characters may separate from it.
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn", "tax id", "customer id", "member id")
CUE_GAP = 32
#: Parameters of a web address that say who someone is; other addresses are nobody's data.
PERSONAL = re.compile(r"(?i)[?&;](?:user(?:name|id)?|uid|login|e?mail|phone|tel|mobile|(?:first|last|full|sur)?name|ssn|iban|account|customer|member|token|session(?:id)?|auth|passw(?:or)?d|pwd)(?:_?id)?=[^&#]")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())]))
_LOCAL = set("._%+-")
_RUN = set("0123456789 ()+-.")
_ADDRESS_END = set("\"'<>`|\\^{}")
_PHONE = re.compile(r"(?<![\d.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d|[.-]\d)")
_CARD = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Letters and marks on the cue's line, then a number: digits with hyphens, or groups of two to four digits with single blanks.
_ACCOUNT = re.compile(r"(?:[^\W\d]|[ \t.:#=()\[\]{}\"'/*-]){0,%d}?(?<![^\W_])([A-Z]{0,3}(?:\d[\d-]{4,18}\d|\d{2,4}(?: \d{2,4}){1,7}))(?![\d-])" % CUE_GAP)


@cache
def anchors():
    """The automaton: at-sign, schemes, identifier cues, and any two digits; for folded() text."""
    a = ahocorasick.Automaton()
    a.add_word("@", (0, 1))
    for s in ("://", "www."):
        a.add_word(s, (1, len(s)))
    for i in range(100):
        a.add_word(f"{i:02d}", (2, 2))
    for i in range(10):
        a.add_word(f".{i}.", (2, 2))
    for c in CUES:
        a.add_word(c, (3, len(c)))
    a.make_automaton()
    return a


def folded(t: str) -> str:
    """t in lower case, each character where it was."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(x if len(x := c.lower()) == 1 else c for c in t)


def luhn(digits: str) -> bool:
    twice = "0246813579"
    return sum(int(c) if k % 2 == 0 else int(twice[int(c)]) for k, c in enumerate(reversed(digits))) % 10 == 0


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def email_at(t: str, p: int):
    """The address around the at-sign at p, or None."""
    i, j, n = p, p + 1, len(t)
    while i > 0 and (t[i - 1].isalnum() or t[i - 1] in _LOCAL):
        i -= 1
    while j < n and (t[j].isalnum() or t[j] in ".-"):
        j += 1
    while i < p and t[i] in ".-":
        i += 1
    while j > p + 1 and t[j - 1] in ".-":
        j -= 1
    labels = t[p + 1 : j].split(".")
    while len(labels) > 1 and not (len(labels[-1]) > 1 and labels[-1].isalpha()):  # what follows the last name of letters isn't part of it
        j -= len(labels.pop()) + 1
    local = t[i:p]
    if not local or len(local) > 64 or local[-1] == "." or ".." in local or len(labels) < 2:
        return None
    if any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    return "email", i, j


def url_at(t: str, p: int, scheme: bool):
    """The web address whose :// or www. begins at p, or None."""
    i, j, n = p, p + (3 if scheme else 4), len(t)
    if scheme:
        while i > 0 and t[i - 1].isascii() and (t[i - 1].isalnum() or t[i - 1] in "+-."):
            i -= 1
        while i < p and not t[i].isalpha():
            i += 1
        if p - i < 2 or p - i > 20:
            return None
    elif i > 0 and (t[i - 1].isalnum() or t[i - 1] in "/.-@"):
        return None
    host = j
    while j < n and not t[j].isspace() and t[j] not in _ADDRESS_END:
        j += 1
    while j > host and t[j - 1] in ".,;:!?)]*#&%$":
        j -= 1
    h = re.split(r"[/?#]", t[host:j], maxsplit=1)[0].rpartition("@")[2].partition(":")[0]
    return ("url", i, j) if h and all(h.split(".")) and ("." in h or h == "localhost") and h[0] != "-" else None


def numbers_in(t: str, i: int, j: int):
    """Cards, phones, addresses and numbers of persons in t[i:j], a run of digits and what may stand between them."""
    for rx, kind, good in (
        (_IP, "ip", lambda s: all(int(x) < 256 and (x == "0" or x[0] != "0") for x in s.split("."))),
        (_CARD, "card", lambda s: s[0] != "0" and luhn(re.sub(r"\D", "", s))),
        (_SSN, "ssn", lambda s: True),
        (_PHONE, "phone", lambda s: 8 <= sum(c.isdigit() for c in s) <= 15),
    ):
        for m in rx.finditer(t, i, j):
            before, after = t[max(0, m.start() - 1) : m.start()], t[m.end() : m.end() + 1]
            if good(m.group()) and not before.isalnum() and not after.isalnum():
                yield kind, m.start(), m.end()


def personal(url: str) -> bool:
    """Whether a web address names a user before its host, holds a mail address, or has a PERSONAL parameter."""
    host = re.split(r"[/?#]", url.partition("://")[2] or url, maxsplit=1)[0]
    return "@" in host or PERSONAL.search(url) is not None or any(email_at(url, m.start()) for m in re.finditer("@", url))


def scan(t: str, urls: bool = False) -> list[tuple[str, int, int]]:
    """every_span() without web addresses that aren't personal(), or with all if urls; numbers within them aren't looked at either way."""
    return [(k, i, j) for k, i, j in every_span(t) if k != "url" or urls or personal(t[i:j])]


def every_span(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what text holds, in order, without overlaps: of two, the earlier, then the longer, then the one that isn't just a number after a cue."""
    found, done, run = [], 0, 0
    for at, (kind, size) in anchors().iter(folded(t)):
        p = at - size + 1
        if kind == 0:
            if hit := email_at(t, p):
                found.append(hit)
        elif kind == 1:
            if p >= done and (hit := url_at(t, p, t[p] == ":")):
                found.append(hit)
                done = hit[2]
        elif kind == 3:
            if (m := _ACCOUNT.match(t, at + 1)) and not t[max(0, p - 1) : p].isalnum() and not t[at + 1 : at + 2].isalnum() and (" " not in m.group(1) or sum(c.isdigit() for c in m.group(1)) > 5):
                found.append(("account", m.start(1), m.end(1)))
        elif p >= run:  # once for each run of digits
            i, j, n = p, at + 1, len(t)
            while i > 0 and t[i - 1] in _RUN:
                i -= 1
            while j < n and t[j] in _RUN:
                j += 1
            run = j
            found += numbers_in(t, i, j)
            k = p  # an IBAN has its letters before the first two digits
            if k > 1 and t[k - 2 : k].isupper() and t[k - 2 : k].isascii() and (m := _IBAN.match(t, k - 2)):
                text = m.group()
                while text and not iban_ok(text):  # words that follow may look like a last group
                    text = text.rpartition(" ")[0]
                if text:
                    found.append(("iban", m.start(), m.start() + len(text)))
    out, end = [], -1
    for kind, i, j in sorted(set(found), key=lambda x: (x[1], -x[2], x[0] == "account", x[0])):
        if i >= end:
            out.append((kind, i, j))
            end = j
    return out


@F.pandas_udf(SPANS)
def spans(texts):
    return texts.map(lambda t: None if t is None else [{"kind": k, "start": i, "end": j, "value": t[i:j]} for k, i, j in scan(t)])


def find(docs: DataFrame, urls: bool = False) -> DataFrame:
    """(doc_id, kind, start, end, value) of each piece of personal data; start and end count characters from 0.

    An Aho-Corasick pass over the whole text finds at-signs, schemes, identifier cues and digit pairs; from each anchor a
    parser expands to the boundaries and validates: email (labels, name of the domain), url, ip (four bytes), card
    (Luhn), iban (mod 97), ssn, phone, and account (a number of 6 digits or more after a cue). Of overlapping hits the
    earlier, then the longer one counts. A url is listed if it is personal(), or, with urls, always. No row moves; the
    texts pass Arrow once.

    Null, empty and clean texts give no rows; a null doc_id gives rows with a null doc_id; repeated rows give theirs
    each time. Columns other than doc_id and text aren't looked at. An empty table gives no rows.
    """

    def run(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, t in zip(ids, b.column(1)):
                if (s := t.as_py()) is not None:
                    rows += [(i, k, x, y, s[x:y]) for k, x, y in scan(s, urls)]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()))], ["doc_id", "kind", "start", "end", "value"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, kind string, start int, end int, value string")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each hit of find() replaced by its kind in angle brackets; null texts stay null, all columns and rows stay."""
    hits, cols = fresh(docs, "_hits"), []
    out = docs.withColumn(hits, spans("text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("s"))
    merge = lambda acc, h: F.struct(h["end"].alias("at"), F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, h["start"] - acc["at"]), F.lit("<"), h["kind"], F.lit(">")).alias("s"))
    clean = F.aggregate(hits, start, merge, lambda acc: F.concat(acc["s"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    for c in docs.columns:
        cols.append(F.when(F.size(hits) > 0, clean).otherwise(F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`"))
    return out.select(*cols)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
