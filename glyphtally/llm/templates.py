"""Line dedup by a tree of log templates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, fresh, small, table, text_key, written

#: Leading tokens that the tree looks at; least share of equal tokens to join a template; least documents of a recurring template; least fixed tokens of a template; share of a document that recurs, and of the documents with a template, from which they count as copies.
DEPTH, SIMILARITY, MIN_DOCS, MIN_FIXED, COPY_SHARE = 3, 0.7, 3, 4, 0.5
#: Templates of a leaf from which an index leads to those that a line may join; rows of a result that are sent at once.
INDEXED, ROWS = 512, 10_000
ANY = "<*>"


def n_tokens(line):
    """Tokens of a masked line. replace() works on bytes; translate() looks characters up one by one and is many times as slow."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def masked(text):
    """Array of (line_no, size, line): tokens with a digit are variable fields, white space is single blanks, and no line is blank.

    Each step is a pass of its own over the array, so that its value is computed once; nested in one expression, it would be
    copied wherever it is used. Lines that a step doesn't concern skip its regular expression.
    """

    def step(lines, change):
        return F.transform(lines, lambda y: F.struct(y["line_no"].alias("line_no"), y["size"].alias("size"), change(y["line"]).alias("line")))

    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("line_no"), F.length(x).alias("size"), F.trim(x).alias("line")))
    lines = step(lines, lambda x: F.when(x.contains("\t") | x.contains("\r"), F.trim(x, F.lit(" \t\r"))).otherwise(x))
    lines = step(lines, lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"[^ \t\r0-9]*+[0-9][^ \t\r]*+", ANY)).otherwise(x))
    lines = step(lines, lambda x: F.when(x.contains("  ") | x.contains("\t") | x.contains("\r"), F.regexp_replace(x, r"[ \t\r]+", " ")).otherwise(x))
    return F.filter(lines, lambda y: y["line"] != "")


def lines_of(docs: DataFrame) -> DataFrame:
    """(id, key, total, line_no, size, n, p, line) of each line; n: its tokens, p: a hash of the first DEPTH of them. n and p lead to a leaf of the tree."""
    # what belongs to the document is computed once, in a generator: a projection's values would be computed again for each line
    head = F.struct(F.col("doc_id").cast("bigint").alias("id"), text_key(F.col("text")).alias("key"), F.length("text").alias("total"), masked(F.col("text")).alias("lines"))
    each = docs.where("text IS NOT NULL").select(F.explode(F.array(head)).alias("d"))
    rows = each.select("d.id", "d.key", "d.total", F.inline("d.lines"))
    return rows.select("id", "key", "total", "line_no", "size", n_tokens(F.col("line")).alias("n"), F.xxhash64(F.substring_index("line", " ", DEPTH)).alias("p"), "line")


class Leaf:
    """The templates of a leaf (same token count), as its lines come: each line joins the most similar one so far, or is a new one."""

    def __init__(self, similarity: float = SIMILARITY, min_fixed: int = MIN_FIXED):
        self.similarity, self.min_fixed = similarity, min_fixed
        self.codes: dict[str, int] = {ANY: 0}
        self.templates, self.found = np.empty((16, 0), np.int32), 0
        # (position, token) of the first `upto` templates in order, and whose they are
        self.keys, self.owner, self.upto = np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    def index(self) -> None:
        """Built again when an eighth of the templates isn't in it. What is variable by now stays in it, which adds candidates and loses none."""
        t = self.templates[: self.found]
        owner, at = np.nonzero(t)
        keys = at.astype(np.int64) << 32 | t[owner, at]
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.upto = keys[order], owner[order].astype(np.int32), self.found

    def candidates(self, row: np.ndarray, least: int):
        """Templates, in order, among which are all that share least fixed tokens with row.

        One that does shares one at least of any fixed - least + 1 tokens of the row: the rarest are looked up.
        """
        if self.found < INDEXED or least < 1:
            return slice(0, self.found)
        if 8 * self.upto < 7 * self.found:
            self.index()
        at = np.flatnonzero(row)
        keys = at.astype(np.int64) << 32 | row[at]
        first, end = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        rarest = np.argsort(end - first, kind="stable")[: max(0, len(at) - least + 1)]
        some = [self.owner[first[k] : end[k]] for k in rarest if end[k] > first[k]]
        return np.concatenate([np.unique(np.concatenate(some)) if some else self.owner[:0], np.arange(self.upto, self.found, dtype=np.int32)])

    def add(self, line: str) -> int:
        """The number of the line's template."""
        row = np.array([self.codes.setdefault(t, len(self.codes)) for t in line.split(" ")], np.int32)
        if not self.found:
            self.templates = np.empty((16, len(row)), np.int32)
        fixed = max(1, int((row != 0).sum()))
        need = max(self.similarity * fixed, self.min_fixed)
        some = self.candidates(row, math.ceil(need))
        score = ((self.templates[some] == row) & (row != 0)).sum(1)
        best = int(score.argmax()) if len(score) else -1
        if best >= 0 and score[best] >= need:
            k = best if isinstance(some, slice) else int(some[best])
            self.templates[k, self.templates[k] != row] = 0
            return k
        if self.found == len(self.templates):
            self.templates = np.concatenate([self.templates, np.empty_like(self.templates)])
        self.templates[self.found] = row
        self.found += 1
        return self.found - 1

    def texts(self) -> list[str]:
        words = list(self.codes)
        return [" ".join(words[c] for c in t) for t in self.templates[: self.found]]


def parse_leaf(lines: list[str], similarity: float = SIMILARITY, min_fixed: int = MIN_FIXED) -> list[str]:
    """The template of each distinct line of a leaf (same token count), in the order given."""
    leaf = Leaf(similarity, min_fixed)
    at = [leaf.add(line) for line in lines]
    texts = leaf.texts()
    return [texts[k] for k in at]


def bounded(lines: DataFrame, most: int) -> DataFrame:
    """Distinct lines (n, p, h, line) with leaf, a hash: leaves of more than most lines branch on as many tokens again, until they hold no more.

    With all its tokens a line is alone in its leaf, so this ends, after the logarithm of the longest crowded line in rounds.
    """
    rows, depth = lines.withColumn("leaf", F.col("p")), DEPTH
    while True:
        crowded = cut(rows.groupBy("n", "leaf").count().where(F.col("count") > most).select("n", "leaf"))
        if crowded.isEmpty():
            return rows
        depth *= 2
        far = F.xxhash64(F.substring_index("line", " ", depth), F.lit(depth))
        here = rows.join(small(crowded.withColumn("many", F.lit(True))), ["n", "leaf"], "left")
        rows = cut(here.select("n", "p", "h", "line", F.when(F.col("many"), far).otherwise(F.col("leaf")).alias("leaf")))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, leaf_lines: int | None = None) -> DataFrame:
    """(id, key, line_no, size, total, template, n_docs) of each line whose template occurs in min_docs unlike texts or more."""
    spark = docs.sparkSession
    # the lines are made once; what follows reads the columns that it needs
    lines, path = written(lines_of(docs))
    hot = cut(lines.select("n", "p", "key").distinct().groupBy("n", "p").count().where(F.col("count") >= min_docs).select("n", "p"))
    candidates = cut(lines.join(small(hot), ["n", "p"], "left_semi").withColumn("h", F.xxhash64("line")))
    discard(spark, path)

    def parse(frames):
        cols = ["n", "p", "h", "template"]
        types = {"n": "int32", "p": "int64", "h": "int64"}
        name, leaf, held, out = None, None, [], []

        def flush():
            texts = leaf.texts() if held else []
            for n, p, h, k in held:
                out.append((n, p, h, texts[k]))
                if len(out) == ROWS:
                    yield pd.DataFrame(out, columns=cols).astype(types)
                    out.clear()

        # lines go as they come; of a leaf its templates are held, and for each line its numbers
        for frame in frames:
            for n, of, p, h, line in zip(*(frame[c].tolist() for c in ("n", "leaf", "p", "h", "line"))):
                if name != (n, of):
                    yield from flush()
                    name, leaf, held = (n, of), Leaf(), []
                held.append((n, p, h, leaf.add(line)))
        yield from flush()
        if out:
            yield pd.DataFrame(out, columns=cols).astype(types)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = candidates.select("n", "p", "h", "line").distinct()
    leaves = leaves.withColumn("leaf", F.col("p")) if leaf_lines is None else bounded(leaves, leaf_lines)
    parsed = leaves.repartition(tasks, "n", "leaf").sortWithinPartitions("n", "leaf", "line").mapInPandas(parse, "n int, p bigint, h bigint, template string")
    fixed = F.size(F.filter(F.split("template", " ", -1), lambda t: t != ANY))
    where = cut(candidates.drop("line").join(parsed.where(fixed >= F.least(F.lit(MIN_FIXED), "n")), ["n", "p", "h"]).drop("h"))
    counts = where.select("n", "p", "template", "key").distinct().groupBy("n", "p", "template").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return where.join(counts, ["n", "p", "template"]).select("id", "key", "line_no", "size", "total", "template", "n_docs")


def gone_lines(docs: DataFrame, min_docs: int = MIN_DOCS, copy_share: float = COPY_SHARE, leaf_lines: int | None = None) -> DataFrame:
    """(doc_id, key, line_no, template, n_docs) of each line that goes.

    Lines are masked (tokens with digits become <*>), led by token count and first three tokens to a leaf of the tree, and
    there joined to the most similar template if 70 % of their fixed tokens, and four at least, agree; what differs becomes <*>.
    A leaf has as many lines as there are: whether two lines meet doesn't depend on how many others there are, unless the
    caller sets leaf_lines, from which on a leaf branches on further tokens. Lines of up to three tokens are whole paths of the
    tree, so they meet their equals alone. Lines of a leaf come in the order of their text, so that the result doesn't
    depend on partitions. A template recurs in min_docs unlike texts or more; it has four fixed tokens, or no variable field
    where it is shorter. Equal texts count once: to drop copies of a document is document dedup's work.

    The lines of a recurring template go from every document. Text that was copied with changes would be lost altogether
    that way: where documents of which more than copy_share recurs are more than copy_share of those with a template, it
    stays in the first text of them (the least id, then hash of the text) and goes from all others.

    Null and empty texts and blank lines have no template. Rows that repeat a text have the same lines go, whatever their
    doc_id, null ones too; key is a hash of the text. A very long line is a line like others. An empty table gives no rows.
    """
    r = cut(recurring_lines(docs, min_docs, leaf_lines).distinct())
    whole = r.groupBy("id", "key").agg(F.sum("size").alias("cut"), F.max("total").alias("all")).where(F.col("cut") > F.col("all") * F.lit(copy_share)).select(F.col("id").alias("i"), F.col("key").alias("k"))
    held = r.join(whole, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k"))).groupBy("template", "key").agg(F.min(F.struct("id", "key")).alias("first"), F.max("n_docs").alias("of"))
    # the least struct, in which a null id comes first
    first = held.groupBy("template").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.min("first").alias("first")).where(F.col("n") > F.col("of") * F.lit(copy_share))
    stays = first.select("template", F.col("first.key").alias("key"))
    return r.join(stays, ["template", "key"], "left_anti").select(F.col("id").alias("doc_id"), "key", "line_no", "template", "n_docs")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, copy_share: float = COPY_SHARE) -> DataFrame:
    """docs with gone_lines() cut out of text (and n_chars, where there is one, brought up to date), in its columns.

    A row of which nothing but blank lines is left is a copy of what stays elsewhere, and goes. All others stay, those with
    null or blank text too.
    """
    i, k, gone, key = fresh(docs, "_i"), fresh(docs, "_ik"), fresh(docs, "_gone"), fresh(docs, "_key")
    drop = cut(gone_lines(docs, min_docs, copy_share).groupBy(F.col("doc_id").alias(i), F.col("key").alias(k)).agg(F.collect_set("line_no").alias(gone)))
    out = docs.withColumn(key, text_key(F.col("text"))).join(small(drop), F.col("doc_id").cast("bigint").eqNullSafe(F.col(i)) & (F.col(key) == F.col(k)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, j: ~F.array_contains(F.col(gone), j)), "\n")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)
    out = out.where(F.col(gone).isNull() | kept.rlike("[^ \t\r\n]"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(kept).cast(docs.schema[c].dataType)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gone_lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", "template", "n_docs")
