"""Rows that no operator may trip over: nulls in any column, empty and long texts, repeated rows, clashing names."""

import pytest

TEXT = "The quick brown fox jumps over the lazy dog near the river bank. It was a fine day for a walk in the park."
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, _id long, `_lines` string, copy int, `Hash` string, shard string, `a.b` int"


def rows():
    long = "\n".join(f"Line {i} of a very long text that goes on and on with words." for i in range(3000))
    out = [(1, TEXT, "en", "a", len(TEXT)), (1, TEXT, "en", "a", len(TEXT)), (2, TEXT, "en", "a", len(TEXT)), (3, None, "en", "a", None), (4, "", "en", None, 0), (None, TEXT + " More here.", None, "b", 5), (None, None, None, None, None), (5, " \n\t\n ", "fr", "b", 5), (6, long, "en", "b", len(long)), (7, "x" * 200_000, "en", "b", 1), (8, "\n".join([TEXT] * 3), "en", "c", 1), (9, "émoji 😀 ünï.", "de", "", 1)]
    return [(*r, "k", i, None, 3, "h", "s", None) for i, r in enumerate(out)]


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda x: (x is not None, x or 0))


__all__ = ["TEXT", "empty", "ids", "pytest", "rows", "table"]
