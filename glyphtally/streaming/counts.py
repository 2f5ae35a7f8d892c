"""The exact counts, kept up to date over a stream of text files or documents by Structured Streaming.

Batch and stream share their expressions: tokens and pairs are narrow, and the count is one stateful aggregation by key,
so the sums after the last batch are those of the batch query over the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import col

from ..config import Config
from ..functions.tokens import words
from ..operators import ngrams
from ..sources.corpus import hashed_parts


def document_stream(spark: SparkSession, path: str, max_files: int = 1) -> DataFrame:
    """New Parquet files of documents (doc_id, text) in a folder, some a trigger."""
    return spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", max_files).parquet(path)


def streaming_counts(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """(part, kind, key, freq) of a stream of documents; write it in output mode update or complete."""
    tokens = hashed_parts(docs, config.parts).select("part", words(col("text")).alias("tokens"))
    return ngrams.count(ngrams.keys(tokens, config.window))
