from pyspark.sql import functions as F

from glyphtally.functions.tokens import words
from glyphtally.operators import ngrams
from glyphtally.sources.corpus import hashed_parts
from glyphtally.streaming.counts import document_stream, streaming_counts


def test_stream_equals_batch(spark, tmp_path):
    d = spark.createDataFrame([(i, f"a b w{i % 4} a") for i in range(40)], "doc_id long, text string")
    d.repartition(4).write.parquet(f"{tmp_path}/in")
    q = streaming_counts(document_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = ngrams.count(ngrams.keys(hashed_parts(d).select("part", words(F.col("text")).alias("tokens"))))
    assert sorted(map(tuple, spark.sql("SELECT part, kind, key, freq FROM counts").collect())) == sorted(map(tuple, batch.collect()))
