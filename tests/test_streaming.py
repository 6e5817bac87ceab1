import os

import pytest

from eventlens.plans.pipelines import emotion_features
from eventlens.operators.schema import conform
from eventlens.streaming import stream_emotion_features, stream_posts

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_stream_equals_batch(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    stream = stream_posts(spark, SF, schema, glob="documents.parquet")
    assert stream.isStreaming
    q = (
        stream_emotion_features(stream).select("doc_id", "clean_text", "word_count")
        .writeStream.format("memory").queryName("eventlens_stream_test").outputMode("append").start()
    )
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.sql("SELECT * FROM eventlens_stream_test").collect())
    finally:
        q.stop()
    batch = spark.read.parquet(f"{SF}/documents.parquet")
    want = emotion_features(conform(batch, extra=["doc_id"]), "raw_text").select("doc_id", "clean_text", "word_count")
    assert got == sorted(tuple(r) for r in want.collect())
