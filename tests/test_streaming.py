"""The incremental runners give the batch answer over files that arrive in two rounds."""

import tempfile

from pyspark.sql import functions as F

from hazardframe.operators.names import prune_names
from hazardframe.streaming.incremental import stream_prune_names, stream_text_scores
from hazardframe.functions.text import cer


def test_stream_prune_names_two_rounds(spark):
    base = tempfile.mkdtemp(prefix="hf-stream-")
    rows = [(1, "Benzene"), (2, "50-00-0"), (3, "water"), (4, "Aspirin"), (5, "salt"), (6, None)]
    schema = "CID long, Synonyms string"
    spark.createDataFrame(rows[:3], schema).write.parquet(f"{base}/in/r1")
    q = stream_prune_names(spark, f"{base}/in/*", schema, f"{base}/out", checkpoint=f"{base}/ck")
    q.awaitTermination()
    spark.createDataFrame(rows[3:], schema).write.parquet(f"{base}/in/r2")
    q = stream_prune_names(spark, f"{base}/in/*", schema, f"{base}/out", checkpoint=f"{base}/ck")
    q.awaitTermination()
    got = sorted(r.CID for r in spark.read.parquet(f"{base}/out").collect())
    want = sorted(r.CID for r in prune_names(spark.createDataFrame(rows, schema)).collect())
    assert got == want == [1, 3, 5]


def test_stream_text_scores(spark):
    base = tempfile.mkdtemp(prefix="hf-stream-")
    truth = spark.createDataFrame([("001", "water, salt"), ("002", "sugar")], "image_id string, text string")
    schema = "image_id string, engine string, text string, time double"
    spark.createDataFrame([("001", "doctr", "water salt", 1.0), ("003", "doctr", "x", 2.0)], schema) \
        .write.parquet(f"{base}/runs/r1")
    q = stream_text_scores(spark, f"{base}/runs/*", schema, truth, f"{base}/out", checkpoint=f"{base}/ck")
    q.awaitTermination()
    got = {r.image_id: r.cer for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {"001": round(1 / 11, 4), "003": None}
