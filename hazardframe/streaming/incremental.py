"""Incremental runners for the stateless operators (no new operators).

The reference has no streams. Two of its batch operators are row-local, so they can also run
as Structured Streaming queries over files that keep arriving: the name filter (R4) and the
recognised-text scoring (R9/R10, a stream-static join against the ground truth). File source
+ file sink + the caller's checkpoint folder (the same one after a restart) give exactly-once output; ``availableNow`` processes what is there
and stops, so the same code serves scheduled batch and continuous use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hazardframe.functions.text import cer, normalize_text, wer
from hazardframe.operators.names import prune_names

def _start(df: DataFrame, sink_dir: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    w = (df.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_prune_names(spark: SparkSession, source_dir: str, schema: StructType | str, sink_dir: str,
                       checkpoint: str, name_col: str = "Synonyms",
                       available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Keep plain names from name files as they arrive (parquet in, parquet out)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return _start(prune_names(r.parquet(source_dir), name_col), sink_dir, checkpoint, available_now)


def stream_text_scores(spark: SparkSession, runs_dir: str, runs_schema: StructType | str, truth: DataFrame,
                       sink_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Score recognition runs (image_id, engine, text, time) as they arrive against a static
    ground-truth table (image_id, text); runs without ground truth get NULL metrics."""
    runs = spark.readStream.schema(runs_schema).parquet(runs_dir)
    t = truth.select("image_id", F.col("text").alias("truth"))
    has_truth = F.col("truth").isNotNull() & (F.col("truth") != "")
    scored = runs.join(t, "image_id", "left").select(
        "image_id", "engine",
        F.when(has_truth, cer(F.coalesce("text", F.lit("")), "truth")).alias("cer"),
        F.when(has_truth, wer(F.coalesce("text", F.lit("")), "truth")).alias("wer"),
        "time", normalize_text("text").alias("predicted_text"))
    return _start(scored, sink_dir, checkpoint, available_now)
