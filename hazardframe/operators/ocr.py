"""Recognised-text scoring.

Input is a table of recognition runs (image_id, engine, text, time) - the recognition itself is
outside this engine - plus ground truth (image_id, text). All scoring is Column expressions
over joins; one aggregation gives the per-engine summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.functions.text import cer, file_stem, normalize_text, round_ratio, wer, zero_pad
from hazardframe.functions.udfs import edit_counts_udf

# Engine order of the comparison.
DEFAULT_ENGINES = ["paddleocr", "doctr", "tesseract"]


def engine_grid(images: DataFrame, engines: list[str]) -> DataFrame:
    """Every (image, engine) cell with the image's columns; the engine list is a literal, so this
    is a generator per image row (no join, no shuffle)."""
    arr = F.array(*[F.struct(F.lit(i).alias("engine_idx"), F.lit(e).alias("engine")) for i, e in enumerate(engines)])
    return images.select("*", F.inline(arr))


def evaluate_runs(runs: DataFrame, truth: DataFrame, engines: list[str] | None = None,
                  truth_images: bool = True) -> tuple[DataFrame, DataFrame]:
    """Score every (image, engine) cell.

    ``runs``: image_id, engine, text, time (a missing row = the engine failed on that image).
    ``truth``: image_id, text. Returns (metrics, text_pairs):
      metrics    image_id, engine, cer, wer, time - NULLs for a failed run, and NULL cer/wer
                 when the image has no (or an empty) ground truth;
      text_pairs image_id, engine, predicted_text, actual_text - normalised, '' for a failure.
    """
    engines = engines or DEFAULT_ENGINES
    t = truth.select("image_id", F.col("text").alias("truth"))
    images = t if truth_images else runs.select("image_id").distinct().join(t, "image_id", "left")
    grid = engine_grid(images, engines)
    r = runs.select("image_id", "engine", F.col("text").alias("pred"), "time", F.lit(True).alias("ran"))
    cells = grid.join(r, ["image_id", "engine"], "left")
    has_truth = F.col("truth").isNotNull() & (F.col("truth") != "")
    ok = F.col("ran").isNotNull()
    pred = F.coalesce(F.col("pred"), F.lit(""))
    metrics = cells.select(
        "image_id", "engine", "engine_idx",
        F.when(ok & has_truth, cer(pred, "truth")).alias("cer"),
        F.when(ok & has_truth, wer(pred, "truth")).alias("wer"),
        F.when(ok, F.col("time")).alias("time"),
    )
    pairs = cells.select(
        "image_id", "engine", "engine_idx",
        F.when(ok, normalize_text(pred)).otherwise(F.lit("")).alias("predicted_text"),
        normalize_text("truth").alias("actual_text"),
    )
    return metrics, pairs


def summarize(metrics: DataFrame, engines: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Per engine mean CER / WER / time over runs that did not fail, each rounded like
    Python's ``round(mean, 4)``; an engine without a successful run gets a NULL row.

    Means of values that carry at most ``digits`` decimals are formed as exact integer sums,
    so the rounding sees the exact mean.
    """
    engines = engines or DEFAULT_ENGINES
    scale = 10 ** digits
    spark = metrics.sparkSession
    eng = spark.createDataFrame([(i, e) for i, e in enumerate(engines)], "engine_idx int, engine string")

    def mean(c):
        units = F.round(F.col(c) * scale).cast("long")
        return round_ratio(F.sum(units), F.count(F.col(c)) * F.lit(scale), digits)

    agg = (metrics.filter(F.col("time").isNotNull())
           .groupBy("engine")
           .agg(mean("cer").alias("avg_cer"), mean("wer").alias("avg_wer"), mean("time").alias("avg_time")))
    return eng.join(agg, "engine", "left").select("engine", "engine_idx", "avg_cer", "avg_wer", "avg_time")


def missing_keys(spark: SparkSession, present: DataFrame, key: str, lo: int, hi: int, width: int = 3,
                 num_partitions: int | None = None) -> DataFrame:
    """Expected ids lo..hi that are absent from ``present``, zero-padded for display.

    Ids are compared as numbers ('007' is 7; text that is no number is no id) and padded
    afterwards, so ids longer than ``width`` stay whole. The expected range is generated
    distributed (``spark.range``), never as one array.
    """
    expected = spark.range(lo, hi + 1, numPartitions=num_partitions)
    have = present.select(F.col(key).cast("string").try_cast("bigint").alias("id"))
    return expected.join(have, "id", "left_anti").select(zero_pad("id", width).alias(key))


def listed_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every file with content under ``path`` (path, length, stem); the contents are not read. Large trees are listed by the cluster.
    An empty file is no file here."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (r.option("pathGlobFilter", glob) if glob else r).load(path).select("path", "length")
    return files.withColumn("stem", file_stem("path"))


def missing_files(spark: SparkSession, path: str, lo: int, hi: int, width: int = 3, glob: str | None = None, id_pattern: str | None = None) -> DataFrame:
    """Expected ids lo..hi without a file under ``path``. A file's id is its stem, or the first group of ``id_pattern`` in its path."""
    files = listed_files(spark, path, glob)
    found = files.select((F.regexp_extract("path", id_pattern, 1) if id_pattern else F.col("stem")).alias("image_id"))
    return missing_keys(spark, found, "image_id", lo, hi, width)


def error_rates(df: DataFrame, pred: str, truth: str, digits: int = 4) -> DataFrame:
    """R9 and R10 for texts of any length: ``df`` with cer and wer. Same rules and numbers as ``cer`` and ``wer``, which fill
    the whole edit matrix; here the cost follows length and distance (``functions.edits``), in Arrow batches."""
    t = F.col(truth)
    rows = df.withColumn("__p", normalize_text(pred)).withColumn("__t", normalize_text(truth)).withColumn("__e", edit_counts_udf("__p", "__t"))

    def rate(edits, size):
        empty = F.when(F.col("__p") == "", F.when(size > 0, F.lit(1.0)).otherwise(F.lit(0.0))).when(size == 0, F.lit(1.0))
        return F.when(t.isNull() | (t == ""), F.lit(1.0)).otherwise(empty.otherwise(round_ratio(edits, size, digits)))

    e = F.col("__e")
    return rows.withColumn("cer", rate(e["chars"], e["ref_chars"])).withColumn("wer", rate(e["words"], e["ref_words"])).drop("__p", "__t", "__e")


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {image_id: text} per file -> (image_id, text) rows."""
    raw = spark.read.text(path, wholetext=True)  # the text() keyword wins over .option()
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("image_id", "text"))
