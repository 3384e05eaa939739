"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.session import scratch_path, ship_package

#: Words of every operator here: runs of characters outside space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: the lineage ends there,
    a lost executor costs nothing that was written, and later plans see real sizes."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_spool(df: DataFrame) -> None:
    """Remove a table that ``spool`` wrote, once nothing that is still to run reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col.cast("string"), F.lit("")), _UPPER, _LOWER)


def word_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct, so that names of an operator's own can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def row_hash() -> Column:
    """A hash of all columns of a packed row, by which rows of one id and text have one order in every run."""
    return F.xxhash64(F.col("row").cast("string"))


def bounded_batches(spark: SparkSession, rows: int = 1024, size: int = 32 << 20) -> None:
    """Arrow batches for the Python operators: few rows each, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
