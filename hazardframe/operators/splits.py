"""Exact, repeatable splits (M1, M4, M5, M9) without a global sort.

Every row gets a rank inside its stratum in the order of ``md5(key || '|' || seed)``. The rank
is computed in two distributed steps instead of one sort per stratum:
  1. a histogram of (stratum, hash bucket) counts (map-side combined; 2^20 buckets from the
     first five hex digits of the hash), turned into running totals per stratum - a small table;
  2. the rank inside the row's own bucket (a window over one (stratum, bucket) partition).
rank = rows in earlier buckets + rank inside the bucket. A stratum holding a third of all rows
is spread over a million buckets, so no task sorts more than a bucket's share.
The result does not depend on partitioning, task order or the number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 5  # 2^20 buckets


def hash_order(key, seed: int) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"|{seed}")))


def hash_rank(df: DataFrame, key: str, strata: str | None = None, seed: int = 42) -> DataFrame:
    """Adds ``__rank`` (1-based, inside the stratum, by hash then key) and ``__n`` (stratum size)."""
    s = F.col(strata) if strata else F.lit(0)
    d = df.withColumn("__s", s).withColumn("__h", hash_order(key, seed))
    d = d.withColumn("__b", F.conv(F.substring("__h", 1, BUCKET_HEX_DIGITS), 16, 10).cast("long"))
    hist = d.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("__before", F.sum("__c").over(w) - F.col("__c"))
            .withColumn("__n", F.sum("__c").over(Window.partitionBy("__s"))))
    d = d.join(hist.select("__s", "__b", "__before", "__n"), ["__s", "__b"])
    wb = Window.partitionBy("__s", "__b").orderBy("__h", key)
    return d.withColumn("__rank", F.col("__before") + F.row_number().over(wb)).drop("__before", "__b", "__h", "__s")


def stratified_split(df: DataFrame, key: str, strata: str | None, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """M4/M5: adds boolean ``is_test``: the first ceil(test_fraction * n) rows of each stratum
    in hash order (one stratum when ``strata`` is None).

    The histogram gives each stratum's boundary bucket and how many of that bucket's rows are still test
    rows; only the keys of boundary buckets are ranked, for the last test row of each stratum. Every row is then
    decided by comparing its own (hash, key) with that one, so rows are neither shuffled nor sorted.
    """
    name = strata if strata else "__all"
    rows = df if strata else df.withColumn("__all", F.lit(0))
    keys = rows.select(F.col(name).alias("__s"), F.col(key).alias("__k"), hash_order(key, seed).alias("__h"))
    keys = keys.withColumn("__b", F.conv(F.substring("__h", 1, BUCKET_HEX_DIGITS), 16, 10).cast("long"))
    hist = keys.groupBy("__s", "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (hist.withColumn("__upto", F.sum("__c").over(w))
            .withColumn("__quota", F.ceil(F.sum("__c").over(Window.partitionBy("__s")) * F.lit(test_fraction))))
    edge = hist.filter((F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("__c") < F.col("__quota")))
    edge = edge.select(F.col("__s").alias("__es"), F.col("__b").alias("__eb"), (F.col("__quota") - F.col("__upto") + F.col("__c")).alias("__left"))
    if not strata:
        edge = F.broadcast(edge)  # one row
    near = keys.join(edge, F.col("__s").eqNullSafe(F.col("__es")) & (F.col("__b") == F.col("__eb")))
    nth = F.row_number().over(Window.partitionBy("__s").orderBy("__h", "__k"))
    last = near.withColumn("__n", nth).filter(F.col("__n") == F.col("__left")).select(F.col("__s").alias("__ls"), F.struct("__h", "__k").alias("__last"))
    if not strata:
        last = F.broadcast(last)  # one row
    mine = F.struct(hash_order(key, seed).alias("__h"), F.col(key).alias("__k"))
    out = rows.join(last, F.col(name).eqNullSafe(F.col("__ls")), "left")
    return out.withColumn("is_test", F.coalesce(mine <= F.col("__last"), F.lit(False))).select(*df.columns, "is_test")


def split(df: DataFrame, key: str, strata: str | None = None, test_fraction: float = 0.2,
          seed: int = 42) -> tuple[DataFrame, DataFrame]:
    s = stratified_split(df, key, strata, test_fraction, seed)
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter(F.col("is_test")).drop("is_test")


def fold_column(df: DataFrame, key: str, strata: str | None, k: int = 5, seed: int = 42,
                name: str = "fold") -> DataFrame:
    """M9: stratified fold number 0..k-1 = (rank in stratum - 1) mod k."""
    r = hash_rank(df, key, strata, seed)
    return r.withColumn(name, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank", "__n")
