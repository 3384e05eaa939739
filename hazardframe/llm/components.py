"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.common import spool


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or smaller-or-equal) neighbours are linked to its least neighbour."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    if not large:
        both = both.filter("v < u")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    ends = both.join(least, "u")
    ends = ends.filter("v > u") if large else ends.unionByName(least.select("u", F.col("u").alias("v"), "m"))
    return ends.filter("v <> m").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b")).distinct()


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """links (a, b) -> node, label (the least node it is connected with), for nodes that have a link. The
    number of rounds grows with the logarithm of the longest path; each round's links are written down."""
    links = spool(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        links = spool(_stars(_stars(links, True), False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("star contraction has not settled")
    return links.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("label"))).distinct()
