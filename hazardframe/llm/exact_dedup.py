"""Operator 9, exact dedup by skew-safe combining [native].

Each input task first merges its own equal texts (map-side combine), the survivors merge within
(digest, salt) groups, and the salt winners merge globally. All three stages group by the digest
*and* the whole normalised text, so two texts with one digest never merge. A hot text, however
many rows it has, reaches the first shuffle as one row per input task, the second as one row
per salt.

Membership needs no text: winners are written down as (digest, keep_id, size), rows find theirs
by digest. Only where one digest stands for several texts (a collision; never seen with SHA-256,
forced in the tests by a weak digest) are its rows compared by text again.

Defined results: null text is the empty text; of equal texts the largest id stays; null ids lose
against any other; rows that repeat both id and text are each marked kept in ``mark_copies`` and
counted in the size, ``drop_copies`` returns one of them; an empty table gives an empty result;
other columns, whatever their names, are ignored by ``mark_copies`` and carried by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.llm.common import documents, lower_ascii, packed, row_hash, spool

SALTS = 32


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """rows (id, norm, digest) -> one row per distinct text: digest, norm, keep_id, size."""
    salted = (rows.withColumn("salt", F.spark_partition_id() % salts)
              .groupBy("digest", "salt", "norm")
              .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("size")))
    return (salted.groupBy("digest", "norm")
            .agg(F.max("keep_id").alias("keep_id"), F.sum("size").alias("size")))


def _groups(rows: DataFrame, salts: int) -> tuple[DataFrame, DataFrame, bool]:
    """Winners without their texts, the digests that stand for several texts, whether any does."""
    winners = spool(_winners(rows, salts).select("digest", "keep_id", "size"), "exact-winners")
    shared = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    return winners, shared, not shared.isEmpty()


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per input row: id, digest, keep_id, size (see the module's text)."""
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), lower_ascii(F.col(f"`{text_col}`")).alias("norm"))
            .withColumn("digest", digest(F.col("norm"))))
    winners, shared, collided = _groups(rows, salts)
    plain = rows.select("id", "digest")
    if not collided:
        return plain.join(winners, "digest").select("id", "digest", "keep_id", "size")
    by_text = _winners(rows.join(shared, "digest", "left_semi"), salts)
    return (plain.join(winners.join(shared, "digest", "left_anti"), "digest").select("id", "digest", "keep_id", "size")
            .unionByName(rows.join(by_text, ["digest", "norm"]).select("id", "digest", "keep_id", "size")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=sha256) -> DataFrame:
    """The rows that stay, with all their columns: one per distinct normalised text.

    Rows find their group by (id, digest), which no single key dominates, so the hot text's
    copies aren't gathered; equal (id, text) rows meet there and one of them is kept.
    """
    norm = lower_ascii(F.col(f"row.`{text_col}`"))
    rows = packed(docs).withColumn("id", F.col(f"row.`{id_col}`")).withColumn("digest", digest(norm))
    marks = mark_copies(docs, id_col, text_col, salts, digest)
    winners = marks.filter(F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("keep_id"), F.col("digest").alias("won")).distinct()
    kept = rows.join(winners, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("won")))
    order = Window.partitionBy("keep_id", "won", norm).orderBy(row_hash())
    return kept.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("row.*")


def op9_exact_dedup(spark, sf_dir):
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of documents."""
    out = mark_copies(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("size").cast("long").alias("group_size"),
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, g.text_sha256 FROM n JOIN g USING (norm)
"""
