"""Training-data pipeline over the documents table: five stages, each one of the operators in
``hazardframe.llm``, each written as Parquet and read again as the next one's documents.

quality      base rules and the perplexity band; what they reject goes
exact        of equal texts (A-Z lower-cased) the largest doc_id stays
near         of documents linked by 5-word shingles at a Jaccard similarity of 0.8 or more the smallest doc_id stays
mix          sources are mixed to their target weights: documents come as often as they have copies, or not at all
pack         best-fit packing into sequences of at most 2048 tokens, one row per piece

All stages but the last return the columns of documents. Null texts are empty; they leave in the first
stage. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazardframe.llm import entropy_mix, exact_dedup, jaccard_join, quality_ppl, vector_pack
from hazardframe.llm.common import documents, spool
from hazardframe.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_ppl.good_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return entropy_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return vector_pack.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: The model of the first stage and the rounding of the fourth are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
