"""Parquet tables by name, and the mapping of supplied tables onto the document model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (project, file, ext, content): project is the source, '' where missing; the file name is made of the id."""
    return table(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("")).alias("project"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        F.lit("txt").alias("ext"),
        F.coalesce("text", F.lit("")).alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a vector store: (project, file, chunk_id, embedding)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("project"),
        F.col("vec_id").cast("string").alias("file"),
        F.lit(0).cast("long").alias("chunk_id"),
        "embedding",
    )
