"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import markup
from foliant.sources.tables import table

KEY = ["project", "file", "chunk_id"]


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "index_chunks").select(*[F.coalesce(k, F.lit("" if k != "chunk_id" else 0)).alias(k) for k in KEY], "title", "body", "indexed_at")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = markup.residue(_chunks(spark, sf), KEY, "title", "body", texts=False)
    return rows.select(*KEY, F.explode("markup").alias("markup")).distinct()


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Clean text per chunk; repeated rows of a chunk come out once."""
    rows = markup.residue(_chunks(spark, sf), KEY, "title", "body")
    return rows.withColumn("markup", F.concat_ws(",", "markup")).dropDuplicates()


def p6_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by project and markup language."""
    return p6_found(spark, sf).groupBy("project", "markup").agg(F.count("*").alias("chunks"))


QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean, "p6_profile": p6_profile}
SQL: dict[str, str] = {}
