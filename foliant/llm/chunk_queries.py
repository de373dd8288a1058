"""Queries of problems 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import packing, splitting
from foliant.sources.tables import table

KEY = ["project", "file", "chunk_id"]


def with_limits(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """Chunks with the limit and overlap of their configuration; a missing configuration is 0. chunk_config is a fixed,
    small table; its size is left to the planner's own broadcast check."""
    c = config.select(F.col("config_id").alias("_c"), "prose_size", "prose_overlap", "md_heading_max")
    rows = chunks.withColumn("_cfg", F.coalesce("config_id", F.lit(0)))
    limit = F.when(F.col("ext").isin("md", "markdown"), F.col("md_heading_max")).otherwise(F.col("prose_size"))
    return rows.join(c, rows["_cfg"] == c["_c"], "left").select(*[F.coalesce(k, F.lit("" if k != "chunk_id" else 0)).alias(k) for k in KEY], "body", limit.alias("limit"), F.col("prose_overlap").alias("overlap"), "indexed_at")


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_limits(table(spark, sf, "index_chunks"), table(spark, sf, "chunk_config"))
    return splitting.split(rows, KEY, "body", "limit", "overlap")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """A chunk has a second piece exactly if it is above its limit."""
    return _pieces(spark, sf).filter("piece = 1").select(*KEY).distinct()


def p7_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every chunk; repeated rows of a chunk give the same pieces once."""
    return _pieces(spark, sf).dropDuplicates([*KEY, "piece", "start", "end"])


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """A document has a second piece exactly if it alone exceeds a container."""
    return _packed(spark, sf).filter("piece = 1").select("doc_id")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of their capacity that is used."""
    used = _packed(spark, sf).groupBy("container").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("used"))
    return used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * packing.CAPACITY), 4).alias("fill"), F.max("used").alias("fullest"))


QUERIES = {"p7_found": p7_found, "p7_pieces": p7_pieces, "p8_found": p8_found, "p8_packed": p8_packed, "p8_fill": p8_fill}
SQL = {
    "p7_found": """SELECT DISTINCT coalesce(project,'') AS project, coalesce(file,'') AS file, coalesce(chunk_id,0) AS chunk_id FROM index_chunks
LEFT JOIN chunk_config c ON c.config_id = coalesce(index_chunks.config_id, 0)
WHERE length(body) > CASE WHEN ext IN ('md','markdown') THEN md_heading_max ELSE prose_size END""",
}
