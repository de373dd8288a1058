"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm import neighbours
from foliant.sources.tables import table


def usable_vectors(spark: SparkSession, sf: str) -> DataFrame:
    meta = table(spark, sf, "vector_meta").select("model", "dimension").filter("model is not null and dimension > 0")
    dimensions = {r[0]: r[1] for r in meta.collect()}  # fixed, small
    return neighbours.usable(table(spark, sf, "embedding_cache"), dimensions, "vec_id", "model", "embedding", "cached_at")


def _graph(spark: SparkSession, sf: str) -> neighbours.Graph:
    return neighbours.build(usable_vectors(spark, sf))


def p3_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(_graph(spark, sf)).select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), F.round(F.col("s").cast("double"), 4).alias("similarity"), "rank")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbours.nearest(_graph(spark, sf)).filter("s >= 0.9")
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p3_search(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy search for every usable row whose id is divisible by 20, a copy or not: the five most similar others."""
    graph = _graph(spark, sf)
    queries = neighbours.members(graph).filter("id % 20 = 0").select(F.col("id").alias("q"), "model", "vec")
    # six, as the row itself may be among them; among many copies it need not be
    found = neighbours.search(graph, queries, 6).filter("q <> id").withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("rank"))).filter("place <= 5")
    return found.select(F.col("q").alias("vec_id"), F.col("id").alias("neighbour_id"), F.round(F.col("s").cast("double"), 4).alias("similarity"))


QUERIES = {"p3_found": p3_found, "p3_neighbours": p3_neighbours, "p3_search": p3_search}
_NEAR = """
WITH u AS (SELECT e.vec_id, e.model, max(e.embedding::DOUBLE[]) AS v FROM embedding_cache e JOIN vector_meta m ON m.model = e.model AND m.dimension = len(e.embedding)
  WHERE list_sum(list_transform(e.embedding, lambda x: CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 1 ELSE 0 END)) = 0 AND list_max(list_transform(e.embedding, lambda x: abs(x))) > 0 GROUP BY ALL),
s AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS s FROM u a JOIN u b ON a.model = b.model AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 6) DESC, other) AS rank FROM s)
"""
SQL = {"p3_found": _NEAR + "SELECT DISTINCT least(vec_id, other) AS vec_id_a, greatest(vec_id, other) AS vec_id_b FROM r WHERE rank <= 5 AND s >= 0.9"}
