"""Queries of problems 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import fusion, topn
from foliant.sources.tables import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_results").withColumn("project", F.coalesce("project", F.lit("")))
    return topn.top_n(hits, ["query_id", "project"], ["file", "line"], "score", 5).select("query_id", "project", "file", "line")


def p4_ranked(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "search_results").withColumn("project", F.coalesce("project", F.lit("")))
    return topn.top_n(hits, ["query_id", "project"], ["file", "line"], "score", 5)


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    both = {"text": table(spark, sf, "search_results"), "vector": table(spark, sf, "vector_results")}
    return fusion.fuse(both, ["query_id"], ["project", "file"])


def p5_fused(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).withColumn("total", F.round("total", 10))


def p5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Mean NDCG at 10 of the fused ranking and of each score alone, over the judged queries."""
    fused, judged = _fused(spark, sf), table(spark, sf, "relevance")
    out = None
    for name, order in (("fused", "position"), ("text", "text_rank"), ("vector", "vector_rank")):
        one = fusion.ndcg(fused, judged, ["query_id"], ["project", "file"], order)
        one = one.agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_10")).withColumn("ranking", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p4_found": p4_found, "p4_ranked": p4_ranked, "p5_fused": p5_fused, "p5_quality": p5_quality}

_TOP = """
WITH h AS (SELECT query_id, coalesce(project,'') AS project, file, line, max(score) AS score FROM search_results
  WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, project ORDER BY score DESC, file, line) AS rank FROM h)
"""
_FUSE = """
WITH u AS (
  SELECT query_id, coalesce(project,'') AS project, file, CASE WHEN NOT isnan(score) THEN score END AS t, NULL::DOUBLE AS v FROM search_results
  UNION ALL SELECT query_id, coalesce(project,''), file, NULL, CASE WHEN NOT isnan(score) THEN score::DOUBLE END FROM vector_results),
b AS (SELECT query_id, project, file, max(t) AS t, max(v) AS v FROM u WHERE t IS NOT NULL OR v IS NOT NULL GROUP BY ALL),
r AS (SELECT *, CASE WHEN t IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY t DESC NULLS LAST) END AS text_rank,
  CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY v DESC NULLS LAST) END AS vector_rank FROM b),
s AS (SELECT *, coalesce(1.0::DOUBLE/(60+text_rank),0) + coalesce(1.0::DOUBLE/(60+vector_rank),0) AS total FROM r),
f AS (SELECT query_id, project, file, text_rank, vector_rank, total, rank() OVER (PARTITION BY query_id ORDER BY total DESC) AS position FROM s)
"""
_ONE = """SELECT '{0}' AS ranking, count(*) AS queries, round(avg(CASE WHEN ideal > 0 THEN coalesce(got,0)/ideal ELSE 1 END), 6) AS ndcg_at_10
FROM ideal LEFT JOIN (SELECT query_id, sum((2.0::DOUBLE**g - 1)/log2({1} + 1.0::DOUBLE)) AS got FROM f JOIN j USING (query_id, project, file) WHERE {1} <= 10 GROUP BY 1) USING (query_id)"""

SQL = {
    "p4_found": _TOP + "SELECT query_id, project, file, line FROM r WHERE rank <= 5",
    "p4_ranked": _TOP + "SELECT query_id, project, file, line, score, rank FROM r WHERE rank <= 5",
    "p5_fused": _FUSE + "SELECT query_id, project, file, text_rank, vector_rank, round(total, 10) AS total, position FROM f",
    "p5_quality": _FUSE + """, j AS (SELECT query_id, coalesce(project,'') AS project, file, max(coalesce(grade,0)) AS g FROM relevance GROUP BY ALL),
ideal AS (SELECT query_id, sum((2.0::DOUBLE**g - 1)/log2(p + 1.0::DOUBLE)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC) AS p FROM j) WHERE p <= 10 GROUP BY 1)
""" + " UNION ALL ".join(_ONE.format(*x) for x in (("fused", "position"), ("text", "text_rank"), ("vector", "vector_rank"))),
}
