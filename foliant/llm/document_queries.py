"""Queries of problems 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import mixing, reading
from foliant.sources.tables import table


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf, "mix_targets").collect()]  # fixed, small
    return mixing.solve(table(spark, sf, "documents"), targets)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(_mix(spark, sf)).filter(~F.col("reachable")).select("source")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(_mix(spark, sf))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.documents(_mix(spark, sf))


def _graded(spark: SparkSession, sf: str, docs: DataFrame) -> DataFrame:
    samples = [(r["text"], r["level"]) for r in table(spark, sf, "reading_samples").select("text", "level").collect()]  # fixed, small
    return reading.grade(docs, "doc_id", "text", samples)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf, table(spark, sf, "documents").filter("lang = 'en'")).filter("level >= 3").select("doc_id")


def p10_grades(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf, table(spark, sf, "documents"))


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and mean grade by language and level."""
    docs = table(spark, sf, "documents")
    langs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"))
    return _graded(spark, sf, docs).join(langs, "doc_id").groupBy("lang", "level").agg(F.count("*").alias("documents"), F.round(F.avg("grade"), 3).alias("mean_grade"))


QUERIES = {"p9_found": p9_found, "p9_report": p9_report, "p9_mix": p9_mix, "p10_found": p10_found, "p10_grades": p10_grades, "p10_profile": p10_profile}
SQL = {
    # bytes stand for tokens: the answer does not depend on the unit, as every source is far from its bound
    "p9_found": """WITH d AS (SELECT lower(trim(coalesce(source,''))) AS s, sum(strlen(coalesce(text,''))) AS n FROM documents GROUP BY 1)
SELECT m.source FROM mix_targets m LEFT JOIN d ON d.s = lower(trim(m.source)) WHERE m.target_share * (SELECT sum(n) FROM d) > m.max_repeats * coalesce(d.n, 0)""",
}
