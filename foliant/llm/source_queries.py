"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import syntax
from foliant.sources.tables import table


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "source_modules").select(F.coalesce("project", F.lit("")).alias("project"), F.coalesce("module_path", F.lit("")).alias("module_path"), F.col("language").alias("named"), F.col("module_path").alias("path"), "content")
    return syntax.judge(files, ["project", "module_path"], "named", "path", "content")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _judged(spark, sf).filter("not valid").select("project", "module_path").distinct()


def p2_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every file with its verdict; repeated rows once."""
    return _judged(spark, sf).distinct()


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Files that do not parse per project and language, beside what the project's jobs reported as skipped (null where none did)."""
    rates = p2_flags(spark, sf).groupBy("project", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("broken"), F.count_if(F.col("reason") == "end").alias("truncated"),
    )
    said = table(spark, sf, "code_index_results").distinct().groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.sum("files_skipped").alias("reported_skipped"))
    whole = rates.groupBy("project").agg(F.sum("broken").alias("project_broken"))
    return rates.withColumn("rate", F.round(F.col("broken") / F.col("files"), 6)).join(whole, "project").join(said, "project", "left")


QUERIES = {"p2_found": p2_found, "p2_flags": p2_flags, "p2_rates": p2_rates}
SQL: dict[str, str] = {}
