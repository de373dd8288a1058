"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import incremental as inc
from foliant.sources.tables import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return inc.due_files(*(table(spark, sf, t) for t in ("doc_files", "index_meta", "index_runs")))


def p1_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Walks of doc_files per root, path and the committed run that processed them. The first run ends at the middle of the time
    covered and misses rows that come late (here those of more than 6 000 bytes), the second dies, the third takes the rest."""
    walks = table(spark, sf, "doc_files").withColumn("root", F.coalesce("root", F.lit("")))
    ends = walks.agg(F.min(F.unix_micros("scanned_at")).alias("a"), F.max(F.unix_micros("scanned_at")).alias("b")).first()
    middle = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    seen = F.coalesce(F.unix_micros("scanned_at") <= middle, F.lit(True))
    runs = inc.logged_runs(walks, seen, F.coalesce(F.col("size_bytes") > 6000, F.lit(False)))
    path = F.concat_ws("/", F.coalesce("project", F.lit("")), F.coalesce("file", F.lit("")))
    return runs.groupBy("root", path.alias("path"), "run").agg(F.count("*").alias("walks"))


QUERIES = {"p1_found": p1_found, "p1_runs": p1_runs}

SQL = {
    "p1_runs": """
WITH e AS (SELECT (min(epoch_us(scanned_at)) + max(epoch_us(scanned_at))) // 2 AS middle FROM doc_files)
SELECT coalesce(root,'') AS root, coalesce(project,'')||'/'||coalesce(file,'') AS path, CAST(CASE WHEN coalesce(epoch_us(scanned_at) <= middle, true) AND coalesce(size_bytes,0) <= 6000 THEN 1 ELSE 2 END AS INT) AS run, count(*) AS walks
FROM doc_files, e GROUP BY ALL
""",
    "p1_found": r"""
WITH f AS (SELECT root, coalesce(project,'')||'/'||coalesce(file,'') AS path, scanned_at, coalesce(mtime_secs,0) AS m, coalesce(size_bytes,0) AS s FROM doc_files),
present AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY root, path ORDER BY scanned_at DESC, m DESC, s DESC) = 1),
runs AS (SELECT * FROM index_runs QUALIFY row_number() OVER (PARTITION BY run_id, root ORDER BY logged_at DESC, status DESC) = 1),
good AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY started_at DESC, run_id DESC) AS back FROM runs WHERE lower(trim(status)) IN ('ok','success')),
entries AS (SELECT m.root, regexp_replace(replace(m.path, chr(92), '/'), '^(\./)+', '') AS key, m.mtime_secs, m.size_bytes, g.started_at, g.run_id FROM index_meta m JOIN good g ON m.run_id = g.run_id AND m.root = g.root),
rec AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY root, key ORDER BY started_at DESC, run_id DESC) = 1)
SELECT p.root, p.path FROM present p
LEFT JOIN rec r ON r.root = p.root AND r.key = regexp_replace(replace(p.path, chr(92), '/'), '^(\./)+', '')
LEFT JOIN good g ON g.root = p.root AND g.back = 1
WHERE r.key IS NULL OR coalesce(r.mtime_secs,0) <> p.m OR coalesce(r.size_bytes,0) <> p.s
   OR coalesce(g.schema_version,0) < 3 OR coalesce(g.chunk_strategy_version,0) < 2
""",
}
