"""Queries over the upkeep of index and vector store, and fused search with its fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import policy
from foliant.operators import search as s
from foliant.operators import vectors as v
from foliant.plans.hygiene import _FM, _FMCTE
from foliant.plans.retrieval import _ORDER, _VEC, CHUNKS, Q1, Q2, _bm25, _ranked, chunks, q_vector
from foliant.sources.tables import table, vectors


def hybrid_fused(spark, sf):
    """Hybrid search of the chunks and the vectors of embeddings: ranks of both, fused, with text and line of the chunks."""
    h = s.search_hybrid(chunks(spark, sf), vectors(spark, sf), Q1, q_vector(spark, sf), 20)
    return h.select("project", "file", "chunk_id", F.round("score", 8).alias("score"), F.length("snippet").cast("long").alias("chars"), F.col("line").cast("long").alias("line"), "mode")


def vault_hybrid(spark, sf):
    """The same within a vault, where files are told apart by name."""
    h = s.search_vault_hybrid(chunks(spark, sf), vectors(spark, sf), Q2, q_vector(spark, sf), 10)
    return h.select("project", "file", "chunk_id", F.round("score", 8).alias("score"), "mode")


def fallback_ranked(spark, sf):
    """Without vectors the chain ends at ranked search; one row more than asked for is known, so the result is truncated."""
    return s.search_fallback(chunks(spark, sf), None, Q1, None, 10).select("project", "file", F.round("score", 6).alias("score"), "source", "truncated", F.length("snippet").cast("long").alias("chars"))


def vector_store(spark, sf):
    """Per label the vectors left after project '3' and every file of an even id are deleted, and the files without any."""
    store = vectors(spark, sf)
    gone = store.filter(F.col("file").cast("long") % 2 == 0).select("project", "file")
    left = v.delete(v.delete(store, project="3"), keys=gone)
    told = v.has_file(left, store.select("project", "file").distinct())
    meta = v.store_meta(left, "m").select("dimension", "vector_count")
    return told.groupBy("project").agg(F.count_if("has_vectors").alias("kept"), F.count_if(~F.col("has_vectors")).alias("without")).crossJoin(F.broadcast(meta))


def vector_blobs(spark, sf):
    """Vectors that survive the way through their stored form."""
    e = table(spark, sf, "embeddings")
    back = e.withColumn("back", v.from_blob(v.to_blob(F.col("embedding"))))
    return back.groupBy("label").agg(F.count_if(F.col("back") == F.col("embedding")).alias("equal"), F.count("*").alias("vectors"))


def opted_out(spark, sf):
    d = table(spark, sf, "documents").select(T.text("project").alias("project"), F.col("text").alias("content"))
    return policy.opted_out(d)


def project_resolution(spark, sf):
    """Names as people write them: as they are, in capitals, the first three letters, and one that is none."""
    known = table(spark, sf, "documents").select(T.text("project").alias("project")).filter("project <> ''").distinct()
    asked = known.select(F.explode(F.array("project", F.upper("project"), F.substring("project", 1, 3), F.concat("project", F.lit("-x")))).alias("asked"))
    return policy.resolve_project(known, asked)


def path_guard(spark, sf):
    return table(spark, sf, "index_meta").groupBy(policy.safe_path(F.col("path")).alias("safe")).agg(F.count("*").alias("entries"))


_QUERIES = (hybrid_fused, vault_hybrid, fallback_ranked, vector_store, vector_blobs, opted_out, project_resolution, path_guard)
QUERIES = {f.__name__: f for f in _QUERIES}


def _fused(ranked: str, near: int, limit: int, k: int) -> str:
    return f"""{ranked}, n AS (SELECT project, file, chunk_id, score FROM ({_VEC}) t WHERE t.score>0 ORDER BY t.score DESC, project, file LIMIT {near}),
ra AS (SELECT project, file, chunk_id, 0.6::DOUBLE/({k}+row_number() OVER ({_ORDER})) AS a FROM top), rb AS (SELECT project, file, chunk_id, 0.4::DOUBLE/({k}+row_number() OVER ({_ORDER})) AS b FROM n),
fu AS (SELECT project, file, chunk_id, coalesce(a,0)+coalesce(b,0) AS score FROM ra FULL JOIN rb USING (project, file, chunk_id)), fused AS (SELECT * FROM fu {_ORDER} LIMIT {limit})"""


SQL = {
    "hybrid_fused": f"""{_fused(_ranked(CHUNKS, Q1, 40, cap=False), 40, 20, s.rrf_k(20))} SELECT f.project, f.file, f.chunk_id, round(f.score,8) AS score, length(coalesce(c.body,''))::BIGINT AS chars, coalesce(c.line_start,0)::BIGINT AS line, 'hybrid-bm25-vector' AS mode
FROM fused f LEFT JOIN ({CHUNKS}) c ON c.project=f.project AND c.file=f.file AND c.chunk_id=f.chunk_id""",
    "vault_hybrid": f"""{_fused(_bm25(CHUNKS, Q2, s.BOOSTS) + f", top AS (SELECT * FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY file {_ORDER})=1) {_ORDER} LIMIT 20)", 20, 10, s.rrf_k(10))} SELECT project, file, chunk_id, round(score,8) AS score, 'hybrid-bm25-vector' AS mode FROM fused""",
    "fallback_ranked": f"""{_ranked(CHUNKS, Q1, 11)} SELECT t.project, t.file, round(t.score,6) AS score, 'bm25' AS source, (SELECT count(*) FROM top)>10 AS truncated, length(c.body)::BIGINT AS chars FROM top t JOIN ({CHUNKS}) c ON c.project=t.project AND c.file=t.file AND c.chunk_id=t.chunk_id
ORDER BY t.score DESC, t.project, t.file LIMIT 10""",
    "vector_store": """WITH l AS (SELECT label::VARCHAR AS project, vec_id, embedding, label<>3 AND vec_id%2=1 AS keep FROM embeddings) SELECT project, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS without,
(SELECT max(len(embedding)) FROM l WHERE keep)::INT AS dimension, (SELECT count(*) FROM l WHERE keep) AS vector_count FROM l GROUP BY project""",
    "vector_blobs": "SELECT label, count(*) AS equal, count(*) AS vectors FROM embeddings GROUP BY 1",
    "opted_out": f"WITH {_FMCTE('(SELECT coalesce(project, $$$$) AS project, coalesce(text, $$$$) AS t FROM documents)', 't')} SELECT project, count(*) AS files, count(*) FILTER (lower({_FM('', 'draft')}) IN ('true','yes','1') OR lower({_FM('', 'status')})='deprecated') AS opted_out FROM fmx GROUP BY 1",
    "project_resolution": """WITH k AS (SELECT DISTINCT project FROM documents WHERE coalesce(project,'')<>''), a AS (SELECT DISTINCT unnest([project, upper(project), project[1:3], project||'-x']) AS asked FROM k),
m AS (SELECT asked, project, CASE WHEN project=asked THEN 0 WHEN lower(project)=lower(trim(asked)) THEN 1 ELSE 2 END AS w FROM a JOIN k ON starts_with(lower(project), lower(trim(asked)))),
b AS (SELECT asked, min(w) AS w, count(*) AS n, arg_min(project, (w, project)) AS p FROM m GROUP BY 1)
SELECT asked, CASE WHEN w<2 OR n=1 THEN p END AS project, CASE WHEN w IS NULL OR NOT (w<2 OR n=1) THEN 'none' WHEN w=0 THEN 'exact' WHEN w=1 THEN 'case' ELSE 'prefix' END AS how FROM a LEFT JOIN b USING (asked)""",
    "path_guard": r"""WITH p AS (SELECT replace(coalesce(path,''), chr(92), '/') AS p FROM index_meta) SELECT p<>'' AND NOT regexp_matches(p, '^/|^[A-Za-z]:|^[A-Za-z][A-Za-z0-9+.-]*://|(^|/)\.\.(/|$)') AS safe, count(*) AS entries FROM p GROUP BY 1""".replace("\\\\", "\\"),
}
