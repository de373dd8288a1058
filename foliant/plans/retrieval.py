"""Queries over the document mapping of the supplied tables: search, vectors, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import evaluation as ev
from foliant.operators import search as s
from foliant.operators import vectors as v
from foliant.sources.tables import docs, table, vectors

Q1, Q2, LONG = "release plan", "nightly cache", "search index review"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Stored chunks; of repeated rows one. Null texts read as ''."""
    c = table(spark, sf, "index_chunks").select(T.text("project").alias("project"), T.text("file").alias("file"), T.text("filename").alias("filename"), T.text("title").alias("title"), "chunk_id", T.text("body").alias("body"), "line_start")
    return c.dropDuplicates(s.KEY)


def whole(spark: SparkSession, sf: str) -> DataFrame:
    """documents as one chunk each."""
    d = docs(spark, sf)
    return d.select("project", "file", T.stem(F.col("file")).alias("filename"), F.lit("").alias("title"), F.lit(0).cast("long").alias("chunk_id"), F.col("content").alias("body"), F.lit(1).cast("long").alias("line_start"))


def _scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("project", "file", "chunk_id", *more, F.round("score", 6).alias("score"))


def q_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def bm25_topk(spark, sf):
    return _scored(s.bm25_scores(whole(spark, sf), Q1, {"body": 1.0}).orderBy(F.desc("score"), "project", "file", "chunk_id").limit(20))


def bm25_fields(spark, sf):
    return _scored(s.bm25_scores(chunks(spark, sf), Q1).orderBy(F.desc("score"), "project", "file", "chunk_id").limit(50))


def bm25_dedupe_file(spark, sf):
    return _scored(s.best_per_file(s.bm25_scores(chunks(spark, sf), Q2), "project", "file"))


def bm25_project_cap(spark, sf):
    return _scored(s.search_ranked(chunks(spark, sf), Q1, 20))


def bm25_prefilter(spark, sf):
    return _scored(s.search_ranked(chunks(spark, sf), Q1, 20, "platform-handbook"))


def bm25_postfilter(spark, sf):
    return _scored(s.search_ranked(chunks(spark, sf), Q1, 20, "platform-handbook", post_filter=True))


def grouped_by_file(spark, sf):
    g = s.search_grouped(chunks(spark, sf), Q2, 20)
    return g.select("project", "file", F.round("score", 6).alias("score"), F.size("sections").cast("long").alias("sections"), F.array_join(F.transform("sections", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"))


def grep_best_line(spark, sf):
    return s.search_grep(docs(spark, sf), LONG, 100).select("project", "file", F.col("line").cast("long").alias("line"), F.col("hits").cast("long").alias("hits"), "snippet")


def grep_all_tokens(spark, sf):
    return s.search_grep(docs(spark, sf), "the queue worker", 1 << 30).groupBy("project").agg(F.count("*").alias("files"), F.sum("hits").cast("long").alias("hits"))


def vault_search(spark, sf):
    return _scored(s.search_vault(chunks(spark, sf), Q1, 10))


def all_vault_merge(spark, sf):
    c = chunks(spark, sf)
    return _scored(s.search_all_vaults({p: c.filter(F.col("project") == p) for p in ("billing-api", "search-web", "platform-handbook")}, Q1, 10), "vault")


def multi_root_merge(spark, sf):
    c = chunks(spark, sf)
    roots = {"billing": c.filter(F.col("project").startswith("billing")), "search": c.filter(F.col("project").startswith("search"))}
    return _scored(s.search_multi_root(roots, Q1, 10), "root", "truncated")


def minmax_per_root(spark, sf):
    h = table(spark, sf, "vector_results").filter("score is not null and not isnan(score)").select("query_id", "project", "file", "chunk_id", F.col("score").cast("double").alias("score"))
    return s.minmax(h, "query_id").withColumn("score", F.round("score", 6))


def vector_topk(spark, sf):
    return _scored(v.search_vector(vectors(spark, sf), q_vector(spark, sf), 20))


def vector_topk_filtered(spark, sf):
    return _scored(v.search_vector(vectors(spark, sf), q_vector(spark, sf), 10, "3"))


def vector_allowlist(spark, sf):
    allow = vectors(spark, sf).filter(F.col("project").isin("1", "2")).select("project", "file")
    return _scored(v.search_vector(vectors(spark, sf), q_vector(spark, sf), 10, allow=allow))


def vector_batch(spark, sf):
    """Every vector whose id is divisible by 20, against all."""
    e = table(spark, sf, "embeddings")
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    return v.search_batch(vectors(spark, sf), queries, 5).select("qid", "file", F.round("score", 6).alias("score"), "rank")


def vector_lsh(spark, sf):
    return _scored(v.search_lsh(vectors(spark, sf), q_vector(spark, sf), 10))


def vector_quantised(spark, sf):
    return _scored(v.search_quantised(v.quantise(vectors(spark, sf)), q_vector(spark, sf), 10))


def cache_aside_split(spark, sf):
    texts = chunks(spark, sf).select(T.content_hash(T.embedding_text(F.col("body"), "none")).alias("hash")).distinct()
    have = texts.filter("hash < '8'").select("hash", F.lit("m").alias("model"), F.array(F.lit(0.0)).alias("embedding"))
    hit, miss = v.split_cache(texts, have, "m")
    return hit.agg(F.count("*").alias("hits")).crossJoin(miss.agg(F.count("*").alias("misses")))


def rrf_fusion(spark, sf):
    """Text and vector hits of one query, by weighted ranks."""
    text = table(spark, sf, "search_results").filter("query_id = 2 and score is not null and not isnan(score)").groupBy(T.text("project").alias("project"), "file").agg(F.max("score").alias("score"))
    near = table(spark, sf, "vector_results").filter("query_id = 2 and score is not null and not isnan(score)").groupBy(T.text("project").alias("project"), "file").agg(F.max("score").cast("double").alias("score"))
    zero = F.lit(0).cast("long").alias("chunk_id")
    return _scored(s.rrf(text.select("project", "file", zero, "score"), near.select("project", "file", zero, "score"), 50))


def hybrid_search(spark, sf):
    """Chunks fused with a hashing vectoriser's vectors; no semantic model."""
    c = chunks(spark, sf)
    stored = v.hashing_vectors(c)
    probe = v.hashing_vectors(spark.createDataFrame([("", "", 0, Q1)], "project string, file string, chunk_id long, body string")).first()["embedding"]
    return s.search_hybrid(c, stored, Q1, list(probe), 10).select("project", "file", "chunk_id", "line", F.round("score", 6).alias("score"), "mode")


def _run(spark, sf):
    """Text hits as a run: rank of each file in its query."""
    hits = table(spark, sf, "search_results").filter("score is not null and not isnan(score)").groupBy(F.col("query_id").alias("qid"), F.concat_ws("/", T.text("project"), "file").alias("file")).agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "file"))
    return hits.withColumn("rank", rank).filter("rank <= 20").select("qid", "file", "rank")


def _truth(spark, sf):
    return table(spark, sf, "relevance").filter("grade > 0").select(F.col("query_id").alias("qid"), F.concat_ws("/", T.text("project"), "file").alias("file"))


def _queries(spark, sf):
    return table(spark, sf, "search_results").select(F.col("query_id").alias("qid")).distinct()


def precision_recall_at_k(spark, sf):
    m = ev.metrics(_run(spark, sf), _truth(spark, sf), _queries(spark, sf), (5, 10, 20))
    return m.select("qid", "k", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def ndcg_map_at_k(spark, sf):
    m = ev.averages(ev.metrics(_run(spark, sf), _truth(spark, sf), _queries(spark, sf), (5, 10, 20)))
    return m.select("k", F.round("avg_ndcg", 6).alias("ndcg"), F.round("avg_ap", 6).alias("map"))


def mrr(spark, sf):
    return ev.mrr(_run(spark, sf), _truth(spark, sf), _queries(spark, sf)).select("qid", F.round("rr", 6).alias("rr"))


def percentile_nearest_rank(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.floor(F.col("value") * 1000).cast("long").alias("us"))
    return ev.latency(e, ["event_type"], "us")


def regression_status(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("value"), F.round(F.avg(F.when(F.dayofmonth("ts") <= 15, F.col("value"))), 4).alias("base"))
    kind = F.when(F.col("event_type").isin("click", "view"), "latency").when(F.col("event_type") == "purchase", "precision").otherwise("throughput")
    current = e.select(F.col("event_type").alias("metric"), kind.alias("kind"), "value")
    return ev.regression(current, e.select(F.col("event_type").alias("metric"), F.col("base").alias("value"))).withColumn("change_percent", F.round("change_percent", 4))


def chunk_range_join(spark, sf):
    """Text hits whose line lies within a stored chunk of their file."""
    c = chunks(spark, sf)
    nxt = F.lead("line_start").over(W.partitionBy("project", "file").orderBy("line_start", "chunk_id"))
    spans = c.select("project", "file", "chunk_id", F.col("line_start").alias("first"), F.coalesce(nxt, F.lit(1 << 40)).alias("next"))
    hits = table(spark, sf, "search_results").select("query_id", T.text("project").alias("project"), "file", "line").distinct()
    inside = hits.join(spans, ["project", "file"]).filter("line >= first and line < next")
    return inside.groupBy("project").agg(F.count("*").alias("hits"), F.countDistinct("file", "chunk_id").alias("chunks"))


def ngram_stats(spark, sf):
    """Distinct and total n-grams of titles."""
    g = chunks(spark, sf).select("title").distinct().select("title", T.ngrams(F.col("title")).alias("g"))
    return g.select("title", F.size("g").cast("long").alias("total"), F.size(F.array_distinct("g")).cast("long").alias("distinct_grams"))


NAMES = "bm25_topk bm25_fields bm25_dedupe_file bm25_project_cap bm25_prefilter bm25_postfilter grouped_by_file grep_best_line grep_all_tokens vault_search all_vault_merge multi_root_merge minmax_per_root vector_topk vector_topk_filtered vector_allowlist vector_batch vector_lsh vector_quantised cache_aside_split rrf_fusion hybrid_search precision_recall_at_k ndcg_map_at_k mrr percentile_nearest_rank regression_status chunk_range_join ngram_stats".split()
QUERIES = {n: globals()[n] for n in NAMES}


# ---- SQL

def _bm25(source: str, query: str, boosts: dict[str, float]) -> str:
    """CTEs up to scored(project, file, chunk_id, score)."""
    terms = s.words(query)
    grams = list(dict.fromkeys(g for w in terms for g in s.grams(w)))
    count = lambda f, g: f"(length(lower({f}))-length(replace(lower({f}),'{g}','')))//{len(g)}"
    cols = ", ".join([f"{count(f, g)} AS tf_{i}_{j}" for i, f in enumerate(boosts) for j, g in enumerate(grams)] + [f"greatest(length(lower({f}))-1,0)+greatest(length(lower({f}))-2,0) AS dl_{i}" for i, f in enumerate(boosts)])
    stats = ", ".join(["count(*) AS n"] + [f"count(*) FILTER (tf_{i}_{j}>0) AS df_{i}_{j}" for i in range(len(boosts)) for j in range(len(grams))] + [f"avg(dl_{i}) AS avg_{i}" for i in range(len(boosts))])
    parts = []
    for i, f in enumerate(boosts):
        for w in terms:
            js = [grams.index(g) for g in s.grams(w)]
            freq = f"least({', '.join(f'tf_{i}_{j}' for j in js)})" if len(js) > 1 else f"tf_{i}_{js[0]}"
            idf = " + ".join(f"ln(1+(n-df_{i}_{j}+0.5::DOUBLE)/(df_{i}_{j}+0.5::DOUBLE))" for j in js)
            parts.append(f"CASE WHEN {freq}>0 THEN {boosts[f]}::DOUBLE*({idf})*{freq}*2.2::DOUBLE/({freq}+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl_{i}/greatest(avg_{i},1e-9))) ELSE 0 END")
    return f"WITH src AS ({source}), counted AS (SELECT *, {cols} FROM src), stats AS (SELECT {stats} FROM counted), scored AS (SELECT * FROM (SELECT project, file, chunk_id, {' + '.join(parts)} AS score FROM counted, stats) WHERE score > 0)"


_DOCS = "SELECT coalesce(source,'') AS project, doc_id||'.txt' AS file, coalesce(text,'') AS content FROM documents"
_WHOLE = "SELECT coalesce(source,'') AS project, doc_id||'.txt' AS file, doc_id::VARCHAR AS filename, '' AS title, 0::BIGINT AS chunk_id, coalesce(text,'') AS body, 1::BIGINT AS line_start FROM documents"
CHUNKS = "SELECT coalesce(project,'') AS project, coalesce(file,'') AS file, any_value(coalesce(filename,'')) AS filename, any_value(coalesce(title,'')) AS title, chunk_id, any_value(coalesce(body,'')) AS body, any_value(line_start) AS line_start FROM index_chunks GROUP BY 1,2,5"
_ORDER = "ORDER BY score DESC, project, file, chunk_id"
_PICK = "SELECT project, file, chunk_id, round(score,6) AS score"
_BEST = f"best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY project, file {_ORDER})=1)"


def _ranked(source: str, query: str, limit: int, cap: bool = True) -> str:
    cut = f"capped AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY project {_ORDER})<=2)" if cap else "capped AS (SELECT * FROM best)"
    return f"{_bm25(source, query, s.BOOSTS)}, {_BEST}, {cut}, top AS (SELECT * FROM capped {_ORDER} LIMIT {limit})"


def _sub(where: str) -> str:
    return f"SELECT * FROM ({CHUNKS}) WHERE {where}"


def _root(name: str, where: str, limit: int) -> str:
    return f"SELECT '{name}' AS root, * FROM ({_ranked(_sub(where), Q1, limit)} SELECT * FROM top)"


_QV = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_VEC = f"SELECT label::VARCHAR AS project, vec_id::VARCHAR AS file, 0::BIGINT AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], {_QV}) AS score FROM embeddings"
_TOKENS = [f"contains(lower(content), '{t}')" for t in LONG.split()]
_LINES = "lines AS (SELECT project, file, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)),1) AS i FROM d)"
_RUN = """hits AS (SELECT query_id AS qid, coalesce(project,'')||'/'||file AS file, max(score) AS score FROM search_results WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL),
run AS (SELECT qid, lower(replace(file, chr(92), '/')) AS file, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file) AS rank FROM hits QUALIFY rank <= 20),
truth AS (SELECT DISTINCT query_id AS qid, lower(replace(coalesce(project,'')||'/'||file, chr(92), '/')) AS file FROM relevance WHERE grade > 0),
q AS (SELECT DISTINCT query_id AS qid FROM search_results), rel AS (SELECT qid, count(t.file) AS n FROM q LEFT JOIN truth t USING (qid) GROUP BY 1),
j AS (SELECT r.qid, r.rank, CASE WHEN t.file IS NULL THEN 0 ELSE 1 END AS rel FROM run r LEFT JOIN truth t ON t.qid=r.qid AND t.file=r.file),
c AS (SELECT *, sum(rel) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM j), ks AS (SELECT unnest([5,10,20]) AS k),
m AS (SELECT rel.qid, k, n, coalesce(sum(c.rel),0) AS h, coalesce(sum(CASE WHEN c.rel=1 THEN 1/log2(rank+1.0::DOUBLE) END),0) AS dcg, coalesce(sum(CASE WHEN c.rel=1 THEN cum/rank::DOUBLE END),0) AS ap
  FROM rel CROSS JOIN ks LEFT JOIN c ON c.qid=rel.qid AND c.rank<=k GROUP BY 1,2,3)"""
_IDEAL = "list_sum(list_transform(range(1, greatest(least(n,k),1)+1), lambda i: 1/log2(i+1.0::DOUBLE)))"
_PCT = lambda p: f"list_sort(list(us))[floor({p}/100.0*(count(us)-1)+0.5)::INT+1]"

SQL = {
    "bm25_topk": f"{_bm25(_WHOLE, Q1, {'body': 1.0})} {_PICK} FROM scored {_ORDER} LIMIT 20",
    "bm25_fields": f"{_bm25(CHUNKS, Q1, s.BOOSTS)} {_PICK} FROM scored {_ORDER} LIMIT 50",
    "bm25_dedupe_file": f"{_bm25(CHUNKS, Q2, s.BOOSTS)}, {_BEST} {_PICK} FROM best",
    "bm25_project_cap": f"{_ranked(CHUNKS, Q1, 20)} {_PICK} FROM top",
    "bm25_prefilter": f"{_bm25(CHUNKS, Q1, s.BOOSTS)}, {_BEST} {_PICK} FROM best WHERE project='platform-handbook' {_ORDER} LIMIT 20",
    "bm25_postfilter": f"{_bm25(CHUNKS, Q1, s.BOOSTS)}, t AS (SELECT * FROM scored {_ORDER} LIMIT 60), b AS (SELECT * FROM t WHERE project='platform-handbook' QUALIFY row_number() OVER (PARTITION BY project, file {_ORDER})=1) {_PICK} FROM (SELECT * FROM b {_ORDER} LIMIT 40) {_ORDER} LIMIT 20",
    "grouped_by_file": f"{_bm25(CHUNKS, Q2, s.BOOSTS)}, g AS (SELECT project, file, max(score) AS score, count(*) AS sections, string_agg(chunk_id::VARCHAR, ',' ORDER BY score DESC, chunk_id) AS chunk_ids FROM scored GROUP BY 1,2), c AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, file)<=2) SELECT project, file, round(score,6) AS score, sections, chunk_ids FROM c ORDER BY c.score DESC, project, file LIMIT 20",
    "grep_best_line": f"WITH d AS (SELECT * FROM ({_DOCS}) WHERE {' AND '.join(_TOKENS)}), {_LINES}, h AS (SELECT project, file, i AS line, {'+'.join(x.replace('content', 'l') + '::INT' for x in _TOKENS)} AS hits, trim(rtrim(l, chr(13))) AS snippet FROM lines), b AS (SELECT * FROM h WHERE hits>0 QUALIFY row_number() OVER (PARTITION BY project, file ORDER BY hits DESC, line)=1) SELECT project, file, line::BIGINT AS line, hits::BIGINT AS hits, snippet FROM b ORDER BY hits DESC, project, file LIMIT 100",
    "grep_all_tokens": f"WITH d AS (SELECT * FROM ({_DOCS}) WHERE contains(lower(content),'the') AND contains(lower(content),'queue') AND contains(lower(content),'worker')), {_LINES}, h AS (SELECT project, file, max(contains(lower(l),'the')::INT+contains(lower(l),'queue')::INT+contains(lower(l),'worker')::INT) AS hits FROM lines GROUP BY 1,2) SELECT project, count(*) AS files, sum(hits)::BIGINT AS hits FROM h GROUP BY 1",
    "vault_search": f"{_bm25(CHUNKS, Q1, s.BOOSTS)}, b AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY file {_ORDER})=1) {_PICK} FROM b {_ORDER} LIMIT 10",
    "multi_root_merge": f"WITH m AS ({_root('billing', 'starts_with(project, $$billing$$)', 10)} UNION ALL {_root('search', 'starts_with(project, $$search$$)', 10)}), w AS (SELECT *, min(score) OVER (PARTITION BY root) AS lo, max(score) OVER (PARTITION BY root) AS hi, count(*) OVER (PARTITION BY root) AS n, count(*) OVER () AS total FROM m), z AS (SELECT project, file, chunk_id, root, total>10 AS truncated, CASE WHEN n<=1 THEN score WHEN hi=lo THEN 0.5 ELSE (score-lo)/(hi-lo) END AS score FROM w) SELECT project, file, chunk_id, root, truncated, round(score,6) AS score FROM z ORDER BY z.score DESC, project, file, chunk_id, root LIMIT 10",
    "all_vault_merge": "SELECT project, file, chunk_id, vault, round(score,6) AS score FROM (" + " UNION ALL ".join(
        f"SELECT '{p}' AS vault, * FROM ({_bm25(_sub(f'project=$${p}$$'), Q1, s.BOOSTS)}, b AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY file {_ORDER})=1) SELECT * FROM b {_ORDER} LIMIT 10)" for p in ("billing-api", "search-web", "platform-handbook")
    ) + ") t ORDER BY t.score DESC, project, file, chunk_id, vault LIMIT 10",
    "minmax_per_root": "WITH h AS (SELECT query_id, project, file, chunk_id, score::DOUBLE AS score FROM vector_results WHERE score IS NOT NULL AND NOT isnan(score)), w AS (SELECT *, min(score) OVER p AS lo, max(score) OVER p AS hi, count(*) OVER p AS n FROM h WINDOW p AS (PARTITION BY query_id)) SELECT query_id, project, file, chunk_id, round(CASE WHEN n<=1 THEN score WHEN hi=lo THEN 0.5 ELSE (score-lo)/(hi-lo) END, 6) AS score FROM w",
    "vector_topk": f"{_PICK} FROM ({_VEC}) t WHERE t.score>0 ORDER BY t.score DESC, project, file LIMIT 20",
    "vector_topk_filtered": f"{_PICK} FROM ({_VEC}) t WHERE t.score>0 AND project='3' ORDER BY t.score DESC, project, file LIMIT 10",
    "vector_allowlist": f"{_PICK} FROM ({_VEC}) t WHERE t.score>0 AND project IN ('1','2') ORDER BY t.score DESC, project, file LIMIT 10",
    "vector_batch": "WITH p AS (SELECT a.vec_id AS qid, b.label::VARCHAR AS project, b.vec_id::VARCHAR AS file, list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0) SELECT qid, file, round(s,6) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, project, file) AS rank FROM p WHERE s>0 QUALIFY rank<=5",
    "cache_aside_split": f"WITH h AS (SELECT DISTINCT sha256(body) AS hash FROM ({CHUNKS})) SELECT count(*) FILTER (hash<'8') AS hits, count(*) FILTER (hash>='8') AS misses FROM h",
    "rrf_fusion": """WITH t AS (SELECT coalesce(project,'') AS project, file, max(score) AS s FROM search_results WHERE query_id=2 AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1,2),
v AS (SELECT coalesce(project,'') AS project, file, max(score)::DOUBLE AS s FROM vector_results WHERE query_id=2 AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1,2),
a AS (SELECT project, file, 0.6::DOUBLE/(60+row_number() OVER (ORDER BY s DESC, project, file)) AS x FROM t), b AS (SELECT project, file, 0.4::DOUBLE/(60+row_number() OVER (ORDER BY s DESC, project, file)) AS y FROM v),
z AS (SELECT project, file, 0::BIGINT AS chunk_id, coalesce(x,0)+coalesce(y,0) AS score FROM a FULL JOIN b USING (project, file)) SELECT project, file, chunk_id, round(score,6) AS score FROM z ORDER BY z.score DESC, project, file LIMIT 50""",
    "precision_recall_at_k": f"WITH {_RUN} SELECT qid, k, round(h/k::DOUBLE,6) AS precision, round(CASE WHEN n=0 THEN 1 ELSE h/n::DOUBLE END,6) AS recall FROM m",
    "ndcg_map_at_k": f"WITH {_RUN} SELECT k, round(avg(CASE WHEN n=0 THEN 1 ELSE dcg/{_IDEAL} END),6) AS ndcg, round(avg(CASE WHEN n=0 THEN 1 ELSE ap/greatest(least(n,k),1) END),6) AS map FROM m GROUP BY k",
    "mrr": f"WITH {_RUN}, f AS (SELECT qid, min(rank) AS r FROM j WHERE rel=1 GROUP BY 1) SELECT qid, round(CASE WHEN n=0 THEN 1 ELSE coalesce(1.0::DOUBLE/r,0) END,6) AS rr FROM rel LEFT JOIN f USING (qid)",
    "percentile_nearest_rank": f"WITH e AS (SELECT event_type, floor(value*1000)::BIGINT AS us FROM events) SELECT event_type, floor(sum(us)/count(us))::BIGINT AS avg, {_PCT(50)} AS p50, {_PCT(95)} AS p95, {_PCT(99)} AS p99 FROM e GROUP BY 1",
    "regression_status": """WITH e AS (SELECT event_type AS metric, round(avg(value),4) AS current, round(avg(CASE WHEN day(ts)<=15 THEN value END),4) AS baseline FROM events GROUP BY 1),
c AS (SELECT *, (current-baseline)/baseline*100 AS ch, CASE WHEN metric IN ('click','view') THEN 20 WHEN metric='purchase' THEN 5 ELSE 15 END AS lim, CASE WHEN metric IN ('click','view') THEN 1 ELSE -1 END AS sgn FROM e WHERE baseline<>0)
SELECT metric, baseline, current, round(ch,4) AS change_percent, CASE WHEN ch*sgn>=lim THEN 'regression' WHEN ch*sgn>=lim/2.0 THEN 'warn' ELSE 'pass' END AS status FROM c""",
    "chunk_range_join": f"WITH c AS ({CHUNKS}), sp AS (SELECT project, file, chunk_id, line_start AS a, coalesce(lead(line_start) OVER (PARTITION BY project, file ORDER BY line_start, chunk_id), 1::BIGINT<<40) AS b FROM c), h AS (SELECT DISTINCT query_id, coalesce(project,'') AS project, file, line FROM search_results), i AS (SELECT h.project, h.file, chunk_id FROM h JOIN sp ON sp.project=h.project AND sp.file=h.file AND line>=a AND line<b) SELECT project, count(*) AS hits, count(DISTINCT (file, chunk_id)) AS chunks FROM i GROUP BY 1",
    "ngram_stats": f"WITH t AS (SELECT DISTINCT title FROM ({CHUNKS})), g AS (SELECT title, list_concat(list_transform(range(1, greatest(length(lower(title)),1)), lambda i: substring(lower(title), i, 2)), list_transform(range(1, greatest(length(lower(title))-1,1)), lambda i: substring(lower(title), i, 3))) AS g FROM t) SELECT title, len(g)::BIGINT AS total, len(list_distinct(g))::BIGINT AS distinct_grams FROM g",
}
