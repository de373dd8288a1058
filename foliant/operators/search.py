"""Ranked, grouped, token and hybrid search over chunks.

BM25 works from the query: its words' 2- and 3-grams are counted in each field with built-in expressions, the corpus is
never exploded into n-grams. Statistics come from one aggregate over the corpus; rows without a match leave before they are scored. Scores are exact (true field lengths, double
precision); every ranking has a total order, on unrounded scores, with ties by project, file and chunk.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T

K1, B = 1.2, 0.75
BOOSTS = {"body": 1.0, "title": 3.0, "filename": 2.0}
KEY = ["project", "file", "chunk_id"]


def words(query: str) -> list[str]:
    """Distinct lower-cased words that have a 2-gram."""
    return list(dict.fromkeys(w for w in query.lower().split() if len(w) > 1))


def grams(word: str) -> list[str]:
    return list(dict.fromkeys(word[i : i + n] for n in (2, 3) for i in range(len(word) - n + 1)))


def occurrences(t: Column, gram: str) -> Column:
    """How often the gram occurs in lower-cased text, overlapping ones too."""
    overlaps = any(gram[:k] == gram[-k:] for k in range(1, len(gram)))
    if overlaps:
        return F.regexp_count(t, F.lit(f"(?={re.escape(gram)})"))
    return ((F.length(t) - F.length(F.replace(t, F.lit(gram), F.lit("")))) / len(gram)).cast("int")


def field_length(t: Column) -> Column:
    """Number of 2- and 3-grams."""
    n = F.length(t)
    return F.greatest(n - 1, F.lit(0)) + F.greatest(n - 2, F.lit(0))


def bm25_scores(chunks: DataFrame, query: str, boosts: dict[str, float] | None = None) -> DataFrame:
    """chunks with a score, matching ones only. A word matches a field that has all its grams; its frequency there is the
    least of theirs and its weight the sum of their idf; words and fields add up."""
    boosts = boosts or BOOSTS
    terms = words(query)
    if not terms:
        return chunks.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    every = list(dict.fromkeys(g for w in terms for g in grams(w)))
    low = {f: f"_low{i}" for i, f in enumerate(boosts)}
    lowered = chunks.select("*", *[F.lower(T.text(f)).alias(n) for f, n in low.items()])
    has = lambda f, g: F.contains(F.col(low[f]), F.lit(g))
    # one row of statistics comes to the driver, so that weights are constants in the scan that scores
    stats = lowered.agg(F.count("*"), *[F.avg(field_length(F.col(low[f]))) for f in boosts], *[F.count_if(has(f, g)) for f in boosts for g in every]).first()
    n, means = stats[0], stats[1 : 1 + len(boosts)]
    df = dict(zip(((f, g) for f in boosts for g in every), stats[1 + len(boosts) :]))
    parts, hits = [], []
    for f, mean in zip(boosts, means):
        norm = K1 * (1 - B + B * field_length(F.col(low[f])) / max(mean or 0.0, 1e-9))
        for w in terms:
            own = grams(w)
            match = reduce(lambda a, b: a & b, [has(f, g) for g in own])
            each = [occurrences(F.col(low[f]), g) for g in own]
            freq = F.least(*each) if len(each) > 1 else each[0]
            idf = sum(math.log(1 + (n - df[f, g] + 0.5) / (df[f, g] + 0.5)) for g in own)
            hits.append(match)
            parts.append(F.when(match, F.lit(boosts[f] * idf * (K1 + 1)) * freq / (freq + norm)).otherwise(0.0))
    scored = lowered.filter(reduce(lambda a, b: a | b, hits))
    return scored.select(*chunks.columns, reduce(lambda a, b: a + b, parts).alias("score"))


def _order(*extra: str) -> list[Column]:
    return [F.desc("score"), F.asc("project"), F.asc("file"), *[F.asc(c) for c in extra]]


def diversify(df: DataFrame, per_project: int, *ties: str) -> DataFrame:
    """At most per_project rows of each project, the best ones."""
    return df.withColumn("_p", F.row_number().over(W.partitionBy("project").orderBy(*_order(*ties)))).filter(F.col("_p") <= per_project).drop("_p")


def best_per_file(scored: DataFrame, *by: str) -> DataFrame:
    """The best chunk of each file."""
    w = W.partitionBy(*by).orderBy(*_order("chunk_id"))
    return scored.withColumn("_f", F.row_number().over(w)).filter(F.col("_f") == 1).drop("_f")


def search_ranked(chunks: DataFrame, query: str, limit: int = 20, project: str | None = None, post_filter: bool = False, per_project: int | None = 2) -> DataFrame:
    """Best chunk per file, at most per_project files of a project where no project is asked for, the best limit of them.

    The project is filtered before ranking; post_filter takes the best 3 x limit chunks of all projects first, as an
    engine does that filters afterwards."""
    if limit <= 0:
        return bm25_scores(chunks, "").limit(0)
    scored = bm25_scores(chunks, query)
    if post_filter:
        scored = scored.orderBy(*_order("chunk_id")).limit(3 * limit)
    if project is not None:
        scored = scored.filter(F.col("project") == project)
    best = best_per_file(scored, "project", "file")
    if post_filter:
        best = best.orderBy(*_order("chunk_id")).limit(2 * limit)
    if project is None and per_project:
        best = diversify(best, per_project, "chunk_id")
    return best.orderBy(*_order("chunk_id")).limit(limit)


def search_grouped(chunks: DataFrame, query: str, limit: int = 20, project: str | None = None, per_project: int | None = 2) -> DataFrame:
    """Files with the score of their best chunk and all matching sections, best first: project, file, score, sections."""
    scored = bm25_scores(chunks, query)
    if project is not None:
        scored = scored.filter(F.col("project") == project)
    section = F.struct((-F.col("score")).alias("order"), "chunk_id", "line_start", "score", F.col("body").alias("snippet"))
    files = scored.groupBy("project", "file").agg(F.max("score").alias("score"), F.sort_array(F.collect_list(section)).alias("_s"))
    files = files.withColumn("sections", F.transform("_s", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["line_start"].alias("line"), s["score"].alias("score"), s["snippet"].alias("snippet")))).drop("_s")
    if project is None and per_project:
        files = diversify(files, per_project)
    return files.orderBy(*_order()).limit(limit)


def search_grep(docs: DataFrame, query: str, limit: int = 20, project: str | None = None) -> DataFrame:
    """Files that hold every word of the query, with the first line that holds most of them: project, file, line, snippet,
    hits; most hits first, then by name."""
    tokens = list(dict.fromkeys(query.lower().split()))
    content = T.text("content")
    hit = docs if project is None else docs.filter(F.col("project") == project)
    if not tokens or limit <= 0:
        hit = hit.limit(0)
    hit = hit.filter(reduce(lambda a, b: a & b, [F.contains(F.lower(content), F.lit(t)) for t in tokens], F.lit(True)))
    hits_of = lambda x: reduce(lambda a, b: a + b, [F.contains(F.lower(x), F.lit(t)).cast("int") for t in tokens], F.lit(0))
    numbered = F.transform(T.lines(content), lambda x, i: F.struct(hits_of(x).alias("hits"), (-(i + 1)).alias("back"), F.trim(x).alias("snippet")))
    # the greatest (hits, -line) is the first line with most hits; without any hit no line is named
    best = hit.select(T.text("project").alias("project"), T.text("file").alias("file"), F.array_max(numbered).alias("b"))
    some = F.coalesce(F.col("b.hits"), F.lit(0)) > 0
    best = best.select("project", "file", F.when(some, -F.col("b.back")).otherwise(0).alias("line"), F.when(some, F.col("b.snippet")).otherwise("").alias("snippet"), F.coalesce("b.hits", F.lit(0)).alias("hits"))
    return best.orderBy(F.desc("hits"), "project", "file").limit(limit)


def rrf_k(limit: int) -> int:
    """Rank constant: 60 at a limit of 50, growing with its root, at least 10."""
    return max(10, math.floor(60 * math.sqrt(limit / 50) + 0.5))


def rrf(text: DataFrame, vector: DataFrame, limit: int, k: int | None = None, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Weighted reciprocal rank fusion of two scored lists by (project, file, chunk_id): KEY, score."""
    k = rrf_k(limit) if k is None else k
    w = W.orderBy(*_order("chunk_id"))  # both lists are limited results
    a = text.select(*KEY, (F.lit(weights[0]) / (k + F.row_number().over(w))).alias("_a"))
    b = vector.select(*KEY, (F.lit(weights[1]) / (k + F.row_number().over(w))).alias("_b"))
    both = a.join(b, KEY, "full_outer")
    return both.select(*KEY, (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))).alias("score")).orderBy(*_order("chunk_id")).limit(limit)


def with_snippets(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk text and line of each hit, '' and 0 where the chunk is gone."""
    c = chunks.select(*KEY, F.col("body").alias("snippet"), F.col("line_start").alias("line"))
    return ranked.join(c, KEY, "left").withColumn("snippet", T.text("snippet")).withColumn("line", F.coalesce("line", F.lit(0)))


def search_hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vec: Sequence[float] | None, limit: int = 20, project: str | None = None) -> DataFrame:
    """Fusion of ranked and vector search, each twice the limit deep; one of them alone where the other has no query."""
    from foliant.operators.vectors import search_vector

    ranked = search_ranked(chunks, query, 2 * limit, project, per_project=None)
    if not query_vec:
        return with_snippets(ranked.select(*KEY, "score").orderBy(*_order("chunk_id")).limit(limit), chunks).withColumn("mode", F.lit("bm25-only"))
    near = search_vector(vectors, query_vec, 2 * limit, project)
    mode = "hybrid-bm25-vector" if words(query) else "vector-only"
    return with_snippets(rrf(ranked, near, limit), chunks).withColumn("mode", F.lit(mode))


def search_vault(chunks: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """As search_ranked, files told apart by name only and no cap per project."""
    return best_per_file(bm25_scores(chunks, query), "file").orderBy(*_order("chunk_id")).limit(limit)


def search_vault_hybrid(chunks: DataFrame, vectors: DataFrame, query: str, query_vec: Sequence[float] | None, limit: int = 10) -> DataFrame:
    """Fusion within one vault: as search_hybrid, but files are told apart by name only and no project has a cap."""
    from foliant.operators.vectors import search_vector

    ranked = search_vault(chunks, query, 2 * limit).select(*KEY, "score")
    if not query_vec:
        return with_snippets(ranked.orderBy(*_order("chunk_id")).limit(limit), chunks).withColumn("mode", F.lit("bm25-only"))
    near = search_vector(vectors, query_vec, 2 * limit)
    return with_snippets(rrf(ranked, near, limit), chunks).withColumn("mode", F.lit("hybrid-bm25-vector" if words(query) else "vector-only"))


def result(rows: DataFrame, source: str, limit: int | None = None) -> DataFrame:
    """Any search's rows in the schema common to all: project, file, line, snippet, score, source, truncated. rows: one more
    than limit where there are more, so that `truncated` can be told; without a limit nothing is cut."""
    have = set(rows.columns)
    line = F.col("line") if "line" in have else F.col("line_start") if "line_start" in have else F.lit(0)
    snippet = F.col("snippet") if "snippet" in have else F.col("body") if "body" in have else F.lit("")
    score = F.col("score") if "score" in have else F.col("hits") if "hits" in have else F.lit(0)
    out = rows.select(
        T.text("project").alias("project"), T.text("file").alias("file"), F.coalesce(line.cast("long"), F.lit(0)).alias("line"), F.coalesce(snippet, F.lit("")).alias("snippet"),
        F.coalesce(score.cast("double"), F.lit(0.0)).alias("score"), F.lit(source).alias("source"),
    )
    if limit is None:
        return out.withColumn("truncated", F.lit(False))
    total = F.count("*").over(W.partitionBy(F.lit(1)))  # rows are a limited result
    return out.withColumn("truncated", total > limit).orderBy(F.desc("score"), "project", "file", "line").limit(limit)


def search_fallback(chunks: DataFrame, vectors: DataFrame | None, query: str, query_vec: Sequence[float] | None, limit: int = 20, project: str | None = None) -> DataFrame:
    """Hybrid search where there are vectors and a query vector, ranked search otherwise, in the common schema; the limit is held
    between 1 and 100. An empty query is an error where there is no query vector either."""
    limit = min(max(limit, 1), 100)
    if not query.strip() and not query_vec:
        raise ValueError("empty query")
    if vectors is not None and query_vec:
        return result(search_hybrid(chunks, vectors, query, query_vec, limit + 1, project), "hybrid", limit)
    return result(search_ranked(chunks, query, limit + 1, project), "bm25", limit)


def search_all_vaults(vaults: dict[str, DataFrame], query: str, limit: int = 10) -> DataFrame:
    """Results of all vaults below each other, by raw score."""
    each = [search_vault(c, query, limit).withColumn("vault", F.lit(name)) for name, c in vaults.items()]
    return reduce(lambda a, b: a.unionByName(b), each).orderBy(*_order("chunk_id"), "vault").limit(limit)


def minmax(df: DataFrame, by: str, score: str = "score") -> DataFrame:
    """Scores of each group stretched to 0..1; one alone stays as it is, equal ones become 0.5."""
    w = W.partitionBy(by)
    lo, hi, n = F.min(score).over(w), F.max(score).over(w), F.count("*").over(w)
    return df.withColumn(score, F.when(n <= 1, F.col(score)).when(hi == lo, 0.5).otherwise((F.col(score) - lo) / (hi - lo)))


def search_multi_root(roots: dict[str, DataFrame], query: str, limit: int = 20) -> DataFrame:
    """Ranked search of every root, scores stretched per root, merged; truncated says whether more than limit were found."""
    if not roots:
        raise ValueError("no indexed root")
    each = [search_ranked(c, query, limit).withColumn("root", F.lit(name)) for name, c in roots.items()]
    merged = minmax(reduce(lambda a, b: a.unionByName(b), each), "root")
    total = F.count("*").over(W.partitionBy(F.lit(1)))  # at most limit rows a root
    return merged.withColumn("truncated", total > limit).orderBy(*_order("chunk_id"), "root").limit(limit)


def search_auto(chunks: DataFrame, docs: DataFrame, query: str, limit: int = 20, project: str | None = None, mode: str = "auto") -> tuple[str, DataFrame]:
    """(source, rows): ranked search, and token search where that finds nothing or mode is 'grep'."""
    if not query.strip():
        raise ValueError("empty query")
    if mode != "grep":
        ranked = search_ranked(chunks, query, limit, project)
        if mode == "ranked" or not ranked.isEmpty():
            return "ranked", ranked
    return "grep", search_grep(docs, query, limit, project)


def search_fresh(store, docs: DataFrame, build, query: str, limit: int = 20, project: str | None = None) -> DataFrame:
    """Ranked search over a stored index that is brought up to date first."""
    from foliant.operators.index import ensure_fresh

    ensure_fresh(store, docs, build)
    return search_ranked(store.read("chunks"), query, limit, project)


def bm25_batch(chunks: DataFrame, queries: dict[str, str], limit: int = 20, boosts: dict[str, float] | None = None) -> DataFrame:
    """(qid, project, file, chunk_id, score, rank): the best chunks of many queries in one pass over the corpus.

    Only grams that a query asks for are counted, in one look at each text; their postings meet the queries' words in a
    join with the word table, which is as long as the queries are. The ranking keeps `limit` rows per query before it is
    shuffled."""
    from collections.abc import Iterator

    import pandas as pd

    boosts = boosts or BOOSTS
    spark = chunks.sparkSession
    rows = [(qid, w, g, len(grams(w))) for qid, q in queries.items() for w in words(q) for g in grams(w)]
    if len(rows) > 1_000_000:
        raise ValueError("too many query words for one batch")
    wanted = spark.sparkContext.broadcast(frozenset(r[2] for r in rows))
    asked = spark.createDataFrame(rows, "qid string, word string, gram string, need int")
    fields = list(boosts)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        want = wanted.value
        for b in batches:
            at, field, gram, tf, length = [], [], [], [], []
            for i, texts in enumerate(zip(*(b[f] for f in fields))):
                for j, t in enumerate(texts):
                    seen: dict[str, int] = {}
                    for n in (2, 3):
                        for k in range(len(t) - n + 1):
                            g = t[k : k + n]
                            if g in want:
                                seen[g] = seen.get(g, 0) + 1
                    for g, c in seen.items():
                        at.append(i), field.append(j), gram.append(g), tf.append(c), length.append(max(len(t) - 1, 0) + max(len(t) - 2, 0))
            yield b[KEY].iloc[at].reset_index(drop=True).assign(field=field, gram=gram, tf=tf, dl=length)

    low = chunks.select(*KEY, *[F.lower(T.text(f)).alias(f) for f in fields])
    postings = low.mapInPandas(count, "project string, file string, chunk_id long, field int, gram string, tf int, dl int")
    stats = low.agg(F.count("*"), *[F.avg(field_length(F.col(f))) for f in fields]).first()
    n, means = stats[0], [max(m or 0.0, 1e-9) for m in stats[1:]]
    df = postings.groupBy("field", "gram").agg(F.count("*").alias("df")).withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df")
    per_field = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("field") + 1)
    met = postings.join(asked, "gram").join(df, ["field", "gram"])
    found = met.groupBy("qid", "word", "need", "field", *KEY).agg(F.count("*").alias("have"), F.min("tf").alias("tf"), F.sum("idf").alias("idf"), F.first("dl").alias("dl")).filter("have = need")
    norm = K1 * (1 - B + B * F.col("dl") / per_field(means))
    gain = per_field(boosts[f] for f in fields) * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    scored = found.groupBy("qid", *KEY).agg(F.sum(gain).alias("score"))
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.round(F.col("score"), 9).desc(), "project", "file", "chunk_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)
