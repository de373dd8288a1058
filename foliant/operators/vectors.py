"""Vector store operations: exact and approximate search, cache-aside embedding, validity of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE = ["project", "file"]
ANN_FROM = 5000  # rows from which approximate search is worth an index


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector has no direction."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def _literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def search_vector(vectors: DataFrame, query: Sequence[float], limit: int, project: str | None = None, allow: DataFrame | None = None, positive_only: bool = True) -> DataFrame:
    """Exact top k by cosine similarity: project, file, chunk_id, score. allow: keys that may be found (columns of it)."""
    rows = vectors if project is None else vectors.filter(F.col("project") == project)
    if allow is not None:
        rows = rows.join(allow.distinct(), allow.columns, "left_semi")
    scored = rows.select("project", "file", "chunk_id", cosine(F.col("embedding"), _literal(query)).alias("score"))
    if positive_only:
        scored = scored.filter("score > 0")
    return scored.orderBy(F.desc("score"), "project", "file", "chunk_id").limit(limit)


def search_batch(vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Top k for every (qid, query) at once: qid, project, file, chunk_id, score, rank. queries is a stated set of at most 100 000
    rows, which is checked; beyond that the graph search is the way. Each Arrow batch of vectors meets the queries as matrices and
    sends on its best k a query."""
    asked = queries.select(F.col("qid").cast("string").alias("qid"), F.col("query").cast("array<double>")).limit(100_001).collect()
    if len(asked) > 100_000:
        raise ValueError("too many queries for an exact scan")
    asked = [r for r in asked if r[1] and all(x is not None for x in r[1])]
    handed = vectors.sparkSession.sparkContext.broadcast([(r[0], np.asarray(r[1])) for r in asked])
    kind = dict(queries.dtypes)["qid"]

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_width: dict[int, list[int]] = {}
        for i, (_, q) in enumerate(handed.value):
            by_width.setdefault(len(q), []).append(i)
        names = np.array([n for n, _ in handed.value], dtype=object)
        sides = {w: (names[at], unit(np.stack([handed.value[i][1] for i in at]))) for w, at in by_width.items()}
        for b in batches:
            width = b["embedding"].map(lambda e: -1 if e is None else len(e))
            for w, (qids, q) in sides.items():
                rows = b[width == w]
                if not len(rows):
                    continue
                x = unit(np.stack(rows["embedding"].to_numpy()).astype(np.float64))
                for start in range(0, len(qids), 1000):
                    sims = q[start : start + 1000] @ x.T
                    # ties at the edge of the best stay in, so that the final order decides them
                    edge = np.partition(sims, -min(limit, len(rows)), axis=1)[:, -min(limit, len(rows))][:, None] if limit > 0 else np.inf
                    i, j = np.nonzero((sims >= edge - 1e-12) & (sims > 0))
                    yield rows[["project", "file", "chunk_id"]].iloc[j].reset_index(drop=True).assign(qid=qids[start + i], score=sims[i, j])

    found = vectors.select("project", "file", "chunk_id", "embedding").mapInPandas(run, "project string, file string, chunk_id long, qid string, score double")
    w = W.partitionBy("qid").orderBy(F.desc("score"), "project", "file", "chunk_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return best.select(F.col("qid").cast(kind).alias("qid"), "project", "file", "chunk_id", "score", "rank")


def search_lsh(vectors: DataFrame, query: Sequence[float], limit: int, project: str | None = None, bucket: float = 0.5, tables: int = 6, seed: int = 7) -> DataFrame:
    """Approximate top k: unit vectors hashed by random projections, where the Euclidean order is the cosine order."""
    from pyspark.ml.linalg import Vectors

    norm = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    rows = vectors if project is None else vectors.filter(F.col("project") == project)
    unit = rows.filter(norm > 0).withColumn("unit", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / norm)))
    size = sum(float(x) ** 2 for x in query) ** 0.5 or 1.0
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense([float(x) / size for x in query]), limit, distCol="d")
    return near.select("project", "file", "chunk_id", (1 - F.col("d") * F.col("d") / 2).alias("score"))


def search(vectors: DataFrame, query: Sequence[float], limit: int, project: str | None = None, ann_from: int = ANN_FROM) -> DataFrame:
    """Exact below ann_from rows, by hashing from there; 0 always hashes, a number above the rows never does."""
    if vectors.limit(ann_from).count() < ann_from:
        return search_vector(vectors, query, limit, project)
    return search_lsh(vectors, query, limit, project)


def quantise(vectors: DataFrame) -> DataFrame:
    """4-bit codes per dimension (array<tinyint> 0..15) with each vector's least value and step; dimensions must be a
    multiple of 8, others are null."""
    lo, hi = F.array_min("embedding"), F.array_max("embedding")
    step = F.when(hi > lo, (hi - lo) / 15).otherwise(1.0)
    code = F.when(F.size("embedding") % 8 == 0, F.transform("embedding", lambda x: F.round((x - lo) / step).cast("tinyint")))
    return vectors.withColumn("code", code).withColumn("least", lo.cast("double")).withColumn("step", step.cast("double")).drop("embedding")


def search_quantised(codes: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """Top k from 4-bit codes; scores are approximate."""
    back = F.transform("code", lambda c: F.col("least") + c * F.col("step"))
    scored = codes.filter("code is not null").select("project", "file", "chunk_id", cosine(back, _literal(query)).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "project", "file", "chunk_id").limit(limit)


def split_cache(texts: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(hits with embedding, misses) of (hash, ...) rows against the cache (hash, model, embedding)."""
    c = cache.filter(F.col("model") == model).select("hash", "embedding")
    return texts.join(c, "hash"), texts.join(c, "hash", "left_anti")


def store_meta(vectors: DataFrame, model: str) -> DataFrame:
    """One row: model, dimension (of the longest vector, 0 if there is none), vector_count."""
    return vectors.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"), F.count("*").alias("vector_count")).select(F.lit(model).alias("model"), "dimension", "vector_count")


def is_empty(vectors: DataFrame) -> bool:
    return vectors.isEmpty()


def has_file(vectors: DataFrame, files: DataFrame) -> DataFrame:
    """files with a column has_vectors: whether any chunk of (project, file) has a vector."""
    have = vectors.select(*FILE).distinct().withColumn("_has", F.lit(True))
    return files.join(have, FILE, "left").withColumn("has_vectors", F.coalesce("_has", F.lit(False))).drop("_has")


def delete(vectors: DataFrame, project: str | None = None, keys: DataFrame | None = None, everything: bool = False) -> DataFrame:
    """The store without a project's vectors, without those of the given keys (any of project, file, chunk_id), or without any."""
    if everything:
        return vectors.limit(0)
    if project is not None:
        vectors = vectors.filter(~F.col("project").eqNullSafe(F.lit(project)))
    if keys is not None:
        vectors = vectors.join(keys.distinct(), keys.columns, "left_anti")
    return vectors


def put_cache(cache: DataFrame, fresh: DataFrame, order: str | None = None) -> DataFrame:
    """The embedding cache (content_hash, model, embedding) with fresh rows in place of those of the same hash and model; vectors that are
    missing or empty are not cached."""
    from foliant.operators.index import upsert

    return upsert(cache, fresh.filter(F.coalesce(F.size("embedding"), F.lit(0)) > 0), ["content_hash", "model"], order)


def embed(chunks: DataFrame, factory: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]], text: str = "body") -> DataFrame:
    """chunks with a column `embedding` (array<float>) by a model of the caller's: factory is called once a task and gives a function from
    texts to vectors, which gets an Arrow batch of texts at a time. Missing texts read as ''."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            yield pd.Series([[float(x) for x in v] for v in model(texts)] if texts else [], dtype="object")

    return chunks.withColumn("embedding", run(F.col(text)))


def to_blob(embedding: Column) -> Column:
    """A vector as hexadecimal text of its little-endian 32-bit floats."""

    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes().hex())

    return run(embedding)


def from_blob(blob: Column) -> Column:
    """The vector of such a text; null where it is no whole number of floats."""

    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or len(x) % 8 else np.frombuffer(bytes.fromhex(x), dtype="<f4").tolist())

    return run(blob)


def valid_vectors(vectors: DataFrame, meta: DataFrame, model: str, dimension: int) -> DataFrame:
    """The stored vectors if their meta row names this model and dimension, none otherwise."""
    same = meta.filter((F.col("model") == model) & (F.col("dimension") == dimension)).limit(1).select(F.lit(True).alias("_ok"))
    return vectors.join(F.broadcast(same), F.col("_ok"), "left_semi")


def hashing_vectors(chunks: DataFrame, dimensions: int = 64) -> DataFrame:
    """A hashing vectoriser of words, for tests and offline use; it is no semantic model."""
    word = F.explode(F.split(F.lower(F.col("body")), r"[^\p{L}\p{N}]+")).alias("w")
    counted = chunks.select("project", "file", "chunk_id", word).filter("w <> ''").groupBy("project", "file", "chunk_id", F.pmod(F.xxhash64("w"), F.lit(dimensions)).cast("int").alias("d")).agg(F.count("*").alias("n"))
    cells = F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m")
    rows = counted.groupBy("project", "file", "chunk_id").agg(cells)
    return rows.select("project", "file", "chunk_id", F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("float")).alias("embedding"))
