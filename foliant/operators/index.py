"""What changed since a build, incremental builds, and keyed updates of stored tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA_VERSION, CHUNK_VERSION = 3, 2
FILE = ["project", "file"]


def diff_state(current: DataFrame, recorded: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    """(keys, status) of every file in either: added, modified, deleted, unchanged. Both have mtime_secs and size_bytes; missing
    numbers are 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    a = current.select(*keys, zero("mtime_secs").alias("_m"), zero("size_bytes").alias("_s"), F.lit(1).alias("_here"))
    b = recorded.select(*keys, zero("mtime_secs").alias("_rm"), zero("size_bytes").alias("_rs"), F.lit(1).alias("_was"))
    status = (
        F.when(F.col("_was").isNull(), "added").when(F.col("_here").isNull(), "deleted")
        .when((F.col("_m") != F.col("_rm")) | (F.col("_s") != F.col("_rs")), "modified").otherwise("unchanged")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def change_summary(diff: DataFrame) -> DataFrame:
    """One row: counts per status, what is indexed in all, and whether the index is stale."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = diff.agg(of("added"), of("modified"), of("deleted"), of("unchanged"))
    return out.withColumn("total_indexed", F.col("modified") + F.col("deleted") + F.col("unchanged")).withColumn("is_stale", F.col("added") + F.col("modified") + F.col("deleted") > 0)


def is_stale(current: DataFrame, recorded: DataFrame | None) -> bool:
    """No record at all is stale; otherwise one difference is enough."""
    return recorded is None or recorded.isEmpty() or not diff_state(current, recorded).filter("status <> 'unchanged'").isEmpty()


def delete_keys(old: DataFrame, keys_df: DataFrame, keys: Sequence[str] = FILE) -> DataFrame:
    return old.join(keys_df.select(*keys).distinct(), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of both, of one key the new one; of several new ones the greatest by order."""
    if order:
        new = new.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).filter("_r = 1").drop("_r")
    else:
        new = new.dropDuplicates(list(keys))
    return delete_keys(old, new, keys).unionByName(new)


def build_incremental(chunks: DataFrame, docs: DataFrame, diff: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored chunks without those of changed and deleted files, and the chunks of added and modified ones."""
    touched = diff.filter("status in ('modified', 'deleted')")
    fresh = docs.join(diff.filter("status in ('added', 'modified')").select(*FILE), FILE, "left_semi")
    return delete_keys(chunks, touched).unionByName(build(fresh))


def needs_rebuild(schema_version: int | None, chunk_version: int | None) -> bool:
    """Older formats are rebuilt from nothing."""
    return (schema_version or 0) < SCHEMA_VERSION or (chunk_version or 0) < CHUNK_VERSION


def ensure_fresh(store, docs: DataFrame, build: Callable[[DataFrame], DataFrame]) -> dict:
    """Bring a stored index up to date and tell what was done: mode (none, incremental, full) and the numbers of added, modified and
    deleted files. docs: (project, file, mtime_secs, size_bytes, ...) of all present files, what build makes chunks from. The store
    holds the tables chunks and files and the format's versions; an older format, or none, is built from nothing."""
    meta, recorded, base = store.meta(), store.read("files"), store.version()
    state = docs.select(*FILE, "mtime_secs", "size_bytes")
    versions = {"schema_version": SCHEMA_VERSION, "chunk_version": CHUNK_VERSION}
    if recorded is None or needs_rebuild(meta.get("schema_version"), meta.get("chunk_version")):
        store.publish({"chunks": build(docs), "files": state}, versions, base=base)
        return {"mode": "full", "added": state.count(), "modified": 0, "deleted": 0}
    diff = diff_state(state, recorded)
    found = change_summary(diff).first()
    if found["is_stale"]:
        store.publish({"chunks": build_incremental(store.read("chunks"), docs, diff, build), "files": state}, versions, base=base)
    return {"mode": "incremental" if found["is_stale"] else "none", **{k: found[k] for k in ("added", "modified", "deleted")}}


def without_vectors(docs: DataFrame, vectors: DataFrame, by_hash: bool = True) -> DataFrame:
    """Files that must be embedded: those without vectors of their present content (by_hash) or without any."""
    on = [*FILE, "hash"] if by_hash else FILE
    return docs.join(vectors.select(*on).distinct(), on, "left_anti")


def id_stamp(df: DataFrame, column: str) -> DataFrame:
    """One hash of a set of ids, whatever their order. Ids are hashed and added up, so no task gathers them."""
    return df.select(column).distinct().agg(F.count("*").alias("ids"), F.sum(F.xxhash64(column).cast("decimal(38,0)")).cast("string").alias("stamp"))
