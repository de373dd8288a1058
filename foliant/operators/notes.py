"""Memory notes: short texts with an optional expiry, stored as documents of a vault and recalled by search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.search import search_vault

MOST_BYTES = 1 << 20


def store_note(notes: DataFrame, content: str, stamp: str, title: str | None = None, project: str = "", valid_until: str = "") -> DataFrame:
    """notes (project, file, content, ext) and one more. stamp: a file-name timestamp that tells notes of a title apart."""
    if not content.strip():
        raise ValueError("empty note")
    if len(content.encode()) > MOST_BYTES:
        raise ValueError(f"content exceeds {MOST_BYTES} bytes")
    if valid_until and datetime.fromisoformat(valid_until.replace("Z", "+00:00")).tzinfo is None:
        raise ValueError("valid_until must have a time zone")
    one = notes.sparkSession.createDataFrame([(project, content, title, valid_until, stamp)], "project string, body string, title string, valid_until string, stamp string")
    name = F.concat_ws("-", "stamp", F.when(T.slug(F.coalesce("title", T.note_title(F.col("body")))) != "", T.slug(F.coalesce("title", T.note_title(F.col("body"))))))
    head = F.concat(F.lit("---\nproject: "), F.col("project"), F.lit("\nvalid_until: "), F.col("valid_until"), F.lit("\n---\n"))
    new = one.select("project", F.concat(name, F.lit(".md")).alias("file"), F.concat(head, F.col("body")).alias("content"), F.lit("md").alias("ext"))
    return notes.select("project", "file", "content", "ext").unionByName(new)


def recall(chunks: DataFrame, notes: DataFrame, query: str, now: str, limit: int = 10, keep_expired: bool = False) -> DataFrame:
    """Best notes for a query; expired ones stay out unless asked for."""
    if not keep_expired:
        alive = notes.filter(~T.is_expired(T.front_value(F.col("content"), "valid_until"), F.lit(now))).select("file")
        chunks = chunks.join(alive, "file", "left_semi")
    return search_vault(chunks, query, limit)
