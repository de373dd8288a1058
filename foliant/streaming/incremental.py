"""Index maintenance on a stream of documents: every micro-batch replaces the chunks of the files it brings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.chunking import ChunkConfig, chunk
from foliant.operators.index import delete_keys
from foliant.sources.sinks import Store


def maintain(docs: DataFrame, store: Store, checkpoint: str, cfg: ChunkConfig = ChunkConfig(), order: str | None = None, buckets: int = 256) -> StreamingQuery:
    """docs: a stream of (project, file, ext, content). Of several versions of a file in a batch the one with the greatest `order`
    column counts (a time or a number; without one, the greatest content, so that a repeated run does the same). Files are
    spread over hash buckets, and a batch rewrites those it touches: its cost follows its size, not that of the index. Batches
    that were published before a restart are recognised by their number in the store's meta and not applied again."""
    bucket = F.pmod(F.xxhash64("project", "file"), F.lit(buckets)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        base = store.version()
        if store.meta().get("batch", -1) >= number:
            return
        best = F.struct(*([F.col(order)] if order else []), F.coalesce("content", F.lit("")), "ext")
        last = batch.groupBy("project", "file").agg(F.max_by(F.struct("ext", "content"), best).alias("r")).select("project", "file", "r.ext", "r.content")
        touched = [r[0] for r in last.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        if not touched:
            return
        fresh, old = chunk(last, cfg), store.read("chunks", touched)
        merged = fresh if old is None else delete_keys(old, last).select(*fresh.columns).unionByName(fresh)
        store.publish_buckets("chunks", merged.withColumn("bucket", bucket), "bucket", touched, {"batch": number}, base)

    return docs.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
