"""Versioned tables in a folder. A version is a commit marker that names, per table, the folders it consists of; every writer
writes to folders of its own, so versions can share what did not change and no writer touches another's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.sources.markers import Conflict, Markers, fresh

__all__ = ["Conflict", "Store"]


class Store:
    """<path>/current/<n>: markers; <path>/data/<folder>: Parquet. Readers see the last version that counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._markers = Markers(spark, self.path + "/current")

    def version(self) -> int:
        return self._markers.latest()[0]

    def meta(self) -> dict:
        return self._markers.latest()[1].get("meta", {})

    def _at(self, folder: str) -> str:
        return f"{self.path}/data/{folder}"

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The table; of a bucketed one only the given buckets, if any are given."""
        held = self._markers.latest()[1].get("tables", {}).get(table)
        if held is None:
            return None
        folders = sorted({f for b, f in held.items() if buckets is None or b == "" or int(b) in buckets})
        schema = self.spark.read.parquet(self._at(next(iter(held.values())))).schema
        return self.spark.read.schema(schema).parquet(*map(self._at, folders)) if folders else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], meta: dict | None = None, partition_by: dict[str, str] | None = None, base: int | None = None) -> int:
        """Write the tables as one new version, in place of all others. Of two writers with the same base one gets a Conflict and
        leaves nothing behind; base: the version the tables were made from, by default the present one."""
        base = self.version() if base is None else base
        written = {}
        for name, df in tables.items():
            written[name] = {"": fresh(name)}
            writer = df.write
            if partition_by and name in partition_by:
                writer = writer.partitionBy(partition_by[name])
            writer.parquet(self._at(written[name][""]))
        return self._commit(base, written, meta)

    def publish_buckets(self, table: str, df: DataFrame, bucket: str, touched: list[int], meta: dict | None = None, base: int | None = None) -> int:
        """A new version of which only the touched buckets of one table are written anew; the rest is shared with the version
        before. df: all rows of those buckets, with their number in column `bucket`."""
        base = self.version() if base is None else base
        held = dict(self._markers.latest()[1].get("tables", {}))
        name = fresh(table)
        df.repartition(max(1, len(touched)), bucket).write.partitionBy(bucket).parquet(self._at(name))
        for b in touched:
            if self._markers.fs.exists(self._markers.at("..", "data", name, f"{bucket}={b}")):
                held[table] = {**held.get(table, {}), str(b): f"{name}/{bucket}={b}"}
            else:
                held[table] = {k: f for k, f in held.get(table, {}).items() if k != str(b)}
        return self._commit(base, held, meta, {table: {"": name}})

    def _commit(self, base: int, tables: dict, meta: dict | None, written: dict | None = None) -> int:
        try:
            return self._markers.commit(base, {"tables": tables, "meta": meta or {}})
        except Conflict:
            for folders in (written or tables).values():
                for folder in folders.values():
                    self._markers.fs.delete(self._markers.at("..", "data", folder), True)
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders that none of the last `keep` versions reads. Only where no writer is at work, as its folders are not
        committed yet."""
        used = {f.split("/")[0] if "=" not in f else f for _, info in self._markers.commits()[-keep:] for held in info["tables"].values() for f in held.values()}
        whole = {f.split("/")[0] for f in used}
        root, gone = self._markers.at("..", "data"), 0
        for status in self._markers.fs.listStatus(root) if self._markers.fs.exists(root) else ():
            name = status.getPath().getName()
            if name not in whole:
                gone += bool(self._markers.fs.delete(status.getPath(), True))
            elif name not in used:
                for part in self._markers.fs.listStatus(status.getPath()):
                    if "=" in part.getPath().getName() and f"{name}/{part.getPath().getName()}" not in used:
                        gone += bool(self._markers.fs.delete(part.getPath(), True))
        return gone
