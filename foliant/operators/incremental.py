"""Problem 1: process only records that are new or changed since the last successful run.

Work is tracked as sequence numbers within a *shard* (any set of key columns). The processed numbers of a shard are kept
as disjoint closed intervals; what is due is `available - processed`, so a record that was committed late, with a
number below the highest processed one, is simply a gap and gets its turn. A run writes its output and the merged
intervals to folders of its own, and one commit marker publishes both: a run that dies before it leaves nothing that counts,
a repeated run finds the same gaps, and of two runs at the same time one counts and the other finds its work still due.

Shards, not whole sources, are the unit of sorting: a source holding a third of all rows is spread over all of its shards.

Defined cases: null sequence numbers are never due (they name no record); repeated rows carry the same number and are
all returned when due; empty sources give empty intervals; extra columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.session import cut, shared_dir
from foliant.sources.markers import Conflict, Markers, fresh


def intervals(df: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """Sequence numbers -> disjoint maximal intervals (keys, lo, hi): numbers minus their row number are constant on a run."""
    runs = df.filter(F.col(seq).isNotNull()).select(*keys, F.col(seq).cast("long").alias("_s")).distinct()
    w = W.partitionBy(*keys).orderBy("_s")
    return (
        runs.withColumn("_g", F.col("_s") - F.row_number().over(w))
        .groupBy(*keys, "_g")
        .agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
        .drop("_g")
    )


def merge_intervals(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of two interval sets, adjacent and overlapping ones joined into one."""
    w = W.partitionBy(*keys).orderBy("lo", "hi")
    both = a.select(*keys, "lo", "hi").unionByName(b.select(*keys, "lo", "hi")).filter("lo <= hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    return (
        both.withColumn("_new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
        .withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "_g")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_g")
    )


def subtract_intervals(available: DataFrame, processed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The gaps: available minus processed, both disjoint per key. A sweep over interval ends; no pairs are formed."""
    keys = list(keys)
    ends = [
        (available, F.col("lo"), 1, 0), (available, F.col("hi") + 1, -1, 0),
        (processed, F.col("lo"), 0, 1), (processed, F.col("hi") + 1, 0, -1),
    ]
    marks = None
    for df, at, a, p in ends:
        one = df.filter("lo <= hi").select(*keys, at.alias("at"), F.lit(a).alias("a"), F.lit(p).alias("p"))
        marks = one if marks is None else marks.unionByName(one)
    marks = marks.groupBy(*keys, "at").agg(F.sum("a").alias("a"), F.sum("p").alias("p"))
    w = W.partitionBy(*keys).orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    swept = marks.select(
        *keys, F.col("at").alias("lo"), (F.lead("at").over(w) - 1).alias("hi"),
        F.sum("a").over(upto).alias("_a"), F.sum("p").over(upto).alias("_p"),
    )
    open_ = swept.filter((F.col("_a") > 0) & (F.col("_p") <= 0) & F.col("hi").isNotNull()).select(*keys, "lo", "hi")
    return merge_intervals(open_, open_.limit(0), keys)


def rows_in(df: DataFrame, gaps: DataFrame, keys: Sequence[str], seq: str = "seq", width: int = 4096) -> DataFrame:
    """Rows whose number lies in a gap: gaps are cut at multiples of width and joined by (keys, block), so the range condition
    meets only the gaps of one block. Cutting goes in two steps, first into stretches of `width` blocks, which are spread over
    the tasks, so that no row makes an array of more than `width` entries unless its gap is longer than width cubed."""
    keys = list(keys)
    names = [f"_k{i}" for i in range(len(keys))]
    stretch = width * width
    coarse = gaps.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / stretch), F.floor(F.col("hi") / stretch))).alias("_c"),
    )
    part = coarse.select(*names, F.greatest("lo", F.col("_c") * stretch).alias("lo"), F.least("hi", (F.col("_c") + 1) * stretch - 1).alias("hi"))
    cutup = part.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    left = df.withColumn("_blk", F.floor(F.col(seq) / width))
    on = [left[k].eqNullSafe(cutup[n]) for k, n in zip(keys, names)]
    on += [left["_blk"] == cutup["_b"], left[seq] >= cutup["lo"], left[seq] <= cutup["hi"]]
    return left.join(cutup, on, "left_semi").drop("_blk")


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, rows_per_shard: int = 200_000) -> DataFrame:
    """Give each row a shard and a dense number in it, for sources without numbers of their own. Shards are hash buckets
    of (keys, order), so the rows that one task sorts stay near rows_per_shard however uneven the keys are. rows: an upper
    bound of the number of rows."""
    shards = max(1, math.ceil(rows / rows_per_shard))
    out = df.withColumn("shard", F.pmod(F.xxhash64(*keys, *order), F.lit(shards)).cast("int"))
    return out.withColumn("seq", F.row_number().over(W.partitionBy(*keys, "shard").orderBy(*order)).cast("long"))


class Ledger:
    """Processed intervals and outputs under one folder of a shared file system.

    <path>/out/<folder>      output of a run
    <path>/ledger/<folder>   processed intervals after it
    <path>/commit/<n>        marker that names both folders, see Markers
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], seq: str = "seq"):
        self.spark, self.path, self.keys, self.seq = spark, path.rstrip("/"), list(keys), seq
        self._markers = Markers(spark, self.path + "/commit")

    def runs(self) -> list[int]:
        """Numbers of the committed runs, ascending."""
        return [n for n, _ in self._markers.commits()]

    def _at(self, info: dict, what: str) -> str:
        return f"{self.path}/{what}/{info[what]}"

    def _processed(self, info: dict, like: DataFrame) -> DataFrame:
        if info:
            return self.spark.read.parquet(self._at(info, "ledger"))
        return like.select(*self.keys, F.lit(0).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi")).limit(0)

    def processed(self, like: DataFrame) -> DataFrame:
        return self._processed(self._markers.latest()[1], like)

    def adopt(self, done: DataFrame) -> int:
        """Take over intervals (keys, lo, hi) that another log says are processed, as a commit without output."""
        base, info = self._markers.latest()
        return self._commit(base, None, merge_intervals(self._processed(info, done), done, self.keys))

    def due(self, source: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(gaps, rows in them)."""
        gaps = subtract_intervals(intervals(source, self.keys, self.seq), self.processed(source), self.keys)
        return gaps, rows_in(source, gaps, self.keys, self.seq)

    def run(self, source: DataFrame, process: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] = lambda: None) -> int | None:
        """Process what is due and commit it with the merged intervals. Returns the run's number, None if nothing was due; Conflict
        if another run committed meanwhile. before_commit: called when all is written and nothing published, to check or count
        what was written; if it raises, nothing counts."""
        base, info = self._markers.latest()
        done = self._processed(info, source)
        gaps = cut(subtract_intervals(intervals(source, self.keys, self.seq), done, self.keys))
        if gaps.isEmpty():
            return None
        out = process(rows_in(source, gaps, self.keys, self.seq))
        return self._commit(base, out, merge_intervals(done, gaps, self.keys), before_commit)

    def _commit(self, base: int, out: DataFrame | None, ledger: DataFrame, before_commit: Callable[[], None] = lambda: None) -> int:
        info = {"ledger": fresh("run")} | ({"out": fresh("run")} if out is not None else {})
        try:
            if out is not None:
                out.write.parquet(self._at(info, "out"))
            ledger.write.parquet(self._at(info, "ledger"))
            before_commit()
            return self._markers.commit(base, info)
        except BaseException as e:
            if isinstance(e, Conflict) or base == self._markers.latest()[0]:  # it does not count: leave nothing behind
                for what in info:
                    self._markers.fs.delete(self._markers.at("..", what, info[what]), True)
            raise

    def output(self, run: str | None = None) -> DataFrame | None:
        """Rows of all committed runs, with the run's number in column `run` if that is given; folders of runs that never
        committed are not read."""
        held = [(n, self._at(info, "out")) for n, info in self._markers.commits() if "out" in info]
        if not held:
            return None
        if run is None:
            return self.spark.read.parquet(*(at for _, at in held))
        parts = [self.spark.read.parquet(at).withColumn(run, F.lit(n)) for n, at in held]
        while len(parts) > 1:
            parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
        return parts[0]


def norm_path(path: Column) -> Column:
    """Backslashes read as slashes, without a leading './'; missing is ''."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"^(\./)+", "")


def latest_runs(index_runs: DataFrame) -> DataFrame:
    """One row per run, the last logged; ties of logged_at go to the greater (status, versions)."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    last = F.max(F.struct("logged_at", "status", zero("schema_version").alias("schema_version"), zero("chunk_strategy_version").alias("chunk_strategy_version"), "started_at")).alias("r")
    return index_runs.groupBy("run_id", "root").agg(last).select(
        "run_id", "root", "r.started_at", "r.schema_version", "r.chunk_strategy_version",
        F.lower(F.trim(F.coalesce("r.status", F.lit("")))).isin("ok", "success").alias("succeeded"),
    )


def file_states(doc_files: DataFrame, index_meta: DataFrame, index_runs: DataFrame, schema_version: int = 3, chunk_version: int = 2) -> DataFrame:
    """Every present file with its stamp, the recorded stamp and whether it is as recorded under current versions:
    (root, path, key, mtime_secs, size_bytes, known, current).

    Missing numbers are 0, missing names ''. Of walks of the same moment the greater stamp counts.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    present = (
        doc_files.select(text("root").alias("root"), F.concat_ws("/", text("project"), text("file")).alias("path"), "scanned_at", zero("mtime_secs").alias("m"), zero("size_bytes").alias("s"))
        .groupBy("root", "path").agg(F.max(F.struct("scanned_at", "m", "s")).alias("w"))
        .select("root", "path", norm_path(F.col("path")).alias("key"), F.col("w.m").alias("mtime_secs"), F.col("w.s").alias("size_bytes"))
    )
    good = latest_runs(index_runs).filter("succeeded").withColumn("root", text("root"))
    recorded = (
        index_meta.select("run_id", text("root").alias("root"), norm_path(F.col("path")).alias("key"), zero("mtime_secs").alias("m"), zero("size_bytes").alias("s"))
        .join(good.select("run_id", "root", "started_at"), ["run_id", "root"])
        .groupBy("root", "key").agg(F.max(F.struct("started_at", "run_id", "m", "s")).alias("e"))
    )
    versions = good.groupBy("root").agg(F.max(F.struct("started_at", "run_id", "schema_version", "chunk_strategy_version")).alias("v"))
    fresh = versions.select("root", ((F.col("v.schema_version") >= schema_version) & (F.col("v.chunk_strategy_version") >= chunk_version)).alias("fresh"))
    return present.join(recorded, ["root", "key"], "left").join(fresh, "root", "left").select(
        "root", "path", "key", "mtime_secs", "size_bytes", F.col("e").isNotNull().alias("known"),
        F.coalesce((F.col("e.m") == F.col("mtime_secs")) & (F.col("e.s") == F.col("size_bytes")) & F.col("fresh"), F.lit(False)).alias("current"),
    )


def due_files(doc_files: DataFrame, index_meta: DataFrame, index_runs: DataFrame, rows_per_shard: int = 200_000, **versions: int) -> DataFrame:
    """(root, path) of the present files that the next run of their root must process.

    Present files are numbered per (root, shard) as a registry would that had seen the succeeded runs: first the file versions that are
    recorded, then those that are not. The recorded numbers of a shard are one interval, which a ledger takes over from the
    run log as processed; what is due are its gaps.
    """
    keys = ["root", "shard"]
    states = file_states(doc_files, index_meta, index_runs, **versions)
    states = cut(number(states.withColumn("late", ~F.col("current")), ["root"], ["late", "path"], doc_files.count(), rows_per_shard).select("root", "path", "shard", "seq", "current"))
    spark = states.sparkSession
    ledger = Ledger(spark, f"{shared_dir(spark)}/{fresh('due')}", keys)
    ledger.adopt(states.filter("current").groupBy(*keys).agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")))
    return ledger.due(states)[1].select("root", "path")


def logged_runs(walks: DataFrame, moment: Column, late: Column) -> DataFrame:
    """What several runs over a growing log of walks give, (columns of walks, shard, seq, run): every row has its number from the moment it
    is made. A first run sees those made up to `moment` except those that come `late`; a second one dies when all is
    written and nothing published; a third sees everything, the late ones in the gaps below what is processed."""
    spark = walks.sparkSession
    order = [c for c in ("scanned_at", "project", "file", "mtime_secs", "size_bytes", "ext") if c in walks.columns]
    numbered = cut(number(walks, ["root"], order, walks.count()))
    ledger = Ledger(spark, f"{shared_dir(spark)}/{fresh('runs')}", ["root", "shard"])

    def dies() -> None:
        raise InterruptedError("the driver is gone")

    ledger.run(numbered.filter(moment & ~late), lambda rows: rows)
    try:
        ledger.run(numbered.filter(moment), lambda rows: rows, dies)
    except InterruptedError:
        pass  # nothing of it counts
    ledger.run(numbered, lambda rows: rows)
    out = ledger.output("run")
    return numbered.withColumn("run", F.lit(0)).limit(0) if out is None else out
