"""Session helpers: a local session for tests and benches, and lineage cutting that survives lost executors."""

from __future__ import annotations

import tempfile

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foliant")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only where it is unset on a local master, as in tests, a
    folder of this machine is made; on a cluster executors would write to different disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="foliant-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write df to the shared folder and go on from there: nothing before it is computed twice, and no executor holds the only
    copy. instead_of: what an earlier cut gave and nothing needs any more, as in loops; its files are removed."""
    spark = df.sparkSession
    shared_dir(spark)
    out = df.checkpoint(eager=True)
    if instead_of is not None:
        plan = instead_of._jdf.queryExecution().logical()
        held = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if held is not None and held.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(held.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def bounded(df: DataFrame, limit: int = 32_000_000) -> DataFrame:
    """df, which should be cut or small to compute, marked for broadcast if the bytes of its values are proven to be within the
    limit; otherwise as it is, so that the planner joins it by shuffle and AQE splits what is skewed."""
    width = [F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(16) for c, kind in df.dtypes]
    size = df.agg(F.sum(reduce(lambda a, b: a + b, width))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
