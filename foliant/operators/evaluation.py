"""Retrieval quality, latency and regression figures. A run is (qid, file, rank from 1); truth is (qid, file)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T

# fixed values: changes in percent that count as regressions
THRESHOLDS = {"precision": (5.0, True), "latency": (20.0, False), "throughput": (15.0, True)}


def norm(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def judged(run: DataFrame, truth: DataFrame) -> DataFrame:
    """run with rel (0 or 1)."""
    t = truth.select("qid", norm(F.col("file")).alias("_f")).distinct().withColumn("_r", F.lit(1))
    return run.withColumn("_f", norm(F.col("file"))).join(t, ["qid", "_f"], "left").select("qid", "file", "rank", F.coalesce("_r", F.lit(0)).alias("rel"))


def _per_query(run: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, relevant) of all queries."""
    n = truth.select("qid", norm(F.col("file")).alias("f")).distinct().groupBy("qid").agg(F.count("*").alias("relevant"))
    return queries.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("relevant", F.lit(0)).alias("relevant"))


def metrics(run: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(qid, k, precision, recall, ndcg, ap) for every query and k. A query without relevant files has recall, NDCG and AP 1."""
    running = F.sum("rel").over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    hits = judged(run, truth).withColumn("_c", running)
    each = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    base = _per_query(run, truth, queries).select("qid", "relevant", each)
    sums = hits.filter("rel = 1").join(base.select("qid", "k"), "qid").filter(F.col("rank") <= F.col("k")).groupBy("qid", "k").agg(
        F.sum("rel").alias("_h"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("_dcg"), F.sum(F.col("_c") / F.col("rank")).alias("_ap"),
    )
    ideal_hits = F.least("relevant", "k").cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(ideal_hits, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero, none = lambda c: F.coalesce(F.col(c), F.lit(0.0)), F.col("relevant") == 0
    return base.join(sums, ["qid", "k"], "left").select(
        "qid", "k", (F.coalesce("_h", F.lit(0)) / F.col("k")).alias("precision"), F.when(none, 1.0).otherwise(F.coalesce("_h", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.when(none, 1.0).otherwise(zero("_dcg") / ideal).alias("ndcg"), F.when(none, 1.0).otherwise(zero("_ap") / F.greatest(ideal_hits, F.lit(1))).alias("ap"),
    )


def mrr(run: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, rr): inverse rank of the first relevant file, 0 if none came, 1 if there is none."""
    first = judged(run, truth).filter("rel = 1").groupBy("qid").agg(F.min("rank").alias("r"))
    return _per_query(run, truth, queries).join(first, "qid", "left").select("qid", F.when(F.col("relevant") == 0, 1.0).otherwise(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("rr"))


def averages(per_query: DataFrame) -> DataFrame:
    """Means over all queries by k."""
    return per_query.groupBy("k").agg(*[F.avg(c).alias(f"avg_{c}") for c in ("precision", "recall", "ndcg", "ap")])


def section_ranges(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """(qid, file, first, last) of (qid, file, heading) sections that are there. A section ends before the next line that starts
    with the heading's marks, two at least, and is longer than those."""
    ls = T.lines(F.col("content"))
    d = docs.select(norm(F.col("file")).alias("_f"), ls.alias("ls"))
    rows = sections.select("qid", norm(F.col("file")).alias("_f"), F.lower("heading").alias("h")).join(d, "_f")
    at = F.array_position(F.transform("ls", lambda l: F.startswith(F.lower(l), F.col("h"))), True).cast("int")
    rows = rows.withColumn("first", at).filter("first > 0")
    mark = F.length(F.regexp_extract(F.get("ls", F.col("first") - 1), r"^\s*(\S*)", 1))
    rows = rows.withColumn("_m", mark)
    bare = lambda l: F.ltrim(l)
    stops = lambda l: bare(l).startswith("#") & (F.length(bare(l)) > F.least("_m", F.lit(2))) & (F.length(F.regexp_extract(bare(l), "^(#*)", 1)) >= F.least(F.greatest(F.col("_m"), F.lit(2)), F.length(bare(l))))
    after = F.slice("ls", F.col("first") + 1, F.greatest(F.size("ls") - F.col("first"), F.lit(0)))
    n = F.array_position(F.transform(after, stops), True).cast("int")
    return rows.select("qid", F.col("_f").alias("file"), "first", F.when(n > 0, F.col("first") + n - 1).otherwise(F.size("ls")).alias("last"))


def chunk_precision(chunks: DataFrame, ranges: DataFrame, queries: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(qid, k, precision, recall) of retrieved chunks (qid, file, line_start, rank): a hit starts within a relevant section of
    its file. Queries without sections have precision 0 and recall 1."""
    c, r = chunks.withColumn("file", norm(F.col("file"))), ranges.select("qid", "file", "first", "last")
    inside = (F.col("line_start") >= F.col("first")) & (F.col("line_start") <= F.col("last"))
    hit = c.join(r, ["qid", "file"]).filter(inside).select("qid", "rank").distinct()
    total = ranges.groupBy("qid").agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    base = queries.select("qid").distinct().join(total, "qid", "left").select("qid", "n", each)
    hits = hit.join(base.select("qid", "k"), "qid").filter(F.col("rank") <= F.col("k")).groupBy("qid", "k").agg(F.count("*").alias("h"))
    h = F.coalesce("h", F.lit(0))
    return base.join(hits, ["qid", "k"], "left").select("qid", "k", F.when(F.col("n").isNull(), 0.0).otherwise(h / F.col("k")).alias("precision"), F.when(F.col("n").isNull(), 1.0).otherwise(h / F.col("n")).alias("recall"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, ps: Sequence[int]) -> DataFrame:
    """(by, p50, ...): nearest rank, index round(p / 100 x (n - 1)) of the sorted values. Values are counted first, so that a
    group's sort holds its distinct values only."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("_c").over(W.partitionBy(*by))
    ranked = counts.withColumn("_u", upto).withColumn("_n", total)
    want = lambda p: F.floor(F.lit(p) / 100 * (F.col("_n") - 1) + 0.5)
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("_u") > want(p), F.col(value))).alias(f"p{p}") for p in ps])


def latency(df: DataFrame, by: Sequence[str], micros: str) -> DataFrame:
    """(by, avg, p50, p95, p99) in whole microseconds; the mean is rounded down."""
    avg = df.groupBy(*by).agg(F.floor(F.sum(micros) / F.count(micros)).alias("avg"))
    return avg.join(percentiles(df, by, micros, (50, 95, 99)), list(by))


def regression(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(metric, baseline, current, change_percent, status) of (metric, kind, value) tables. Half a threshold warns; metrics with
    baseline 0 are left out."""
    b = baseline.select("metric", F.col("value").alias("baseline"))
    both = current.select("metric", "kind", F.col("value").alias("current")).join(b, "metric").filter("baseline <> 0")
    change = (F.col("current") - F.col("baseline")) / F.col("baseline") * 100
    limit, loss = F.lit(None).cast("double"), change
    for kind, (percent, lower_is_worse) in THRESHOLDS.items():
        limit = F.when(F.col("kind") == kind, percent).otherwise(limit)
        loss = F.when(F.col("kind") == kind, -change if lower_is_worse else change).otherwise(loss)
    status = F.when(loss >= limit, "regression").when(loss >= limit / 2, "warn").otherwise("pass")
    return both.select("metric", "baseline", "current", change.alias("change_percent"), status.alias("status"))


def passed(compared: DataFrame) -> bool:
    return compared.filter("status = 'regression'").isEmpty()


def disk_ratio(index_bytes: Column, doc_bytes: Column) -> Column:
    return F.when(doc_bytes > 0, index_bytes / doc_bytes * 100).otherwise(0.0)


def report(metrics: DataFrame, compared: DataFrame | None = None) -> str:
    """Markdown of a (metric, kind, value) table, with the comparison of regression() if there is one. Metrics are few."""
    lines = ["# Benchmark", "", "| Metric | Kind | Value |", "|---|---|---|"]
    lines += [f"| {r['metric']} | {r['kind']} | {r['value']:.4f} |" for r in metrics.orderBy("metric").collect()]
    if compared is not None:
        lines += ["", "| Metric | Baseline | Current | Change % | Status |", "|---|---|---|---|---|"]
        lines += [f"| {r['metric']} | {r['baseline']:.4f} | {r['current']:.4f} | {r['change_percent']:+.1f} | {r['status']} |" for r in compared.orderBy("metric").collect()]
    return "\n".join(lines) + "\n"


def to_json(metrics: DataFrame) -> str:
    """A baseline that from_json reads again."""
    return json.dumps({r["metric"]: {"kind": r["kind"], "value": r["value"]} for r in metrics.orderBy("metric").collect()}, indent=1)


def from_json(spark: SparkSession, text: str) -> DataFrame:
    rows = [(m, v["kind"], float(v["value"])) for m, v in json.loads(text).items()]
    return spark.createDataFrame(rows, "metric string, kind string, value double")
