"""Problem 5: one ranking from several differently scaled scores, by reciprocal rank fusion.

Items are ranked separately per score; an item's total is the sum of 1 / (constant + rank) over the scores that have it.
Only ranks enter, so no score dominates by its range. Equal scores share a rank (1 + the number of greater ones), and equal
totals share a position.

Layout: a scope (query) lies in one task, where one shuffle serves de-duplication, all rankings and the final order. Scopes
with more than `hot_rows` rows, an absolute number that one task can hold, take another way that never gathers a scope:
distinct scores are counted with map-side aggregation, laid out by range in partitions of about `hot_rows` values, ranked within
(scope, partition) and offset by the counts of the partitions above; the ranks are joined back by value. The list of hot
scopes is broadcast only if its size is proven; otherwise it is joined.

Defined cases: null and NaN scores give no rank; an item none of whose scores counts takes no part; of repeated items the
highest score of each kind counts; null scope or item columns are values of their own; empty tables give no rows; columns
that are not named are left behind.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.session import bounded, cut


def _usable(c: str) -> Column:
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


def gather(tables: dict[str, DataFrame], scope: Sequence[str], item: Sequence[str], score: str = "score") -> DataFrame:
    """Rows of all tables below each other, the score of table t in column t. Missing text keys are ''."""
    parts = []
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        keys = [F.coalesce(F.col(c), F.lit("")).alias(c) if kinds[c] == "string" else F.col(c) for c in [*scope, *item]]
        parts.append(df.select(*keys, *[(_usable(score) if t == name else F.lit(None).cast("double")).alias(t) for t in tables]))
    return reduce(DataFrame.unionByName, parts).filter(F.coalesce(*tables).isNotNull())


def rank_by_value(df: DataFrame, scope: Sequence[str], value: str, rank: str, parts: int) -> DataFrame:
    """df with the rank (1 + number of greater values) of each row within its scope, null for null values, without any
    task holding a scope. The ranks of distinct values are found in `parts` ranges of (scope, value) of about equal size, and
    joined back by value; AQE splits the join where one value is hot."""
    scope = list(scope)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*scope, value).agg(F.count("*").alias("_n"))
    # a range is a partition, and stays one as it is written: equal values lie together, and numbers fall as values rise
    banded = cut(counts.repartitionByRange(max(1, parts), *scope, F.desc(value)).withColumn("_band", F.spark_partition_id()))
    inside = W.partitionBy(*scope, "_band").orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(*scope).orderBy("_band").rowsBetween(W.unboundedPreceding, -1)
    offsets = banded.groupBy(*scope, "_band").agg(F.sum("_n").alias("_m")).withColumn("_above", F.coalesce(F.sum("_m").over(above), F.lit(0)))
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in scope], F.col("_band").alias("_ob"), "_above")
    ranks = banded.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ranks = ranks.join(offsets, [*[F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in scope], F.col("_band") == F.col("_ob")])
    ranks = ranks.select(*[F.col(c).alias(f"_r_{c}") for c in scope], F.col(value).alias("_rv"), (F.col("_above") + F.col("_in") + 1).cast("int").alias(rank))
    return df.join(ranks, [*[F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in scope], F.col(value) == F.col("_rv")], "left").drop("_rv", *[f"_r_{c}" for c in scope])


def _total(kinds: Sequence[str], constant: float) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.lit(1.0) / (F.lit(float(constant)) + F.col(f"{t}_rank")), F.lit(0.0)) for t in kinds])


def fuse(tables: dict[str, DataFrame], scope: Sequence[str], item: Sequence[str], score: str = "score", constant: float = 60, hot_rows: int = 200_000) -> DataFrame:
    """(scope, item, <table>_rank for each table, total, position)."""
    scope, item, kinds = list(scope), list(item), list(tables)
    rows = gather(tables, scope, item, score)
    hot = cut(rows.groupBy(*scope).count().filter(F.col("count") > hot_rows).select(*[F.col(c).alias(f"_h_{c}") for c in scope], "count"))
    is_hot = [F.col(c).eqNullSafe(F.col(f"_h_{c}")) for c in scope]
    best = [F.max(t).alias(t) for t in kinds]
    hot_total = hot.agg(F.sum("count")).first()[0] or 0
    hot = bounded(hot.drop("count")) if hot_total else None

    cold = (rows.join(hot, is_hot, "left_anti") if hot_total else rows).repartition(*scope).groupBy(*scope, *item).agg(*best)
    for t in kinds:  # rank() counts nulls last, so they disturb nothing before them
        cold = cold.withColumn(f"{t}_rank", F.when(F.col(t).isNotNull(), F.rank().over(W.partitionBy(*scope).orderBy(F.desc_nulls_last(t)))))
    cold = cold.withColumn("total", _total(kinds, constant))
    cold = cold.withColumn("position", F.rank().over(W.partitionBy(*scope).orderBy(F.desc("total"))))
    out = [*scope, *item, *[f"{t}_rank" for t in kinds], "total", "position"]
    if not hot_total:
        return cold.select(*out)

    parts = -(-hot_total // hot_rows)
    warm = cut(rows.join(hot, is_hot, "left_semi").groupBy(*scope, *item).agg(*best))
    for t in kinds:
        warm = rank_by_value(warm, scope, t, f"{t}_rank", parts)
    warm = rank_by_value(cut(warm.withColumn("total", _total(kinds, constant))), scope, "total", "position", parts)
    return cold.select(*out).unionByName(warm.select(*out))


def ndcg(ranking: DataFrame, relevance: DataFrame, scope: Sequence[str], item: Sequence[str], order: str, grade: str = "grade", k: int = 10) -> DataFrame:
    """(scope, ndcg) at k for judged scopes: graded gain 2^grade - 1, items not named count 0; of repeated judgements the
    highest grade counts."""
    scope, item = list(scope), list(item)
    text = {c for c, t in relevance.dtypes if t == "string"}
    judged = relevance.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in text else F.col(c) for c in [*scope, *item]], F.coalesce(F.col(grade), F.lit(0)).alias("_g"))
    judged = judged.groupBy(*scope, *item).agg(F.max("_g").alias("_g"))
    gain = (F.pow(F.lit(2.0), F.col("_g")) - 1) / F.log2(F.col("_p") + 1)
    ideal = judged.withColumn("_p", F.row_number().over(W.partitionBy(*scope).orderBy(F.desc("_g")))).filter(F.col("_p") <= k)
    ideal = ideal.groupBy(*scope).agg(F.sum(gain).alias("_ideal"))
    got = ranking.filter(F.col(order) <= k).join(judged, [*scope, *item])
    got = got.withColumn("_p", F.col(order)).groupBy(*scope).agg(F.sum(gain).alias("_got"))
    return ideal.join(got, scope, "left").select(*scope, F.when(F.col("_ideal") > 0, F.coalesce("_got", F.lit(0.0)) / F.col("_ideal")).otherwise(1.0).alias("ndcg"))
