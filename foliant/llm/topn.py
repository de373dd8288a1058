"""Problem 4: the N best items of every group, by descending score bands.

The score range of each group is cut into bands, about one per 4 N rows, so small groups have one band. A count of the
distinct items per (group, band), from the top, tells the boundary band in which a group fills up; the group is anti-joined
from every band below it, and what is left is ranked exactly with the tie rule.

Skew: a group with more than `hot_rows` rows, an absolute number that one task can hold, is hot, at every size of the table.
Hot groups are de-duplicated with map-side aggregation and never laid out by group. Their bands are cut at approximate quantiles,
which a heavy tail cannot defeat, and the bands down to the boundary are cut again until they hold `hot_rows` items or a
single score; each turn reads only what the turn before has left. All other groups lie in one task each, where items, bands and
anti-join share one shuffle. The list of hot groups is broadcast only if its size is proven; otherwise it is joined. The
final ranking keeps N rows per group on each side of its shuffle first.

Defined cases: rows with a null or NaN score do not count; a null in a group or item column is a value like others, other
than ''; repeated rows of an item count once, with the highest score; ties are broken by the item columns ascending, text
by code points, nulls first; empty tables give no rows; columns that are not named are left behind, so clashing names
cannot matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import bounded, cut


def _without_nulls(df: DataFrame, columns: Sequence[str]) -> tuple[Column, dict[str, Column]]:
    """A bit mask of the null columns, and the columns with their nulls filled: such keys join and partition as plain equality."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    mask = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)])
    fill = {c: F.coalesce(F.col(c), (F.lit("") if isinstance(kinds[c], T.StringType) else F.lit(0)).cast(kinds[c])) for c in columns}
    return mask.cast("int"), fill


def _hot_items(items: DataFrame, keys: Sequence[str], n: int, hot_rows: int, pieces: int = 64) -> DataFrame:
    """The distinct items of hot groups without those in bands below the boundary band."""
    quantiles = [i / pieces for i in range(1, pieces)]
    items = cut(items)
    while True:
        sizes = items.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_score").alias("_min"), F.max("_score").alias("_max"), F.percentile_approx("_score", quantiles, 1000).alias("_edges"))
        sizes = cut(sizes.filter((F.col("_n") > hot_rows) & (F.col("_max") > F.col("_min"))).select(*keys, "_edges"))
        # one array of edges a group; within the limit they go to every task
        edges = bounded(sizes.select(*keys, F.concat_ws(",", F.col("_edges").cast("array<string>")).alias("_text"))).select(*keys, F.split("_text", ",").cast("array<double>").alias("_edges"))
        banded = items.join(edges, list(keys)).select(*keys, F.size(F.filter("_edges", lambda e: e > F.col("_score"))).alias("_band"), "_edges")
        counts = banded.groupBy(*keys, "_band").agg(F.count("*").alias("_c"), F.first("_edges").alias("_edges"))
        down = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, 0)
        filled = counts.withColumn("_upto", F.sum("_c").over(down)).filter(F.col("_upto") >= n).groupBy(*keys).agg(F.min("_band").alias("_boundary"), F.first("_edges").alias("_edges"))
        # band b reaches down to the b-th edge from the top
        floors = filled.select(*keys, F.element_at(F.sort_array("_edges", False), F.col("_boundary") + 1).alias("_floor"))
        floors = cut(floors.filter(F.col("_floor").isNotNull()))
        if floors.isEmpty():
            return items
        floors = bounded(floors)
        before, on = items, [items[k] == floors[k] for k in keys] + [items["_score"] < floors["_floor"]]
        size = before.count()
        items = cut(before.join(floors, on, "left_anti"), before)
        if items.count() == size:
            return items


def top_n(df: DataFrame, group: Sequence[str], item: Sequence[str], score: str, n: int = 5, hot_rows: int = 20_000) -> DataFrame:
    """(group, item, score, rank): the n best items of each group. item: the columns that tell a group's items apart; they
    also break ties, in their order."""
    group, item = list(group), list(item)
    value = F.col(score).cast("double")
    rows = df.filter(value.isNotNull() & ~F.isnan(value))
    mask, fill = _without_nulls(df, group)
    keys = [f"_k{i}" for i in range(len(group))] + ["_nulls"]
    # adding 0.0 makes -0.0 and 0.0 the same score
    rows = rows.select(*[fill[c].alias(k) for c, k in zip(group, keys)], mask.alias("_nulls"), *item, (value + F.lit(0.0)).alias("_score"))

    groups = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_score").alias("_max"), F.min("_score").alias("_min"))
    hot = cut(groups.filter(F.col("_n") > hot_rows).select(*keys))
    some_hot = not hot.isEmpty()
    hot = bounded(hot) if some_hot else hot
    cold = rows.join(hot, keys, "left_anti") if some_hot else rows
    items = cold.repartition(*keys).groupBy(*keys, *item).agg(F.max("_score").alias("_score"))

    large = groups.filter((F.col("_n") > 4 * n) & (F.col("_n") <= hot_rows))
    width = (F.col("_max") - F.col("_min")) / F.ceil(F.col("_n") / (4 * n))
    band = F.when(F.col("_max") > F.col("_min"), F.floor((F.col("_max") - F.col("_score")) / width)).otherwise(0)
    items = items.join(large, keys, "left").select(*keys, *item, "_score", band.alias("_band"))
    counts = items.filter("_band is not null").groupBy(*keys, "_band").agg(F.count("*").alias("_c"))
    down = W.partitionBy(*keys).orderBy("_band").rowsBetween(W.unboundedPreceding, 0)
    filled = counts.withColumn("_upto", F.sum("_c").over(down))
    filled = filled.filter(F.col("_upto") >= n).groupBy(*keys).agg(F.min("_band").alias("_boundary"))
    on = [items[k] == filled[k] for k in keys] + [items["_band"] > filled["_boundary"]]
    left = items.join(filled, on, "left_anti").select(*keys, *item, "_score")
    if some_hot:
        warm = rows.join(hot, keys, "left_semi").groupBy(*keys, *item).agg(F.max("_score").alias("_score"))
        left = left.unionByName(_hot_items(warm, keys, n, hot_rows))

    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_score"), *[F.asc_nulls_first(c) for c in item]))
    best = left.withColumn("rank", rank).filter(F.col("rank") <= n)
    restored = [F.when(F.col("_nulls").bitwiseAND(F.lit(1 << i)) == 0, F.col(k)).alias(c) for i, (c, k) in enumerate(zip(group, keys))]
    return best.select(*restored, *item, F.col("_score").alias(score), "rank")
