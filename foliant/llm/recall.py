"""Recall of problem 3 against brute force: python -m foliant.llm.recall FOLDER [QUERIES]. Prints, per model and in all, the share of
the 5 nearest that is found from the trees alone, after the descent, and by greedy search, for QUERIES rows of each model."""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm import neighbours
from foliant.llm.vector_queries import usable_vectors
from foliant.session import local_session


def shares(found: dict[int, set[int]], vectors: dict[str, tuple[np.ndarray, np.ndarray]], asked: dict[str, np.ndarray], k: int = 5) -> dict[str, float]:
    """Per model the share of the k nearest of the asked rows that is found; an other one that is as near counts too."""
    out = {}
    for model, (ids, x) in vectors.items():
        place, hits = {i: j for j, i in enumerate(ids)}, 0
        for a in range(0, len(asked[model]), 500):
            rows = asked[model][a : a + 500]
            s = x[rows] @ x.T
            s[np.arange(len(rows)), rows] = -2
            least = -np.sort(-s, axis=1)[:, k - 1]
            hits += sum(min(k, sum(s[r, place[o]] >= least[r] - 1e-6 for o in found.get(int(ids[i]), ()))) for r, i in enumerate(rows))
        out[model] = hits / max(1, k * len(asked[model]))
    return out


def main(folder: str, queries: int) -> None:
    spark = local_session(8, memory="12g")
    graph = neighbours.build(usable_vectors(spark, folder), keep_start=True)
    everyone = neighbours.members(graph)
    table = everyone.toPandas()  # brute force needs all; this is a measurement on one machine
    vectors = {m: (d["id"].to_numpy(), np.stack([np.frombuffer(v, dtype=np.float32) for v in d["vec"]])) for m, d in table.groupby("model")}
    rng = np.random.default_rng(0)
    asked = {m: rng.choice(len(ids), min(queries, len(ids)), replace=False) for m, (ids, _) in vectors.items()}

    def sets(df: DataFrame, key: str, other: str) -> dict[int, set[int]]:
        got: dict[int, set[int]] = {}
        for a, b in df.select(key, other).toLocalIterator():
            got.setdefault(a, set()).add(b)
        return got

    begun = graph.start.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(F.desc("s"), "u"))).filter("r <= 9").drop("r")
    trees = neighbours.nearest(neighbours.Graph(begun, graph.vertices, graph.copies, graph.k, 0))
    wanted = spark.createDataFrame([(int(i),) for m, (ids, _) in vectors.items() for i in ids[asked[m]]], "q long")
    search = neighbours.search(graph, everyone.withColumnRenamed("id", "q").join(wanted, "q"), 6).filter("q <> id").withColumn("p", F.row_number().over(W.partitionBy("q").orderBy("rank"))).filter("p <= 5")
    print(f"edges changed in each round: {graph.moved}")
    for name, found in (("trees", sets(trees, "id", "other")), ("descent", sets(neighbours.nearest(graph), "id", "other")), ("search", sets(search, "q", "id"))):
        got = shares(found, vectors, asked)
        whole = sum(got[m] * len(ids) for m, (ids, _) in vectors.items()) / max(1, len(table))
        print(name, {m: round(x, 3) for m, x in got.items()}, "all", round(whole, 3), flush=True)


if __name__ == "__main__":
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 500)
