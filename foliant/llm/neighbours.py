"""Problem 3: the k most similar vectors of every vector, by NN-descent; queries by greedy search of the graph.

Vectors are routed to blocks of up to `block_rows`, which a task can hold, by random-projection trees that grow until no block is
larger: their upper levels are fitted on the driver to bounded samples (`sample_rows` a turn), turn by turn for the blocks
that are still too large, so no level is fitted to fewer than `node_rows` rows and nothing is cut by hash. Within a block a task
grows a forest of its own to leaves of `leaf_rows` and compares all pairs of each leaf. A model that fits one block gets
all its `trees` there; a larger one is routed by three trees, so that what one parts another may bring together, and gets a
third of them in each block.

NN-descent then improves the lists by iterated joins: every vertex is the centre of its neighbours and of (up to
`reverse`) vertices that have it as neighbour; all pairs among those of which one is new are tried, and a pair is sent on only if
it beats the worst neighbour that one of its ends has. Lists travel as ids; centres are grouped by their block, and each
vector is fetched once for a block and not once for a centre. It ends when less than `settled` of all edges change; there is
no other limit. Vectors travel in full precision: in a tight crowd the similarities of all pairs differ by less than a
coarser form would keep.

Copies: vectors that are equal after scaling are one vertex, so a crowd of copies costs nothing; they come out as
neighbours of each other at similarity 1 (nearest by id first), in front of the neighbours of the vertex, whose own copies
count by id too. Rows of one id and copies are found by two 64-bit hashes of the vector, so that only hashes are shuffled for that.

Skew: blocks are bounded by construction, and the lists of one vertex before any shuffle by vertex. Each round is written to
the shared folder, and what it replaces is removed.

Defined cases: vectors that are null, of another length than their model's, all zero or not finite take no part; models
without a dimension take no part; null ids take no part; of rows with one id the one with the greatest (order) counts;
fewer than k others give fewer neighbours; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.session import bounded, cut

EDGE = "v long, u long, s float"
PLACED = "block int, id long, vec binary"


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype=kind)
    width = len(column[0].as_py())
    return np.frombuffer(column.buffers()[-1], dtype=np.uint8)[column.offset * width :][: n * width].view(kind).reshape(n, -1)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All of a task's rows; tasks are kept small by the number of partitions."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _best(v: np.ndarray, u: np.ndarray, s: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best distinct edges of each v; of equal edges an old one stays."""
    order = np.lexsort((new, u, v))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (v[order][1:] != v[order][:-1]) | (u[order][1:] != u[order][:-1])
    order = order[keep]
    order = order[np.lexsort((u[order], -s[order], v[order]))]
    starts = np.flatnonzero(np.r_[True, v[order][1:] != v[order][:-1]]) if len(order) else np.zeros(0, dtype=int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def _bytes(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values, without a copy a row."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    width = x.shape[1] * 4 if x.ndim == 2 else 0
    if not len(x) or len(x) * width >= 1 << 31:
        return pa.array([r.tobytes() for r in x], pa.binary())
    offsets = np.arange(len(x) + 1, dtype=np.int64) * width
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def usable(df: DataFrame, dimensions: dict[str, int], key: str, model: str, vector: str, order: str | None = None) -> DataFrame:
    """(id, model, vec, o): unit vectors as float32 bytes, of every usable row. dimensions: a small fixed table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            length = batch.column(2)
            length = pa.compute.fill_null(pa.compute.list_value_length(length), -1).to_numpy(zero_copy_only=False)
            present = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for name in dict.fromkeys(n for n in names if n in dimensions):
                d = dimensions[name]
                good = np.flatnonzero((names == name) & present & (length == d)) if d > 0 else np.zeros(0, dtype=int)
                if not len(good):
                    continue
                x = batch.column(2).take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(good), d)
                peak = np.abs(x).max(axis=1)
                ok = np.isfinite(x).all(axis=1) & (peak > 0)
                x, good = x[ok] / peak[ok][:, None], pa.array(good[ok])
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = x.astype(np.float32) + np.float32(0)  # -0 and 0 are one number
                yield pa.RecordBatch.from_arrays([batch.column(0).take(good), batch.column(1).take(good), _bytes(x), batch.column(3).take(good)], names=["id", "model", "vec", "o"])

    rows = df.select(F.col(key).cast("long").alias("id"), model, F.col(vector).cast("array<float>"), (F.col(order) if order else F.lit(0)).cast("long").alias("o"))
    return rows.mapInArrow(run, "id long, model string, vec binary, o long")


class Blocks:
    """One random-projection tree of a model's vectors: inner nodes with hyperplanes, leaves with the numbers of blocks."""

    def __init__(self, first: int):
        self.normals: list[np.ndarray] = [np.zeros(1, dtype=np.float32)]
        self.offsets, self.right, self.block = [0.0], [-1], [first]  # the left child stands before the right one

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, active = np.zeros(len(x), dtype=int), np.arange(len(x))
        right = np.array(self.right)
        while True:
            active = active[right[at[active]] >= 0]
            if not len(active):
                return at
            for node in np.unique(at[active]):
                mine = active[at[active] == node]
                at[mine] = right[node] - 1 + (x[mine] @ self.normals[node] > self.offsets[node])

    def blocks(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.block)[self.place(x)]

    def divide(self, node: int, x: np.ndarray, parts: float, node_rows: int, rng: np.random.Generator, number: Callable[[], int]) -> None:
        """Grow below a leaf until it has `parts` leaves, as far as the sample x of its rows goes."""
        work = [(node, x, parts)]
        while work:
            node, x, parts = work.pop()
            if parts <= 1 or len(x) < node_rows:
                continue
            normal = _direction(x, rng)
            p = x @ normal
            middle = float(np.median(p))
            if not (p > middle).any():
                continue  # nothing to tell the rows apart by
            self.normals[node], self.offsets[node], self.right[node] = normal, middle, len(self.block) + 1
            for side in (p <= middle, p > middle):
                self.normals.append(np.zeros(1, dtype=np.float32)), self.offsets.append(0.0), self.right.append(-1), self.block.append(number())
                work.append((len(self.block) - 1, x[side], parts / 2))


def _direction(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A random mixture of the widest directions of the rows."""
    x = x[rng.choice(len(x), 1024, replace=False)] if len(x) > 1024 else x
    x = (x - x.mean(axis=0)).astype(np.float64)
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, -8:]
    return (axes @ rng.standard_normal(axes.shape[1])).astype(np.float32)


def _leaves(x: np.ndarray, leaf_rows: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Row numbers of the leaves of a tree grown on x."""
    out, work = [], [np.arange(len(x))]
    while work:
        rows = work.pop()
        if len(rows) > leaf_rows:
            p = x[rows] @ _direction(x[rows], rng)
            right = p > np.median(p)
            if right.any():
                work += [rows[~right], rows[right]]
                continue
            half = np.argsort(p, kind="stable")  # all on one side: equal along this direction
            work += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
            continue
        out.append(rows)
    return out


@dataclass
class Graph:
    """edges (v, u, s): the k + spare best known neighbours of each vertex; vertices (id, model, vec): one
    of each class of copies; copies (id, rep): members of classes with more than one; placed: (id, model, vec) to
    (block, id, vec) of every tree, for entry points, None without vertices; moved: edges changed in each round."""

    edges: DataFrame
    vertices: DataFrame
    copies: DataFrame
    k: int
    rounds: int
    moved: list[int] = field(default_factory=list)
    placed: Callable[[DataFrame], DataFrame] | None = None
    start: DataFrame | None = None


def _fetched(lists: DataFrame, member: str, vertices: DataFrame) -> DataFrame:
    """(at, id, vec) of the members that the lists (block, ..., member) name, each once for a block."""
    need = lists.select("block", F.col(member).alias("id")).distinct()
    return need.join(vertices.select("id", "vec"), "id").select(F.col("block").alias("at"), "id", "vec")


def build(
    vectors: DataFrame, k: int = 5, width: int = 14, trees: int = 18, leaf_rows: int = 1024, reverse: int = 10, block_rows: int = 32_768,
    sample_rows: int = 50_000, node_rows: int = 32, settled: float = 0.01, seed: int = 7, keep_start: bool = False,
) -> Graph:
    """vectors: what usable() gives. width: neighbours kept while descending, at least k + 4. keep_start: hand out the edges as
    they were before the descent too, to measure what it adds."""
    spark = vectors.sparkSession
    hashed = vectors.select("id", "model", "o", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(seed), "vec").alias("h2"))
    last = hashed.groupBy("id").agg(F.max(F.struct("o", "model", "h1", "h2")).alias("r")).select("id", "r.model", "r.h1", "r.h2")
    last = cut(last)
    classes = last.groupBy("model", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    classes = cut(classes)
    copies = last.join(classes.filter("n > 1"), ["model", "h1", "h2"]).select("id", "rep")
    own = classes.select(F.col("rep").alias("id"), "h1", "h2", F.col("model").alias("m"))
    count = {r[0]: r[1] for r in classes.groupBy("model").count().collect()}  # one row per model
    total = sum(count.values())
    mine = vectors.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(seed), "vec")).withColumnRenamed("model", "m")
    # a row given twice is one vertex; the planner broadcasts the hashes if they are few
    vertices = cut(mine.join(own, ["id", "h1", "h2", "m"]).groupBy("id").agg(F.first("m").alias("model"), F.first("vec").alias("vec")))
    if not total:
        return Graph(spark.createDataFrame([], EDGE), vertices, copies, k, 0)

    rng = np.random.default_rng(seed)
    numbers = iter(range(1 << 31))
    number = lambda: next(numbers)
    forest = {m: [Blocks(number()) for _ in range(3 if n > block_rows else 1)] for m, n in count.items()}

    def route(handed, only: frozenset[int] | None = None, share: float = 1.0) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pick = np.random.default_rng(seed)
            for batch in batches:
                models = np.array(batch.column("model").to_pylist(), dtype=object)
                for m in dict.fromkeys(x for x in models if x in handed.value):
                    rows = np.flatnonzero(models == m)
                    x = _matrix(batch.column("vec").take(pa.array(rows)), np.float32)
                    for tree in handed.value[m]:
                        block = tree.blocks(x)
                        at = np.arange(len(rows)) if only is None else np.flatnonzero(np.isin(block, list(only)) & (pick.random(len(rows)) < share))
                        take = pa.array(rows[at])
                        yield pa.RecordBatch.from_arrays([pa.array(block[at], pa.int32()), batch.column("id").take(take), batch.column("vec").take(take)], names=["block", "id", "vec"])

        return run

    sizes = {tree.block[0]: count[m] for m, own_trees in forest.items() for tree in own_trees}
    stuck: set[int] = set()
    while large := sorted((n, b) for b, n in sizes.items() if n > 1.3 * block_rows and b not in stuck)[-max(1, sample_rows // (2 * node_rows)) :]:
        wanted = frozenset(b for _, b in large)
        handed = spark.sparkContext.broadcast(forest)  # some `block_rows` rows for each of its nodes
        sample = vertices.mapInArrow(route(handed, wanted, sample_rows / sum(n for n, _ in large)), PLACED).limit(2 * sample_rows).collect()  # a bounded sample
        rows: dict[int, list[bytes]] = {}
        for r in sample:
            rows.setdefault(r["block"], []).append(r["vec"])
        before = dict(sizes)
        for own_trees in forest.values():
            for tree in own_trees:
                for leaf in [i for i, b in enumerate(tree.block) if tree.right[i] < 0 and b in wanted]:
                    x = np.stack([np.frombuffer(v, dtype=np.float32) for v in rows.get(tree.block[leaf], [])]) if tree.block[leaf] in rows else np.zeros((0, 1), dtype=np.float32)
                    tree.divide(leaf, x, 2 ** np.ceil(np.log2(sizes[tree.block[leaf]] / block_rows)), node_rows, rng, number)
        handed = spark.sparkContext.broadcast(forest)
        sizes = {r[0]: r[1] for r in vertices.mapInArrow(route(handed), PLACED).groupBy("block").count().collect()}  # one row a block
        stuck |= {b for b in wanted if sizes.get(b) == before[b] and len(rows.get(b, ())) >= node_rows}
    handed = spark.sparkContext.broadcast(forest)
    placed = lambda df: df.select("id", "model", "vec").mapInArrow(route(handed), PLACED)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * (width + reverse) // 300_000))
    local_trees = {n: max(1, trees // n) for n in (1, 3)}

    def grow(table: pa.Table) -> pa.Table:
        """The lists of a block's rows by the forest grown in it."""
        x, ids = _matrix(table.column("vec"), np.float32), table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        n, block = len(ids), table.column("block")[0].as_py()
        alone = next(len(own_trees) for own_trees in handed.value.values() if any(block in tree.block for tree in own_trees))
        us, ss = np.full((n, width), -1, dtype=np.int32), np.full((n, width), -2, dtype=np.float32)
        own_rng = np.random.default_rng((seed, block))
        for _ in range(local_trees[alone] if n > leaf_rows else 1):
            for rows in _leaves(x, leaf_rows, own_rng):
                keep = min(width, len(rows) - 1)
                for a in range(0, len(rows) if keep > 0 else 0, 2048):
                    some = rows[a : a + 2048]
                    sims = x[some] @ x[rows].T
                    sims[np.arange(len(some)), a + np.arange(len(some))] = -3
                    top = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
                    u, s = np.concatenate([us[some], rows[top]], axis=1), np.concatenate([ss[some], np.take_along_axis(sims, top, 1)], axis=1)
                    by_id = np.argsort(u, axis=1, kind="stable")
                    u, s = np.take_along_axis(u, by_id, 1), np.take_along_axis(s, by_id, 1)
                    s[:, 1:][u[:, 1:] == u[:, :-1]] = -2
                    best = np.argpartition(-s, width - 1, axis=1)[:, :width]
                    us[some], ss[some] = np.take_along_axis(u, best, 1), np.take_along_axis(s, best, 1)
        v, place = np.nonzero(ss > -2)
        return pa.table({"v": ids[v], "u": ids[us[v, place]], "s": pa.array(ss[v, place], pa.float32())})

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole(batches)
        if table is not None:
            v, u, s, new = (table.column(c).to_numpy() for c in ("v", "u", "s", "new"))
            at = _best(v, u, s, new, width)
            yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(u[at]), pa.array(s[at]), pa.array(new[at])], names=["v", "u", "s", "new"])

    state = EDGE + ", new int"
    first = placed(vertices).groupBy("block").applyInArrow(grow, EDGE).withColumn("new", F.lit(1))
    edges = cut(first.repartition(parts, "v").mapInArrow(trim, state))
    start = edges.select("v", "u", "s") if keep_start else None
    top_tree = {m: own_trees[:1] for m, own_trees in forest.items()}
    homes = cut(vertices.mapInArrow(route(spark.sparkContext.broadcast(top_tree)), PLACED).select("id", "block"))

    def local_join(lists: pa.Table, members: pa.Table) -> pa.Table:
        """Pairs around the centres of one block that beat the worst neighbour of one end."""
        c, m, new, worst = (lists.column(n).to_numpy() for n in ("c", "m", "new", "worst"))
        ids, h = members.column("id").to_numpy(), _matrix(members.column("vec"), np.float32)
        by_id = np.argsort(ids)
        order = np.lexsort((-new, m, c))
        order = order[np.r_[True, (c[order][1:] != c[order][:-1]) | (m[order][1:] != m[order][:-1])]] if len(order) else order
        c, m, new, worst = c[order], m[order], new[order], worst[order]
        row = by_id[np.searchsorted(ids, m, sorter=by_id)] if len(ids) else np.zeros(0, dtype=int)
        starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, dtype=int)
        size = np.diff(np.r_[starts, len(c)])
        lanes = np.arange(int(size.max(initial=0)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(starts), 1000):
            begin, valid = starts[a : a + 1000], lanes < size[a : a + 1000, None]
            at = np.minimum(begin[:, None] + lanes, len(c) - 1)
            x = h[row[at]]
            sims = np.matmul(x, x.transpose(0, 2, 1))
            fresh = (new[at] > 0) & valid
            pair = valid[:, :, None] & valid[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (sims > worst[at][:, :, None])
            pair[:, lanes, lanes] = False
            b, i, j = np.nonzero(pair)
            found.append((m[at[b, i]], m[at[b, j]], sims[b, i, j]))
            if len(found) > 30:
                found = [_few(found, width)]
        v, u, s = _few(found, width)
        return pa.table({"v": pa.array(v, pa.int64()), "u": pa.array(u, pa.int64()), "s": pa.array(s, pa.float32())})

    moved: list[int] = []
    while True:
        worst = edges.groupBy("v").agg(F.when(F.count("*") >= width, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("worst")).select(F.col("v").alias("m"), "worst")
        back = edges.select(F.col("u").alias("c"), F.col("v").alias("m"), "new")
        lot = F.row_number().over(W.partitionBy("c").orderBy(F.desc("new"), F.xxhash64("m", "c", F.lit(len(moved)))))
        back = back.withColumn("lot", lot).filter(F.col("lot") <= reverse).drop("lot")
        around = edges.select(F.col("v").alias("c"), F.col("u").alias("m"), "new").unionByName(back)
        fresh = around.filter("new = 1").select("c").distinct()  # where nothing is new there is nothing to try
        around = around.join(fresh, "c", "left_semi").join(homes.withColumnRenamed("id", "c"), "c").join(worst, "m", "left").select("block", "c", "m", "new", F.coalesce("worst", F.lit(-2.0)).cast("float").alias("worst"))
        around = cut(around)
        met = around.groupBy("block").cogroup(_fetched(around, "m", vertices).groupBy("at")).applyInArrow(local_join, EDGE)
        merged = edges.withColumn("new", F.lit(0)).unionByName(met.withColumn("new", F.lit(1)))
        edges = cut(merged.repartition(parts, "v").mapInArrow(trim, state), None if start is not None and not moved else edges)
        moved.append(edges.filter("new > 0").count())
        if moved[-1] <= settled * total * width:
            break

    best = edges.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy(F.desc("s"), "u"))).filter(F.col("r") <= k + 4)
    return Graph(cut(best.select("v", "u", "s")), vertices, copies, k, len(moved), moved, placed, start)


def _few(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `width` best edges of each vertex among those found so far."""
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    v, u, s = (np.concatenate(x) for x in zip(*found))
    at = _best(v, u, s, np.zeros(len(v), dtype=np.int8), width)
    return v[at], u[at], s[at].astype(np.float32)


def nearest(graph: Graph) -> DataFrame:
    """(id, other, s, rank): the k most similar of every vector, copies told apart."""
    k = graph.k
    within = W.partitionBy("rep").orderBy("id")
    ranked = graph.copies.withColumn("at", F.row_number().over(within))
    heads = ranked.filter(F.col("at") <= k + 1)  # enough for any member to find k others
    # each vertex's neighbours, each standing for its first k copies
    stand = heads.filter(F.col("at") <= k).select(F.col("rep").alias("u"), F.col("id").alias("o"))
    to = graph.edges.join(stand, "u", "left").select("v", F.coalesce("o", "u").alias("other"), "s")
    best = W.partitionBy("v").orderBy(F.desc("s"), "other")
    to = to.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")
    # every member of a class has the class's neighbours, behind its own copies; inner, so that a hot class can be split
    own = graph.copies.select(F.col("rep").alias("v"), "id")
    alone = to.join(own.select("v").distinct(), "v", "left_anti").select(F.col("v").alias("id"), "other", "s")
    mine = own.join(to, "v").select("id", "other", "s").unionByName(alone)
    twins = ranked.select("id", "rep").join(heads.select("rep", F.col("id").alias("other")), "rep").filter("id <> other").select("id", "other", F.lit(1.0).cast("float").alias("s"))
    order = W.partitionBy("id").orderBy(F.desc("s"), "other")
    return mine.unionByName(twins).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def members(graph: Graph) -> DataFrame:
    """(id, model, vec) of every row of the graph, copies included."""
    others = graph.copies.filter("id <> rep").join(graph.vertices.withColumnRenamed("id", "rep"), "rep")
    return graph.vertices.select("id", "model", "vec").unionByName(others.select("id", "model", "vec"))


def search(graph: Graph, queries: DataFrame, k: int = 5, beam: int = 16, leaf_rows: int = 512) -> DataFrame:
    """(q, id, s, rank): greedy search of the graph for query vectors (q, model, vec), all queries in step. A query falls into
    one block of every tree of its model and there into one leaf of a tree grown for it, and starts at the `beam` best vertices of
    that leaf and, in case its blocks are empty, at `beam` vertices that all queries of the model share; each step scores the unvisited
    neighbours, in both directions, of its beam's unexpanded vertices, and a query ends when its beam has none left; there is no
    other limit. Equal queries are searched once, and every vertex found stands for its first k copies."""
    v = graph.vertices
    if graph.placed is None:
        return v.sparkSession.createDataFrame([], "q long, id long, s float, rank int")
    everyone = cut(queries.filter("model is not null").select("q", "model", F.col("vec").alias("a")))
    queries = cut(everyone.groupBy("model", "a").agg(F.min("q").alias("q")))
    equal = everyone.join(queries.withColumnRenamed("q", "head"), ["model", "a"]).select("q", "head")
    places = cut(graph.placed(queries.select(F.col("q").alias("id"), "model", F.col("a").alias("vec"))))
    asked = bounded(queries.select("q", "a"))  # a query set of proven size goes to every task, so that only ids cross the network; a larger one is joined

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = np.zeros(batch.num_rows, dtype=np.float32)
                widths = pa.compute.binary_length(batch.column("a")).to_numpy(zero_copy_only=False)
                for w in np.unique(widths):  # models differ in length
                    mine = np.flatnonzero(widths == w)
                    a, b = (_matrix(batch.column(c).take(pa.array(mine)), np.float32) for c in ("a", "b"))
                    s[mine] = np.einsum("ij,ij->i", a, b)
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("u"), pa.array(s)], names=["q", "u", "s"])

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.join(v.select(F.col("id").alias("u"), F.col("vec").alias("b")), "u").join(asked, "q")
        return full.select("q", "u", "a", "b").mapInArrow(dot, "q long, u long, s float").withColumn("done", F.lit(0))

    links = graph.edges.select("v", "u")
    links = cut(links.unionByName(links.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct())
    top = W.partitionBy("q").orderBy(F.desc("s"), "u")

    def enter(table: pa.Table) -> pa.Table:
        asks = table.column("query").to_numpy(zero_copy_only=False)
        x, ids = _matrix(table.column("vec"), np.float32), table.column("id").to_numpy()
        held, qs, us = np.flatnonzero(~asks), [], []
        rng = np.random.default_rng(table.column("block")[0].as_py())
        work = [(held[np.argsort(ids[held])], np.flatnonzero(asks))] if len(held) else []
        while work:
            mine, asking = work.pop()
            if not len(asking):
                continue
            if len(mine) > leaf_rows:
                normal = _direction(x[mine], rng)
                p = x[mine] @ normal
                middle = np.median(p)
                if (p > middle).any():
                    side = x[asking] @ normal > middle
                    work += [(mine[p <= middle], asking[~side]), (mine[p > middle], asking[side])]
                    continue
            keep = min(beam, len(mine))
            for i in range(0, len(asking), 1024):
                near = np.argpartition(-(x[asking[i : i + 1024]] @ x[mine].T), keep - 1, axis=1)[:, :keep]
                qs.append(np.repeat(ids[asking[i : i + 1024]], keep)), us.append(ids[mine[near]].ravel())
        cat = lambda z: pa.array(np.concatenate(z) if z else np.zeros(0, dtype=np.int64), pa.int64())
        return pa.table({"q": cat(qs), "u": cat(us)})

    held = graph.placed(v).join(bounded(cut(places.select("block").distinct())), "block", "left_semi").withColumn("query", F.lit(False))  # blocks without queries stay where they are
    near = held.unionByName(places.withColumn("query", F.lit(True))).groupBy("block").applyInArrow(enter, "q long, u long")
    hashed = F.row_number().over(W.partitionBy("model").orderBy(F.xxhash64("id")))
    shared = v.select("id", "model").withColumn("h", hashed).filter(F.col("h") <= beam).select("model", F.col("id").alias("u"))
    seen = cut(scored(near.unionByName(queries.join(shared, "model").select("q", "u")).distinct()))
    while True:
        held = seen.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= beam)
        front = held.filter("done = 0").select("q", F.col("u").alias("v"))
        reach = front.join(links, "v").select("q", "u").distinct().join(seen.select("q", "u"), ["q", "u"], "left_anti")
        grown = cut(held.select("q", "u", "s", F.lit(1).alias("done")).unionByName(scored(reach)), seen)
        seen = grown
        if grown.filter("done = 0").isEmpty():
            break
    best = seen.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k).drop("r")
    first = graph.copies.withColumn("at", F.row_number().over(W.partitionBy("rep").orderBy("id"))).filter(F.col("at") <= k)
    told = best.join(first.select(F.col("rep").alias("u"), F.col("id").alias("o")), "u", "left").select(F.col("q").alias("head"), F.coalesce("o", "u").alias("id"), "s")
    rank = F.row_number().over(W.partitionBy("head").orderBy(F.desc("s"), "id"))
    return equal.join(told.withColumn("rank", rank).filter(F.col("rank") <= k), "head").select("q", "id", "s", "rank")
