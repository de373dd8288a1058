import numpy as np
import pytest

from foliant.llm import neighbours as nb

SCHEMA = "vec_id long, model string, embedding array<float>, at long, u string, s string"


def frame(spark, rows):
    return spark.createDataFrame([(i, m, None if v is None else [float(x) for x in v], 0, "x", "y") for i, m, v in rows], SCHEMA)


def usable(spark, rows, dims=None):
    return nb.usable(frame(spark, rows), dims or {"m": 16}, "vec_id", "model", "embedding", "at")


def brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {ids[i]: [ids[j] for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def clustered(n, d=16, seed=0, spread=0.25):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, d))
    return centres[r.integers(0, 12, n)] + spread * r.standard_normal((n, d))


def test_small_collections_are_exact(spark):
    x = clustered(120)
    g = nb.build(usable(spark, [(i, "m", v) for i, v in enumerate(x)]))
    got = {}
    for r in nb.nearest(g).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other)
    want = brute(np.arange(120), x, 5)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.995 * 600 and all(len(v) == 5 for v in got.values())


def test_descent_and_search_reach_the_recall(spark):
    """Leaves far smaller than the collection, so that trees alone do not suffice; a third of it is one tight crowd."""
    x = np.vstack([clustered(1400, seed=1), np.random.default_rng(2).standard_normal(16) + 0.02 * np.random.default_rng(3).standard_normal((700, 16))])
    g = nb.build(usable(spark, [(i, "m", v) for i, v in enumerate(x)]), trees=2, leaf_rows=60, block_rows=400, keep_start=True)
    want = brute(np.arange(len(x)), x, 5)
    begun = {}
    for r in g.start.collect():
        begun.setdefault(r.v, []).append((-r.s, r.u))
    assert g.placed(g.vertices).groupBy("block").count().count() > 6 and sum(u in want[v] for v, us in begun.items() for _, u in sorted(us)[:5]) < 0.8 * 5 * len(x)  # the descent finds the rest
    near = nb.nearest(g).collect()
    hits = sum(r.other in want[r.id] for r in near)
    assert g.rounds > 1 and g.moved[0] > g.moved[-1] and hits >= 0.9 * 5 * len(x)
    q = g.vertices.filter("id % 20 = 0").withColumnRenamed("id", "q")
    found = nb.search(g, q, 6).filter("q <> id").collect()
    queries = [i for i in want if i % 20 == 0]
    assert sum(r.id in want[r.q] for r in found) >= 0.9 * 5 * len(queries)


def test_copies_are_neighbours_of_each_other(spark):
    x = clustered(60, seed=4)
    rows = [(i, "m", v) for i, v in enumerate(x)] + [(100 + i, "m", x[0] * 4) for i in range(9)] + [(200, "m", x[1])]
    got = {}
    for r in nb.nearest(nb.build(usable(spark, rows))).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.other, round(r.s, 4)))
    assert got[0] == [(100 + i, 1.0) for i in range(5)] and got[108] == [(0, 1.0)] + [(100 + i, 1.0) for i in range(4)] and got[1][0] == (200, 1.0) and got[200][0] == (1, 1.0)


def test_search_answers_copies_and_finds_them(spark):
    x = clustered(60, seed=4)
    rows = [(i, "m", v) for i, v in enumerate(x)] + [(100 + i, "m", x[0] * 4) for i in range(9)] + [(200, "m", x[1])]
    g = nb.build(usable(spark, rows))
    queries = nb.members(g).withColumnRenamed("id", "q")
    assert sorted(r.q for r in queries.collect()) == sorted(i for i, _, _ in rows)
    got = {}
    for r in nb.search(g, queries, 6).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append(r.id)
    assert got[0] == got[108] == [0] + [100 + i for i in range(5)] and got[200][:2] == [1, 200] and set(got) == {i for i, _, _ in rows}


def test_search_reaches_every_island(spark):
    """Two hundred groups far apart, each without an edge to another: more than any fixed set of entries would cover."""
    r = np.random.default_rng(8)
    x = np.repeat(r.standard_normal((200, 16)), 12, axis=0) + 0.01 * r.standard_normal((2400, 16))
    g = nb.build(usable(spark, [(i, "m", v) for i, v in enumerate(x)]), trees=4, leaf_rows=60)
    want = brute(np.arange(2400), x, 5)
    found = nb.search(g, nb.members(g).filter("id % 8 = 0").withColumnRenamed("id", "q"), 6).filter("q <> id").collect()
    assert sum(r.id in want[r.q] for r in found) >= 0.98 * 5 * 300


def test_search_walks_as_far_as_it_must(spark):
    """A chain of which no leaf gives an entry near the query."""
    n = 60
    at = np.arange(n) * np.pi / 2 / n
    x = np.zeros((n, 16), dtype=np.float32)
    x[:, 0], x[:, 1] = np.cos(at), np.sin(at)
    g = nb.build(usable(spark, [(i, "m", v) for i, v in enumerate(x)]))
    g.edges = spark.createDataFrame([(i, i + 1, float(x[i] @ x[i + 1])) for i in range(n - 1)], nb.EDGE)
    whole, vertices = g.placed, g.vertices
    g.placed = lambda df: whole(df).filter("false" if df is vertices else "true")
    # the hash picks two vertices for all; the walk from them to the end that is farther off takes more than eight steps
    picked = [r.id for r in vertices.selectExpr("id", "xxhash64(id) h").orderBy("h").limit(2).collect()]
    far = max((0, n - 1), key=lambda e: min(abs(e - p) for p in picked))
    assert min(abs(far - p) for p in picked) > 8
    found = nb.search(g, vertices.filter(f"id = {far}").withColumnRenamed("id", "q"), 1, beam=2).collect()
    assert [r.id for r in found] == [far]


def test_the_query_answers_every_row(spark, tmp_path):
    from foliant.llm import vector_queries

    x = clustered(30, seed=6)
    rows = [(i, "m", v) for i, v in enumerate(x)] + [(100 + i, "m", x[3]) for i in range(50)]
    frame(spark, rows).select("vec_id", "model", "embedding", "at").withColumnRenamed("at", "cached_at").write.parquet(f"{tmp_path}/embedding_cache.parquet")
    spark.createDataFrame([("m", 16)], "model string, dimension int").write.parquet(f"{tmp_path}/vector_meta.parquet")
    got = {}
    for r in vector_queries.p3_search(spark, str(tmp_path)).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbour_id)
    crowd = [3] + list(range(100, 150))
    assert set(got) == {0, 20, 100, 120, 140} and all(len(v) == 5 for v in got.values())
    assert all(got[q] == set([i for i in crowd if i != q][:5]) for q in (100, 120, 140))


def test_blocks_grow_until_none_is_too_large(spark):
    """Whatever the sample, blocks are bounded and every vertex lies in one block of each tree."""
    x = np.vstack([clustered(600, seed=9), np.repeat([[1.0] + [0.0] * 15], 300, axis=0) + 1e-5 * np.random.default_rng(1).standard_normal((300, 16))])
    for sample in (64, 2000):
        g = nb.build(usable(spark, [(i, "m", v) for i, v in enumerate(x)]), block_rows=50, leaf_rows=20, sample_rows=sample, node_rows=8)
        rows = g.placed(g.vertices).groupBy("block").count().collect()
        assert max(r["count"] for r in rows) <= 1.3 * 50 and sum(r["count"] for r in rows) == 3 * len(x)


def test_equal_rows_of_the_same_moment(spark):
    """Rows of one id that differ: one of them counts, the same for its vector and its class."""
    x = clustered(10, seed=3)
    rows = [(i, "m", v) for i, v in enumerate(x)] + [(0, "m", x[5]), (1, "m", x[1])]
    g = nb.build(usable(spark, rows))
    assert sorted(r.id for r in nb.members(g).collect()) == list(range(10))


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [1.0] * 15 + [0.5]
    rows = [(1, "m", good), (2, "m", [0.0] * 16), (3, "m", [nan] + [1.0] * 15), (4, "m", [inf] + [1.0] * 15), (5, "m", [1.0] * 8), (6, "m", None), (7, "other", good), (8, None, good), (None, "m", good), (9, "m", [1.0] * 16), (9, "m", [1.0] * 16), (10, "m", []), (11, "m", [1e-30] * 16)]
    v = usable(spark, rows)
    assert sorted(r.id for r in v.collect()) == [1, 9, 9, 11]
    near = sorted((r.id, r.other) for r in nb.nearest(nb.build(v)).collect())
    assert near == [(1, 9), (1, 11), (9, 1), (9, 11), (11, 1), (11, 9)]


def test_a_null_inside_a_vector(spark):
    df = spark.sql("select 1L as vec_id, 'm' as model, array(cast(null as float), 1f) as embedding, 0L as at union all select 2L, 'm', array(1f, 1f), 0L")
    assert [r.id for r in nb.usable(df, {"m": 2}, "vec_id", "model", "embedding", "at").collect()] == [2]


def test_models_apart_and_empty(spark):
    x = clustered(40, seed=5)
    rows = [(i, "m", v) for i, v in enumerate(x)] + [(1000 + i, "w", np.r_[v, v]) for i, v in enumerate(x)]
    got = nb.nearest(nb.build(usable(spark, rows, {"m": 16, "w": 32}))).collect()
    assert len(got) == 400 and all((r.id < 1000) == (r.other < 1000) for r in got)
    empty = usable(spark, [], {"m": 16})
    g = nb.build(empty)
    assert nb.nearest(g).count() == 0
    one = nb.build(usable(spark, [(1, "m", x[0])]))
    assert nb.nearest(one).count() == 0


@pytest.mark.parametrize("k", [1, 3])
def test_best_edges(k):
    v, u, s = np.array([1, 1, 1, 2, 1]), np.array([5, 5, 6, 7, 8]), np.array([0.5, 0.5, 0.9, 0.1, 0.9], dtype=np.float32)
    at = nb._best(v, u, s, np.array([1, 0, 1, 1, 1]), k)
    got = [(int(v[i]), int(u[i])) for i in at]
    assert got == ([(1, 6), (2, 7)] if k == 1 else [(1, 6), (1, 8), (1, 5), (2, 7)]) and 0 not in at
