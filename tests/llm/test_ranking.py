import random
from collections import defaultdict

import pytest
from oracle import connect, same

from foliant.llm import catalogue, fusion, topn

SCHEMA = "q long, p string, f string, l long, s double, rank string, count long"


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, con):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.SQL:
        same(df, con, catalogue.SQL[name])
    assert df.count() > 0 or name in ("p8_found",)


def brute(rows, n):
    best = defaultdict(dict)
    for q, p, f, l, s, *_ in rows:
        if s is not None and s == s:
            old = best[q, p].get((f, l))
            best[q, p][f, l] = s if old is None else max(old, s)
    out = set()
    for g, items in best.items():
        ordered = sorted(items.items(), key=lambda x: (-x[1], x[0][0] is not None, x[0][0] or "", x[0][1] is not None, x[0][1] or 0))
        out |= {(*g, *i, s, r + 1) for r, (i, s) in enumerate(ordered[:n])}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_top_n_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, None]), r.choice(["a", "b", "", None]), r.choice(["x", "y", "é", None]) or None, r.choice([1, 2, 3, None]), r.choice([None, float("nan"), 0.0, -0.0, 1.5, 2.5, r.random(), float("inf")]), "z", 1) for _ in range(400)]
    rows += [(9, "hot", f"f{i % 700}", i % 5, float(i % 13), "z", 1) for i in range(6000)] + [(9, "hot", "f1", 1, 12.5, "z", 1)] * 2000
    df = spark.createDataFrame(rows, SCHEMA)
    got = topn.top_n(df, ["q", "p"], ["f", "l"], "s", 5, hot_rows=500)
    assert {tuple(x) for x in got.collect()} == brute(rows, 5) and got.count() == len(brute(rows, 5))


def test_top_n_of_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topn.top_n(df, ["q", "p"], ["f", "l"], "s").count() == 0
    only_bad = spark.createDataFrame([(1, "a", "f", 1, None, "z", 1), (1, "a", "f", 1, float("nan"), "z", 1)], SCHEMA)
    assert topn.top_n(only_bad, ["q", "p"], ["f", "l"], "s").count() == 0


@pytest.mark.parametrize("score", [lambda i: float(i % 7), lambda i: 1.0, lambda i: 10.0 ** (i % 300), lambda i: float(i)])
def test_groups_are_hot_by_rows_and_not_by_share(spark, score, monkeypatch):
    """A group of a hundredth of all rows is split; equal scores, few scores, a heavy tail and many scores."""
    took = []
    real = topn._hot_items
    monkeypatch.setattr(topn, "_hot_items", lambda items, *a, **k: took.append(items) or real(items, *a, **k))
    rows = [(1, "hot", f"f{i}", i, score(i), "", 0) for i in range(400)] * 2 + [(i, "cold", f"f{i % 9}", i % 7, float(i % 11), "", 0) for i in range(40)] * 1000
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    assert {tuple(x) for x in topn.top_n(df, ["q", "p"], ["f", "l"], "s", 5, hot_rows=300).collect()} >= brute(rows[:800], 5) and len(took) == 1
    assert {tuple(x) for x in topn.top_n(df, ["q", "p"], ["f", "l"], "s", 5, hot_rows=2000).collect()} == brute(rows, 5) and len(took) == 1


def tables(spark, text, vector):
    s = "q long, p string, f string, score double, total string"
    return {"text": spark.createDataFrame([(*r, "clash") for r in text], s), "vector": spark.createDataFrame([(*r, "clash") for r in vector], s)}


def brute_fusion(text, vector, k=60):
    best = [defaultdict(lambda: defaultdict(lambda: None)) for _ in range(2)]
    for b, rows in zip(best, (text, vector)):
        for q, p, f, s in rows:
            if s is not None and s == s:
                key = (p or "", f or "")
                b[q][key] = s if b[q][key] is None else max(b[q][key], s)
    out = set()
    for q in set(best[0]) | set(best[1]):
        items = set(best[0][q]) | set(best[1][q])
        ranks = [{i: 1 + sum(o > v for o in b[q].values()) for i, v in b[q].items()} for b in best]
        total = {i: sum(1.0 / (k + r[i]) for r in ranks if i in r) for i in items}
        out |= {(q, *i, ranks[0].get(i), ranks[1].get(i), round(total[i], 12), 1 + sum(o > total[i] for o in total.values())) for i in items}
    return out


@pytest.mark.parametrize("hot_rows", [200_000, 20])
def test_fusion_against_brute_force(spark, hot_rows):
    """Once with every scope in one task, once with all scopes on the way of hot ones."""
    r = random.Random(1)
    value = lambda: r.choice([None, float("nan"), 1.0, 2.0, round(r.random(), 2)])
    text = [(r.choice([1, 2, 3]), r.choice(["a", None]), f"f{r.randrange(40)}", value()) for _ in range(500)]
    vector = [(r.choice([2, 3, 4]), "a", f"f{r.randrange(60)}", value()) for _ in range(400)]
    got = fusion.fuse(tables(spark, text, vector), ["q"], ["p", "f"], hot_rows=hot_rows)
    assert {(*x[:5], round(x.total, 12), x.position) for x in got.collect()} == brute_fusion(text, vector)


def test_scale_does_not_matter(spark):
    text = [(1, "a", f"f{i}", float(i)) for i in range(30)]
    vector = [(1, "a", f"f{i}", 0.5 + 0.001 * ((i * 7) % 30)) for i in range(30)]
    one = fusion.fuse(tables(spark, text, vector), ["q"], ["p", "f"]).select("f", "position").collect()
    big = fusion.fuse(tables(spark, [(q, p, f, s * 1e9 - 5) for q, p, f, s in text], vector), ["q"], ["p", "f"]).select("f", "position").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, big))


def test_fusion_of_nothing(spark):
    assert fusion.fuse(tables(spark, [], []), ["q"], ["p", "f"]).count() == 0


def test_rank_by_value_with_bands(spark):
    r = random.Random(2)
    rows = [(r.choice([1, None]), r.choice([None, float(r.randrange(300)), 1e9])) for _ in range(2000)]
    got = fusion.rank_by_value(spark.createDataFrame(rows, "q long, v double"), ["q"], "v", "rank", parts=8).collect()
    for q in (1, None):
        values = [v for k, v in rows if k == q and v is not None]
        assert all(x.rank == (None if x.v is None else 1 + sum(o > x.v for o in values)) for x in got if x.q == q)
    assert len(got) == 2000
