import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.operators import incremental as inc


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_intervals_join_neighbours_and_ignore_nulls(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 3, 7, 9, 10, None)] + [("b", 5)], "k string, seq long")
    assert rows(inc.intervals(df, ["k"]), "k", "lo", "hi") == [("a", 1, 3), ("a", 7, 7), ("a", 9, 10), ("b", 5, 5)]


def test_subtract_leaves_gaps_of_late_commits(spark):
    have = spark.createDataFrame([("a", 1, 10), ("b", 1, 3)], "k string, lo long, hi long")
    done = spark.createDataFrame([("a", 2, 4), ("a", 6, 6), ("a", 9, 12), ("c", 1, 2)], "k string, lo long, hi long")
    assert rows(inc.subtract_intervals(have, done, ["k"]), "k", "lo", "hi") == [("a", 1, 1), ("a", 5, 5), ("a", 7, 8), ("b", 1, 3)]


@pytest.mark.parametrize("seed", range(4))
def test_subtract_and_merge_against_sets(spark, seed):
    import random

    r = random.Random(seed)
    a, b = ({x for x in range(1, 60) if r.random() < p} for p in (0.6, 0.5))
    frame = lambda s: inc.intervals(spark.createDataFrame([("k", x) for x in s], "k string, seq long"), ["k"])
    spread = lambda df: {x for _, lo, hi in rows(df, "k", "lo", "hi") for x in range(lo, hi + 1)}
    assert spread(inc.subtract_intervals(frame(a), frame(b), ["k"])) == a - b
    merged = rows(inc.merge_intervals(frame(a), frame(b), ["k"]), "k", "lo", "hi")
    assert {x for _, lo, hi in merged for x in range(lo, hi + 1)} == a | b
    assert all(y[1] > x[2] + 1 for x, y in zip(merged, merged[1:]))


def test_rows_in_blocks_keeps_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([("a", i, f"v{i}") for i in (1, 5000, 5000, 9000)], "k string, seq long, lo string")
    gaps = spark.createDataFrame([("a", 4000, 8200)], "k string, lo long, hi long")
    got = inc.rows_in(df, gaps, ["k"])
    assert got.columns == ["k", "seq", "lo"] and [r.seq for r in got.collect()] == [5000, 5000]


def test_ledger_processes_once_and_survives_a_failed_run(spark, tmp_path):
    make = lambda seqs: spark.createDataFrame([("s", x, f"v{x}") for x in seqs], "shard string, seq long, v string")
    ledger = inc.Ledger(spark, f"file://{tmp_path}/l", ["shard"])
    assert ledger.output() is None
    assert ledger.run(make([1, 2, 5]), lambda d: d) == 1
    with pytest.raises(Exception, match="boom"):
        ledger.run(make([1, 2, 3, 5]), lambda d: d.select(F.raise_error(F.lit("boom")).alias("v")))
    assert ledger.runs() == [1]
    assert ledger.run(make([1, 2, 3, 5, 8]), lambda d: d) == 2  # 3 came late, below 5
    assert ledger.run(make([1, 2, 3, 5, 8]), lambda d: d) is None
    assert sorted(r.seq for r in ledger.output().collect()) == [1, 2, 3, 5, 8]
    assert rows(ledger.processed(make([1])), "lo", "hi") == [(1, 3), (5, 5), (8, 8)]


def test_two_writers_one_counts(spark, tmp_path):
    """Both process the same gaps; the slower one gets a Conflict, takes nothing of the winner's away and leaves nothing behind."""
    rows_ = spark.createDataFrame([("s", x, f"v{x}") for x in (1, 2, 3)], "shard string, seq long, v string")
    a, b = (inc.Ledger(spark, f"file://{tmp_path}/l", ["shard"]) for _ in range(2))
    with pytest.raises(inc.Conflict):
        a.run(rows_, lambda d: d, lambda: b.run(rows_, lambda d: d))
    assert a.runs() == [1] and sorted(r.seq for r in a.output("run").collect()) == [1, 2, 3]
    assert len(list((tmp_path / "l" / "out").iterdir())) == len(list((tmp_path / "l" / "ledger").iterdir())) == 1


def test_a_writer_that_died_at_its_marker_is_passed_over(spark, tmp_path):
    rows_ = lambda *s: spark.createDataFrame([("s", x) for x in s], "shard string, seq long")
    ledger = inc.Ledger(spark, f"file://{tmp_path}/l", ["shard"])
    assert ledger.run(rows_(1), lambda d: d) == 1
    (tmp_path / "l" / "commit" / "2").write_text("")
    assert ledger.run(rows_(1, 2), lambda d: d) == 3 and ledger.runs() == [1, 3]
    (tmp_path / "l" / "commit" / "4").write_text('{"ledger": "x", "out": "x", "base": 1}')  # made upon what is no longer the latest
    assert ledger.runs() == [1, 3] and ledger.run(rows_(1, 2), lambda d: d) is None


def test_first_run_over_a_long_range_is_cut_in_steps(spark):
    df = spark.createDataFrame([("a", x) for x in (0, 10**9, 10**10, 2 * 10**10 + 1)], "k string, seq long")
    gaps = spark.createDataFrame([("a", 10**9, 2 * 10**10)], "k string, lo long, hi long")
    assert sorted(r.seq for r in inc.rows_in(df, gaps, ["k"], width=65_536).collect()) == [10**9, 10**10]


def test_runs_with_a_failure_and_late_rows(spark):
    walks = spark.createDataFrame([("r", f"f{i}", i, T0 + dt.timedelta(hours=i)) for i in range(20)], "root string, file string, size_bytes long, scanned_at timestamp")
    got = inc.logged_runs(walks, F.col("scanned_at") <= F.lit(T0 + dt.timedelta(hours=9)), F.col("size_bytes") % 4 == 0)
    assert {r.file: r.run for r in got.collect()} == {f"f{i}": 1 if i < 10 and i % 4 else 2 for i in range(20)} and got.count() == 20
    assert inc.logged_runs(walks.limit(0), F.lit(True), F.lit(False)).count() == 0


T0 = dt.datetime(2025, 1, 1)
FILES = "root string, project string, file string, mtime_secs long, size_bytes long, scanned_at timestamp, extra int"
META = "run_id long, root string, path string, mtime_secs long, size_bytes long"
RUNS = "run_id long, root string, started_at timestamp, status string, schema_version int, chunk_strategy_version int, logged_at timestamp"


def test_due_files_cases(spark):
    at = lambda d: T0 + dt.timedelta(days=d)
    files = [("r", "p", "same.md", 1, 1, at(9), 0), ("r", "p", "changed.md", 2, 1, at(9), 0), ("r", "p", "changed.md", 1, 1, at(8), 0), ("r", "p", "new.md", 1, 1, at(9), 0),
             ("r", "p", "null.md", None, None, at(9), 0), ("r", "p", "failed.md", 1, 1, at(9), 0), ("r", None, "top.md", 1, 1, at(9), 0), ("old", "p", "a.md", 1, 1, at(9), 0), ("none", "p", "a.md", 1, 1, at(9), 0),
             ("r", "p", "same.md", 1, 1, at(9), 0)]
    meta = [(1, "r", ".\\p\\same.md".replace(".\\", "./", 1), 1, 1), (1, "r", "p\\changed.md", 1, 1), (1, "r", "p/null.md", 0, None), (2, "r", "p/failed.md", 1, 1), (3, "old", "p/a.md", 1, 1)]
    runs = [(1, "r", at(1), " OK ", 3, 2, at(2)), (1, "r", at(1), "running", 3, 2, at(1)), (2, "r", at(3), "failed", 3, 2, at(4)), (3, "old", at(1), "success", 2, 2, at(2))]
    got = inc.due_files(spark.createDataFrame(files, FILES), spark.createDataFrame(meta, META), spark.createDataFrame(runs, RUNS), rows_per_shard=2)
    assert rows(got, "root", "path") == [("none", "p/a.md"), ("old", "p/a.md"), ("r", "/top.md"), ("r", "p/changed.md"), ("r", "p/failed.md"), ("r", "p/new.md")]


def test_due_files_of_empty_tables(spark):
    assert inc.due_files(spark.createDataFrame([], FILES), spark.createDataFrame([], META), spark.createDataFrame([], RUNS)).count() == 0
