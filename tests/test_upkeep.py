"""Keeping an index fresh, the vector store's surface, reports, and the guards around them."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import evaluation as ev
from foliant.operators import index, policy, search
from foliant.operators import vectors as v
from foliant.operators.chunking import chunk
from foliant.sources.sinks import Store

DOCS = "project string, file string, ext string, content string, mtime_secs long, size_bytes long"


def test_an_index_is_kept_fresh(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/i")
    docs = lambda *rows: spark.createDataFrame([(p, f, "md", c, m, len(c)) for p, f, c, m in rows], DOCS)
    build = lambda d: chunk(d.select("project", "file", "ext", "content"))
    texts = lambda: {(r.file, r.body) for r in store.read("chunks").collect()}
    assert index.ensure_fresh(store, docs(("p", "a.md", "one", 1), ("p", "b.md", "two", 1)), build) == {"mode": "full", "added": 2, "modified": 0, "deleted": 0}
    version = store.version()
    assert index.ensure_fresh(store, docs(("p", "a.md", "one", 1), ("p", "b.md", "two", 1)), build)["mode"] == "none" and store.version() == version
    got = index.ensure_fresh(store, docs(("p", "b.md", "two again", 2), ("p", "c.md", "three", 1)), build)
    assert got == {"mode": "incremental", "added": 1, "modified": 1, "deleted": 1} and texts() == {("b.md", "two again"), ("c.md", "three")}
    store.publish({"chunks": store.read("chunks"), "files": store.read("files")}, {"schema_version": 1, "chunk_version": 2})
    assert index.ensure_fresh(store, docs(("p", "b.md", "two again", 2)), build)["mode"] == "full" and texts() == {("b.md", "two again")}


def test_vector_store(spark):
    rows = [("p", "a", 0, [1.0, 0.0]), ("p", "a", 1, [0.0, 1.0]), ("p", "b", 0, [1.0, 1.0]), (None, "c", 0, [1.0, 2.0])]
    store = spark.createDataFrame(rows, "project string, file string, chunk_id long, embedding array<float>")
    keys = lambda d: sorted((r.project or "", r.file, r.chunk_id) for r in d.collect())
    assert keys(v.delete(store, project="p")) == [("", "c", 0)] and v.is_empty(v.delete(store, everything=True))
    assert keys(v.delete(store, keys=spark.createDataFrame([("p", "a", 1), ("p", "a", 1)], "project string, file string, chunk_id long"))) == [("", "c", 0), ("p", "a", 0), ("p", "b", 0)]
    files = spark.createDataFrame([("p", "a"), ("p", "z")], "project string, file string")
    assert {r.file: r.has_vectors for r in v.has_file(store, files).collect()} == {"a": True, "z": False}
    assert tuple(v.store_meta(store, "m").first()) == ("m", 2, 4) and tuple(v.store_meta(store.limit(0), "m").first()) == ("m", 0, 0)
    assert [r.back for r in store.select(v.from_blob(v.to_blob(F.col("embedding"))).alias("back")).collect()] == [x[3] for x in rows]
    assert spark.sql("select '0000' as b, cast(null as string) as n").select(v.from_blob(F.col("b")), v.from_blob(F.col("n"))).first() == (None, None)


def test_embedding_cache_and_hook(spark):
    cache = spark.createDataFrame([("h1", "m", [1.0]), ("h2", "m", [2.0])], "content_hash string, model string, embedding array<float>")
    fresh = spark.createDataFrame([("h2", "m", [9.0]), ("h3", "m", []), ("h4", "n", [4.0]), ("h5", "m", None)], cache.schema)
    assert sorted((r.content_hash, r.embedding[0]) for r in v.put_cache(cache, fresh).collect()) == [("h1", 1.0), ("h2", 9.0), ("h4", 4.0)]
    chunks = spark.createDataFrame([("a",), (None,), ("ccc",)], "body string")
    got = v.embed(chunks, lambda: lambda texts: [[len(t), 1] for t in texts])
    assert sorted(r.embedding for r in got.collect()) == [[0.0, 1.0], [1.0, 1.0], [3.0, 1.0]] and v.embed(chunks.limit(0), lambda: lambda t: t).count() == 0


def test_report_and_baseline(spark):
    m = spark.createDataFrame([("p@5", "precision", 0.5), ("p50", "latency", 12.0)], "metric string, kind string, value double")
    back = ev.from_json(spark, ev.to_json(m))
    assert sorted(map(tuple, back.select(*m.columns).collect())) == sorted(map(tuple, m.collect()))
    text = ev.report(m, ev.regression(m, back))
    assert "| p@5 | precision | 0.5000 |" in text and "| p50 | 12.0000 | 12.0000 | +0.0 | pass |" in text


def test_common_schema_and_fallback(spark):
    rows = [("p", f"f{i}.md", f"f{i}", "", 0, "cache words here", 1 + i) for i in range(5)]
    c = spark.createDataFrame(rows, "project string, file string, filename string, title string, chunk_id long, body string, line_start long")
    got = search.search_fallback(c, None, "cache", None, 2, "p")
    assert got.columns == ["project", "file", "line", "snippet", "score", "source", "truncated"] and [r.truncated for r in got.collect()] == [True, True]
    assert not search.search_fallback(c, None, "cache", None, 100, "p").first().truncated and search.search_fallback(c, None, "cache", None, -3, "p").count() == 1
    with pytest.raises(ValueError):
        search.search_fallback(c, None, "  ", None)
    near = c.select("project", "file", "chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    assert search.search_fallback(c, near, "cache", [1.0, 0.0], 3).first().source == "hybrid"


@pytest.mark.parametrize("path,safe", [("a/b.md", True), ("../a", False), ("a/../../b", False), ("a..b/c", True), ("/etc/x", False), ("C:\\x", False), ("a\\..\\b", False), ("http://x", False), ("", False), (None, False), ("./a", True)])
def test_path_guard(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(policy.safe_path(F.col("p"))).first()[0] == safe


def test_project_resolution(spark):
    known = spark.createDataFrame([("billing-api",), ("billing-web",), ("search",)], "project string")
    asked = spark.createDataFrame([("search",), ("SEARCH",), ("sea",), ("billing",), ("x",), ("",), (None,)], "asked string")
    got = {r.asked: (r.project, r.how) for r in policy.resolve_project(known, asked).collect()}
    assert got["search"] == ("search", "exact") and got["SEARCH"] == ("search", "case") and got["sea"] == ("search", "prefix") and got["billing"] == (None, "none") and got["x"] == (None, "none") and got[""] == (None, "none")
