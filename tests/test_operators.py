"""Literal cases of the operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import code_index, evaluation, graph, index, notes, policy, search, vectors
from foliant.operators.chunking import ChunkConfig, pieces, windows
from foliant.plans.hygiene import FIXTURE, NOW, POLICY, fixture
from foliant.streaming.rate_limit import rate_limit


def value(spark, column, **cols):
    rows = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols) or "x string")
    return rows.select(column).first()[0]


def chunks_of(spark, docs):
    return spark.createDataFrame([(p, f, f.rsplit(".", 1)[0], "", 0, c, 1) for p, f, c in docs], "project string, file string, filename string, title string, chunk_id long, body string, line_start long")


# chunks


def test_windows_golden():
    got = windows(["x" * 100] * 40, 1500, 300)
    assert [line for _, line in got] == [1, 12, 23, 34]


def test_windows_carry_nothing_when_overlap_is_out_of_reach():
    assert windows(["ab", "cd", "ef"], 6, 100) == [("ab\ncd", 1), ("ef", 3)]


def test_model_sizes():
    assert ChunkConfig.for_max_tokens(512) == ChunkConfig(768, 153, 460, 92, 998)
    assert ChunkConfig.for_max_tokens(8192) == ChunkConfig(2000, 400, 1200, 240, 2600)


def test_sections():
    cfg = ChunkConfig()
    body = "y" * 80
    assert len(pieces(f"## A\n{body}\n## B\n{body}", "md", cfg)) == 2
    merged = pieces(f"## A\n## B\n{body}", "md", cfg)
    assert len(merged) == 1 and "## A" in merged[0][0] and body in merged[0][0]
    long = pieces("## Long\n" + "\n".join(["z" * 99] * 29), "md", cfg)
    assert len(long) >= 2 and all("## Long" in t for t, _ in long)
    assert pieces("", "md", cfg) == [] and pieces(None, "txt", cfg) == []
    assert pieces("no heading\n" * 5, "md", cfg) == pieces("no heading\n" * 5, "txt", cfg)


def test_every_line_is_in_some_chunk():
    text = "\n".join(f"line {i} " + "w" * (i * 37 % 400) for i in range(300))
    for ext in ("txt", "py", "md"):
        seen = "\n".join(t for t, _ in pieces(text, ext, ChunkConfig()))
        assert all(x in seen for x in text.split("\n"))


# text


@pytest.mark.parametrize("raw,want", [("C++", r"C\+\+"), ("test:query", r"test\:query"), ("(foo)", r"\(foo\)"), ("a/b", r"a\/b"), ("   ", ""), ("<script>", r"\<script\>"), ('"hello"', r"\"hello\"")])
def test_sanitize(spark, raw, want):
    assert value(spark, T.sanitize(F.col("q")), q=raw) == want


def test_slug(spark):
    assert value(spark, T.slug(F.col("t")), t="Hello,  World!! — 알고리즘 노트") == "hello-world-알고리즘-노트"


@pytest.mark.parametrize("block,skip", [("draft: true", True), ("draft: yes", True), ("draft: 1", True), ("Draft: TRUE", True), ("draft: false", False), ("status: deprecated", True), ('status: "Deprecated"', True), ("status: active", False)])
def test_front_matter(spark, block, skip):
    assert value(spark, T.should_skip(F.col("c")), c=f"---\n{block}\n---\ntext") is skip
    assert value(spark, T.should_skip(F.col("c")), c=f"---\n{block}\n...\ntext") is skip
    assert value(spark, T.should_skip(F.col("c")), c=f"---\n{block}\ntext") is False
    assert value(spark, T.should_skip(F.col("c")), c=f"\n---\n{block}\n---\n") is False


@pytest.mark.parametrize("text,n", [("## H\n- a\n- b\n- c", 3), ("## H\n- a\n## I\n- b", 1), ("## H\n- a\n### S\n- b", 2), ("## H\n* a\n* b", 2), ("## H\n- a\n* b\n- c\n* d", 4), ("## H\n1. a\n- b", 1), ("- a", 0)])
def test_list_items(spark, text, n):
    assert value(spark, T.list_items(F.col("c"), "## H"), c=text) == n


def test_expiry(spark):
    e = lambda v, n=NOW: value(spark, T.is_expired(F.col("v"), F.lit(n)), v=v)
    assert e("2026-08-18T23:00:00+09:00") and not e("") and e("2026-01-01") and not e("zzz")


def test_page_markers(spark):
    assert value(spark, T.page_markers(F.col("t")), t="a\fb\fc") == "a\n--- Page 2 ---\nb\n--- Page 3 ---\nc"


# search


def test_one_row_per_file_and_two_per_project(spark):
    docs = [("p", f"f{i}.md", "OAuth code flow\n" * 3) for i in range(5)] + [("q", "g.md", "OAuth"), ("_x", "n.md", "nothing")]
    got = search.search_ranked(chunks_of(spark, docs), "oauth", 10).collect()
    assert len({(r.project, r.file) for r in got}) == len(got) and [r.project for r in got].count("p") == 2 and any(r.project == "q" for r in got)
    assert len(search.search_ranked(chunks_of(spark, docs), "oauth", 10, project="p").collect()) == 5


def test_scripts_without_word_spaces(spark):
    docs = [("k", "a.md", "인증 흐름 문서"), ("j", "b.md", "認証フロー"), ("c", "c.md", "认证流程")]
    for q, p in (("인증", "k"), ("認証", "j"), ("认证", "c")):
        assert [r.project for r in search.search_ranked(chunks_of(spark, docs), q, 5).collect()] == [p]


def test_empty_queries_and_limits(spark):
    c = chunks_of(spark, [("p", "f.md", "text")])
    assert search.search_ranked(c, "", 5).count() == 0 and search.search_ranked(c, "x", 5).count() == 0 and search.search_ranked(c, "text", 0).count() == 0
    with pytest.raises(ValueError):
        search.search_auto(c, c, " ")


def test_overlapping_grams_count(spark):
    assert value(spark, search.occurrences(F.col("t"), "aa"), t="aaaa") == 3
    assert value(spark, search.occurrences(F.col("t"), "ab"), t="abab") == 2


def test_batch_agrees_with_single_queries(spark):
    docs = [("p", "a.md", "release plan for the cache"), ("p", "b.md", "plan"), ("q", "c.md", "cache of the release")]
    c = chunks_of(spark, docs)
    batch = {(r.qid, r.file): r.score for r in search.bm25_batch(c, {"1": "release plan", "2": "cache"}).collect()}
    for qid, q in (("1", "release plan"), ("2", "cache")):
        for r in search.bm25_scores(c, q).collect():
            assert batch[qid, r.file] == pytest.approx(r.score)


def test_rrf(spark):
    assert [search.rrf_k(x) for x in (1, 5, 10, 20, 50)] == [10, 19, 27, 38, 60]
    rows = lambda *ids: spark.createDataFrame([("p", i, 0, 1.0 / (k + 1)) for k, i in enumerate(ids)], "project string, file string, chunk_id long, score double")
    got = search.rrf(rows("a", "b"), rows("b", "c"), 10, k=60).collect()
    assert [r.file for r in got] == ["b", "a", "c"]
    assert [round(r.score, 7) for r in got] == [0.0162310, 0.0098361, 0.0064516] or [round(r.score, 6) for r in got][1:] == [0.009836, 0.006452]


def test_minmax(spark):
    df = spark.createDataFrame([("a", 0.2), ("a", 0.8), ("a", 0.5), ("b", 0.7), ("b", 0.7), ("c", 42.0)], "g string, score double")
    got = sorted((r.g, round(r.score, 9)) for r in search.minmax(df, "g").collect())
    assert got == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.5), ("b", 0.5), ("c", 42.0)]


def test_grep_takes_the_first_best_line(spark):
    docs = spark.createDataFrame([("p", "a.md", "alpha\nbeta alpha\r\nalpha beta"), ("p", "b.md", "alpha only"), ("q", "c.md", "x\nbeta\nalpha")], "project string, file string, content string")
    assert [tuple(r) for r in search.search_grep(docs, "Alpha  beta").collect()] == [("p", "a.md", 2, "beta alpha", 2), ("q", "c.md", 2, "beta", 1)]


# vectors


@pytest.mark.parametrize("a,b,want", [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0, 1.0, 0.0], [1.0, 0.0, 0.0], 0.7071), ([0.0, 0.0], [1.0, 0.0], 0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want, abs=1e-4)


def store(spark):
    return spark.createDataFrame([("a", "x", 0, [1.0, 0.0] * 4), ("b", "y", 0, [1.0, 0.1] * 4), ("b", "z", 0, [-1.0, 0.0] * 4)], "project string, file string, chunk_id long, embedding array<float>")


def test_vector_filters(spark):
    q = [1.0, 0.0] * 4
    assert [r.file for r in vectors.search_vector(store(spark), q, 5).collect()] == ["x", "y"]
    assert [r.file for r in vectors.search_vector(store(spark), q, 5, "b").collect()] == ["y"]
    assert vectors.search_vector(store(spark), q, 5, allow=store(spark).select("file").limit(0)).count() == 0
    assert [r.file for r in vectors.search_quantised(vectors.quantise(store(spark)), q, 2).collect()] == ["x", "y"]
    assert vectors.search_lsh(store(spark), q, 1).first().file == "x"
    assert vectors.search(store(spark), q, 1).first().file == "x"


def test_model_change_empties_the_store(spark):
    meta = spark.createDataFrame([("m", 8)], "model string, dimension int")
    assert vectors.valid_vectors(store(spark), meta, "m", 8).count() == 3 and vectors.valid_vectors(store(spark), meta, "other", 8).count() == 0


# evaluation


def run_of(spark, **runs):
    return spark.createDataFrame([(q, f, i) for q, fs in runs.items() for i, f in enumerate(fs, 1)], "qid string, file string, rank int")


def truth_of(spark, **truth):
    return spark.createDataFrame([(q, f) for q, fs in truth.items() for f in fs], "qid string, file string")


def test_metrics(spark):
    run, truth = run_of(spark, a=["A", "B", "C"], b=["x", "a", "y"], c=["x", "a"], d=["z"]), truth_of(spark, a=["A", "B"], b=["a", "b"], c=["a", "b"])
    queries = spark.createDataFrame([(q,) for q in "abcd"], "qid string")
    got = {(r.qid, r.k): r for r in evaluation.metrics(run, truth, queries, (1, 2, 3, 5)).collect()}
    assert (got["a", 1].precision, got["a", 1].recall, got["a", 2].precision, got["a", 2].recall) == (1, 0.5, 1, 1)
    assert got["b", 3].ndcg == pytest.approx(0.386853, abs=1e-6) and got["c", 5].ap == pytest.approx(0.25)
    assert (got["d", 1].precision, got["d", 1].recall, got["d", 1].ndcg, got["d", 1].ap) == (0, 1, 1, 1)
    rr = {r.qid: r.rr for r in evaluation.mrr(run_of(spark, a=["x", "y", "a"], d=["z"], e=["q"]), truth_of(spark, a=["A"], e=["r"]), spark.createDataFrame([(q,) for q in "ade"], "qid string")).collect()}
    assert rr == {"a": pytest.approx(1 / 3), "d": 1.0, "e": 0.0}


def test_paths_compare_in_one_form(spark):
    assert evaluation.judged(run_of(spark, a=["Proj\\Architecture.md"]), truth_of(spark, a=["proj/architecture.md"])).first().rel == 1


def test_percentiles(spark):
    df = spark.createDataFrame([("a", x) for x in (30, 10, 50, 20, 40)] + [("b", 42), ("c", None)], "g string, v long")
    got = {r.g: tuple(r)[1:] for r in evaluation.percentiles(df, ["g"], "v", (0, 50, 100)).collect()}
    assert got == {"a": (10, 30, 50), "b": (42, 42, 42)}


def test_sections_and_chunks(spark):
    text = "# T\n\nintro\n\n## Section One\na\nb\n\n## Section Two\nc\nd"
    docs = spark.createDataFrame([("P\\f.md", text)], "file string, content string")
    s = spark.createDataFrame([("q", "p/f.md", "## section one"), ("q", "p/f.md", "## Section Two"), ("q", "p/f.md", "## None")], "qid string, file string, heading string")
    ranges = evaluation.section_ranges(docs, s)
    assert sorted((r.first, r.last) for r in ranges.select(F.col("first").alias("first"), "last").collect()) == [(5, 8), (9, 11)]
    c = spark.createDataFrame([("q", "p/f.md", 6, 1), ("q", "p/f.md", 2, 2), ("q", "p/f.md", 9, 3)], "qid string, file string, line_start long, rank int")
    got = {(r.qid, r.k): (r.precision, r.recall) for r in evaluation.chunk_precision(c, ranges, spark.createDataFrame([("q",), ("none",)], "qid string"), (2, 3)).collect()}
    assert got["q", 2] == (0.5, 0.5) and got["q", 3] == (pytest.approx(2 / 3), 1.0) and got["none", 2] == (0.0, 1.0)


def test_regression(spark):
    cur = spark.createDataFrame([("p", "precision", 0.94), ("l", "latency", 1.1), ("t", "throughput", 99.0), ("z", "latency", 5.0)], "metric string, kind string, value double")
    base = spark.createDataFrame([("p", 1.0), ("l", 1.0), ("t", 100.0), ("z", 0.0)], "metric string, value double")
    got = evaluation.regression(cur, base)
    assert {r.metric: r.status for r in got.collect()} == {"p": "regression", "l": "warn", "t": "pass"} and not evaluation.passed(got)


# changes


def test_incremental_build_equals_full(spark):
    from foliant.operators.chunking import chunk

    make = lambda rows: spark.createDataFrame(rows, "project string, file string, ext string, content string, mtime_secs long, size_bytes long")
    old = make([("p", "a.md", "md", "one", 1, 3), ("p", "b.md", "md", "two", 1, 3), ("p", "c.md", "md", "three", 1, 5)])
    new = make([("p", "a.md", "md", "one", 1, 3), ("p", "b.md", "md", "two!", 2, 4), ("p", "d.md", "md", "four", 1, 4)])
    diff = index.diff_state(new, old)
    assert {r.file: r.status for r in diff.collect()} == {"a.md": "unchanged", "b.md": "modified", "c.md": "deleted", "d.md": "added"}
    got = index.build_incremental(chunk(old), new, diff, chunk)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunk(new).collect()))
    assert index.is_stale(new, old) and not index.is_stale(new, new) and index.is_stale(new, None)
    assert index.needs_rebuild(2, 2) and not index.needs_rebuild(3, 2)


def test_upsert_keeps_the_last(spark):
    df = lambda rows: spark.createDataFrame(rows, "k string, v int")
    assert sorted(map(tuple, index.upsert(df([("a", 1), ("b", 1)]), df([("b", 2), ("b", 3)]), ["k"], "v").collect())) == [("a", 1), ("b", 3)]


# graph, policy


def test_graph_update_prunes(spark):
    docs = fixture(spark)
    nodes, edges = graph.build_graph(docs)
    assert {(r.source, r.target) for r in edges.collect()} >= {("alpha/README.md", "alpha/PRD.md"), ("beta/DEPLOYMENT.md", "alpha/docs/setup.md")}
    less = docs.filter("file <> 'docs/setup.md'")
    n2, e2 = graph.update_graph(edges, nodes, docs.filter("file = 'README.md'").select("project", "file"), less)
    n3, e3 = graph.build_graph(less)
    assert sorted(r.id for r in n2.collect()) == sorted(r.id for r in n3.collect()) and sorted(r.id for r in e2.collect()) == sorted(r.id for r in e3.collect())
    assert {r.last_verified for r in graph.verify(nodes, "alpha/PRD.md", NOW).filter("id = 'alpha/PRD.md'").collect()} == {NOW}
    with pytest.raises(KeyError):
        graph.verify(nodes, "nowhere", NOW)


@pytest.mark.parametrize("path,want", [("a/../b/./c.md", "b/c.md"), ("../x", "x"), ("a\\b", "a/b"), ("a/b/../../c", "c")])
def test_normalise_path(spark, path, want):
    assert value(spark, graph.normalise_path(F.col("p")), p=path) == want


def test_policy_results(spark):
    got = {(r.project, r.file): r for r in policy.validate(fixture(spark), POLICY).collect()}
    assert got["alpha", "PRD.md"].status == "fail" and [s.status for s in got["alpha", "PRD.md"].sections] == ["pass", "fail", "warn"]
    assert (got["alpha", "ARCHITECTURE.md"].status, got["alpha", "ARCHITECTURE.md"].reason) == ("warn", "template_unfilled")
    assert (got["beta", "PRD.md"].status, got["beta", "PRD.md"].reason) == ("warn", "minimal_content")
    assert (got["beta", "DEPLOY.md"].status, got["alpha", "DEPLOY.md"].reason) == ("pass", "file_not_found")
    assert len(FIXTURE) == 10


def test_policy_file():
    p = policy.Policy.read("not toml [", '[policy]\nenforce = "error"\n[[policy.required]]\nname = "A.md"\naliases = ["B.md"]\n[[policy.required.sections]]\nheading = "## X"\nmin_items = 2\n[policy.naming]\ncase = "kebab-case"')
    assert p.enforce == "error" and p.required[0].aliases == ("B.md",) and p.required[0].sections[0].min_items == 2 and p.naming.case == "kebab-case"
    assert policy.Policy.read(None).required[0].name == "PRD.md"


def test_notes(spark):
    empty = spark.createDataFrame([], "project string, file string, content string, ext string")
    n = notes.store_note(empty, "First line\nbody about caches", "20260101", project="p", valid_until="2020-01-01T00:00:00Z")
    n = notes.store_note(n, "caches again", "20260102", title="Näme!")
    assert sorted(r.file for r in n.collect()) == ["20260101-first-line.md", "20260102-näme.md"]
    from foliant.operators.chunking import chunk

    c = chunk(n)
    assert [r.file for r in notes.recall(c, n, "caches", NOW).collect()] == ["20260102-näme.md"]
    assert notes.recall(c, n, "caches", NOW, keep_expired=True).count() == 2
    for bad in (dict(content=" "), dict(content="x", valid_until="2020-01-01"), dict(content="x" * (1 << 20) + "y")):
        with pytest.raises(ValueError):
            notes.store_note(empty, stamp="1", **bad)


# code


def test_outlines():
    py = code_index.outline("import os\nfrom . import x\n\n@d\ndef f(a, *, b=1) -> int: ...\n\nclass A(B):\n    def __init__(self): ...\n    def _h(self): ...\n\ndef _g(): ...\n", "python")
    assert py == {"functions": ["@d def f(a, *, b=1) -> int", "A.def __init__(self)"], "types": ["class A(B)"], "submodules": [], "imports": ["os", "."]}
    assert code_index.outline("def f(:", "python") is None
    rust = code_index.outline("use std::fmt;\npub struct S { a: u8 }\nstruct T;\nmod inner;\npub fn f(a: &str) -> bool { true }\nfn g() {}\n// pub fn h() {}\n", "rust")
    assert rust["functions"] == ["pub fn f(a: &str) -> bool"] and rust["types"] == ["pub struct S"] and rust["submodules"] == ["inner"] and rust["imports"] == ["std::fmt"]
    assert code_index.outline("package x\nimport \"fmt\"\ntype T struct {}\nfunc (t *T) Show() string { return \"func Hidden()\" }\nfunc hide() {}\n", "go")["functions"] == ["func (t *T) Show() string"]
    assert code_index.outline("public class A { public int f(int x) { return x; } int g() { return 1; } }".replace("{ ", "{\n").replace("} ", "}\n"), "java")["functions"] == ["public int f(int x)"]
    assert code_index.outline("static int h(void) {\n}\nint f(int a) {\n}\nstruct s {\n};\n", "c") == {"functions": ["int f(int a)"], "types": ["struct s"], "submodules": [], "imports": []}
    assert code_index.outline("class A\n  def a\n  end\n  private\n  def b\n  end\nend\n", "ruby")["functions"] == ["def a"]
    for lang, src, want in (("typescript", "export function f(a: number): string {\n}\nexport interface I {}\n", "function f(a: number): string"), ("kotlin", "fun f(a: Int): Int = a\nprivate fun g() = 1\n", "fun f(a: Int): Int"), ("swift", "public func f(a: Int) -> Int {\n}\nprivate func g() {}\n", "public func f(a: Int) -> Int"), ("csharp", "public static int F(int a) {\n}\nint G() {\n}\n", "public static int F(int a)"), ("cpp", "int ns::f(int a) const {\n}\n", "int ns::f(int a) const")):
        assert code_index.outline(src, lang)["functions"] == [want], lang


@pytest.mark.parametrize("path,lang,want", [("src/a/mod.rs", "rust", "src::a"), ("a/__init__.py", "python", "a"), ("a/b.py", "python", "a.b"), ("x/index.ts", "typescript", "x"), ("a/b.c", "c", "a/b.c"), ("a/B.java", "java", "a.B")])
def test_module_paths(path, lang, want):
    assert code_index.module_path(path, lang) == want


# rate limit


def test_rate_limit_is_a_fold(spark):
    t0 = dt.datetime(2025, 1, 1)
    secs = [0, 10, 20, 30, 60, 61, 70, 71]
    rows = [(i, 1, t0 + dt.timedelta(seconds=s)) for i, s in enumerate(secs)] + [(100, 2, t0), (101, 2, None), (102, None, t0)]
    got = {r.event_id: r.admitted for r in rate_limit(spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp"), most=3, window_secs=60).collect()}
    assert [got[i] for i in range(8)] == [True, True, True, False, False, True, False, True]
    assert got[100] and not got[101] and got[102]
