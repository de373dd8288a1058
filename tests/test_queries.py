"""Every core query against its SQL on the smallest tables; those without SQL run and give rows."""

import pytest
from oracle import connect, same

from foliant.plans import catalogue

MAY_BE_EMPTY = {"bm25_postfilter"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf, con):
    df = catalogue.QUERIES[name](spark, sf)
    if name in catalogue.SQL:
        same(df, con, catalogue.SQL[name])
    if name not in MAY_BE_EMPTY:
        assert df.limit(1).count() == 1


def test_sql_belongs_to_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_hygiene_reads_the_tables(spark, sf, con):
    """Every operator that has a query over the fixture has one over the tables: none of their files is left out."""
    q = catalogue.QUERIES
    files = "select distinct coalesce(project, '') as project, coalesce(file, '') as file from documents"
    want = {tuple(r) for r in con.execute(files).fetchall()}
    projects = {p for p, _ in want}
    shown = q["overview_tables"](spark, sf).collect()
    assert {(r.project, r.file) for r in shown} <= want and len(shown) == len({(r.project, r.file) for r in shown}) > 10
    for name in ("policy_status_tables", "policy_rollup_tables", "audit_summary_tables", "repo_actions_tables", "audit_tables"):
        assert {r.project for r in q[name](spark, sf).select("project").distinct().collect()} == projects, name
    ids = {(p + "/" if p else "") + f for p, f in con.execute("select distinct coalesce(project, ''), coalesce(file, '') from index_chunks").fetchall()}
    edges = q["graph_edges_tables"](spark, sf).collect()
    assert edges and {e.source for e in edges} | {e.target for e in edges} <= ids
    # links do not cross chunks here, so that the files' edges are at least those of the single chunks
    single = {(r.source, r.to) for r in q["link_targets"](spark, sf).filter("`to` is not null").collect()}
    assert single <= {(e.source, e.target) for e in edges}


def test_every_title_has_a_slug(spark, tmp_path):
    """Titles in other alphabets, which the given tables lack, are not left out."""
    titles = {"Größe & Maß": "größe-maß", "정책 문서!": "정책-문서", "Año (fiscal)": "año-fiscal", "Read Me": "read-me", "": ""}
    rows = [("p", "f.md", "f.md", t, i, "x", 1) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "project string, file string, filename string, title string, chunk_id long, body string, line_start int").write.parquet(f"{tmp_path}/index_chunks.parquet")
    assert {r.title: r.slug for r in catalogue.QUERIES["slugs"](spark, str(tmp_path)).collect()} == titles
