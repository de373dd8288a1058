import datetime as dt
import io
import zipfile

import pytest

from foliant.operators import code_index
from foliant.operators.chunking import chunk
from foliant.sources import readers
from foliant.sources.sinks import Conflict, Store
from foliant.streaming.incremental import maintain
from foliant.streaming.rate_limit import rate_limit, rate_limit_stream


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_X", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office_readers():
    docx = archive(word__document_X=f"<w:document {W}><w:t>Hello </w:t><w:t>there</w:t></w:document>")
    assert readers.read_text("a.docx", docx) == "Hello there"
    pptx = archive(ppt__slides__slide10_X=f"<a:x {A}><a:t>ten</a:t></a:x>", ppt__slides__slide2_X=f"<a:x {A}><a:t>two</a:t></a:x>")
    text = readers.read_text("a.pptx", pptx)
    assert text.index("two") < text.index("ten") and "--- Slide ppt/slides/slide2.xml ---" in text
    xlsx = archive(
        xl__workbook_X=f'<workbook {S}><sheets><sheet name="Plan"/></sheets></workbook>', xl__sharedStrings_X=f"<sst {S}><si><t>key</t></si></sst>",
        xl__worksheets__sheet1_X=f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>1.5</v></c></row></sheetData></worksheet>',
    )
    assert readers.read_text("a.xlsx", xlsx) == "\n--- Sheet: Plan ---\nkey\t\t1.5\n"
    assert readers.read_text("a.csv", b'a,"b,c"\n') == "\n--- Sheet: a.csv ---\na\tb,c\n"
    assert readers.read_text("a.docx", b"no zip") is None and readers.read_text("a.md", b"\xff\xfe") is None and readers.read_text("a.md", b"") == ""


def test_corpus_rules(spark, tmp_path):
    for name, text in {
        "alpha/PRD.md": "# Product", "alpha/docs/mcp/x.md": "kept: reserved names count at the first level only", "alpha/_template.md": "no", "mcp/a.md": "no", "_t/a.md": "no", ".h/a.md": "no", "top.md": "no",
        "alpha/draft.md": "---\ndraft: true\n---\n", "beta/a b+c.txt": "odd name", "beta/openapi-v1.yaml": "api", "beta/other.yaml": "no", "beta/x.py": "no",
    }.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {(r.project, r.file) for r in readers.corpus(spark, str(tmp_path)).collect()}
    assert got == {("alpha", "PRD.md"), ("alpha", "docs/mcp/x.md"), ("beta", "a b+c.txt"), ("beta", "openapi-v1.yaml")}
    assert {r.file for r in readers.vault(spark, str(tmp_path / "alpha"), "v").collect()} == {"PRD.md", "docs/mcp/x.md"}
    assert readers.lint_corpus(spark, str(tmp_path / "mcp")).count() == 1


def test_source_walk(spark, tmp_path):
    for name in ("src/a.rs", "node_modules/b.js", ".git/c.py", "d.py", "e.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("pub fn f() {}\n" if name.endswith("rs") else "def f(): pass\n")
    mods = code_index.code_index(readers.sources(spark, str(tmp_path))).collect()
    assert {(m.path, m.language) for m in mods} == {("src/a.rs", "rust"), ("d.py", "python")}


def test_config(spark):
    assert readers.read_config('a = 1\n', "broken [", "a = 2\nb = 3") == {"a": 1, "b": 3}
    t = readers.ground_truth(spark, '[[queries]]\ntext = "q"\nrelevant_files = ["a.md"]\n[[queries.relevant_sections]]\nfile = "a.md"\nheading = "## X"').first()
    assert t.relevant_files == ["a.md"] and t.relevant_sections[0].heading == "## X"


def test_store_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.read("t") is None and s.meta() == {}
    s.publish({"t": spark.range(3)}, {"schema_version": 3})
    s.publish({"t": spark.range(5)}, {"schema_version": 4})
    assert s.read("t").count() == 5 and s.version() == 2 and s.meta() == {"schema_version": 4}


def test_store_two_writers_and_vacuum(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    base = a.version()
    b.publish({"t": spark.range(3)})
    with pytest.raises(Conflict):
        a.publish({"t": spark.range(7)}, base=base)
    assert a.read("t").count() == 3
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    a.publish_buckets("b", rows((1, "x"), (2, "y"), (3, "z")), "k", [1, 2, 3])
    a.publish_buckets("b", rows((2, "Y")), "k", [2, 3])  # 3 is emptied, 1 is shared with the version before
    assert sorted(r.v for r in a.read("b").collect()) == ["Y", "x"] and [r.v for r in a.read("b", [2]).collect()] == ["Y"] and a.read("t").count() == 3
    before = len(list((tmp_path / "s" / "data").rglob("*.parquet")))
    assert a.vacuum(keep=1) == 2 and len(list((tmp_path / "s" / "data").rglob("*.parquet"))) < before
    assert sorted(r.v for r in a.read("b").collect()) == ["Y", "x"]


def test_stream_of_documents_equals_batch(spark, tmp_path):
    schema = "project string, file string, ext string, content string"
    src = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1)
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda: maintain(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)), store, str(tmp_path / "cp")).awaitTermination()
    rows(("p", "a.md", "md", "one"), ("p", "b.md", "md", "two")).write.mode("append").parquet(str(src))
    run()
    rows(("p", "b.md", "md", "two again"), ("p", "c.md", "md", "three")).write.mode("append").parquet(str(src))
    run()
    run()  # nothing new
    want = chunk(rows(("p", "a.md", "md", "one"), ("p", "b.md", "md", "two again"), ("p", "c.md", "md", "three")))
    assert sorted(map(tuple, store.read("chunks").collect())) == sorted(map(tuple, want.collect()))


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, i % 3, t0 + dt.timedelta(seconds=7 * i)) for i in range(60)]
    schema = "event_id long, user_id long, ts timestamp"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = rate_limit_stream(stream, most=2, window_secs=60).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.event_id, r.admitted) for r in spark.sql("select * from admitted").collect()}
    assert got == {(r.event_id, r.admitted) for r in rate_limit(spark.createDataFrame(rows, schema), most=2, window_secs=60).collect()}
