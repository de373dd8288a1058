"""Corpora from folders: which files are documents, and their text. Specific readers go before the plain one."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T

# fixed values: first-level folders that are no projects
RESERVED = ("mcp", "skills", "scripts")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}t"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}t"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def raw_files(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, mtime_secs, size_bytes, bytes) of all files."""
    base = root.rstrip("/").removeprefix("file:").replace("//", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^(?:file:/*|[a-z0-9]+://[^/]*)", "/")
    below = F.substring(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), len(base) + 2, 1 << 30)
    return files.select(below.alias("path"), F.unix_timestamp("modificationTime").alias("mtime_secs"), F.col("length").alias("size_bytes"), F.col("content").alias("bytes"))


def in_project(path: Column) -> Column:
    """Below a first-level folder that is a project; reserved names count at that level only. Files that start with '_' are templates."""
    top = F.substring_index(path, "/", 1)
    return F.contains(path, F.lit("/")) & ~top.isin(*RESERVED) & ~top.rlike("^[._]") & ~T.file_name(path).startswith("_")


def _xml_text(data: bytes, tag: str) -> str:
    return "".join(x.text or "" for x in ElementTree.fromstring(data).iter(tag))


def _workbook(data: bytes) -> str:
    """A header line per sheet; cells joined by tabs, rows by line feeds."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")]
    titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet")] if "xl/workbook.xml" in names else []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for i, name in enumerate(sheets):
        out.append(f"\n--- Sheet: {titles[i] if i < len(titles) else name} ---\n")
        for row in ElementTree.fromstring(z.read(name)).iter(_S + "row"):
            cells = []
            for c in row.iter(_S + "c"):
                letters = re.match(r"[A-Z]*", c.get("r", ""))[0]
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                while column and len(cells) < column - 1:
                    cells.append("")
                v, kind = c.find(_S + "v"), c.get("t")
                if kind == "s" and v is not None:
                    cells.append(shared[int(v.text)])
                elif kind == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(_S + "t")))
                elif kind == "b" and v is not None:
                    cells.append("true" if v.text == "1" else "false")
                else:
                    cells.append(v.text or "" if v is not None else "")
            out.append("\t".join(cells) + "\n")
    return "".join(out)


def _csv(data: bytes, name: str) -> str:
    import csv

    rows = csv.reader(io.StringIO(data.decode("utf-8")))
    return f"\n--- Sheet: {name} ---\n" + "".join("\t".join(r) + "\n" for r in rows)


def _pdf(data: bytes) -> str | None:
    """By an installed library or the pdftotext program, where there is one; pages after the first get a line."""
    text = None
    try:
        from pypdf import PdfReader  # optional

        text = "\f".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
    except ImportError:
        import shutil
        import subprocess

        if program := shutil.which("pdftotext"):
            try:
                text = subprocess.run([program, "-", "-"], input=data, capture_output=True, timeout=30, check=True).stdout.decode("utf-8", "replace")
            except (subprocess.SubprocessError, OSError):
                return None
    except Exception:  # noqa: BLE001 - broken files are skipped
        return None
    if not text or not text.strip():
        return None
    pages = text.split("\f")
    return pages[0] + "".join(f"\n--- Page {i} ---\n{p}" for i, p in enumerate(pages[1:], 2))


def read_text(path: str, data: bytes) -> str | None:
    """Text of a file by its extension; None if it has none (broken, or no UTF-8)."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    try:
        if ext == "docx":
            return _xml_text(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"), _W)
        if ext == "pptx":
            z = zipfile.ZipFile(io.BytesIO(data))
            slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
            texts = [(n, _xml_text(z.read(n), _A)) for n in slides]
            return "".join(f"\n--- Slide {n} ---\n{t}" for n, t in texts if t)
        if ext == "xlsx":
            return _workbook(data)
        if ext == "csv":
            return _csv(data, path.rsplit("/", 1)[-1])
        if ext == "pdf":
            return _pdf(data)
        return data.decode("utf-8")
    except (UnicodeDecodeError, zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError):
        return None


def with_text(files: DataFrame) -> DataFrame:
    """files with content in place of bytes; files without text are left out."""
    keep = [c for c in files.columns if c != "bytes"]
    kinds = dict(files.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keep].copy()
            out["content"] = [read_text(p, bytes(x)) for p, x in zip(b["path"], b["bytes"])]
            yield out[out["content"].notna()]

    return files.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "content string"]))


def corpus(spark: SparkSession, root: str, extra: Sequence[str] = ()) -> DataFrame:
    """Documents of a doc root: project, file, ext, mtime_secs, size_bytes, content. Drafts and deprecated ones stay out."""
    path = F.col("path")
    found = with_text(raw_files(spark, root).filter(in_project(path) & T.is_indexable(path, list(extra))))
    named = found.select(F.substring_index(path, "/", 1).alias("project"), F.regexp_replace(path, "^[^/]*/", "").alias("file"), T.extension(path).alias("ext"), "mtime_secs", "size_bytes", "content")
    return named.filter(~T.should_skip(F.col("content")))


def vault(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Markdown files of a vault, in any case; the project is the vault's name."""
    path = F.col("path")
    found = with_text(raw_files(spark, root).filter(F.lower(T.extension(path)).isin("md", "markdown") & ~T.file_name(path).startswith("_")))
    return found.select(F.lit(name).alias("project"), path.alias("file"), T.extension(path).alias("ext"), "mtime_secs", "size_bytes", "content").filter(~T.should_skip(F.col("content")))


def lint_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Files that lint looks at: md, txt and markdown, reserved folders included."""
    path = F.col("path")
    found = with_text(raw_files(spark, root).filter(F.lower(T.extension(path)).isin("md", "txt", "markdown")))
    return found.select(F.lit("").alias("project"), path.alias("file"), "content")


def sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of source files outside skipped folders."""
    from foliant.operators.code_index import BY_EXTENSION, is_source_path

    path = F.col("path")
    return with_text(raw_files(spark, root).filter(T.extension(path).isin(*BY_EXTENSION) & is_source_path(path))).select("path", "content")


def overlay(*configs: dict | None) -> dict:
    """Fields of the first configuration that has them: project before global before defaults."""
    out: dict = {}
    for c in reversed(configs):
        out.update({k: v for k, v in (c or {}).items() if v is not None})
    return out


def read_config(*texts: str | None) -> dict:
    """TOML texts, most specific first; those that do not parse count as empty."""
    import tomllib

    parsed = []
    for t in texts:
        try:
            parsed.append(tomllib.loads(t or ""))
        except tomllib.TOMLDecodeError:
            parsed.append({})
    return overlay(*parsed)


def ground_truth(spark: SparkSession, text: str) -> DataFrame:
    """(qid, text, relevant_files, project, category, difficulty, relevant_sections) from the TOML of a benchmark."""
    import tomllib

    rows = [
        (i, q["text"], list(q.get("relevant_files", [])), q.get("project"), q.get("category"), q.get("difficulty"), [(s["file"], s["heading"]) for s in q.get("relevant_sections", [])])
        for i, q in enumerate(tomllib.loads(text).get("queries", []))
    ]
    return spark.createDataFrame(rows, "qid int, text string, relevant_files array<string>, project string, category string, difficulty string, relevant_sections array<struct<file:string,heading:string>>")
