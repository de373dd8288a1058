"""Chunks of documents. Merging and carrying lines over depends on order, so this is an Arrow-batched Python fold; everything
around it stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

MIN_SECTION = 50
Piece = tuple[str, int]  # text, first line from 1


@dataclass(frozen=True)
class ChunkConfig:
    prose_size: int = 1500
    prose_overlap: int = 300
    code_size: int = 800
    code_overlap: int = 150
    md_heading_max: int = 2400

    @classmethod
    def for_max_tokens(cls, n: int) -> ChunkConfig:
        """Sizes in characters for a model that reads n tokens: three quarters of two characters each, 2000 at most."""
        prose = min(int(n * 1.5), 2000)
        code = int(prose * 0.6)
        return cls(prose, int(prose * 0.2), code, int(code * 0.2), int(prose * 1.3))


def sizes_for_tokens(n: Column) -> dict[str, Column]:
    """ChunkConfig.for_max_tokens as columns."""
    prose = F.least(F.floor(n * 1.5), F.lit(2000)).cast("int")
    code = F.floor(prose * 0.6).cast("int")
    return {"prose_size": prose, "prose_overlap": F.floor(prose * 0.2).cast("int"), "code_size": code, "code_overlap": F.floor(code * 0.2).cast("int"), "md_heading_max": F.floor(prose * 1.3).cast("int")}


def split_lines(text: str) -> list[str]:
    out = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    if out and not out[-1]:
        out.pop()
    return out


def windows(lines: list[str], size: int, overlap: int, first: int = 1) -> list[Piece]:
    """Windows of whole lines. A line costs its characters and one; a window closes before it would exceed the size. The next
    starts with the fewest last lines that reach the overlap; if all of them do not, with none."""
    out: list[Piece] = []
    begin, cost = 0, 0
    for i, line in enumerate(lines):
        price = len(line) + 1
        if i > begin and cost + price > size:
            out.append(("\n".join(lines[begin:i]), first + begin))
            carried, start = 0, i
            for j in range(i - 1, begin - 1, -1):
                carried += len(lines[j]) + 1
                if carried >= overlap:
                    start = j
                    break
            begin, cost = start, carried if start < i else 0
        cost += price
    if lines:
        out.append(("\n".join(lines[begin:]), first + begin))
    return out


def sections(text: str, cfg: ChunkConfig) -> list[Piece]:
    """Sections at second-level headings, short ones joined with what follows, long ones cut into windows under their heading."""
    lines = split_lines(text)
    heads = [i for i, x in enumerate(lines) if x.lstrip().startswith("## ")]
    if not heads:
        return windows(lines, cfg.prose_size, cfg.prose_overlap)
    bounds = sorted({0, *heads, len(lines)})
    joined: list[list] = []  # [first line from 0, heading, text]
    open_ = False  # the last entry is still too short
    for a, b in zip(bounds, bounds[1:]):
        heading = lines[a].lstrip()[3:].strip() if a in heads else ""
        body = "\n".join(lines[a:b])
        if open_:
            last = joined[-1]
            last[1] = last[1] or heading
            last[2] = f"{last[2]}\n{body}" if last[2] and body else last[2] or body
        else:
            joined.append([a, heading, body])
        open_ = len(joined[-1][2]) < MIN_SECTION
    if open_ and len(joined) > 1:
        rest = joined.pop()
        joined[-1][2] = f"{joined[-1][2]}\n{rest[2]}" if joined[-1][2] else rest[2]
    out: list[Piece] = []
    for at, heading, body in joined:
        if len(body) <= cfg.md_heading_max:
            out.append((body, at + 1))
            continue
        for piece, line in windows(split_lines(body), cfg.prose_size, cfg.prose_overlap, at + 1):
            out.append((f"## {heading}\n{piece}" if heading and not piece.startswith("## ") else piece, line))
    return out


def pieces(text: str | None, ext: str | None, cfg: ChunkConfig) -> list[Piece]:
    if not text:
        return []
    if ext in ("md", "markdown"):
        return sections(text, cfg) or [(text, 1)]
    code = ext in T.CODE_EXTENSIONS
    return windows(split_lines(text), cfg.code_size if code else cfg.prose_size, cfg.code_overlap if code else cfg.prose_overlap)


def chunk(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """(project, file, ext, content) -> one row per chunk: project, file, filename, title, chunk_id, body, line_start."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [pieces(t, e, cfg) for t, e in zip(b["content"], b["ext"])]
            at = [i for i, g in enumerate(got) for _ in g]
            yield pd.DataFrame({
                "project": b["project"].iloc[at].to_numpy(), "file": b["file"].iloc[at].to_numpy(),
                "chunk_id": [k for g in got for k in range(len(g))], "body": [p[0] for g in got for p in g], "line_start": [p[1] for g in got for p in g],
            })

    rows = docs.select(T.text("project").alias("project"), T.text("file").alias("file"), "ext", "content")
    out = rows.mapInPandas(run, "project string, file string, chunk_id long, body string, line_start long")
    return out.select("project", "file", T.stem(F.col("file")).alias("filename"), T.title(F.col("body"), F.col("file"), F.col("chunk_id")).alias("title"), "chunk_id", "body", "line_start")
