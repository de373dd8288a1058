"""Problem 7: cut oversized items into overlapping pieces at natural boundaries.

Every position of a text has a boundary strength (heading, paragraph, line, sentence, clause, word, character). A sparse
table of range maxima over strengths answers, for each piece, which cut in its permissible window is strongest; the key
carries the position below the strength, so ties go to the right. The next piece starts `overlap` characters before the cut.
The table covers a stretch of the text at a time and has levels up to the longest window only, so a text of n characters costs
O(n log limit) time and memory for one stretch, whatever n is. Where the last part of the window offers no boundary better than
a character, all of the window is asked.

Guarantees: every piece has at most `limit` code points; piece k+1 starts exactly `overlap` characters before the end of
piece k; joined without overlaps, the pieces give the text back. No cut parts a CR LF pair, a base character from its
combining marks or joiners, or a pair of regional indicators, unless the window offers nothing else.

Defined cases: null bodies read as '' and, like all bodies within the limit, come out as one piece; an overlap that is
null or negative is 0, one of the limit or more is limit - 1; a null limit or one below 1 does not limit; repeated rows are
split each for itself; extra columns that are not named are left behind.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.keys import Carried

HEADING, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER, INSIDE = 7, 6, 5, 4, 3, 2, 1, 0

# fixed values: punctuation that ends sentences and clauses
SENTENCE_ENDS = ".!?…。！？"
WIDE_ENDS = "。！？"
CLAUSE_ENDS = ",;:–—、，；："
CLOSERS = "\"')]}”’»」』）"


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], dtype=np.uint32)


_LINE_END = re.compile(r"\r\n|[\n\r\u2028\u2029]")
_SOLID = re.compile(r"\S")
_HEADINGS = ("#", "==", r"\section", r"\subsection", r"\chapter", "<h1", "<h2", "<h3")


def _line_starts(text: str) -> Iterator[tuple[int, int]]:
    """(position, strength) of the lines that begin a paragraph or heading, the last cut of a run of blank lines counting."""
    fence, blank_seen, begin, n = False, False, 0, len(text)
    while begin < n:
        m = _LINE_END.search(text, begin)
        end = m.end() if m else n
        solid = _SOLID.search(text, begin, end)
        if solid is None:
            blank_seen = True
        else:
            at = solid.start()
            if text.startswith(("```", "~~~"), at):
                if begin and not fence and blank_seen:
                    yield begin, PARAGRAPH
                fence = not fence
            elif begin and not fence:
                if text.startswith(_HEADINGS, at):
                    yield begin, HEADING
                elif blank_seen:
                    yield begin, PARAGRAPH
            blank_seen = False
        begin = end


class Boundaries:
    """Strengths of the cuts of a text, asked for stretch by stretch with rising starts."""

    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self._lines = _line_starts(text)
        self._known: deque[tuple[int, int]] = deque()  # lines met and not yet passed

    def between(self, lo: int, hi: int) -> np.ndarray:
        """Strengths of a cut before each of the positions lo to hi - 1."""
        text, n = self.text, self.n
        s = np.full(hi - lo, CHARACTER, dtype=np.int8)
        first, last = max(lo, 1), min(hi, n)  # cuts at both ends of the text are plain
        if first >= last:
            return s
        c = max(0, first - 3)  # a cut at i looks at a[i-3] to a[i]
        while c and 0x1F1E6 <= ord(text[c]) <= 0x1F1FF:  # flags pair up from the first of a run
            c -= 1
        a = np.frombuffer(text[c:last].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        i = np.arange(first, last) - c

        def at(values: np.ndarray, back: int) -> np.ndarray:
            """values of the characters `back` places before the one after the cut; nothing before the text."""
            out = values[np.maximum(i - back, 0)]
            out[i < back] = False
            return out

        newline = (a == 10) | (a == 0x2028) | (a == 0x2029)
        newline[:-1] |= (a[:-1] == 13) & (a[1:] != 10)
        space = np.isin(a, _codes(" \t\n\r\f\v\u00a0\u2028\u2029\u3000"))
        ends, closers = np.isin(a, _codes(SENTENCE_ENDS)), np.isin(a, _codes(CLOSERS))
        ended = ends.copy()  # also behind closing quotes and brackets
        ended[1:] |= closers[1:] & ends[:-1]
        inner = s[first - lo : last - lo]
        gap = at(space, 1) & ~at(space, 0)  # the cut comes behind the blank after the mark
        inner[gap] = WORD
        inner[gap & at(np.isin(a, _codes(CLAUSE_ENDS)), 2)] = CLAUSE
        inner[at(np.isin(a, _codes("、，；")), 1)] = CLAUSE
        inner[gap & at(ended, 2)] = SENTENCE
        inner[at(np.isin(a, _codes(WIDE_ENDS)), 1) & ~at(closers, 0)] = SENTENCE
        line = at(newline, 1)
        inner[line] = np.maximum(inner[line], LINE)
        while self._known and self._known[0][0] < lo:
            self._known.popleft()
        while not self._known or self._known[-1][0] < hi:
            entry = next(self._lines, None)
            if entry is None:
                break
            if entry[0] >= lo:
                self._known.append(entry)
        for position, strength in self._known:
            if position < hi:
                s[position - lo] = strength
        inner[at(a == 13, 1) & at(a == 10, 0)] = INSIDE
        if (a > 0x2FF).any():
            joined = np.isin(a, _codes("\u200d\ufe0e\ufe0f")) | ((a >= 0x1F3FB) & (a <= 0x1F3FF))
            marks = np.unique(a[a > 0x2FF])
            marks = marks[[unicodedata.combining(chr(x)) > 0 or unicodedata.category(chr(x)) in ("Mn", "Me", "Mc") for x in marks]]
            joined |= np.isin(a, marks)
            flag = (a >= 0x1F1E6) & (a <= 0x1F1FF)
            parity = np.zeros(len(a), dtype=np.int64)
            for k in np.flatnonzero(flag):
                parity[k] = parity[k - 1] + 1 if k and flag[k - 1] else 1
            inner[at(joined, 0) | at(a == 0x200D, 1) | (at(flag, 0) & (parity[i] % 2 == 0))] = INSIDE
        return s


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..n."""
    return Boundaries(text).between(0, len(text) + 1)


class RangeMax:
    """Sparse table: level j holds the maximum of 2^j neighbours; any range of up to `longest` is two overlapping blocks."""

    def __init__(self, values: np.ndarray, longest: int | None = None):
        self.n = len(values)
        kind = np.int32 if 8 * self.n < 1 << 31 else np.int64
        self.levels = [values.astype(kind) * kind(self.n) + np.arange(self.n, dtype=kind)]
        width = 1
        while 2 * width <= min(self.n, longest or self.n):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: len(last) - width], last[width:]))
            width *= 2

    def best(self, lo: int, hi: int) -> tuple[int, int]:
        """(maximum, the rightmost position of it) in [lo, hi]."""
        j = (hi - lo + 1).bit_length() - 1
        level = self.levels[j]
        return divmod(int(max(level[lo], level[hi - (1 << j) + 1])), self.n)

    def argmax(self, lo: int, hi: int) -> int:
        return self.best(lo, hi)[1]


def cut_points(text: str, limit: int, overlap: int, fill: float = 0.5, stretch: int = 1 << 18) -> list[tuple[int, int]]:
    """Spans of the pieces. The cut is sought in the last (1 - fill) of the permitted length, and in all of it where that offers
    nothing natural. stretch: positions per table, four limits at least."""
    n = len(text)
    if limit < 1 or n <= limit:
        return [(0, n)]
    overlap = min(max(overlap, 0), limit - 1)
    stretch = max(stretch, 4 * limit)
    boundaries = Boundaries(text)
    out, start, base, table = [], 0, 0, None
    while n - start > limit:
        if table is None or start + limit >= base + table.n:
            base = start
            table = RangeMax(boundaries.between(base, min(n + 1, base + stretch)), limit)
        least = start + overlap + 1
        low = min(max(least, start + max(int(limit * fill), 1)), start + limit)
        strength, end = table.best(low - base, start + limit - base)
        if strength <= CHARACTER and least < low:
            wider = table.best(least - base, start + limit - base)
            if wider[0] > strength:
                end = wider[1]
        end += base
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split(df: DataFrame, keys: Sequence[str], text: str, limit: str, overlap: str) -> DataFrame:
    """(keys, piece, start, end, text): piece counts from 0; start and end are code point offsets. Items within their
    limit never leave the JVM."""
    carried = Carried(df, keys)
    keys = carried.keys
    rows = df.select(*carried.cols, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(limit).cast("int").alias("_limit"), F.coalesce(F.col(overlap), F.lit(0)).cast("int").alias("_overlap"))
    large = (F.col("_limit") >= 1) & (F.length("_text") > F.col("_limit"))
    zero = F.lit(0).cast("int")
    small = rows.filter(F.coalesce(~large, F.lit(True))).select(*carried.back, zero.alias("piece"), zero.alias("start"), F.length("_text").alias("end"), F.col("_text").alias("text"))
    schema = f"{carried.schema}, _o_piece int, _o_start int, _o_end int, _o_text string"

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, no, begin, stop, texts = [], [], [], [], []
            for i, (body, most, shared) in enumerate(zip(batch["_text"], batch["_limit"], batch["_overlap"])):
                for k, (a, b) in enumerate(cut_points(body, int(most), int(shared))):
                    at.append(i), no.append(k), begin.append(a), stop.append(b), texts.append(body[a:b])
            out = batch[keys].iloc[at].reset_index(drop=True)
            yield out.assign(_o_piece=no, _o_start=begin, _o_end=stop, _o_text=texts)

    cut = rows.filter(large).mapInPandas(pieces, schema)
    return small.union(cut.select(*carried.back, *[F.col("_o_" + c).alias(c) for c in ("piece", "start", "end", "text")]))
