"""Problem 10: how demanding a text is to read.

Prose is what remains without front matter, headings, code, tables, quotes' and lists' marks. Words, sentences and
syllables feed five classic formulas (Flesch-Kincaid, Gunning fog, SMOG, automated readability, Coleman-Liau); the grade
of a text is their median, so no single formula's weakness decides. Thresholds between the levels of a labelled sample are
fitted to the sample's grades: each lies where it parts the two neighbouring levels with the fewest errors, in the middle
of the widest such gap.

Syllables follow hyphenation-style rules: vowel groups, silent endings, hiatus pairs, and syllabic endings.

Defined cases: null, empty and word-free texts, and texts in scripts without word spaces, have a null grade and level;
repeated rows are graded each for itself; very long texts are read whole; other columns are left behind.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.keys import Carried

# fixed values: abbreviations whose full stop does not end a sentence
ABBREVIATIONS = frozenset(
    "al approx art ca cf ch chap chs co corp dept dr ed eds e.g eg eq eqs est etc fig figs i.e ie inc jan feb mar apr jun jul aug sep sept oct nov dec jr "
    "lit ltd messrs mr mrs ms no nos op p par pp prof ref refs resp sec sect sects sr st supp tab trans v viz vol vols vs".split()
)
# abbreviations that often stand last in a sentence: before a capital they end it
LAST = frozenset("etc al inc ltd co corp jr sr".split())

_FRONT = re.compile(r"\A\ufeff?---[ \t]*\r?\n.*?^(?:---|\.\.\.)[ \t]*\r?$\n?", re.S | re.M)
_FENCE = re.compile(r"^[ \t]*(?:[-*+>][ \t]+)*(`{3,}|~{3,})[^\n]*\n.*?(?:^[ \t>]*\1[`~]*[ \t]*$|\Z)", re.S | re.M)
_MARKUP_CODE = re.compile(r"<(pre|code|script|style)\b[^>]*>.*?</\1>|<!--.*?-->|\\begin\{(?:verbatim|lstlisting|equation|align)\*?\}.*?\\end\{[a-z]+\*?\}|\$\$.*?\$\$", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z](?:[^<>\n]|\n(?![ \t\r]*\n))*>")
_INLINE = re.compile(r"(`+)(?:(?!\1).)+?\1(?!`)")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_URL = re.compile(r"\b(?:https?|ftp)://\S+|\bwww\.\S+")
_HEADING = re.compile(r"^[ \t]{0,3}#{1,6}(?:[ \t]|$)|^=+[^=\n].*=+[ \t]*$|^\\(?:sub)*section\*?\{")
_RULE = re.compile(r"^[ \t]*(?:={3,}|-{3,}|\*{3,}|_{3,}|~{3,}|\^{3,})[ \t]*$")
_LIST = re.compile(r"^[ \t]*(?:[-*+•‣◦–]|\(?\d{1,3}[.)]|\(?[a-z][.)])[ \t]+(?:\[[ xX]\][ \t]+)?")
_TABLE = re.compile(r"^[ \t]*\|.*\||^[ \t]*[:|+-]{3,}[ \t]*$|^[^|\n]+\|[^|\n]+\|")
_SETTING = re.compile(r"^[ \t]*(?:export[ \t]+)?[\w.\-\[\]]+[ \t]*(?:=|:=)[ \t]*\S[^.!?]*$|^[ \t]*[\w.-]+:[ \t]*(?:[\w./-]+|\"[^\"]*\")?[ \t]*$")
_INDENTED = re.compile(r"^(?: {4,}|\t)\S")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_STOP = re.compile(r"([.!?…]+)[\"'”’)\]]*(\s+)(?=[\"'“‘(\[]*(.))")
_WIDE = re.compile(r"[\u3040-ヿ㐀-鿿가-\ud7af]")


def prose(text: str) -> list[str]:
    """Paragraphs of running text; each list entry is a paragraph of its own."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _FRONT.sub("", text, count=1)
    text = _FENCE.sub("\n\n", text)
    text = _MARKUP_CODE.sub(" ", text)
    text = _INLINE.sub(" ", _LINK.sub(r"\1", _URL.sub(" ", text)))
    text = _TAG.sub(" ", text)
    out: list[str] = []
    open_: list[str] = []
    lines = text.split("\n")

    def close() -> None:
        if open_:
            out.append(" ".join(open_))
            open_.clear()

    after_blank = True
    for i, line in enumerate(lines):
        bare = line.strip()
        below = lines[i + 1].strip() if i + 1 < len(lines) else ""
        underlined = bool(bare) and len(below) >= 3 and _RULE.match(below) and after_blank and below[0] in "=-~^" and not _LIST.match(line)
        if not bare or underlined or _RULE.match(line) or _HEADING.match(line) or _TABLE.match(line) or _SETTING.match(line):
            close()
        elif _INDENTED.match(line) and (after_blank or not open_) and not _LIST.match(line):
            close()
        else:
            bare = bare.lstrip("> \t")
            if mark := _LIST.match(bare):
                close()
                bare = bare[mark.end() :]
            open_.append(bare.replace("**", "").replace("__", ""))
        after_blank = not bare
    close()
    return out


def sentences(paragraph: str) -> int:
    """Sentence count; a paragraph with words has at least one."""
    count, last = 0, 0
    for m in _STOP.finditer(paragraph):
        before = paragraph[last : m.start()]
        if m[1] == ".":
            word = before.rsplit(None, 1)[-1].lstrip("(\"'[“‘") if before.strip() else ""
            low = word.lower()
            if low in ABBREVIATIONS and not (low in LAST and m[3].isupper()) or (len(word) == 1 and word.isupper() and word != "I"):
                continue
        if m[3].islower():
            continue
        if _WORD.search(before):
            count += 1
            last = m.end()
    return count + bool(_WORD.search(paragraph[last:]))


_GROUPS = re.compile(r"[aeiouyàâäáãåæéèêëíìîïóòôöõøœúùûüýÿ]+")
_SILENT = re.compile(r"(?:[^aeiouy]e|[^aeiouytd]ed|[^aeiouyszxcgh]es|[^aeiouy](?:ely|efuls?|eness|eless|ements?))$")
_SYLLABIC = re.compile(r"[^aeiouy]les?$|[^aeiouy]led$")
_HIATUS = re.compile(r"ia(?!l|n\b)|[dnrv]ial|io(?!n|us)|iu|eo(?!u|p)|hier|nuit|[dr]ea$|ua[lt]|uou|ying|[aeiou]ing|dien|ie[tr]\b|iet|[^q]ua(?!r)|creat|scien")


@lru_cache(maxsize=200_000)
def syllables(word: str) -> int:
    """At least one; parts around hyphens and apostrophes count for themselves."""
    word = word.lower()
    if "-" in word:
        return sum(syllables(p) for p in word.split("-") if p) or 1
    word = re.sub(r"['’].*$", "", word)
    n = len(_GROUPS.findall(word))
    if n > 1 and _SILENT.search(word) and not _SYLLABIC.search(word):
        n -= 1
    n += len(_HIATUS.findall(word))
    if re.search(r"[^aeiou]sms?$|thms?$", word):
        n += 1
    return max(1, n)


def measures(text: str | None) -> tuple[int, int, int, float | None]:
    """(words, sentences, syllables, median grade)."""
    if not text:
        return 0, 0, 0, None
    parts = [p for p in prose(text) if p]
    words = [w for p in parts for w in _WORD.findall(p)]
    n = len(words)
    if not n or sum(map(len, (w for w in words if _WIDE.search(w)))) * 2 > sum(map(len, words)):
        return n, 0, 0, None
    s = max(1, sum(map(sentences, parts)))
    each = [syllables(w) for w in words]
    syl, complex_, letters = sum(each), sum(x > 2 for x in each), sum(map(len, words))
    wps = n / s
    grades = (
        0.39 * wps + 11.8 * syl / n - 15.59,
        0.4 * (wps + 100 * complex_ / n),
        1.043 * math.sqrt(complex_ * 30 / s) + 3.1291,
        4.71 * letters / n + 0.5 * wps - 21.43,
        5.88 * letters / n - 29.6 * s / n - 15.8,
    )
    return n, s, syl, float(median(grades))


def thresholds(samples: Sequence[tuple[str, int]]) -> dict[int, float]:
    """level -> least grade of that level, for every level but the lowest."""
    graded = sorted((g, level) for text, level in samples if (g := measures(text)[3]) is not None and level is not None)
    levels = sorted({x for _, x in graded})
    out = {}
    for below, level in zip(levels, levels[1:]):
        own = [(g, x) for g, x in graded if x in (below, level)]
        best = None
        for i in range(1, len(own)):
            wrong = sum(x >= level for _, x in own[:i]) + sum(x < level for _, x in own[i:])
            key = (wrong, own[i - 1][0] - own[i][0])
            if best is None or key < best[0]:
                best = (key, (own[i - 1][0] + own[i][0]) / 2)
        if best:
            out[level] = best[1]
    return out


def grade(df: DataFrame, key: str, text: str, samples: Sequence[tuple[str, int]]) -> DataFrame:
    """(key, words, sentences, syllables, grade, level). samples: the labelled passages, a small fixed table."""
    carried = Carried(df, [key])
    steps = sorted(thresholds(samples).items())
    lowest = min((x for _, x in samples if x is not None), default=1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [measures(t) for t in batch["_t"]]
            out = pd.DataFrame(rows, columns=["words", "sentences", "syllables", "grade"])
            out["grade"] = out["grade"].astype("float64").round(4)
            out.insert(0, key, batch[key].to_numpy())
            yield out

    rows = df.select(*carried.cols, F.col(text).alias("_t")).mapInPandas(run, f"{carried.schema}, words int, sentences int, syllables int, grade double")
    value = F.when(F.isnan("grade"), None).otherwise(F.col("grade"))
    level = F.lit(lowest)
    for at, least in steps:
        level = F.when(F.col("grade") >= least, at).otherwise(level)
    out = rows.withColumn("grade", value).withColumn("level", F.when(F.col("grade").isNotNull(), level).cast("int"))
    return out.select(*carried.back, "words", "sentences", "syllables", "grade", "level")
