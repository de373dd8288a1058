"""Problem 2: source files that do not parse.

A file's tokens are fed to the memoised derivatives of its language's grammar. The first token whose derivative is empty is
the error; a file that ends on a remainder that is not nullable, or inside a comment or literal, is truncated.

What the lexical rules of a language leave to its grammar is decided by derivatives too: a slash in JavaScript starts a
pattern where no division may come; a missing semicolon is inserted where a token has no derivative after a line end or before
a closing brace; two closing angle brackets are tried as one token and as two.

Defined cases: null and empty contents are valid; a null or unknown language is given by the extension; if that
is unknown too, the file is not judged (valid is null); line ends of all kinds count as one; contents are read whole; repeated
rows are judged each for itself (equal contents once per task); other columns are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.keys import Carried
from foliant.llm import lexers
from foliant.llm.derivatives import Grammar
from foliant.llm.grammars import grammar

# fixed values: languages by extension
EXTENSIONS = {
    "py": "Python", "pyi": "Python", "rs": "Rust", "go": "Go", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript",
    "java": "Java", "c": "C", "h": "C",
}
_NAMES = {x.lower(): x for x in EXTENSIONS.values()}
_ANGLES = {">>": (">", ">"), ">>>": (">", ">", ">"), ">=": (">", "="), ">>=": (">", ">", "="), ">>>=": (">", ">", ">", "=")}

Verdict = tuple[bool, str, int]  # valid; reason: '', token, lexical or end; line from 1, 0 if valid


def language_of(language: str | None, path: str | None) -> str | None:
    if language and language.strip().lower() in _NAMES:
        return _NAMES[language.strip().lower()]
    return EXTENSIONS.get((path or "").rsplit(".", 1)[-1].lower()) if "." in (path or "") else None


def _run(g: Grammar, tokens: Iterator[lexers.Token], text: str, angles: bool, start: str | None = None, check: Callable[[str, int], str] | None = None) -> tuple[str, int]:
    state, empty, derive = g.start(start), g.empty, g.derive
    for kind, at, _ in tokens:
        if kind == "FSTR" and check:
            if reason := check(text, at):
                return reason, at
            kind = "STR"
        after = state.memo.get(kind)
        if after is None:
            if kind == lexers.ERROR or kind == lexers.OPEN:
                return ("end" if kind == lexers.OPEN else "lexical"), at
            after = derive(state, kind)
        if angles and kind in _ANGLES:
            other = state
            for one in _ANGLES[kind]:
                other = derive(other, one)
            after = g._alt((after, other))
        if after is empty:
            return "token", at
        state = after
    return ("", -1) if state.null else ("end", len(text))


def _conditional(g: Grammar, tokens: Iterator[lexers.Token], marks: list[tuple[int, str]], text: str) -> tuple[str, int]:
    """The state forks at a conditional: every branch that can be taken is parsed from the state before it, and what follows is
    parsed from the alternative of their ends (and of the state before, where no branch need be taken)."""
    state, empty, derive, k = g.start(), g.empty, g.derive, 0
    forks: list[list] = []  # state before, ends of the branches so far, whether the present one can be taken

    def upto(at: int) -> None:
        nonlocal state, k
        while k < len(marks) and marks[k][0] <= at:
            mark = marks[k][1]
            k += 1
            if mark.startswith("if"):
                forks.append([state, [], mark == "if"])
                continue
            before, ends, taken = forks[-1]
            if taken:
                ends.append(state)
            if mark.startswith("else"):
                state, forks[-1][2] = before, mark == "else"
            else:
                forks.pop()
                state = g._alt(ends if mark == "only" else [*ends, before])

    for kind, at, _ in tokens:
        upto(at)
        if kind == lexers.ERROR or kind == lexers.OPEN:
            return ("end" if kind == lexers.OPEN else "lexical"), at
        state = state.memo.get(kind) or derive(state, kind)
        if state is empty:
            return "token", at
    upto(len(text))
    return ("", -1) if state.null else ("end", len(text))


def _fstring(text: str, at: int) -> str:
    prefix, _, body = lexers.string_at(text, at)
    inner = lexers.fields(body, "r" in prefix)
    if inner is None:
        return "lexical"
    for field in inner:
        if not field.strip():
            return "token"
        source = "(" + field.strip().replace("\n", " ") + ")"
        got, _ = _run(grammar("Python"), lexers.python(source), source, False, "fline", _fstring)
        if got:
            return got
    return ""


def _javascript(g: Grammar, text: str, typed: bool) -> tuple[str, int]:
    stream = lexers.JavaScript(text, typed)
    state, empty, derive, last = g.start(), g.empty, g.derive, ""

    def pattern_may_come() -> bool:
        return derive(state, "/") is empty and derive(state, "/=") is empty

    while (token := stream.next(pattern_may_come)) is not None:
        kind, at, newline = token
        if kind in (lexers.ERROR, lexers.OPEN):
            return ("end" if kind == lexers.OPEN else "lexical"), at
        if newline and (last in ("return", "break", "continue") or kind in ("++", "--")) and (ended := derive(state, "ASI")) is not empty:
            state = ended
        after = state.memo.get(kind) or derive(state, kind)
        if typed and kind in _ANGLES:
            other = state
            for one in _ANGLES[kind]:
                other = derive(other, one)
            after = g._alt((after, other))
        if after is empty and (newline or kind == "}"):
            after = derive(derive(state, "ASI"), kind)
        if after is empty:
            return "token", at
        state, last = after, kind
    return ("", -1) if state.null or derive(state, "ASI").null else ("end", len(text))


def verdict(language: str, content: str | None) -> Verdict:
    """Whether the content is valid in the language; why and where not."""
    text = (content or "").replace("\r\n", "\n").replace("\r", "\n")
    if text.startswith("\ufeff"):
        text = text[1:]
    if not text.strip():
        return True, "", 0
    if language in ("JavaScript", "TypeScript"):
        reason, at = _javascript(grammar(language), text, language == "TypeScript")
    elif language == "Python":
        reason, at = _run(grammar("Python"), lexers.python(text), text, False, None, _fstring)
    elif language == "Go":
        tokens = list(lexers.go(text))
        reason, at = _run(grammar("Go"), iter(tokens), text, False) if tokens else ("", -1)
    elif language == "C":
        reason, at = _conditional(grammar("C"), *lexers.c(text), text)
    else:
        reason, at = _run(grammar(language), {"Java": lexers.java, "Rust": lexers.rust}[language](text), text, True)
    return (True, "", 0) if not reason else (False, reason, text.count("\n", 0, max(at, 0)) + 1)


def judge(df: DataFrame, keys: Sequence[str], language: str, path: str, content: str) -> DataFrame:
    """(keys, language, valid, reason, line) of each file; language is the one it was judged as."""
    carried = Carried(df, keys)
    keys = carried.keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, bytes], Verdict] = {}  # by digest, so that it holds no texts
        for batch in batches:
            rows: list[tuple] = []
            for lang, where, text in zip(batch["_language"], batch["_path"], batch["_content"]):
                lang = language_of(lang, where)
                if lang is None:
                    rows.append((None, None, "", 0))
                    continue
                key = (lang, hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = verdict(lang, text)
                rows.append((lang, *known[key]))
            out = batch[keys].reset_index(drop=True)
            for i, name in enumerate(("language", "valid", "reason", "line")):
                out["_o_" + name] = pd.Series([r[i] for r in rows], dtype="object")
            yield out

    picked = df.select(*carried.cols, F.col(language).alias("_language"), F.col(path).alias("_path"), F.col(content).alias("_content"))
    schema = f"{carried.schema}, _o_language string, _o_valid boolean, _o_reason string, _o_line int"
    return picked.mapInPandas(run, schema).select(*carried.back, *[F.col("_o_" + c).alias(c) for c in ("language", "valid", "reason", "line")])
