"""Token streams of the seven languages: (kind, offset, newline before). Keywords and operators are their own kinds. What no
token can start, and literals or comments that do not end, come as the kinds ERROR and OPEN; OPEN is a truncation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from foliant.llm import grammars as g

Token = tuple[str, int, bool]
ERROR, OPEN = "ERROR", "OPEN"

_ID = r"[^\W\d]\w*"


def _operators(*names: str) -> str:
    return "|".join(re.escape(x) for x in sorted(names, key=lambda x: (-len(x), x)))


class Regular:
    """Tokens of a language whose lexical grammar is regular, one match each with the blanks before it. In the token pattern
    groups name the kinds, 'op' and 'id' stand for themselves; words: kinds of identifiers that are no names."""

    def __init__(self, space: str, token: str, words: Iterable[str], same: dict[str, str] | None = None, lines: bool = False, number: re.Pattern | None = None):
        self.scan = re.compile(f"(?:{space})(?:{token})", re.S | re.M)
        self.space = re.compile(space, re.S | re.M)
        self.kinds = {w: w for w in words} | (same or {})
        self.lines, self.number = lines, number

    def __call__(self, text: str) -> Iterator[Token]:
        pos, kinds, lines, number = 0, self.kinds, self.lines, self.number
        for m in iter(self.scan.scanner(text).match, None):
            kind = m.lastgroup
            at = m.start(kind)
            newline = lines and at > pos and text.find("\n", pos, at) >= 0
            if kind == "id":
                kind = kinds.get(m["id"], "NAME")
            elif kind == "op":
                kind = m["op"]
                if kind == "/" and text.startswith("/*", at):
                    break
            elif number and kind == "NUM" and not number.match(m["NUM"]):
                kind = ERROR
            yield kind, at, newline
            pos = m.end()
        blank = self.space.match(text, pos)
        if blank.end() < len(text):
            yield (OPEN if _unfinished(text, blank.end()) else ERROR), blank.end(), "\n" in blank[0]


def _unfinished(text: str, pos: int) -> bool:
    """A comment or literal that starts here and has no end before the end of the text."""
    return text.startswith(("/*", '"', "'", "`", 'r"', "r#", 'b"'), pos) and (text[pos] in "/`r" or "\n" not in text[pos:].rstrip("\n"))


_ESC = r"(?:[^\\\n{q}]|\\(?:.|\n))"


def _quoted(q: str, many: str = "*") -> str:
    return q + _ESC.replace("{q}", q) + many + q


_C_SPACE = r"(?:[ \t\n\f\v]++|\\\n|//(?:[^\n\\]|\\(?:.|\n))*+|/\*.*?\*/)*+"
_C_TOKEN = (
    rf"(?P<STR>(?:u8|[uUL])?{_quoted('\"')})|(?P<CHAR>[uUL]?{_quoted("'", '+')})|(?P<NUM>\.?[0-9](?:[eEpP][+-]|[0-9A-Za-z_.])*)|(?P<id>{_ID})"
    rf"|(?P<op>{_operators('...', '->', '++', '--', *g.C_BIN, *g.C_ASSIGN, '~', '!', '.', ',', ';', ':', '?', '(', ')', '[', ']', '{', '}')})"
)
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)((?:[^\n\\]|\\(?:.|\n))*)", re.M)
_C_COMMENT_OR_STRING = re.compile(r"//(?:[^\n\\]|\\(?:.|\n))*|/\*.*?\*/|" + _quoted('"') + "|" + _quoted("'", "+"), re.S)
_C_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F]*\.?[0-9a-fA-F]*(?:[pP][+-]?\d+)?|0[bB][01]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[uUlLfF]*\Z")


_PLUS = re.compile(r"#?[ \t]*(?:defined[ \t]*\(?[ \t]*__cplusplus[ \t]*\)?|__cplusplus)[ \t]*\Z")


def preprocess(text: str) -> tuple[str, list[tuple[int, str]], int]:
    """Text with its directives and the branches that can never be taken (#if 0, what follows #if 1, C++) blanked out; the
    conditionals as (offset, 'if', 'else', 'endif', or 'only' for the end of one of which a branch must be taken); and where an
    unbalanced one stands, else -1. Of all other branches every one is kept."""
    masked = _C_COMMENT_OR_STRING.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0].replace("#", " "), text) if "#" in text else ""
    out, pos, marks = [], 0, []
    stack: list[list] = []  # offset, this branch can be taken, a branch must have been taken, else was seen, the whole can be reached
    for m in _DIRECTIVE.finditer(masked):
        part, live = text[pos : m.start()], not stack or stack[-1][1] and stack[-1][4]
        out.append(part if live else re.sub(r"[^\n]", " ", part))
        name, rest = m[1], m[2].strip()
        if name in ("if", "ifdef", "ifndef"):
            plus = bool(_PLUS.match(rest))
            never = name == "if" and rest == "0" or plus and name != "ifndef"
            always = name == "if" and rest == "1" or plus and name == "ifndef"
            stack.append([m.start(), not never, always, False, live])
            if live:
                marks.append((m.start(), "if" if not never else "if never"))
        elif name in ("elif", "else", "endif"):
            if not stack or name != "endif" and stack[-1][3]:
                return text, marks, m.start()
            top = stack[-1]
            if name == "endif":
                stack.pop()
                if top[4]:
                    marks.append((m.start(), "only" if top[2] else "endif"))
            else:
                never = top[2] or name == "elif" and rest == "0"
                if top[4]:
                    marks.append((m.start(), "else never" if never else "else"))
                top[1] = not never
                top[2] = top[2] or name == "else" or name == "elif" and rest == "1"
                top[3] = name == "else"
        elif name not in ("", "define", "undef", "include", "line", "error", "pragma", "warning", "include_next", "ident") and live and not name.isdigit():
            return text, marks, m.start()
        out.append(re.sub(r"[^\n]", " ", text[m.start() : m.end()]))
        pos = m.end()
    if not out:
        return text, marks, -1
    part = text[pos:]
    out.append(part if not stack or stack[-1][1] and stack[-1][4] else re.sub(r"[^\n]", " ", part))
    return "".join(out), marks, (stack[-1][0] if stack else -1)


_C = Regular(_C_SPACE, _C_TOKEN, (*g.C_WORDS, "asm", "__asm__", "__asm", "__attribute__"), {"__inline": "inline", "__inline__": "inline", "__restrict": "restrict", "__const": "const"}, number=_C_NUMBER)


def c(text: str) -> tuple[Iterator[Token], list[tuple[int, str]]]:
    """Tokens of all branches that can be taken, and the conditionals they stand in."""
    plain, marks, broken = preprocess(text)

    def tokens() -> Iterator[Token]:
        for token in _C(plain):
            if 0 <= broken < token[1] and not text.startswith("#if", broken):
                break
            yield token
        if broken >= 0:
            yield OPEN if text[broken:].lstrip(" \t").startswith("#") and re.match(r"[ \t]*#[ \t]*if", text[broken:]) else ERROR, broken, True

    return tokens(), marks


_GO_SPACE = r"(?:[ \t\n]++|//[^\n]*+|/\*.*?\*/)*+"
_GO_NUMBER = r"0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?i?"
_GO_TOKEN = (
    rf"(?P<NUM>(?:{_GO_NUMBER})(?![\w]))|(?P<STR>\"(?:[^\"\\\n]|\\[^\n])*\"|`[^`]*`)|(?P<CHAR>'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}))')|(?P<id>{_ID})"
    rf"|(?P<op>{_operators('...', '<-', '++', '--', ':=', '&^=', '&^', *g.C_BIN, *g.C_ASSIGN, '~', '!', '.', ',', ';', ':', '(', ')', '[', ']', '{', '}')})"
)
_GO_ENDS = frozenset(("NAME", "NUM", "STR", "CHAR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))


_GO = Regular(_GO_SPACE, _GO_TOKEN, g.GO_WORDS, lines=True)


def go(text: str) -> Iterator[Token]:
    """With the semicolons that line ends stand for; one before a closing bracket may be left out."""
    last = ""
    for kind, at, newline in _GO(text):
        if newline and last in _GO_ENDS:
            yield ";", at, True
            last = ";"
        yield kind, at, newline
        last = kind
    if last in _GO_ENDS:
        yield ";", len(text), True


_JAVA_SPACE = r"(?:[ \t\n\f]++|//[^\n]*+|/\*.*?\*/|\x1a\Z)*+"
_JAVA_TOKEN = (
    rf"(?P<STR>\"\"\"[ \t\f]*\n(?:[^\\]|\\(?:.|\n))*?\"\"\"|\"(?:[^\"\\\n]|\\(?:[btnfrs0-7\"'\\]|u+[0-9a-fA-F]{{4}}))*\")|(?P<CHAR>'(?:[^'\\\n]|\\(?:[btnfrs\"'\\]|[0-7]{{1,3}}|u+[0-9a-fA-F]{{4}}))')"
    rf"|(?P<NUM>(?:0[xX](?:[0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?[0-9_]+[fFdD]?|[0-9a-fA-F_]+[lL]?)|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[fFdDlL]?)(?![\w]))|(?P<id>(?:[^\W\d]|\$)(?:\w|\$)*)"
    rf"|(?P<op>{_operators('...', '->', '::', '++', '--', '>>>=', '>>>', *g.C_BIN, *g.C_ASSIGN, '~', '!', '.', ',', ';', ':', '?', '@', '(', ')', '[', ']', '{', '}')})"
)


java = Regular(_JAVA_SPACE, _JAVA_TOKEN, (*g.JAVA_HARD, *g.JAVA_SOFT))


_RUST_TOKEN = re.compile(
    r"(?P<LIT>b?'(?:[^'\\\n\t]|\\(?:[nrt\\0'\"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))'|(?:0x[0-9a-fA-F_]+|0o[0-7_]+|0b[01_]+|[0-9][0-9_]*(?:\.(?![._A-Za-z])[0-9_]*)?(?:[eE][+-]?[0-9_]+)?)(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w))"
    r"|(?P<STR>b?r(#*)\"(?:.|\n)*?\"\3(?!#)|b?\"(?:[^\"\\]|\\(?:[nrt\\0'\"\n]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))*\")|(?P<LIFETIME>'[^\W\d]\w*(?!'))|(?P<id>(?:r#)?[^\W\d]\w*)"
    rf"|(?P<op>{_operators(*(x for x in g.RUST_OPERATORS))})"
)
_RUST_BLANK = re.compile(r"(?:\s++|//[^\n]*+)*+")


_RUST_WORDS = {w: w for w in (*g.RUST_HARD, *g.RUST_SOFT)} | {"_": "_"}
_RUST_NEXT = re.compile(f"{_RUST_BLANK.pattern}(?!/\\*)(?:{_RUST_TOKEN.pattern})")


def rust(text: str) -> Iterator[Token]:
    """Block comments nest, so they are skipped by hand."""
    words, pos, n, match = _RUST_WORDS, 0, len(text), _RUST_NEXT.match
    if text.startswith("#!") and not re.match(r"#!\s*\[", text):
        pos = (text + "\n").index("\n")
    while True:
        m = match(text, pos)
        if not m:
            pos = _RUST_BLANK.match(text, pos).end()
            if text.startswith("/*", pos):
                start, depth = pos, 0
                for m in re.compile(r"/\*|\*/").finditer(text, pos):
                    depth += 1 if m[0] == "/*" else -1
                    if not depth:
                        pos = m.end()
                        break
                if depth:
                    yield OPEN, start, False
                    return
                continue
            if pos < n:
                yield (OPEN if text[pos] == '"' or text.startswith(('r"', "r#", 'b"'), pos) else ERROR), pos, False
            return
        kind = m.lastgroup
        if kind == "id":
            lexeme = m["id"]
            yield words.get(lexeme, "NAME"), m.start("id"), False
        elif kind == "op":
            yield m["op"], m.start("op"), False
        else:
            kind = "STR" if m["STR"] is not None else "LIT" if m["LIT"] is not None else kind
            yield kind, m.start(kind), False
        pos = m.end()


_JS_SPACE = re.compile(r"(?:[\s\ufeff]++|//[^\n\u2028\u2029]*+|/\*.*?\*/|<!--[^\n]*+|^-->[^\n]*+)*+", re.S | re.M)
_TS_SPACE = re.compile(r"(?:[\s\ufeff]++|//[^\n\u2028\u2029]*+|/\*.*?\*/)*+", re.S)
_JS_OPERATORS = _operators("...", "=>", "?.", "++", "--", "**", "===", "!==", "??", ">>>", *g.JS_ASSIGN, *g.C_BIN, "~", "!", ".", ",", ";", ":", "?", "@", "(", ")", "[", "]", "{", "}")
_JS_TOKEN = re.compile(
    rf"(?P<STR>\"(?:[^\"\\\n]|\\(?:.|\n))*\"|'(?:[^'\\\n]|\\(?:.|\n))*')|(?P<NUM>(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|[0-9][0-9_]*n|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)(?![\w$]))"
    rf"|(?P<id>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})*)|(?P<PRIVATE>#(?:[^\W\d]|\$)[\w$]*)|(?P<op>\?\.(?![0-9])|{_JS_OPERATORS.replace(re.escape('?.') + '|', '')})"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?:.|\n)|\$(?!\{))*(`|\$\{)", re.S)


_JS_WORDS = {w: w for w in (*g.JS_HARD, *g.JS_SOFT)}


_JS_TABLES = [(x, re.compile(f"(?:{x.pattern})(?![`/])(?:{_JS_TOKEN.pattern})", re.S | re.M)) for x in (_JS_SPACE, _TS_SPACE)]


class JavaScript:
    """Tokens on demand: whether a slash divides or starts a pattern only the parser knows."""

    def __init__(self, text: str, typed: bool):
        self.text, self.pos, self.words = text, 0, _JS_WORDS
        self.space, self.quick = _JS_TABLES[typed]
        self.braces: list[bool] = []  # for every open brace: does it belong to a template?
        if text.startswith("#!"):
            self.pos = (text + "\n").index("\n")

    def _template(self, start: int, head: bool) -> str:
        m = _JS_TEMPLATE.match(self.text, start)
        if not m:
            self.pos = len(self.text)
            return OPEN
        self.pos = m.end()
        if m[1] == "`":
            return "TEMPLATE" if head else "TTAIL"
        self.braces.append(True)
        return "THEAD" if head else "TMIDDLE"

    def next(self, pattern_may_come) -> Token | None:
        text, pos = self.text, self.pos
        m = self.quick.match(text, pos)
        if m:  # blanks and a token that depends on nothing
            kind = m.lastgroup
            at = m.start(kind)
            newline = at > pos and ("\n" in (gap := text[pos:at]) or "\u2028" in gap or "\u2029" in gap)
            if kind == "id":
                self.pos = m.end()
                return self.words.get(m["id"], "NAME"), at, newline
            if kind != "op":
                self.pos = m.end()
                return kind, at, newline
            lexeme = m["op"]
            if lexeme == "{":
                self.braces.append(False)
            elif lexeme == "}" and self.braces and self.braces.pop():
                return self._template(at + 1, False), at, newline
            self.pos = m.end()
            return lexeme, at, newline
        m = self.space.match(text, pos)
        self.pos = at = m.end()
        newline = at > pos and ("\n" in (gap := m[0]) or "\u2028" in gap or "\u2029" in gap)
        if at >= len(text):
            return None
        ch = text[at]
        if ch == "`":
            return self._template(at + 1, True), at, newline
        if ch == "/":
            if text.startswith("/*", at):
                return OPEN, at, newline
            if pattern_may_come() and (m := _JS_REGEX.match(text, at)):
                self.pos = m.end()
                return "REGEX", at, newline
            if m := _JS_TOKEN.match(text, at):
                self.pos = m.end()
                return m[0], at, newline
        return (OPEN if ch in "\"'" and "\n" not in text[at:].rstrip("\n") else ERROR), at, newline


_PY_NUMBER = r"0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
_PY_OPERATORS = _operators("...", "->", ":=", "**", "==", "!=", "<=", ">=", "<", ">", "=", "~", ".", ",", ":", ";", "(", ")", "[", "]", "{", "}", *g.PYTHON_BIN, *g.PYTHON_AUG)
_PY_STRING = re.compile(r"(?i:([rbuf]{0,2}))('''|\"\"\"|'|\")")
_PY_TOKEN = rf"(?P<str>(?i:[rbuf]{{0,2}})(?:'''|\"\"\"|'|\"))|(?P<NUM>{_PY_NUMBER})|(?P<id>{_ID})|(?P<op>{_PY_OPERATORS})"
_PY_ENDS = {q: re.compile(rf"(?:[^\\]|\\(?:.|\n))*?{q}", re.S) if len(q) == 3 else re.compile(rf"(?:[^\\\n{q}]|\\(?:.|\n))*{q}") for q in ("'''", '"""', "'", '"')}
_PY_PREFIXES = frozenset(("", "r", "b", "u", "f", "rb", "br", "rf", "fr"))
_PY_BLANK = re.compile(r"(?:[ \t\f]++|\\\n)*+(?:#[^\n]*+)?+")
_PY_NEXT = re.compile(f"{_PY_BLANK.pattern}(?:(?P<end>\\n)|{_PY_TOKEN})")
_PY_LEAD = re.compile(r"[ \t\f]*")
_BRACKETS = {")": "(", "]": "[", "}": "{"}


_PY_WORDS = frozenset((*g.PYTHON_HARD, *g.PYTHON_SOFT))
_PY_NAME = re.compile(_ID)
_PY_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|or|not)\b")


def python(text: str) -> Iterator[Token]:
    """With NEWLINE, INDENT and DEDENT. F-strings come as STR; their fields are checked by the caller through fields()."""
    words, step = _PY_WORDS, _PY_NEXT.match
    pos, n, indents, open_, fresh = 0, len(text), [("", 0, 0)], [], True
    if text.startswith("\ufeff"):
        pos = 1
    while True:
        if fresh and not open_:
            lead = _PY_LEAD.match(text, pos)
            at = lead.end()
            if at >= n:
                break
            if text[at] in "#\n":
                pos = at if text[at] == "\n" else (text.find("\n", at) if text.find("\n", at) >= 0 else n)
                if pos < n:
                    pos += 1
                    continue
            elif not (text[at] == "\\" and text[at + 1 : at + 2] == "\n" and lead[0] == ""):
                blank = lead[0].rpartition("\f")[2]
                wide, narrow = len(blank.expandtabs(8)), len(blank.replace("\t", " "))
                _, w0, n0 = indents[-1]
                if wide == w0:
                    if narrow != n0:
                        yield ERROR, at, True
                        return
                elif wide > w0:
                    if narrow <= n0:
                        yield ERROR, at, True
                        return
                    indents.append((blank, wide, narrow))
                    yield "INDENT", at, True
                else:
                    while indents[-1][1] > wide:
                        indents.pop()
                        yield "DEDENT", at, True
                    if indents[-1][1] != wide or indents[-1][2] != narrow:
                        yield ERROR, at, True
                        return
                pos = at
            fresh = False
        m = step(text, pos)
        if not m:
            pos = _PY_BLANK.match(text, pos).end()
            if pos < n:
                yield ERROR, pos, False
                return
            break
        kind = m.lastgroup
        pos = m.start(kind)
        if kind == "id":
            lexeme = m["id"]
            yield (lexeme if lexeme in words else "NAME"), pos, False
        elif kind == "op":
            lexeme = m["op"]
            if lexeme in "([{":
                open_.append(lexeme)
            elif lexeme in _BRACKETS:
                if not open_ or open_.pop() != _BRACKETS[lexeme]:
                    yield ERROR, pos, False
                    return
            yield lexeme, pos, False
        elif kind == "end":
            pos += 1
            if not open_:
                yield "NEWLINE", pos - 1, False
                fresh = True
            continue
        elif kind == "str":
            m = _PY_STRING.match(text, pos)
            prefix = m[1].lower()
            if prefix not in _PY_PREFIXES:
                m = _PY_NAME.match(text, pos)  # a name right before a quote
                yield (m[0] if m[0] in words else "NAME"), pos, False
                pos = m.end()
                continue
            end = _PY_ENDS[m[2]].match(text, m.end())
            if not end:
                yield (OPEN if len(m[2]) == 3 or "\n" not in text[pos:] else ERROR), pos, False
                return
            yield ("FSTR" if "f" in prefix else "STR"), pos, False
            m = end
        else:
            number = m["NUM"]
            if number[0] == "0" and re.match(r"0\d*[1-9]\d*\Z|0_?[0-9_]*[1-9]", number) and number.replace("_", "").isdigit():
                yield ERROR, pos, False
                return
            if text[m.end() : m.end() + 1].isalnum() and not _PY_AFTER_NUMBER.match(text, m.end()):
                yield ERROR, pos, False
                return
            yield "NUM", pos, False
        pos = m.end()
    if open_:
        yield OPEN, n, False
        return
    if not fresh:
        yield "NEWLINE", n, False
    for _ in indents[1:]:
        yield "DEDENT", n, False


def string_at(text: str, at: int) -> tuple[str, str, str]:
    """(prefix, quotes, body) of the string literal at an offset."""
    m = _PY_STRING.match(text, at)
    end = _PY_ENDS[m[2]].match(text, m.end())
    return m[1].lower(), m[2], text[m.end() : end.end() - len(m[2])]


def fields(body: str, raw: bool, depth: int = 0) -> list[str] | None:
    """Expressions of an f-string's replacement fields, those of nested format specifications too; None if malformed."""
    out, i, n = [], 0, len(body)
    while i < n:
        ch = body[i]
        if ch == "\\" and not raw:
            if body.startswith("\\N{", i):
                i = body.find("}", i) + 1 or n
            else:
                i += 2
        elif ch == "{":
            if body.startswith("{{", i) and not depth:
                i += 2
                continue
            start, stack, j, quote = i + 1, [], i + 1, ""
            while j < n:
                x = body[j]
                if quote:
                    if body.startswith(quote, j):
                        j, quote = j + len(quote) - 1, ""
                elif x in "'\"":
                    quote = x * 3 if body.startswith(x * 3, j) else x
                    j += len(quote) - 1
                elif x == "\\" or x == "#":
                    return None  # not before 3.12
                elif x in "([{":
                    stack.append(x)
                elif x in ")]}" and stack:
                    if stack.pop() != _BRACKETS[x]:
                        return None
                elif not stack and (x in ":}" or x == "!" and body[j + 1 : j + 2] != "="):
                    break
                j += 1
            if j >= n:
                return None
            out.append(re.sub(r"(?<![=!<>])=\s*\Z", "", body[start:j]))
            if body[j] == "!":
                if body[j + 1 : j + 2] not in ("r", "s", "a") or body[j + 2 : j + 3] not in (":", "}"):
                    return None
                j += 2
            if body[j] == ":":
                level, k = 0, j + 1
                while k < n and not (body[k] == "}" and not level):
                    level += (body[k] == "{") - (body[k] == "}")
                    k += 1
                inner = fields(body[j + 1 : k], raw, depth + 1) if depth < 2 else None
                if k >= n or inner is None:
                    return None
                out += inner
                j = k
            i = j + 1
        elif ch == "}":
            if not body.startswith("}}", i):
                return None
            i += 2
        else:
            i += 1
    return out
