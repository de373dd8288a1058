"""Problem 6: markup residue. Which markup languages a text holds, and the text without them.

A text is parsed once. A scan sets code and other opaque spans aside, left to right, the earliest opening winning: fences and
code spans (Markdown), comments and pre, code, script and style elements (HTML), verbatim environments and math (LaTeX),
nowiki (wiki). A span counts for the language that opens it and nothing inside it counts. What is left is searched for
the constructs of each language with the renderers' own conditions: flanking rules for emphasis, delimiter rows for tables,
definitions for reference links, element names for tags, dollar signs that touch their formula. HTML elements become a tree.

Both answers come from that parse. Every construct becomes an edit of the original (marks deleted, tags and commands replaced, text
outside the content left out) and counts for its language there; `languages` names the languages that were met, `text` applies all
edits in one pass, so nothing is scanned again and no stand-in characters are needed. Structure keeps one plain form: '# ' headings, '- ' and '1. ' lists, fenced
code, ' | ' table rows, $ and $$ formulas.

HTML goes through composite text density (Sun, Song and Liao, 2011): every node's density is its characters per tag, scaled
down by its links; a node's density sum is that of its children (a leaf's own); the block with the greatest sum is the
content, and the least density on its path to the body is the threshold. Starting at the body, every block that reaches
the threshold gives its own greatest-sum subtree to the content and its children are looked at in turn; other blocks are left out,
as are blocks inside the content that stay below the threshold and are mostly links. Structure outside the content stays: headings,
code, formulas, tables that are not mostly links, and lists at a quarter of the threshold, as they have more tags per character
than prose. Running text outside all elements belongs to the body itself and stays.

All steps are linear in the text apart from sorting edits, no step recurses, and there is no bound on lengths or nesting (list items
are indented by their depth up to 32, so that deep nesting cannot blow up the output).

Defined cases: null title and body read as ''; empty texts hold no markup and clean to ''; unclosed fences, comments and
elements run to the end of the text; NUL characters read as spaces; repeated rows are answered each for itself; other columns
are left behind.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.keys import Carried

LANGUAGES = ("html", "markdown", "wiki", "latex")

# fixed values: the element names of HTML, old ones included
TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo bgsound big blink blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes noscript object ol optgroup option output p "
    "param picture pre progress q rp rt ruby s samp script section select slot small source span strike strong style sub summary sup svg table tbody td template "
    "textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
# fixed values: LaTeX commands without arguments
BARE = frozenset(
    "item maketitle tableofcontents noindent indent newline newpage clearpage pagebreak linebreak centering raggedright bigskip medskip smallskip hfill vfill par appendix "
    "LaTeX TeX ldots dots cdots quad qquad hline toprule midrule bottomrule today bfseries itshape ttfamily small large Large huge tiny footnotesize "
    "alpha beta gamma delta epsilon varepsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega "
    "sum prod int infty partial nabla times cdot div pm leq geq neq approx equiv subset supset cup cap rightarrow leftarrow Rightarrow to log ln exp sin cos tan max min lim".split()
)

_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s+[^\s<>=\"'/]+(?:\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'|[^\s\"'=<>`]+))?)*\s*/?>")
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_CANDIDATE = re.compile(r"[`~<\\$]")
_FENCE_LEAD = re.compile(r"(?:[ ]{0,3}|[ \t]*(?:[-*+>]|\d{1,9}[.)])[ \t]+)(?=```|~~~)")
_ELEMENT = re.compile(r"<(pre|script|style|code|textarea|nowiki|syntaxhighlight|source|math)\b[^<>]*>", re.I)
_ENVIRONMENT = re.compile(r"\\begin\{(verbatim|lstlisting|minted|equation|align|gather|multline|displaymath|math|eqnarray)(\*?)\}", re.I)
_ESCAPED = frozenset("!\"#$%&'()*+,-./:;<=>?@^_`{|}~[]\\")
_BLANK_LINE = re.compile(r"\n[ \t\r]*\n")
_DOLLAR = re.compile(r"(?=\S)(?:\\.|[^$\\])*?(?<![\s\\])\$(?!\d)")  # a formula touches its dollar signs, and no digit follows the closing one
_QUOTED = re.compile(r"[^`'\n]+''")
_MATHLIKE = re.compile(r"\\[A-Za-z]|[\^_=+<>]|\d\s*[-*/]\s*\d")
_LETTER = re.compile(r"\s*[A-Za-z]\s*")
_PLAIN_FORMULA = re.compile(r"[A-Za-z0-9()'|,. *-]+")
_PROSE = re.compile(r"[A-Za-z]{4,} |\d.* ")


def _hidden(text: str) -> str:
    """Blanked out, line by line."""
    return "\n".join("\0" * len(line) for line in text.split("\n")) if "\n" in text else "\0" * len(text)


class Spans:
    """A text's opaque spans as (start, end, kind, inner start, inner end), its escapes as (start, end), and the rest with both
    blanked out. What the scan looks for ahead (ends, blank lines, runs of ticks) is remembered until it is passed."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[tuple[int, int, str, int, int]] = []
        self.escapes: list[tuple[int, int]] = []
        self._ahead: dict[object, int] = {}
        self._ticks: dict[int, list[int]] | None = None
        self._line, self._seen, self._lead = 0, 0, (-1, -1)
        pos, done, out, search = 0, 0, [], _CANDIDATE.search
        while m := search(text, pos):
            span, pos = self._span(m.start())
            if span is None:
                continue
            start, end, kind = span[:3]
            out.append(text[done:start])
            out.append(_hidden(text[start:end]))
            if kind == "escape":
                self.escapes.append((start, end))
            else:
                self.found.append(span)
            done = pos = end
        out.append(text[done:])
        self.rest = "".join(out) if done else text

    def _next(self, what: str | re.Pattern, at: int) -> int:
        """Where `what` comes next, the text's length if nowhere."""
        known = self._ahead.get(what, -1)
        if known < at:
            if isinstance(what, str):
                known = self.text.find(what, at)
            else:
                m = what.search(self.text, at)
                known = m.start() if m else -1
            known = self._ahead[what] = known if known >= 0 else len(self.text)
        return known

    def _fence_at(self, s: int) -> bool:
        newline = self.text.rfind("\n", self._seen, s)
        self._line, self._seen = newline + 1 if newline >= 0 else self._line, s
        if self._lead[0] != self._line:
            m = _FENCE_LEAD.match(self.text, self._line)
            self._lead = self._line, m.end() if m else -1
        return self._lead[1] == s

    def _run(self, s: int, c: str) -> int:
        text, e = self.text, s
        while text.startswith(c, e):
            e += 1
        return e

    def _formula(self, s: int, close: int) -> bool:
        """Whether text[s:close] looks like mathematics."""
        if self._next(_MATHLIKE, s) < close:
            return True
        m = _LETTER.match(self.text, s, close)
        return bool(m) and m.end() == close

    def _span(self, s: int) -> tuple[tuple[int, int, str, int, int] | None, int]:
        """The span that opens at s, if any, and where else to go on."""
        text, n = self.text, len(self.text)
        c = text[s]
        if c in "`~":
            e = self._run(s, c)
            if e - s >= 3 and self._fence_at(s):
                line = text.find("\n", e)
                line = n if line < 0 else line
                if c == "`" and text.find("`", e, line) >= 0:
                    return None, line
                close = re.compile(rf"^[ \t>]*{c}{{{e - s},}}[ \t]*\r?$", re.M).search(text, line)
                inner = min(n, line + 1)
                return ((s, close.end(), "fence", inner, max(inner, close.start())) if close else (s, n, "fence", inner, n)), n
            if c == "~":
                return None, e
            if self._ticks is None:
                self._ticks = {}
                for m in re.finditer("`+", text):
                    self._ticks.setdefault(m.end() - m.start(), []).append(m.start())
            same = self._ticks.get(e - s, ())
            i = bisect_left(same, e)
            if i < len(same) and same[i] + e - s <= self._next(_BLANK_LINE, e) and text[e : same[i]].strip():
                return (s, same[i] + e - s, "code", e, same[i]), n
            if e - s == 2 and (quote := _QUOTED.match(text, e)):
                return (s, quote.end(), "escape", e, quote.end()), n
            return None, e
        if c == "<":
            if text.startswith("<!--", s):
                close = text.find("-->", s + 4)
                return ((s, close + 3, "comment", s + 4, close) if close >= 0 else (s, n, "comment", s + 4, n)), n
            m = _ELEMENT.match(text, s)
            if not m or m[0].endswith("/>"):
                return None, m.end() if m else s + 1
            name, e = m[1].lower(), m.end()
            close = self._next(_CLOSING[name], e)
            if close == n and name in ("source", "math"):
                return None, e
            kind = {"nowiki": "nowiki", "syntaxhighlight": "nowiki", "source": "nowiki", "math": "wikimath"}.get(name, "element:" + name)
            return (s, text.find(">", close) + 1 if close < n else n, kind, e, close), n
        if c == "$":
            if text.startswith("$$", s):
                e, close = s + 2, self._next("$$", s + 2)
                if close < n and self._next("\n\n", e) >= close and text[e:close].strip():
                    return (s, close + 2, "math", e, close), n
                return None, e
            close = _DOLLAR.match(text, s + 1)
            if close and s + 2 < close.end() and not text[s - 1 : s].isalnum():
                body = close[0][:-1]
                if "\n\n" not in body and (self._formula(s + 1, close.end() - 1) or _PLAIN_FORMULA.fullmatch(body) and not _PROSE.search(body)):
                    return (s, close.end(), "inlinemath", s + 1, close.end() - 1), n
            return None, s + 1
        follows = text[s + 1 : s + 2]
        if follows == "b" and (m := _ENVIRONMENT.match(text, s)):
            tail = f"\\end{{{m[1]}{m[2]}}}"
            close = text.find(tail, m.end())
            kind = "verbatim" if m[1].lower() in ("verbatim", "lstlisting", "minted") else "math"
            return ((s, close + len(tail), kind, m.end(), close) if close >= 0 else (s, n, kind, m.end(), n)), n
        if follows and follows in "([":
            e, close = s + 2, self._next("\\)" if follows == "(" else "\\]", s + 2)
            if close < n and self._next("\n\n", e) >= close and self._formula(e, close):
                return (s, close + 2, "inlinemath" if follows == "(" else "math", e, close), n
            return (s, e, "escape", s, e), n
        if follows in _ESCAPED:
            return (s, s + 2, "escape", s, s + 2), n
        return None, s + 1


_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in "pre script style code textarea nowiki syntaxhighlight source math".split()}
_KIND_LANGUAGE = {"fence": "markdown", "code": "markdown", "comment": "html", "verbatim": "latex", "math": "latex", "inlinemath": "latex", "nowiki": "wiki", "wikimath": "wiki"}
_DOCTYPE = re.compile(r"<!DOCTYPE\s+html[^<>]*>?", re.I)
_TARGET = re.compile(r"\]\(<[^<>\n]*>")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|.*?(?:^[ \t]*\|\}|\Z)", re.S | re.M)
_BRACES = re.compile(r"\{+|\}+")
_TEMPLATE_HEAD = re.compile(r"\s*[#:]?[A-Za-z]")
_WIKI_LINK = re.compile(r"(?<![\w\])])!?\[\[(?!\s)([^\[\]\n|]+)(\|[^\[\]\n]*)?\]\]")
_WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t\r]*$", re.M)
_QUOTES = re.compile(r"\n|(?<!')'{2,5}(?!')")
_ATX = re.compile(r"^[ ]{0,3}#{1,6}(?:[ \t]+\S.*|[ \t]*\r?)$", re.M)
_DELIMITER = re.compile(r"^[ ]{0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t\r]*$")
_BULLET = re.compile(r"^([ \t]*)([-*+])([ \t]+)(\[[ xX]\][ \t]+)?(\S.*)$")
_NUMBER = re.compile(r"^([ \t]*)(\d{1,9})([.)])([ \t]+)(\S.*)$")
_QUOTE = re.compile(r"^[ ]{0,3}>[ \t]?.*\S")
_UNDER = re.compile(r"^[ ]{0,3}(=+|-{2,})[ \t\r]*$")
_RULE = re.compile(r"[-*_ \t\r]+\Z")
_INDENTED = re.compile(r"(?: {4,}|\t)[^\s\0]")
_LINE = re.compile(r"^(?: {4}|\t|[ \t]{0,3}[-*+=>|:0-9])", re.M)
_DESTINATION = r"\((?:<[^<>\n]*>|[^\s()<>\0]*(?:\([^\s()]*\)[^\s()]*)*)(?:\s+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^)\n]*\)))?\s*\)"
_GOES_TO = re.compile(_DESTINATION)
_DEFINITION = re.compile(r"^[ ]{0,3}\[([^\[\]\n^]+)\]:[ \t]*(?:<[^<>\n]*>|\S+)(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^)\n]*\)))?[ \t\r]*$", re.M)
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_RUNS = re.compile(r"\*+|_+|~{1,2}(?!~)")
_PUNCTUATION = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~‘’“”«»…–—、。，！？：；（）「」")


def _emphasis(block: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, width) of emphasised spans, by the flanking rules; openers of each mark wait on a stack of their own."""
    stacks: dict[str, tuple[list[tuple[int, int]], list[int]]] = {c: ([], []) for c in "*_~"}  # (width, start), and the ends
    solid, past = -1, 0  # the last character that is neither mark nor space
    for m in _RUNS.finditer(block):
        start, end = m.span()
        c, n = block[start], end - start
        if gap := block[past:start].rstrip("\0 \n*_~"):
            solid = past + len(gap) - 1
        past = end
        if c == "~" and (n != 2 or block[start - 1 : start] == "~"):  # a single one is also a space of LaTeX
            continue
        before, after = block[start - 1] if start else " ", block[end] if end < len(block) else " "
        space_b, blank_a = before.isspace(), after.isspace()
        blank_b = space_b or before == "\0"
        punct_b, punct_a = before in _PUNCTUATION, after in _PUNCTUATION
        left = not blank_a and (not punct_a or blank_b or punct_b)
        right = not space_b and (not punct_b or blank_a or punct_a)
        opens, closes = left and (c != "_" or not right or punct_b), right and (c != "_" or not left or punct_a)
        waiting, ends = stacks[c]
        if closes and ends and (i := bisect_right(ends, solid) - 1) >= 0:
            width, first = waiting[i]
            yield first, end, min(n, width)
            opens = False
            for others, their_ends in stacks.values():
                while others and others[-1][1] >= first:
                    others.pop(), their_ends.pop()
        if opens:
            waiting.append((n, start)), ends.append(end)


def _blocks(t: str) -> Iterator[tuple[int, int]]:
    """Paragraphs: what blank lines separate."""
    pos = 0
    for m in _BLANK_LINE.finditer(t):
        yield pos, m.start()
        pos = m.end()
    yield pos, len(t)


def _cells(row: str) -> int:
    return len(row.strip().replace("\\|", "").strip("|").split("|"))


def _is_delimiter(row: str, before: str | None) -> bool:
    """A delimiter row under a header row of as many cells."""
    return before is not None and "|" in before and bool(_DELIMITER.match(row)) and _cells(row) == _cells(before)


class Lines:
    """The lines of a text that may start a block of Markdown, as (start, end, line, line before or None)."""

    def __init__(self, text: str):
        self.text = text

    def __iter__(self) -> Iterator[tuple[int, int, str, str | None]]:
        t, last = self.text, (-1, -1)
        for m in _LINE.finditer(t):
            s = m.start()
            e = t.find("\n", s)
            e = len(t) if e < 0 else e
            before = None
            if s:
                before = t[last[0] : last[1]] if last[1] == s - 1 else t[t.rfind("\n", 0, s - 1) + 1 : s - 1]
            last = s, e
            yield s, e, t[s:e], before


def _is_setext(line: str, before: str | None) -> bool:
    return bool(before) and bool(before.strip(" \t\r\0")) and bool(_UNDER.match(line)) and not _BULLET.match(before) and not _UNDER.match(before) and "|" not in before and not before.startswith(("    ", "\t"))


def _opens_block(line: str, before: str | None) -> bool:
    """Whether a line opens a list, quote, table or indented code; before the first list, so that a deep indent continues none."""
    bare = line.lstrip(" \t")
    c, after_text = bare[:1], bool(before) and bool(before.strip(" \t\r\0"))
    if c and c in "-*+" and (m := _BULLET.match(line)) and len(m[1]) < 4 and not _RULE.match(line):
        return True
    if c.isdigit() and (m := _NUMBER.match(line)) and len(m[1]) < 4 and (not after_text or m[2] == "1" or _NUMBER.match(before)):
        return True
    return bool(c == ">" and _QUOTE.match(line) or c and c in "-|:" and _is_delimiter(line, before) or not after_text and _INDENTED.match(line))


_VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figure footer form header hr html main menu nav noscript ol p section summary table ul".split())
_LISTS = frozenset("ul ol dl dir menu".split())
_HEADINGS = {f"h{i}": "#" * i + " " for i in range(1, 7)}
_UNSEEN = frozenset("head template noscript script style".split())
_ENDS = {"li": ("li",), "option": ("option",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
_ALT = re.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Tree:
    """The HTML elements of a text in document order, the body first: parents, and figures of each with all below it.
    `runs` are the stretches of text as (start, end, node), `marks` the tags as (start, end, node, opening)."""

    def __init__(self, rest: str, tags: Sequence[re.Match], unseen: Sequence[tuple[int, int]]):
        self.tag, self.up, self.chars = ["body"], [-1], [0]
        self.runs: list[tuple[int, int, int]] = []
        self.marks: list[tuple[int, int, int, bool]] = []
        opened, counts, pos, k = [0], {}, 0, 0

        def text_up_to(end: int, then: int) -> int:
            if end > pos:
                self.runs.append((pos, end, opened[-1]))
                self.chars[opened[-1]] += sum(map(len, rest[pos:end].split()))
            return max(pos, then)

        def shut(names: tuple[str, ...]) -> None:
            while len(opened) > 1 and self.tag[opened[-1]] in names:
                counts[self.tag[opened.pop()]] -= 1

        for m in tags:
            s, e = m.span()
            while k < len(unseen) and unseen[k][0] < s:
                pos = text_up_to(*unseen[k])
                k += 1
            pos = text_up_to(s, e)
            name = m[1].lower()
            if rest[s + 1] == "/":
                if counts.get(name):
                    while self.tag[opened[-1]] != name:
                        counts[self.tag[opened.pop()]] -= 1
                    self.marks.append((s, e, opened[-1], False))
                    counts[name] -= 1
                    opened.pop()
                else:
                    self.marks.append((s, e, -1, False))
                continue
            shut(_ENDS.get(name, ()))
            node = len(self.tag)
            self.tag.append(name), self.up.append(opened[-1]), self.chars.append(0)
            self.marks.append((s, e, node, True))
            if name not in _VOID and not m[0].endswith("/>"):
                opened.append(node)
                counts[name] = counts.get(name, 0) + 1
        for s, e in unseen[k:]:
            pos = text_up_to(s, e)
        text_up_to(len(rest), len(rest))

    def densities(self) -> None:
        """Composite text density of every node, and the sum over its children. A count of 0 reads as 1 wherever it stands, which
        also keeps the base of the logarithm, the logarithm of a sum above 1 + e, away from 1."""
        n = len(self.tag)
        chars, tags, linked, links = self.chars, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            p, is_link = self.up[i], self.tag[i] == "a"
            if is_link:
                linked[i] = chars[i]
            chars[p] += chars[i]
            tags[p] += tags[i] + 1
            linked[p] += linked[i]
            links[p] += links[i] + is_link
        self.density, self.total, self.linked = [0.0] * n, [0.0] * n, linked
        share = max(1, linked[0]) / max(1, chars[0])
        for i in range(n - 1, -1, -1):
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, linked[i]), max(1, links[i])
            if c:
                self.density[i] = c / t * math.log(c / lc * t / lt, math.log(c / max(1, c - lc) * lc + share * c + math.e))
            if not tags[i]:
                self.total[i] = self.density[i]
            if i:
                self.total[self.up[i]] += self.density[i]

    def kept(self) -> list[bool]:
        """For every node whether its own text belongs to the content, or to structure that stays."""
        self.densities()
        n, up, tag, density, total = len(self.tag), self.up, self.tag, self.density, self.total
        block = [t in _BLOCKS for t in tag]
        best, most = [-1] * n, [-1.0] * n  # the block of greatest sum in every subtree, the first of equal ones
        for i in range(n - 1, -1, -1):
            if (block[i] or not i) and total[i] >= most[i]:
                best[i], most[i] = i, total[i]
            if i and best[i] >= 0 and most[i] >= most[up[i]]:
                best[up[i]], most[up[i]] = best[i], most[i]
        least, i = density[best[0]], best[0]
        while i >= 0:
            least, i = min(least, density[i]), up[i]
        content, looked_at = [False] * n, [False] * n
        content[best[0]] = looked_at[0] = True
        keep = [True] * n
        for i in range(n):
            p, t = up[i], tag[i]
            if i and t in _UNSEEN:
                keep[i] = False
                continue
            if i and looked_at[p] and block[i] and density[i] >= least:
                looked_at[i] = True
                content[best[i]] = True
            if i and looked_at[p] and not block[i]:
                looked_at[i] = True
            if not i:
                continue
            content[i] |= content[p]
            mostly_links = self.linked[i] * 2 > self.chars[i]
            if t in _HEADINGS or t == "math" or t == "table" and not mostly_links or t in _LISTS and not mostly_links and density[i] * 4 >= least and t != "menu":
                keep[i] = keep[p] or t not in _LISTS
            elif not block[i]:
                keep[i] = keep[p]
            elif content[i]:
                keep[i] = keep[p] and (density[i] >= least or not mostly_links)
            else:
                keep[i] = keep[p] and (looked_at[i] or t == "hr")
            if keep[i] and not keep[p]:
                content[i] = True  # all of a table or heading stays
        return keep


# commands whose arguments leave with them, those whose first argument does, and headings
_GONE = frozenset("cite ref label eqref pageref vspace hspace includegraphics begin end bibliographystyle bibliography usepackage documentclass".split())
_FIRST_GONE = frozenset("href textcolor hyperref colorbox".split())
_LEVELS = {"chapter": 1, "part": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 1, "subparagraph": 2}
_LATEX_STEP = re.compile(r"[{}]|(?<![\w:\\])\\([A-Za-z]+)\*?((?:\[[^\[\]\n]*\][ \t]*)?\{|(?=\[[^\[\]\n]*\]\s*\{))?")
_OPTIONS = re.compile(r"(?:\[[^\[\]\n]*\]|\{[^{}\n]*\})*")
_ITEM_LINE = re.compile(r"^[ \t]*(?=\\item\b)", re.M)
_SPACES = re.compile(r"[ \t]*")
_LINE_END = re.compile(r"[ \t]*(?:\n|\Z)")
_BAR = re.compile(r"(?<![ \t])[ \t]*(?:\|\||!!)[ \t]*")
_BRACKETS = re.compile(r"!?\[|\]")
_LABEL = re.compile(r"\[[^\[\]\n]*\]")
_HEADING_END = re.compile(r"(?<![ \t])[ \t]+#+[ \t\r]*\Z")

Edit = tuple[int, int, str, bool]  # start, end, what stands there instead, and whether it is code


class Parsed:
    """One parse of a text; languages() and text() read its edits."""

    def __init__(self, text: str | None):
        self.source = (text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\0", " ")
        t = self.source
        self.spans = Spans(t)
        rest = self.spans.rest
        if "](<" in rest:  # a link's target in angle brackets is no tag
            rest = _TARGET.sub(lambda m: "](<" + "x" * (len(m[0]) - 4) + ">", rest)
        self.tags, self.references, self.doctypes = [], [], []
        if "<" in rest:
            self.tags = [m for m in _NAME.finditer(rest) if m[1].lower() in TAGS]
            self.doctypes = [m.span() for m in _DOCTYPE.finditer(rest)] if "<!" in rest else []
        if "&" in rest:
            self.references = [m for m in _REFERENCE.finditer(rest) if m[0].startswith("&#") or m[0][1:] in html.entities.html5]
        self.marked = rest  # what the tree is built from
        self.rest = self._without(rest, [m.span() for m in self.tags])
        self._wiki()
        self.found: set[str] = set()  # the language of every construct that edits() has come to
        self._made: list[Edit] | None = None

    @staticmethod
    def _without(t: str, ranges: Sequence[tuple[int, int]]) -> str:
        """t with the ranges, which are in order and apart, blanked out."""
        if not ranges:
            return t
        out, pos = [], 0
        for s, e in ranges:
            out += t[pos:s], _hidden(t[s:e])
            pos = e
        return "".join((*out, t[pos:]))

    def _wiki(self) -> None:
        t = self.rest
        self.tables = [m.span() for m in _WIKI_TABLE.finditer(t)] if "{|" in t else []
        self.templates = self._templates(t) if "{{" in t else []
        self.links = [m for m in _WIKI_LINK.finditer(t) if not re.search(r"[$=]|^-\w ", m[1])] if "[[" in t else []
        self.headings = list(_WIKI_HEADING.finditer(t)) if "=" in t else []
        self.emphasis = self._quotes(t) if "''" in t else []

    @staticmethod
    def _templates(t: str) -> list[tuple[int, int]]:
        """Outermost templates: paired double braces without single ones, headed by a name."""
        waiting: list[list[int]] = []  # start, and whether a single brace stands inside
        found: list[tuple[int, int]] = []
        for m in _BRACES.finditer(t):
            s, e = m.span()
            if t[s] == "{":
                if (e - s) % 2 and waiting:
                    waiting[-1][1] = 1
                waiting += [[at, 0] for at in range(s + (e - s) % 2, e, 2)]
                continue
            at = s
            while at + 2 <= e and waiting:
                begin, bad = waiting.pop()
                at += 2
                if bad or not _TEMPLATE_HEAD.match(t, begin + 2):
                    if waiting:
                        waiting[-1][1] = 1
                    continue
                while found and found[-1][0] > begin:
                    found.pop()
                found.append((begin, at))
            if at < e and waiting:
                waiting[-1][1] = 1
        return found

    @staticmethod
    def _quotes(t: str) -> list[tuple[int, int, int]]:
        """(start, end, width) of wiki emphasis: runs of as many quotes on one line, touching what they enclose."""
        runs, lines = [], 0
        for m in _QUOTES.finditer(t):
            if m[0] == "\n":
                lines += 1
                continue
            before, after = t[m.start() - 1] if m.start() else " ", t[m.end()] if m.end() < len(t) else " "
            opens = not (before.isalnum() or before == "_") and not after.isspace()
            closes = not before.isspace() and not (after.isalnum() or after == "_")
            runs.append((m.start(), m.end(), (lines, m.end() - m.start()), opens, closes))
        ends: dict[tuple[int, int], list[int]] = {}
        for i, (_, _, key, _, closes) in enumerate(runs):
            if closes:
                ends.setdefault(key, []).append(i)
        out, i = [], 0
        while i < len(runs):
            s, e, key, opens, _ = runs[i]
            mine = ends.get(key, ()) if opens else ()
            k = bisect_right(mine, i) if mine else 0
            if k < len(mine):
                out.append((s, runs[mine[k]][1], e - s))
                i = mine[k]
            i += 1
        return out

    def _plain(self) -> str:
        """What Markdown is looked for in."""
        ranges = sorted([*self.tables, *self.templates, *((s, e) for s, e, _ in self.emphasis), *(m.span() for m in (*self.headings, *self.links))])
        apart: list[tuple[int, int]] = []
        for s, e in ranges:
            if apart and s < apart[-1][1]:
                apart[-1] = apart[-1][0], max(e, apart[-1][1])
            else:
                apart.append((s, e))
        return self._without(self.rest, apart)

    def languages(self) -> set[str]:
        """The markup languages of which the text holds at least one construct."""
        self.edits()
        return self.found

    # ---- the text without markup

    def edits(self) -> list[Edit]:
        """What content extraction and the constructs of all languages change in the text, made once. A construct counts for its
        language here, also where it keeps its form."""
        if self._made is None:
            self._made = edits = []
            for s, e, kind, a, b in self.spans.found:
                self.found.add(_KIND_LANGUAGE.get(kind, "html"))
                edits.append((s, e, *self._shown(kind, self.source[a:b])))
            edits += [(s, s + 1, "", False) for s, e in self.spans.escapes if e == s + 2]
            self._html_edits(edits)
            self._wiki_edits(edits)
            if "\\" in self.rest:
                self._latex_edits(edits)
            self._markdown_edits(edits, self._plain())
        return self._made

    def text(self) -> str:
        return self._apply(self.edits()) if self.source else ""

    @staticmethod
    def _shown(kind: str, inner: str) -> tuple[str, bool]:
        """What stands for an opaque span, and whether it is code."""
        if kind in ("fence", "verbatim"):
            return "```\n" + inner.strip("\n") + "\n```", True
        if kind in ("element:pre", "element:textarea"):
            return "```\n" + html.unescape(re.sub(r"</?code\b[^<>]*>", "", inner)).strip("\n") + "\n```", True
        if kind in ("code", "nowiki"):
            return inner.strip(), False
        if kind == "element:code":
            return html.unescape(re.sub(r"<[^<>]+>", "", inner)).strip(), False
        if kind == "math":
            return "\n$$" + " ".join(inner.split()) + "$$\n", False
        return ("$" + inner.strip() + "$" if kind in ("inlinemath", "wikimath") else ""), False

    def _html_edits(self, edits: list[Edit]) -> None:
        began = len(edits)
        edits += [(m.start(), m.end(), html.unescape(m[0]), False) for m in self.references]
        edits += [(s, e, "", False) for s, e in self.doctypes]
        if len(edits) > began:
            self.found.add("html")
        if not self.tags:
            return
        unseen = [(s, e) for s, e, kind, _, _ in self.spans.found if kind in ("comment", "element:script", "element:style")]
        tree = Tree(self.marked, self.tags, unseen)
        keep = tree.kept()
        if tree.marks:
            self.found.add("html")
        shown = [(s, e) for s, e, kind, _, _ in self.spans.found if kind not in ("comment", "element:script", "element:style", "code")]
        k = 0
        for s, e, node in tree.runs:
            if keep[node]:
                continue
            while k < len(shown) and shown[k][1] <= s:
                k += 1
            pos, j = s, k
            while j < len(shown) and shown[j][0] < e:  # code and formulas stay
                if shown[j][0] > pos:
                    edits.append((pos, shown[j][0], "", False))
                pos, j = max(pos, shown[j][1]), j + 1
            if pos < e:
                edits.append((pos, e, "", False))
        depth = 0
        celled: dict[int, bool] = {}  # rows that have a cell
        for s, e, node, opening in tree.marks:
            tag = tree.tag[node] if node > 0 else ""
            into = ""
            lists = tag in ("ul", "ol", "dl")
            if lists:
                depth += 1 if opening else -1
            if node > 0 and keep[node]:
                if tag == "br":
                    into = "\n"
                elif tag == "hr":
                    into = "\n\n"
                elif tag == "img":
                    alt = _ALT.search(self.source[s:e])
                    into = html.unescape(alt[1] or alt[2] or alt[3] or "") if alt else ""
                elif tag in _HEADINGS:
                    into = "\n\n" + _HEADINGS[tag] if opening else "\n\n"
                elif lists or tag == "table":
                    into = "\n"
                elif tag in ("li", "dt", "dd"):
                    into = "\n" + "  " * min(max(0, depth - 1), 32) + ("1. " if tree.tag[tree.up[node]] == "ol" else "- ") if opening else ""
                elif tag == "tr":
                    into = "\n" if opening else ""
                elif tag in ("td", "th"):
                    row = tree.up[node]
                    into = " | " if opening and celled.get(row) else ""
                    celled[row] = True
                elif tag in _BLOCKS:
                    into = "\n\n"
            edits.append((s, e, into, False))

    def _wiki_edits(self, edits: list[Edit]) -> None:
        t = self.rest
        if self.tables or self.templates or self.links or self.headings or self.emphasis:
            self.found.add("wiki")
        for s, e in self.tables:
            pos, in_row = s, False
            while pos < e:
                end = t.find("\n", pos, e)
                end = e if end < 0 else end
                line = t[pos:end]
                bare = line.lstrip(" \t")
                at = pos + len(line) - len(bare)
                if bare.startswith(("{|", "|}")):
                    edits.append((pos, end, "", False))
                    in_row = False
                elif bare.startswith("|-"):
                    edits.append((pos - (pos > s), end, "", False))
                    in_row = False
                elif bare.startswith(("|", "!")):
                    head = at + (2 if bare.startswith("|+") else 1)
                    head += len(t[head:end]) - len(t[head:end].lstrip(" \t"))
                    edits.append((pos - 1, head, " | ", False) if in_row and pos > s else (pos, head, "", False))
                    in_row = not bare.startswith("|+")
                    edits += [(m.start(), m.end(), " | ", False) for m in _BAR.finditer(t, head, end)]
                pos = end + 1
        edits += [(s, e, "", False) for s, e in self.templates]
        for m in self.links:
            s, e = m.span()
            if re.match(r"(?:Category|File|Image):", m[1], re.I) and t[s - 1 : s] in ("", "\n") and _LINE_END.match(t, e):
                edits.append((s, e, "", False))
            elif m[2] and len(m[2]) > 1:
                edits += [(s, m.start(2) + 1, "", False), (e - 2, e, "", False)]
            else:
                edits += [(s, m.start(1), "", False), (m.end(1), e, "", False)]
        for m in self.headings:
            edits += [(m.start(), m.start(2), "#" * len(m[1]) + " ", False), (m.end(2), m.end(), "", False)]
        for s, e, width in self.emphasis:
            edits += [(s, s + width, "", False), (e - width, e, "", False)]

    def _latex_edits(self, edits: list[Edit]) -> None:
        t = self.rest
        waiting: list[tuple[str, int, int] | None] = []  # (command, its start, end of its opening brace); None for a bare brace
        items = {m.end(): m.start() for m in _ITEM_LINE.finditer(t)}
        argument = -1  # where a command's next argument would open
        name = ""
        for m in _LATEX_STEP.finditer(t):
            s, e = m.span()
            if m[2] is not None or m[1] in BARE and t[e : e + 1] not in ("\\", "/"):
                self.found.add("latex")
            if m[0] == "{":
                waiting.append((name, -1, e) if s == argument else None)
            elif m[0] == "}":
                opened = waiting.pop() if waiting else None
                if opened is None:
                    continue
                name, begin, inner = opened
                gone = name in _GONE or begin >= 0 and name in _FIRST_GONE
                if begin < 0:
                    edits.append((inner - 1, e, "", False) if gone else (inner - 1, inner, "" if name in _FIRST_GONE else " ", False))
                    if not gone:
                        edits.append((s, e, "", False))
                elif gone:
                    if name in ("begin", "end"):
                        e = _OPTIONS.match(t, e).end()
                    elif t[begin - 1 : begin] == "~":
                        begin -= 1
                    edits.append((begin, e, "", False))
                elif name in _LEVELS:
                    edits += [(begin, inner, "\n\n" + "#" * _LEVELS[name] + " ", False), (s, e, "\n\n", False)]
                elif name == "footnote":
                    edits += [(begin, inner, " (", False), (s, e, ")", False)]
                else:
                    edits += [(begin, inner, "", False), (s, e, "", False)]
                argument = e
            elif m[2]:
                waiting.append((m[1], s, e))
            elif m[1] == "item":
                label = _LABEL.match(t, e)
                end = label.end() if label else _SPACES.match(t, e).end()
                edits.append((items.get(s, s), end, "- " + (label[0][1:-1] if label else "") if s in items else "", False))
            elif m[1] in BARE:
                edits.append((s, e + (t[e : e + 1] == " "), "", False))

    def _markdown_edits(self, edits: list[Edit], t: str) -> None:
        began = len(edits)
        edits += [(m.start(), m.end(), "", False) for m in _DEFINITION.finditer(t)] if "]:" in t else ()
        if "<" in t:
            for m in _AUTOLINK.finditer(t):
                edits += [(m.start(), m.start() + 1, "", False), (m.end() - 1, m.end(), "", False)]
        if "#" in t:
            for m in _ATX.finditer(t):
                line = m[0]
                body = line.lstrip(" ")
                level = len(body) - len(body.lstrip("#"))
                inside = body[level:].lstrip(" \t")
                edits.append((m.start(), m.end() - len(inside), "#" * level + " ", False))
                if tail := _HEADING_END.search(line):
                    edits.append((m.start() + tail.start(), m.end(), "", False))
        if len(edits) > began:
            self.found.add("markdown")
        for s, e, line, before in Lines(t):
            setext = _is_setext(line, before)
            if "markdown" not in self.found and (setext or _opens_block(line, before)):
                self.found.add("markdown")
            if setext:
                top = s - 1 - len(before)
                edits.append((top, top + len(before) - len(before.lstrip(" \t")), "# " if "=" in line else "## ", False))
                edits.append((s - 1, e, "", False))
            elif _is_delimiter(line, before):
                edits.append((s - 1, e, "", False))
                self._row(edits, s - 1 - len(before), before)
            elif (quote := re.match(r"[ ]{0,3}(?:>[ \t]?)+", line)) is not None:
                edits.append((s, s + quote.end(), "", False))
            elif (m := _BULLET.match(line)) and not _RULE.match(line):
                edits.append((s + m.start(2), s + m.start(5), "- ", False))
            elif line.lstrip(" \t").startswith("|"):
                self._row(edits, s, line)
        if "](" in t or "][" in t:
            self._link_edits(edits, t)
        if "*" in t or "_" in t or "~~" in t:
            for a, b in _blocks(t):
                for s, e, width in _emphasis(t[a:b]):
                    self.found.add("markdown")
                    edits += [(a + s, a + s + width, "", False), (a + e - width, a + e, "", False)]

    @staticmethod
    def _row(edits: list[Edit], at: int, line: str) -> None:
        """A table row: no outer bars, one space around inner ones."""
        bare = line.strip(" \t")
        if not bare.startswith("|") or not bare.endswith("|") or len(bare) < 3:
            return
        begin = at + len(line) - len(line.lstrip(" \t"))
        bars = [(begin + m.start(), begin + m.end()) for m in re.finditer(r"(?<![ \t])[ \t]*(?<!\\)\|[ \t]*", bare)]
        if len(bars) > 1:
            edits.append((at, bars[0][1], "", False))
            edits += [(s, e, " | ", False) for s, e in bars[1:-1]]
            edits.append((bars[-1][0], bars[-1][1], "", False))

    def _link_edits(self, edits: list[Edit], t: str) -> None:
        """Links and images, nested ones too: brackets are paired, and count where a target or label follows; a label that has a
        target of its own is a link by itself."""
        for a, b in _blocks(t):
            waiting: list[tuple[int, int]] = []
            past = a
            for m in _BRACKETS.finditer(t, a, b):
                s, e = m.span()
                if s < past:
                    continue
                if m[0] != "]":
                    waiting.append((s, e))
                elif waiting:
                    start, inner = waiting.pop()
                    after = _GOES_TO.match(t, e) if t[e : e + 1] == "(" else _LABEL.match(t, e) if t[e : e + 1] == "[" else None
                    if after and t[e] == "[" and _GOES_TO.match(t, after.end()):
                        continue
                    if after and (t[e] == "(" or inner < s):
                        edits += [(start, inner, "", False), (s, after.end(), "", False)]
                        past = after.end()
                        if t[e] == "(":  # a label's definition counts by itself
                            self.found.add("markdown")

    def _apply(self, edits: list[Edit]) -> str:
        """The source with all edits made: of two that meet, the one that starts first, or is longer, goes before."""
        edits.sort(key=lambda x: (x[0], x[1] > x[0], -x[1]))
        parts: list[tuple[str, bool]] = []  # text that is spaced anew, and code that stays as it is
        loose: list[str] = []
        pos = 0
        for s, e, into, code in edits:
            if s < pos:
                pos = max(pos, e) if e > pos else pos
                continue
            loose.append(self.source[pos:s])
            if code:
                loose.append("\n")
                parts += (("".join(loose), False), (into, True))
                loose = ["\n"]
            else:
                loose.append(into)
            pos = e
        loose.append(self.source[pos:])
        parts.append(("".join(loose), False))
        out = []
        for i, (part, code) in enumerate(parts):
            if not code:
                part = re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ \t])[ \t]+$", "", part, flags=re.M))
                part = part.lstrip() if not i else part
                part = part.rstrip() if i == len(parts) - 1 else part
            out.append(part)
        return "".join(out).strip("\n") if len(parts) > 1 else out[0]


def languages(text: str | None) -> set[str]:
    """The markup languages of which the text holds at least one construct."""
    return Parsed(text).languages() if text else set()


def clean(text: str | None) -> str:
    """The text without markup; see above for the form that structure takes."""
    return Parsed(text).text() if text else ""


def residue(df: DataFrame, keys: Sequence[str], title: str, body: str, texts: bool = True) -> DataFrame:
    """(keys, markup, clean_title, clean_text): the languages found in title or body, sorted, and both cleaned. Each text is
    parsed once and its edits are made once for both; with texts=False they are not applied and the two columns are left out."""
    carried = Carried(df, keys)
    keys = carried.keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[keys].copy()
            marks, cleaned = [], ([], [])
            for pair in zip(batch["_title"], batch["_body"]):
                found: set[str] = set()
                for text, into in zip(pair, cleaned):
                    parsed = Parsed(text) if text else None
                    if parsed:
                        found |= parsed.languages()
                    if texts:
                        into.append(parsed.text() if parsed else "")
                marks.append(sorted(found))
            out["_o_markup"] = marks
            if texts:
                out["_o_title"], out["_o_text"] = cleaned
            yield out

    rows = df.select(*carried.cols, F.col(title).alias("_title"), F.col(body).alias("_body"))
    names = {"markup": "array<string>"} | ({"title": "string", "text": "string"} if texts else {})
    got = rows.mapInPandas(run, ", ".join((carried.schema, *(f"_o_{n} {kind}" for n, kind in names.items()))))
    return got.select(*carried.back, *(F.col("_o_" + n).alias(n if n == "markup" else "clean_" + n) for n in names))
