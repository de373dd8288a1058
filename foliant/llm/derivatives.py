"""Memoised parsing with derivatives.

The derivative of a grammar by a token is the grammar of what may follow that token. Grammar nodes are interned, so equal
remainders are one object, and each keeps its derivatives in a table; the nodes reached from a language's start form an
automaton that is built while files are read and shared by all files of a worker. Where a remainder becomes the
empty language the token at hand is the error; where the input ends on a remainder that is not nullable it is truncated.

Grammars have no left recursion (repetition is written {x}), so derivatives need no fixed point; nullability and first
tokens of nonterminals, which do, are found when a grammar is loaded. Ambiguity costs nothing special: alternatives live
side by side in a node until tokens rule them out.

Notation: name = body ; with 'literal', TOKEN, nonterminal, juxtaposition, |, [optional], {repeated}, (group), and ~'literal',
which forbids the rest of its sequence to begin with that token.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

_PIECE = re.compile(r"\s+|#[^\n]*|('(?:[^'\\]|\\.)+')|([A-Za-z_]\w*)|([=;|(){}\[\]])|(~)")


class Node:
    __slots__ = ("op", "a", "b", "null", "memo")

    def __init__(self, op: str, a=None, b=None, null: bool = False):
        self.op, self.a, self.b, self.null, self.memo = op, a, b, null, {}


class Grammar:
    """classes: token class -> kinds it stands for, e.g. NAME also for the soft keywords."""

    def __init__(self, text: str, start: str, classes: dict[str, Iterable[str]] | None = None, most_nodes: int = 300_000):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        self.classes = {k: frozenset(v) for k, v in (classes or {}).items()}
        self.rules = self._read(text)
        self.start_name, self.most = start, most_nodes
        self.literals = {x[1] for body in self.rules.values() for x in self._walk(body) if x[0] == "tok"}
        self._nullable, self._firsts = self._fixed_points()
        self.reset()

    # reading

    def _read(self, text: str) -> dict[str, tuple]:
        pieces, pos = [], 0
        while pos < len(text):
            m = _PIECE.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos : pos + 40]!r}")
            pos = m.end()
            if m[1]:
                pieces.append(("tok", m[1][1:-1].replace("\\'", "'")))
            elif m[2]:
                pieces.append(("tok", m[2]) if m[2].isupper() else ("ref", m[2]))
            elif m[3] or m[4]:
                pieces.append((m[3] or m[4],))
        rules, i = {}, 0
        while i < len(pieces):
            name = pieces[i][1]
            if pieces[i + 1] != ("=",):
                raise ValueError(f"grammar: '=' missing after {name}")
            body, i = self._alternatives(pieces, i + 2)
            if pieces[i] != (";",):
                raise ValueError(f"grammar: ';' missing after {name}")
            rules[name], i = body, i + 1
        unknown = {x[1] for b in rules.values() for x in self._walk(b) if x[0] == "ref"} - rules.keys()
        if unknown:
            raise ValueError(f"grammar: no rules for {sorted(unknown)}")
        return rules

    def _alternatives(self, p: list[tuple], i: int) -> tuple[tuple, int]:
        options, items = [], []
        close = {"(": ")", "[": "]", "{": "}"}
        while True:
            x = p[i]
            if x[0] in ("tok", "ref"):
                items.append(x)
                i += 1
            elif x[0] == "~":
                items.append(("not", p[i + 1][1]))
                i += 2
            elif x[0] in close:
                inner, j = self._alternatives(p, i + 1)
                if p[j] != (close[x[0]],):
                    raise ValueError(f"grammar: {close[x[0]]} missing")
                items.append({"(": inner, "[": ("alt", (("seq", ()), inner)), "{": ("star", inner)}[x[0]])
                i = j + 1
            else:
                options.append(("seq", tuple(items)))
                if x != ("|",):
                    return ("alt", tuple(options)), i
                items, i = [], i + 1

    def _walk(self, x: tuple):
        yield x
        if x[0] == "star":
            yield from self._walk(x[1])
        elif x[0] in ("alt", "seq"):
            for y in x[1]:
                yield from self._walk(y)

    def _kinds(self, token: str) -> frozenset[str]:
        return self.classes.get(token, frozenset((token,)))

    def _fixed_points(self) -> tuple[dict[str, bool], dict[str, frozenset[str]]]:
        null = dict.fromkeys(self.rules, False)
        first = dict.fromkeys(self.rules, frozenset())

        def is_null(x: tuple) -> bool:
            return {"tok": lambda: False, "not": lambda: True, "star": lambda: True, "ref": lambda: null[x[1]], "alt": lambda: any(map(is_null, x[1])), "seq": lambda: all(map(is_null, x[1]))}[x[0]]()

        def firsts(x: tuple) -> frozenset[str]:
            if x[0] == "tok":
                return self._kinds(x[1])
            if x[0] == "ref":
                return first[x[1]]
            if x[0] == "star":
                return firsts(x[1])
            out: frozenset[str] = frozenset()
            if x[0] == "not":
                return out
            for y in x[1]:
                out |= firsts(y)
                if x[0] == "seq" and not is_null(y):
                    break
            return out

        moved = True
        while moved:
            moved = False
            for name, body in self.rules.items():
                n, f = is_null(body), firsts(body)
                moved |= n != null[name] or f != first[name]
                null[name], first[name] = n, f
        return null, first

    # nodes

    def reset(self) -> None:
        """Forget all derivatives; done when they have become too many."""
        self.table: dict[tuple, Node] = {}
        self.empty, self.eps = Node("empty"), Node("eps", null=True)
        self.starts = {self.start_name: self._ref(self.start_name)}

    def start(self, name: str | None = None) -> Node:
        if len(self.table) > self.most:
            self.reset()
        return self._ref(name or self.start_name)

    def _node(self, key: tuple, op: str, a=None, b=None, null: bool = False) -> Node:
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node(op, a, b, null)
        return node

    def _ref(self, name: str) -> Node:
        return self._node(("ref", name), "ref", name, None, self._nullable[name])

    def _seq(self, a: Node, b: Node) -> Node:
        if a is self.empty or b is self.empty:
            return self.empty
        if a is self.eps:
            return b
        if b is self.eps:
            return a
        if a.op == "seq":
            return self._seq(a.a, self._seq(a.b, b))
        return self._node(("seq", id(a), id(b)), "seq", a, b, a.null and b.null)

    def _alt(self, nodes: Iterable[Node]) -> Node:
        members: dict[int, Node] = {}
        for n in nodes:
            if n.op == "alt":
                members.update((id(x), x) for x in n.a)
            elif n is not self.empty:
                members[id(n)] = n
        if not members:
            return self.empty
        if len(members) == 1:
            return next(iter(members.values()))
        return self._node(("alt", frozenset(members)), "alt", tuple(members.values()), None, any(n.null for n in members.values()))

    def _build(self, x: tuple) -> Node:
        kind = x[0]
        if kind == "tok":
            return self._node(("tok", x[1]), "tok", self._kinds(x[1]))
        if kind == "ref":
            return self._ref(x[1])
        if kind == "star":
            inner = self._build(x[1])
            return self._node(("star", id(inner)), "star", inner, None, True)
        if kind == "alt":
            return self._alt([self._build(y) for y in x[1]])
        out = self.eps
        for y in reversed(x[1]):
            out = self._node(("not", y[1], id(out)), "not", y[1], out, out.null) if y[0] == "not" else self._seq(self._build(y), out)
        return out

    def derive(self, node: Node, kind: str) -> Node:
        """What may follow the token kind; the empty node if it may not come here."""
        out = node.memo.get(kind)
        if out is not None:
            return out
        op = node.op
        if op == "seq":
            out = self._seq(self.derive(node.a, kind), node.b)
            if node.a.null:
                out = self._alt((out, self.derive(node.b, kind)))
        elif op == "alt":
            out = self._alt([self.derive(x, kind) for x in node.a])
        elif op == "ref":
            if kind in self._firsts[node.a]:
                if node.b is None:
                    node.b = self._build(self.rules[node.a])
                out = self.derive(node.b, kind)
            else:
                out = self.empty
        elif op == "tok":
            out = self.eps if kind in node.a else self.empty
        elif op == "star":
            out = self._seq(self.derive(node.a, kind), node)
        elif op == "not":
            out = self.empty if kind == node.a else self.derive(node.b, kind)
        else:
            out = self.empty
        node.memo[kind] = out
        return out
