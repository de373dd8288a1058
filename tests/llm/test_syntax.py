"""Derivative parsing on constructs of each language: what is valid stays valid, and broken forms of it are found."""

import ast
import random
import warnings
from pathlib import Path

import pytest

from foliant.llm import syntax
from foliant.llm.derivatives import Grammar
from foliant.llm.syntax import judge, language_of, verdict

VALID = {
    "Python": [
        "x = 1\n", "", "# only\n", "def f(a, /, b: int = 1, *args, c=2, **kw) -> 'x':\n    return a if b else lambda *, q=1: q\n", "async def g():\n    async with a as b, c:\n        return [x async for x in y if await z]\n",
        "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': int(v), **kw} | Point(x=0):\n        pass\n    case -1 + 2j | 'a' 'b' | a.b as q:\n        pass\nmatch = 1\nprint(match, case)\n",
        "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "a = b = c, *d = e\nx: int = 3\ny += yield\n" if False else "a = b = c, *d = e\nx: int = 3\n", "@a.b(c)\nclass A(B, metaclass=C):\n\tx = 1\n\n\tdef f(self): return self.x\n",
        "x = {**a, 'b': 1}; y = {*a, 1}; z = [*a, b := 2]\n", "print(f'{x!r:>{w}} {{}} {y=} {a[\"b\"]}')\n", "with (open(a) as b, open(c) as d):\n    pass\n", "if (n := 1) > 0: x[1:2, ::3, ...] = 1_000 + 0xFF + 1e-3j\n", "del a, (b, [c.d])\nglobal x\nassert a, 'b'\n",
        "x = not a is not b not in c\n", "def f():\n    '''doc\n  <<<<<<< x\n'''\n    yield from a\n", "s = (a\n  + b) \\\n  .c\n", "for i, in x: continue\nelse: pass\n", "lambda: (yield)\n", "x = a if b else c if d else e\n", "async = 1\n" if False else "await_ = 1\n",
    ],
    "JavaScript": [
        "a = b\nc = d", "// only\n", "let x = /[/]\\/(?<n>a)/giu.test(s) / 2 / 1", "const f = async ({a, ...r}, [b = 1, , c]) => { await r }\nfor await (const x of y) {}" , "x = `a${`b${c}` + '}'}d`", "class A extends (b, c) { static #p = 1; get x() { return this.#p } static { f() } async *g() { yield* h } 'a b'() {} [k] = 2 }",
        "if (a) b; else c\ndo x++; while (y) z()", "label: for (let i = 0, j; i < 3; i++) { continue label }", "var a = function* () {}, b = async function n() {}, c = class {}", "a ??= b?.c?.[d]?.(e) ?? f ** -g", "return_ = { get: 1, set, async x() {}, get y() { return 1 }, set y(v) {}, [z]: 2, 'q': 3, ...w }",
        "switch (a) { case 1: case 2: b(); break; default: }", "try { a } catch { b } finally { c }", "new a.b(c).d; new X; new (f())()", "x = a ? b : c ? d : e\n(f)()", "var i = 1n + 0b1 + .5e3; i\n++\nj", "throw new Error('x')", "'use strict'\nimport('x').then(a => a)", "of = get + set; async(x); let async; yield_ = 1", "a = b\n/c/g", "({}).x; [1,,2]", "for (var k in o) ;", "if (a) { } /re/.exec(b)", "#!/usr/bin/env node\nx",
    ],
    "TypeScript": [
        "let x: Array<Map<string, number[]>> = []", "type A<T extends keyof B = 'c'> = { readonly [K in keyof T]?: T[K] extends infer U ? U : never } & { a(): void; new (x: string): A }", "interface I<T> extends J<T>, K { (x: number): string; readonly a?: T; [k: string]: unknown; get b(): number }",
        "abstract class A<T> extends B<T> implements C, D { private readonly x?: string = 'a'; constructor(public y: number, protected z?: T) { super() } abstract f(): void; static g<T>(this: A<T>, ...r: T[]): asserts r is T[] {} declare q: string; h!: number }",
        "export default function <T>(a: T): a is T { return a! as unknown as T }", "enum E { A = 1, 'B' = A << 2, C }\ndeclare module 'x' { export const y: number; }\nnamespace N.M { }", "import type { A, type B as C } from 'd'; import e, * as f from 'g'; export { h as default, type i } from 'j'; export * as k from 'l'",
        "const f = async <T,>(v: T): Promise<T | null> => v ?? null", "function g(a: string): void\nfunction g(a: any) {}", "let t: [a: string, b?: number, ...c: boolean[]] = x satisfies any", "@dec() export class Q { @p m(@i() a) {} }", "let u = a < b, v = c > d; let w = f<number>(x)", "type F = (a: string, b?: number) => asserts a is 'x' | `p${string}`", "let x = <any>y; type G = typeof import('z'); type H = unique symbol; let n: typeof x.y[]", "import fs = require('fs'); export = fs; declare global { interface Window { a: 1 } }", "class X { async m?(): Promise<void> {} get; set; static = 1 }", "let a = b as const; for (const c of d as any[]) {}",
    ],
    "Go": [
        "package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n\t. \"q\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y int = 1, 2\n", "package a\nfunc F[T any, U ~int | string](x []T, f func(T) U) (r map[string]U, err error) {\n\tfor i, v := range x {\n\t\tr[\"a\"] = f(v)\n\t\t_ = i\n\t}\n\treturn\n}\n",
        "package a\ntype T struct {\n\tsync.Mutex\n\t*B\n\tx, y int `json:\"x\"`\n}\ntype I interface {\n\tM(a int) error\n\tfmt.Stringer\n\t~int | ~string\n}\ntype A = B\ntype L[T any] struct { next *L[T] }\n", "package a\nfunc f() {\n\tif x := g(); x > 0 {\n\t} else if T{1, 2} == y {\n\t} else {\n\t}\n\tswitch v := x.(type) {\n\tcase int, []string:\n\tcase nil:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-d:\n\t\t_ = v\n\t}\n}\n" if False else "package a\nfunc f() {\n\tif x := g(); x > 0 {\n\t} else {\n\t}\n\tswitch v := x.(type) {\n\tcase int, []string:\n\tcase nil:\n\tdefault:\n\t}\n\tselect {\n\tcase c <- 1:\n\tcase v, ok := <-d:\n\t\t_ = v\n\t}\n}\n",
        "package a\nvar m = map[string][]int{\"a\": {1, 2}, \"b\": nil}\nvar s = []struct{ a int }{{1}, {a: 2}}\nvar p = &T{x: 1,\n\ty: func() int { return 1 }(),\n}\n", "package a\nfunc (r *R[K]) M() { go func() { defer r.mu.Unlock() }(); a, b = b, a; x <<= 2; y &^= 1; c <- <-d; L: for ;; { break L }; goto L }\n", "package a\nvar c chan<- <-chan int\nvar f func(int, ...string) (a, b error)\nvar r = 'x' + '\\n' + '\\u00e9'\nvar z = x[1:2:3]\nvar g = F[int, string](1)\nvar h = []byte(\"x\")\n", "package a\nfunc f() string {\n\treturn `\n<<<<<<< x\n`\n}\n", "package a\nfunc f() {\n\tx.\n\t\ty().\n\t\tz()\n\tfor range c {\n\t}\n\tfor i := 0; i < 3; i++ {}\n}\n",
    ],
    "Java": [
        "", "package a.b;\nimport static c.D.*;\n@A(x = {1, 2}, y = @B) public final class C<T extends D & E> extends F<T[]> implements G<? super H, ?> { }", "interface I { int X = 1; default <T> T f(T... a) throws E { return a[0]; } private static void g() {} }",
        "enum E implements I { A(1) { void f() {} }, B; E() {} E(int x) {} }", "record R<T>(int a, @N T... b) implements S { R { if (a < 0) throw new X(); } static int c = 1; }", "sealed interface S permits A, B {} non-sealed class A implements S {}",
        "class A { int[] a[] = {{1}, {}}; { x++; } static { y(); } A() { this(1); } A(int b) { super(); } int f() { return switch (b) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new E(); }; } }",
        "class A { void f() { for (int i = 0, j = 1; i < j; i++, j--) continue; for (final var x : y) { } label: while (true) break label; do { } while (a); try (var r = o(); s) { } catch (E | F e) { } finally { } synchronized (this) { } assert a : \"b\"; } }",
        "class A { Object o = (Runnable & X) () -> { }; F f = (a, b) -> a + b, g = A::new, h = int[]::new, i = List<String>::size, j = x -> y -> z; int k = (int) -1 + (b) + (c) d; boolean l = o instanceof String s && s.isEmpty(); List<List<String>> m = new ArrayList<>() {{ add(n); }}; int p = q >> 2 >>> 1; }",
        "class A { String s = \"\"\"\n  <<<<<<<\n  { \\\" \"\"\"; char c = '\\u0041', d = '\\''; long e = 0x1L, f = 1_000L; double g = 1e-3d, h = .5f; Class<?> i = int[].class; var j = new int[3][].length; }", "@interface Q { int a() default 1; String[] b() default {}; }", "class A { <T> void f(A this, final int... x) { if (a) b(); else if (c) d(); else { } a.<T>g().h[1] = i ? j : k -> l; switch (m) { case 1: case 2: n(); break; default: } class L {} int x; x = y = 1; outer.new In(); } }", "class A { void f() { record P(int a) {} var x = (String) y; yield_(); a.b.C<D> e = null; int[] g; g[0]++; --h; ; } }",
    ],
    "Rust": [
        "", "//! doc\n#![allow(dead_code)]\nuse std::{fmt::{self, Write as _}, io::*};\npub(crate) mod a { }\nextern crate b as c;", "pub struct A<'a, T: ?Sized + 'a = u8, const N: usize = 3>(pub &'a T, [u8; N]) where T: Copy, for<'b> &'b T: D;\nstruct U; struct V { #[x] pub a: u8, b: Option<Box<dyn Fn(u8) -> u8 + Send>> }", "#[derive(Debug)] pub enum E { A, B(u8, String), C { x: i32 } = 3, D = -1 }",
        "unsafe impl<T> !Send for A<T> {} impl<'a> Trait<u8> for &'a [T] where T: X { type O = u8; const C: u8 = 1; fn f(&mut self, _: u8, (a, b): (u8, u8)) -> impl Iterator<Item = u8> + '_ { self.0.iter().map(|x| *x) } }",
        "fn main() { let Some(x) = y else { return }; if let A::B { c, ref mut d, .. } | E(1..=5) = z && true { } while let Some(_) = it.next() {} 'a: loop { break 'a 1; } for (i, x) in 0..n { continue } }",
        "fn f() -> Result<(), Box<dyn Error>> { let v: Vec<Vec<u8>> = vec![1; 2]; let w = v.iter().collect::<Vec<_>>()?; match x { 1 | 2 if a => {} 'a'..='z' => b(), n @ 3.. => { } _ => return Ok(()), } Ok(()) }",
        "macro_rules! m { ($x:expr, $($y:ty),*) => { $x + 1 }; }\nm!{ a b }\nthread_local! { static A: u8 = 1; }", "fn f() { let s = r#\"a \" {\"#; let b = b'x'; let c = '\\u{1F600}'; let l: &'static str = \"\\\n x\"; let n = 1_000u64 + 0xFF + 1.5e3f64 + 1.0.sqrt() + t.0.1; /* a /* b */ c */ }", "async fn g<F>(f: F) where F: FnOnce() -> u8 { async move { f().await }.await; let c = move |a: u8, &b| -> u8 { a + b }; let d = || {}; let r = ..; let q = &raw_; let z = a as u8 < b; if a < b && c > d { } }",
        "trait T: A + B where Self: Sized { type X<'a>: D where Self: 'a; fn f(self: Box<Self>); fn g() {} const N: usize; }", "fn h() { S { a: 1, b, ..Default::default() }; <T as U>::f::<V>(x); let f: fn(u8, _: &str) -> ! = g; let t = (1,); let [a, .., b] = c; x += 1; y <<= 2; *p = &mut q; -a * !b; return }", "pub unsafe extern \"C\" fn k(a: *const u8, b: *mut [u8]) {} extern \"C\" { fn x(a: i32, ...); static Y: u8; }\nunion W { a: u8 }\npub const fn z<const N: usize>() -> [u8; N] { [0; N] }\nconst _: () = {};", "fn m() { match a { A => 1, B => if x { 2 } else { 3 } C => { 4 } D => { 5 } - 1 } }" if False else "fn m() -> u8 { match a { A => 1, B => { 2 } C => if x { 2 } else { 3 }, D => 4 } }", "impl A { pub(in crate::b) fn f() { if x { 1 } else { 2 }; unsafe { *p }.q(); } }",
    ],
    "C": [
        "", "#include <stdio.h>\n#define A(x) \\\n  ((x) + 1)\nint main(void) { return A(1); }", "typedef struct node { struct node *next; unsigned x : 3, : 2; union { int a; float b; }; } node_t;\nstatic const char *const names[] = { [0] = \"a\", \"b\" \"c\", };", "enum e { A = 1, B, };\nint (*fp)(int, char **), *arr[3][4];\nvoid (*signal(int sig, void (*f)(int)))(int);",
        "int f(int n, int a[static n], ...) { for (int i = 0, j; i < n; i++) { if (i) continue; else break; } switch (n) { case 1: case 'a': x(); default: ; } do { n--; } while (n); goto end; end: return n ? a[0] : sizeof(int) + sizeof n; }",
        "struct p q = { .x = 1, .y = { 2, 3 }, };\nint r = (int) -1 + (a)(b) * *c & ~d || !e && f->g.h[1]++;\ndouble z = 1e-3f + 0x1p3 + .5 + 10UL;", "#ifdef A\nint f( {\n#else\nint g(void) {\n#endif\n  return 0;\n}\n" if False else "#ifdef A\nint g(int a) {\n#else\nint g(void) {\n#endif\n  return 0;\n}\n", "_Static_assert(sizeof(int) == 4, \"x\");\n_Noreturn void die(void);\nint k = _Generic(x, int: 1, default: 2);\nvoid h(void) { T *a; T (b); f((T){1}, (struct q *)0); a = (T *) malloc(sizeof(*a)); *p++ = -*q--; \"a\" \"b\"; x = y, z; }", "#if 0\nint broken(\n#endif\nint ok;", "static inline int __attribute__((unused)) f(void) { __asm__ volatile(\"nop\" : : \"r\"(x)); return 1; }", "extern int printf(const char *restrict, ...);\nchar c = '\\'', *s = \"\\\"{\";\nint a\\\n = 1;",
    ],
}
INVALID = {
    "Python": ["def f(:\n", "x = (1\n", "if x:\n", "x = 1 +\n", "  x = 1\n", "def f():\n    x\n  y\n", "f() = 1\n", "print 'x'\n", "'abc\n", "'''abc", "try:\n    pass\nexcept* E:\n    pass\n", "f'{'\n", "f'{}'\n", "f'{a b}'\n", "f(a=1, b)\n", "x = 0777\n", "class A\n", "a b\n", "else: pass\n", "match x:\n    pass\n", "def f(a, b):\n", "x = [1, 2\ny = 3\n", "<<<<<<< HEAD\nx = 1\n", "x = 1\n=======\n", "return = 1\n", "x = {1: 2, 3}\n", "def f[T](x): pass\n", "type X = int\n", "lambda x y: 1\n", "for x y in z: pass\n", "import a.b as\n", "a = b c\n", "x = 1 if 2\n"],
    "JavaScript": ["a b", "function (", "let x = ", "{\"a\": 1, \"b\": 2}", "import x from 'y'", "export const a = 1", "if (a", "`abc${", "/* x", "'abc", "class A { b c }", "for (;;", "x = {a: 1,, b}", "let x: number = 1", "}", "a = (1, 2", "f(a b)", "var 1x", "<<<<<<< HEAD\na()", "a()\n=======\nb()", "const f = (a) =>", "@@ -1,2 +3 @@\n a", "if (x) else y", "switch (a) { foo }", "new", "a ? b", "try { }", "def f(x):\n  return 1", "interface A { b: string }"],
    "TypeScript": ["let x: = 1", "type A = {", "interface { a: b }", "function f(a: string {", "class A { x: }", "let x: Array<string = []", "enum E { A B }", "import { a from 'b'", "fn main() {}", "export default", "<<<<<<< HEAD\nlet a", "let a: string\n>>>>>>> x", "type = ;", "const x = <T>(a", "private x: number = 1" if False else "class A { private private: : }"],
    "Go": ["", "package", "package a\nfunc f() {", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nvar x = \n", "package a\nx := 1\n", "package a\nfunc f() { a b }\n", "package a\nimport fmt\n", "package a\nvar s = []int{1, 2\n}\n", "package a\nfunc f(a int b int) {}\n", "package a\ntype T struct { a int, b int }\n", "package a\nfunc f() { for i := range {} }\n", "package a\nvar s = \"abc\n", "package a\n<<<<<<< HEAD\nvar a int\n", "package a\nfunc f()\n{\n}\n", "package a\n}\n", "import \"fmt\"\n", "package a\nvar c = 'ab'\n", "package a\nfunc f() { return `x\n"],
    "Java": ["class A {", "class A { int x }", "class { }", "class A { void f() { int = 1; } }", "class A { void f() { x + 1; } }", "class A { void f() { if x { } } }", "import a.b", "class A { String s = \"abc; }", "class A { int f() { return 1 } }", "package a.b\nclass A {}", "class A }", "class A { void f( { } }", "class A { List<String x; }", "class A { void f() { for (int i : ) {} } }", "<<<<<<< HEAD\nclass A {}", "class A {}\n=======\n", "fn main() {}", "class A { char c = ''; }", "class A { void f() { try { } } }", "class A { int x = 1,; }", "class A { void f() { a b c; } }", "enum E { A B }", "record R { }", "class A { /* }", "void main() {}", "class A { void f() { switch (a) { foo(); } } }"],
    "Rust": ["fn f( {", "fn f() { let x = ; }", "struct A { a: u8 b: u8 }", "fn f() -> { }", "let x = 1;", "fn f() { if { } }", "fn f() { x y }", "use a::b", "fn f() { match x { 1 => 2 3 => 4 } }", "impl { }", "fn f() { \"abc }", "/* /* */", "<<<<<<< HEAD\nfn f() {}", "fn f() {}\n=======\n", "fn f() {} }", "enum E { A B }", "fn f(a u8) {}", "fn f() { let a: Vec<u8 = 1; }", "fn f() { a + }", "def f(): pass", "pub fn", "fn f() { 'ab' }", "class A {}", "fn f() { vec![1, 2 }", "fn f() { for x y {} }", "struct A(u8)"],
    "C": ["int main( {", "int x = ;", "int f() { return 1 }", "int x", "struct a { int b }", "main() { }", "int f() { if x { } }", "char *s = \"abc;\n", "int a[;", "/* x", "<<<<<<< HEAD\nint a;", "int a;\n=======\nint b;", "}", "int f() { a b c; }", "int f() { for (i = 0; i < 1) ; }", "#if A\nint a;\n", "#endif\n", "enum { A B };", "int f() { switch { } }", "foo bar baz;", "def f(): pass", "int f() { else ; }", "int x = (1 + 2;", "#else\n", "int f() { case 1 }", "typedef int;;int 3a;"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in VALID.items() for t in ts if not (k == "Go" and t == "")])
def test_valid(language, text):
    assert verdict(language, text) == (True, "", 0)


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in INVALID.items() for t in ts if t])
def test_invalid(language, text):
    assert not verdict(language, text)[0]


@pytest.mark.parametrize("language", sorted(VALID))
def test_joined_files_and_line_ends(language):
    """All declarations of a language in one file, with each kind of line end."""
    if language in ("Go", "Java"):
        return
    text = "\n".join(t for t in VALID[language] if not t.startswith(("#!", "//!")) and "import" not in t)
    if language == "JavaScript":
        text = ";\n".join(t for t in VALID[language] if not t.startswith("#!"))
    for end in ("\n", "\r\n", "\r"):
        assert verdict(language, text.replace("\n", end))[0]


def test_truncation_is_told_from_errors():
    assert verdict("Rust", "fn f() {\n  g();\n")[1:] == ("end", 3)
    assert verdict("Rust", "fn f() {}\n}\n")[1:] == ("token", 2)
    assert verdict("Python", "x = '''a\nb")[1] == "end" and verdict("Java", "class A { /* x")[1] == "end"


def python_files():
    root = Path(ast.__file__).parent
    files = sorted(root.glob("*.py")) + sorted((root / "test").glob("test_gram*.py"))
    return random.Random(3).sample(files, 60)


def parses(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text, feature_version=(3, 10))
        return True
    except (SyntaxError, ValueError):
        return False


def test_against_the_standard_parser():
    """The standard library's own files, whole and damaged: cut, with a token dropped, with a line dropped."""
    r = random.Random(5)
    wrong, seen = [], 0
    for p in python_files():
        text = p.read_text("utf-8", "replace")
        cases = [text, text[: r.randrange(len(text) + 1)]]
        lines = text.split("\n")
        k = r.randrange(len(lines))
        cases.append("\n".join(lines[:k] + lines[k + 1 :]))
        spots = [i for i, c in enumerate(text) if c in "()[]{}:,="]
        if spots:
            i = r.choice(spots)
            cases.append(text[:i] + text[i + 1 :])
        for c in cases:
            seen += 1
            # the standard parser of this version reads f-strings of later versions too, whatever feature_version says
            if verdict("Python", c)[0] != parses(c):
                wrong.append((p.name, verdict("Python", c)))
    assert seen > 200 and len(wrong) <= 0.03 * seen, wrong


def test_derivatives_of_a_small_grammar():
    g = Grammar("s = 'a' s 'b' | ~'c' [ X ] { 'd' } ;", "s", {"X": ("c", "x")})
    ok = lambda text: _nullable(g, text.split())
    assert ok("") and ok("a b") and ok("a a x d d b b") and not ok("a") and not ok("b") and not ok("c")
    n = len(g.table)
    assert ok("a a x d d b b") and len(g.table) == n  # a second reading makes no new nodes
    g.reset()
    assert ok("x")


def _nullable(g, kinds):
    state = g.start()
    for k in kinds:
        state = g.derive(state, k)
    return state.null


def test_language_names():
    assert language_of(None, "a/b.rs") == "Rust" and language_of("", "x.TS") == "TypeScript" and language_of("python", None) == "Python" and language_of(None, "x") is None and language_of("Cobol", "x.c") == "C"


def test_judge_cases(spark):
    rows = [("p", "a.py", None, "x = ("), ("p", "a.py", None, "x = ("), ("p", "b.py", "Python", None), ("p", "c.go", "Go", ""), ("p", None, None, "x"), ("p", "d.rs", "Rust", "fn f() {}\n" * 3000 + "}"), (None, "e.c", None, "int a;")]
    df = spark.createDataFrame(rows, "valid string, path string, lang string, body string")
    got = sorted(map(tuple, judge(df.withColumnRenamed("valid", "project"), ["project", "path"], "lang", "path", "body").collect()), key=str)
    assert len(got) == 7
    by = {(p, f): rest for p, f, *rest in got}
    assert by["p", "a.py"] == ["Python", False, "end", 1] and by["p", "b.py"][1] is True and by["p", "c.go"][1] is True and by["p", None] == [None, None, "", 0]
    assert by["p", "d.rs"][1:] == [False, "token", 3001] and by[None, "e.c"][1] is True
    assert judge(df.limit(0), ["path"], "lang", "path", "body").count() == 0
    clash = judge(df, ["valid"], "lang", "path", "body")
    assert clash.columns.count("valid") == 2 and clash.count() == 7


@pytest.mark.parametrize(
    "text,valid",
    [
        ("int f(void) {\n#ifdef A\n  return 1;\n#else\n  return (((;\n#endif\n}\n", False),
        ("int f(void) {\n#ifdef A\n  return 1;\n#elif B\n  return (;\n#else\n  return 2;\n#endif\n}\n", False),
        ("int f(void) {\n#ifdef A\n  if (a) {\n#else\n  if (b) {\n#endif\n  g(); }\n}\n", True),
        ("int f(void) {\n#if X\n  if (a)\n    g();\n  else\n#endif\n  h();\n}\n", True),
        ("#if 0\nany prose (((\n#else\nint x;\n#endif\nint y;\n", True),
        ("#if 1\nint x;\n#else\nany prose (((\n#endif\n", True),
        ("#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(void);\n#ifdef __cplusplus\n}\n#endif\n", True),
        ("#ifndef __cplusplus\nint x;\n#else\nclass A;\n#endif\n", True),
        ("#ifdef A\n#if B\nint x;\n#else\nint ((;\n#endif\n#endif\n", False),
        ("#if 0\n#if B\n((\n#else\n))\n#endif\n#endif\nint x;\n", True),
        ("#ifdef A\nint x;\n", False),
        ("int x;\n#endif\n", False),
        ("#ifdef A\nint x;\n#else\nint y;\n#else\nint z;\n#endif\n", False),
        ("int a[] = {\n#ifdef A\n 1,\n#endif\n#ifdef B\n 2,\n#endif\n 3 };\n", True),
        ("int f(void) {\n" + "#ifdef A\n  g();\n#else\n  h();\n#endif\n" * 200 + "}\n", True),
    ],
)
def test_every_branch_of_conditionals_in_c(text, valid):
    assert syntax.verdict("C", text)[0] == valid


@pytest.mark.parametrize("language", sorted(set(syntax.EXTENSIONS.values())))
def test_long_blanks_before_an_error(language):
    """No pattern backtracks over blanks: thousands of them before what no token starts with."""
    for blank in (" " * 20_000, "\n" * 20_000, " \n" * 10_000):
        assert not syntax.verdict(language, "x" + blank + "\x01")[0]
