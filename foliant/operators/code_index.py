"""Outline of source code: functions, types, submodules and imports per file, and its Markdown form.

Python is read with the standard parser. The other languages are outlined by patterns over code whose comments and strings are
blanked, which follow their visibility rules; this is approximate for declarations that macros or unusual layout hide.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: extensions, and path separators of module names
LANGUAGES = {
    "rust": (("rs",), "::"), "python": (("py", "pyi"), "."), "typescript": (("ts", "tsx"), "/"), "javascript": (("js", "jsx", "mjs", "cjs"), "/"), "go": (("go",), "/"), "java": (("java",), "."),
    "kotlin": (("kt", "kts"), "."), "c": (("c",), "/"), "cpp": (("cpp", "cc", "cxx", "hpp", "hxx", "h"), "/"), "swift": (("swift",), "/"), "ruby": (("rb",), "::"), "csharp": (("cs",), "."),
}
BY_EXTENSION = {e: lang for lang, (exts, _) in LANGUAGES.items() for e in exts}
# fixed values: folders without sources of a project's own
SKIPPED = "target node_modules vendor __pycache__ build dist Pods venv coverage bazel-out".split()


def is_source_path(path: Column) -> Column:
    """Not below a skipped or hidden folder."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda p: p.isin(*SKIPPED) | p.startswith("."))


def language_for(path: str) -> str | None:
    return BY_EXTENSION.get(path.rsplit(".", 1)[-1]) if "." in path else None


def module_path(path: str, language: str) -> str:
    """Name of a module by its file: index files stand for their folder."""
    stem = path if language in ("c", "cpp") else path.rsplit(".", 1)[0]
    parts = stem.split("/")
    if parts[-1] == {"rust": "mod", "python": "__init__", "typescript": "index", "javascript": "index"}.get(language) and len(parts) > 1:
        parts.pop()
    return LANGUAGES[language][1].join(parts)


def _python(source: str) -> dict[str, list[str]] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    functions, types, imports = [], [], []
    shown = lambda name: not name.startswith("_") or name.startswith("__") and name.endswith("__")

    def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        marks = "".join(f"@{ast.unparse(d)} " for d in node.decorator_list)
        back = f" -> {ast.unparse(node.returns)}" if node.returns else ""
        return f"{marks}{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)}){back}"

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and shown(node.name):
            functions.append(signature(node))
        elif isinstance(node, ast.ClassDef) and shown(node.name):
            bases = ", ".join(ast.unparse(b) for b in node.bases)
            types.append(f"class {node.name}" + (f"({bases})" if bases else ""))
            functions += [f"{node.name}.{signature(x)}" for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and shown(x.name)]
        elif isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append("." * node.level + (node.module or ""))
    return {"functions": functions, "types": types, "submodules": [], "imports": imports}


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)'", re.S)
_RUBY_BLANK = re.compile(r"#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_SIG = r"\([^(){}]*(?:\([^()]*\)[^(){}]*)*\)"
# per language: kind -> patterns; group 1 is what is listed
_RULES: dict[str, dict[str, list[str]]] = {
    "rust": {
        "functions": [rf"^\s*(pub(?:\([^)]*\))?\s+(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+\w+(?:<[^{{(]*>)?\s*{_SIG}(?:\s*->\s*[^{{;]+)?)"],
        "types": [r"^\s*(pub(?:\([^)]*\))?\s+(?:unsafe\s+)?(?:struct|enum|trait|type|union)\s+\w+)"], "submodules": [r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*[;{]"], "imports": [r"^\s*(?:pub\s+)?use\s+([^;]+);"],
    },
    "typescript": {
        "functions": [rf"^(?:export\s+)?(?:default\s+)?((?:async\s+)?function\s*\*?\s*\w+(?:<[^(]*>)?\s*{_SIG}(?:\s*:\s*[^{{;]+)?)", r"^export\s+(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::\s*[^=]+)?=>"],
        "types": [r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?((?:class|interface|enum|type)\s+\w+)"], "imports": [r"^import\b[^'\"\n]*['\"]([^'\"]+)['\"]"],
    },
    "go": {
        "functions": [rf"^(func\s+(?:{_SIG}\s*)?[A-Z]\w*(?:\[[^\]]*\])?\s*{_SIG}[^{{\n]*)"], "types": [r"^\s*(?:type\s+)?([A-Z]\w*\s+(?:struct|interface))\b", r"^type\s+([A-Z]\w*)\b(?!\s+(?:struct|interface))"], "imports": [r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"]+)\"\s*$"],
    },
    "java": {
        "functions": [rf"^\s*(public\s+(?:(?:static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]*>\s+)?(?:[\w.<>\[\],? ]+\s+)?\w+\s*{_SIG})"],
        "types": [r"^\s*(public\s+(?:(?:static|final|abstract|sealed)\s+)*(?:class|interface|enum|record|@interface)\s+\w+)"], "imports": [r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"],
    },
    "kotlin": {
        "functions": [rf"^\s*((?!private|internal)(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?[\w.<>?]+\s*{_SIG}(?:\s*:\s*[\w<>?., ]+)?)"], "types": [r"^\s*((?!private|internal)(?:(?:public|data|sealed|open|abstract|enum|annotation|value|inner|companion)\s+)*(?:class|interface|object|typealias)\s+\w+)"], "imports": [r"^import\s+([\w.*]+)"],
    },
    "c": {
        "functions": [rf"^((?!static\b|typedef\b|return\b|else\b|if\b|for\b|while\b|switch\b)[A-Za-z_][\w\s*]*?\b\w+\s*{_SIG})\s*\{{"], "types": [r"^(?:typedef\s+)?((?:struct|enum|union)\s+\w+)\s*\{", r"^typedef\s+[^;{]*?\b(\w+)\s*;", r"^\}\s*(\w+)\s*;"], "imports": [r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"],
    },
    "cpp": {
        "functions": [rf"^\s*((?!static\b|typedef\b|return\b|else\b|if\b|for\b|while\b|switch\b|using\b)[A-Za-z_][\w\s*&:<>,~]*?\b[\w:~]+\s*{_SIG}(?:\s*(?:const|noexcept|override|final))*)\s*\{{"], "types": [r"^\s*(?:template\s*<[^>]*>\s*)?((?:class|struct|enum(?:\s+class)?|union)\s+\w+)\s*(?::[^{;]*)?\{", r"^\s*using\s+(\w+)\s*="], "submodules": [r"^\s*namespace\s+([\w:]+)"], "imports": [r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"],
    },
    "swift": {
        "functions": [rf"^\s*((?!private|fileprivate)(?:\w+\s+)*func\s+\w+(?:<[^>]*>)?\s*{_SIG}(?:\s*(?:async\s*)?(?:throws\s*)?->\s*[^{{\n]+)?)"], "types": [r"^\s*(?:\w+\s+)*?((?:class|struct|enum|protocol|actor)\s+\w+)\s*[:<{]"], "imports": [r"^import\s+(\w+)"],
    },
    "csharp": {
        "functions": [rf"^\s*(public\s+(?:(?:static|virtual|override|async|abstract|sealed|partial)\s+)*(?:[\w.<>\[\],? ]+\s+)?\w+(?:<[^>]*>)?\s*{_SIG})"], "types": [r"^\s*(public\s+(?:(?:static|abstract|sealed|partial|readonly)\s+)*(?:class|interface|struct|enum|record|delegate)\s+\w+)"], "imports": [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"],
    },
}
_RULES["javascript"] = {k: _RULES["typescript"][k] for k in ("functions", "types", "imports")}


def _ruby(source: str) -> dict[str, list[str]]:
    """Methods under 'private' and 'protected' are left out until 'public' or the next class."""
    functions, types, imports, hidden = [], [], [], False
    for line in _RUBY_BLANK.sub(lambda m: m[0] if m[0][0] != "#" else "", source).split("\n"):
        if m := re.match(r"\s*((?:class|module)\s+[\w:]+(?:\s*<\s*[\w:]+)?)", line):
            types.append(m[1])
            hidden = False
        elif m := re.match(r"\s*(private|protected|public)\s*$", line):
            hidden = m[1] != "public"
        elif (m := re.match(r"\s*(def\s+[\w.?!=]+(?:\([^)]*\))?)", line)) and not hidden:
            functions.append(m[1])
        elif m := re.match(r"\s*require(?:_relative)?\s+['\"]([^'\"]+)", line):
            imports.append(m[1])
    return {"functions": functions, "types": types, "submodules": [], "imports": imports}


def outline(source: str | None, language: str) -> dict[str, list[str]] | None:
    """Lists of a file, None if it cannot be read."""
    source = (source or "").replace("\r\n", "\n")
    if language == "python":
        return _python(source)
    if language == "ruby":
        return _ruby(source)
    code = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    out = {}
    for kind in ("functions", "types", "submodules", "imports"):
        text = source if kind == "imports" else code
        found = [(m.start(1), re.sub(r"\s+", " ", m[1]).strip()) for p in _RULES[language].get(kind, ()) for m in re.finditer(p, text, re.M)]
        out[kind] = [x for _, x in sorted(found)]
    return out


def code_index(sources: DataFrame, language: str | None = None) -> DataFrame:
    """(path, content) -> (path, module_path, language, functions, types, submodules, imports, skipped) of files with a known
    extension; skipped marks files that could not be parsed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                lang = language_for(path or "")
                if lang is None or language is not None and lang != language:
                    continue
                got = outline(content, lang)
                rows.append((path, module_path(path, lang), lang, *((got or {}).get(k, []) for k in ("functions", "types", "submodules", "imports")), got is None))
            yield pd.DataFrame(rows, columns=["path", "module_path", "language", "functions", "types", "submodules", "imports", "skipped"])

    schema = "path string, module_path string, language string, functions array<string>, types array<string>, submodules array<string>, imports array<string>, skipped boolean"
    return sources.filter(is_source_path(F.col("path"))).select("path", "content").mapInPandas(run, schema)


def languages(modules: DataFrame) -> DataFrame:
    """Sorted distinct languages of modules that list anything."""
    listed = modules.filter((F.size("functions") > 0) | (F.size("types") > 0))
    return listed.agg(F.sort_array(F.collect_set("language")).alias("languages"))  # as many as there are languages


def render_modules(modules: DataFrame) -> DataFrame:
    """(module_path, text): one Markdown section per module that lists anything; sorted by name they make up the document."""
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"### {title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n"), F.lit("\n\n"))).otherwise("")
    listed = modules.filter((F.size("functions") > 0) | (F.size("types") > 0))
    return listed.select("module_path", F.concat(F.lit("## Module: "), F.col("module_path"), F.lit("\n\n"), block("Types", "types"), block("Functions", "functions")).alias("text"))
