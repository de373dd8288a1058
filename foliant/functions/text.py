"""Column expressions over document text, names and paths. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: document file extensions, and the prefixes that make structured files documents
DOC_EXTENSIONS = ("md", "txt", "rst", "pdf", "docx", "pptx", "xlsx", "csv")
API_EXTENSIONS = ("yml", "yaml", "json")
API_PREFIXES = "^(openapi|swagger)"

# fixed values: extensions that are chunked as code
CODE_EXTENSIONS = "rs go py ts tsx js jsx java cpp cc c h hpp cs rb swift kt kts scala ex exs zig lua sh bash zsh".split()

# fixed values: words that suggest where an unrecognised document belongs; the first rule that matches counts
HINTS = (
    ("product|requirement|spec|summary", "Related to PRD.md"),
    ("design|orchestration|implementation", "Related to ARCHITECTURE.md"),
    ("plan|roadmap|todo", "Related to PROGRESS.md"),
    ("feasibility|adr|decision", "Related to DECISIONS.md"),
    ("coding_standard|code_style", "Related to CONVENTIONS.md"),
    ("tech_debt|technical_debt", "Related to DEBT.md"),
    ("env_var|secrets", "Related to SECRETS_MAP.md"),
    ("audit|benchmark|analysis|competitive|comprehensive|session|report", "Candidate for reports/ folder"),
)
NO_HINT = "Uncategorized — ask user"
REPORT_WORDS = "audit|benchmark|analysis|competitive|comprehensive|feasibility|report|session"

# fixed values: prefixes that embedding models want before queries and documents
_INSTRUCTION = "Represent this sentence for searching relevant passages: "
PREFIXES = {"e5": ("query: ", "passage: "), "nomic": ("search_query: ", "search_document: "), "arctic": (_INSTRUCTION, ""), "bge-en": (_INSTRUCTION, ""), "mxbai": (_INSTRUCTION, ""), "none": ("", "")}

WIKILINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
MDLINK = r"\[(?:[^\]]*)\]\(([^)]+)\)"
FENCE = r"(?s)(?:```|~~~)[^\n]*\n.*?(?:```|~~~)"
INLINE_CODE = r"`[^`\n]+`"
_SPECIAL = r'([+\-(){}\[\]^~*?\\/:!<>"])'


def text(c: Column | str) -> Column:
    """Missing stored text is ''."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), value being computed once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lines(content: Column) -> Column:
    """Lines as the engine counts them: split at line feeds, one carriage return dropped, no last empty line."""
    parts = F.transform(F.split(text(content), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def file_name(path: Column) -> Column:
    return F.regexp_extract(text(path), r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".\.([^.]*)$", 1)


def is_doc_file(path: Column) -> Column:
    """Case-sensitive allow list; structured files only where they name an API description."""
    e = extension(path)
    return e.isin(*DOC_EXTENSIONS) | (e.isin(*API_EXTENSIONS) & F.lower(file_name(path)).rlike(API_PREFIXES))


def is_indexable(path: Column, extra: list[str]) -> Column:
    """is_doc_file, or one of the extra extensions in any case, with or without dot."""
    wanted = [x.lower().lstrip(".") for x in extra]
    return is_doc_file(path) | (F.lower(extension(path)).isin(*wanted) if wanted else F.lit(False))


def sanitize(query: Column) -> Column:
    """Backslash before each character with a meaning in query syntax, then trimmed."""
    return F.trim(F.regexp_replace(text(query), _SPECIAL, r"\\$1"))


def ngrams(t: Column, sizes: tuple[int, ...] = (2, 3)) -> Column:
    """Lower-cased character n-grams. For short texts: the substrings make it quadratic in the length."""
    low = F.lower(text(t))
    of = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substring(low, i, n))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[of(n) for n in sizes])


def title(content: Column, path: Column, chunk: Column | int = 0) -> Column:
    """First heading of level 1 to 3 in the first chunk, else the file's stem."""
    found = F.regexp_extract(text(content), r"(?m)^[ \t]*#{1,3} +(\S.*?)\s*$", 1)
    chunk = F.lit(chunk) if isinstance(chunk, int) else chunk
    return F.when((chunk == 0) & (found != ""), found).otherwise(stem(path))


def slug(t: Column, most: int = 60) -> Column:
    """Letters and digits in lower case, anything else one dash, none at the ends."""
    s = F.regexp_replace(F.lower(text(t)), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, most)


def note_title(content: Column) -> Column:
    """First line that is not blank, trimmed."""
    found = F.regexp_extract(text(content), r"(?m)^[ \t]*(\S.*?)[ \t\r]*$", 1)
    return F.when(found == "", "memory").otherwise(found)


def without_code(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text(content), FENCE, " "), INLINE_CODE, " ")


def links(content: Column) -> Column:
    """array<struct<relation, target>>: wiki links, then local Markdown links without their anchors."""
    bare = without_code(content)
    wiki = F.transform(F.regexp_extract_all(bare, F.lit(WIKILINK), 1), lambda x: F.struct(F.lit("wikilink").alias("relation"), F.trim(x).alias("target")))
    local = F.filter(F.regexp_extract_all(bare, F.lit(MDLINK), 1), lambda x: ~F.trim(x).rlike("^(https?:|mailto:|#)"))
    md = F.transform(local, lambda x: F.struct(F.lit("link").alias("relation"), F.trim(F.regexp_replace(x, "(?s)#.*$", "")).alias("target")))
    return F.filter(F.concat(wiki, md), lambda x: x["target"] != "")


def tier(path: Column, core: list[str], team: list[str], public: list[str]) -> Column:
    """Where a document belongs, by its name; lists compared in lower case."""
    name, p = F.lower(file_name(path)), text(path)
    of = lambda names: name.isin(*[x.lower() for x in names]) if names else F.lit(False)
    return (
        F.when(of(core), "doc-repo-required")
        .when(p.startswith("reports/") | p.startswith("reports\\"), "reference")
        .when(of(team), "doc-repo-supplementary")
        .when(of(public), "project-repo")
        .otherwise("unrecognized")
    )


def hint(name: Column) -> Column:
    low = F.lower(text(name))
    out = F.when(low.rlike(HINTS[0][0]), HINTS[0][1])
    for words, where in HINTS[1:]:
        out = out.when(low.rlike(words), where)
    return out.otherwise(NO_HINT)


def is_report_name(name: Column) -> Column:
    return F.lower(text(name)).rlike(REPORT_WORDS)


def doc_status(content: Column) -> Column:
    """Null content stands for a file that does not exist. Sizes are bytes."""
    return (
        F.when(content.isNull(), "missing")
        .when(content.contains("ProjectName"), "template-unfilled")
        .when(F.octet_length(content) < 100, "minimal")
        .otherwise("populated")
    )


def name_error(name: Column, case: str = "free", ext: str = ".md", most: int = 50) -> Column:
    """Why a document name breaks the naming policy, null if it does not. The length limit is in bytes."""
    e, s, want = extension(name), stem(name), ext.lstrip(".")
    allowed = {"kebab-case": "^[a-z0-9_-]*$", "snake_case": "^[a-z0-9_]*$"}.get(case)
    out = F.when((e != "") & (e != want), f"Document must have .{want} extension").when(F.octet_length(s) > most, f"Document name exceeds maximum length of {most} characters")
    return out.when(~s.rlike(allowed), f"Document name must be in {case}") if allowed else out


def slice_text(content: Column, offset: int, limit: int) -> Column:
    """Characters from an offset; past the end it is ''."""
    return F.substring(text(content), offset + 1, limit)


def truncate(t: Column, most: int = 120) -> Column:
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 3), F.lit("..."))).otherwise(t)


def result_bucket(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n < 10, "<10").when(n < 100, "<100").when(n < 1000, "<1k").otherwise(">=1k")


def round_score(score: Column) -> Column:
    return F.round(score, 3)


def embedding_text(t: Column, family: str, query: bool = False) -> Column:
    """Text with the prefix that the model family wants."""
    return F.concat(F.lit(PREFIXES[family][0 if query else 1]), text(t))


def content_hash(t: Column) -> Column:
    return F.sha2(text(t), 256)


def page_markers(t: Column) -> Column:
    """Form feeds become page lines; the first page has none."""
    pages = F.split(text(t), "\f", -1)
    marked = F.transform(pages, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("\n--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p)))
    return F.array_join(marked, "")


def front_matter(content: Column) -> Column:
    """array<struct<key, value>> of the block between a first line '---' and the next '---' or '...'; empty if there is none or it is
    not closed."""
    key = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    unquote = lambda v: F.trim(F.regexp_replace(F.regexp_replace(F.trim(v), '^"+|"+$', ""), "^'+|'+$", ""))
    value = lambda x: unquote(F.regexp_replace(x, "^[^:]*:", ""))
    none = F.array().cast("array<string>")

    def block(ls: Column) -> Column:
        end = F.array_position(F.transform(ls, lambda l, i: (i > 0) & F.rtrim(l).isin("---", "...")), True).cast("int")
        return F.when(end > 1, F.slice(ls, 2, F.greatest(end - 2, F.lit(0)))).otherwise(none)

    entries = F.transform(F.filter(let(lines(content), block), lambda x: F.instr(x, ":") > 0), lambda x: F.struct(key(x).alias("key"), value(x).alias("value")))
    opens = text(content).rlike(r"^---[ \t]*\r?\n")
    return F.when(opens, entries).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def should_skip(content: Column) -> Column:
    """Drafts and deprecated documents."""
    return F.exists(front_matter(content), lambda e: ((e["key"] == "draft") & F.lower(e["value"]).isin("true", "yes", "1")) | ((e["key"] == "status") & (F.lower(e["value"]) == "deprecated")))


def front_value(content: Column, key: str) -> Column:
    """Value of the last entry with this key, '' if there is none."""
    found = F.filter(front_matter(content), lambda e: e["key"] == key)
    return F.coalesce(F.try_element_at(F.transform(found, lambda e: e["value"]), F.lit(-1)), F.lit(""))


def has_section(content: Column, heading: str) -> Column:
    return F.exists(lines(content), lambda l: F.lower(F.trim(l)).startswith(heading.lower()))


def list_items(content: Column, heading: str) -> Column:
    """'- ' and '* ' lines from the first line with this heading to the next heading of its level or above."""
    level = len(heading) - len(heading.lstrip("#"))
    none = F.array().cast("array<string>")

    def after(ls: Column) -> Column:
        first = F.array_position(F.transform(ls, lambda l: F.startswith(F.lower(l), F.lit(heading.lower()))), True).cast("int")
        return F.when(first > 0, F.slice(ls, first + 1, F.size(ls) - first)).otherwise(none)

    def section(rest: Column) -> Column:
        stop = F.array_position(F.transform(rest, lambda l: F.length(F.regexp_extract(l, "^(#*)", 1)).between(1, level)), True).cast("int")
        return F.when(stop > 0, F.slice(rest, 1, stop - 1)).otherwise(rest)

    kept = let(let(F.transform(lines(content), lambda l: F.trim(l)), after), section)
    return F.size(F.filter(kept, lambda l: l.startswith("- ") | l.startswith("* ")))


def is_expired(valid_until: Column, now: Column) -> Column:
    """Compared as instants; as text where either is none; empty never expires."""
    a, b = F.try_to_timestamp(valid_until), F.try_to_timestamp(now)
    return (text(valid_until) != "") & F.when(a.isNotNull() & b.isNotNull(), a < b).otherwise(valid_until < now)
