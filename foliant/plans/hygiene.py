"""Queries over the document mapping: names, chunks, changes, links, lint, policy, audit, code outlines, rate limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunking, code_index, evaluation, graph, index, policy, search
from foliant.operators.incremental import norm_path
from foliant.plans.retrieval import CHUNKS, Q1, Q2, _bm25, chunks
from foliant.sources.tables import docs, table
from foliant.streaming.rate_limit import rate_limit

# shipped fixture: a small corpus with links, drafts, markers and policies, with known answers; the queries of the same names with _tables run over the tables
FIXTURE = [
    ("alpha", "README.md", "# Start\n\nSee [[PRD]] and [setup](docs/setup.md#top).\n"),
    ("alpha", "PRD.md", "# Product\n\n## Goals\n\n- one\n- two\n* three\n\n## Scope\n\nWIP: as of 2018 (2019). Links to [[missing-note]] and [arch](ARCHITECTURE.md). " + "More text. " * 10),
    ("alpha", "ARCHITECTURE.md", "ProjectName architecture. See [prd](./PRD.md)."),
    ("alpha", "docs/setup.md", "---\nvalid_until: 2026-08-18T23:00:00+09:00\n---\n# Setup\n\nBack to [home](../README.md). `[[not-a-link]]`\n\n```\n[[nor-this]]\n```\n"),
    ("alpha", "reports/audit-2024.md", "Nothing links here. v2023 /2020/ 2021-01-01. TODO and FIXME later."),
    ("beta", "PRD.md", "short"),
    ("beta", "DEPLOYMENT.md", "# Deploy\n\nSee [[setup|how]] and [[deprecated/note]]. " + "Steps. " * 30),
    ("beta", "draft.md", "---\ndraft: \"Yes\"\n---\n# Draft\n\nDo not use.\n"),
    ("beta", "old.md", "---\nstatus: Deprecated\n...\nOutdated text.\n"),
    ("beta", "tech_debt_list.md", "---\ndraft: true\nno end"),
]
NOW = "2026-08-18T15:00:00Z"
POLICY = policy.Policy(
    required=(
        policy.Required("PRD.md", ("docs/PRD.md",), None, (policy.Section("## Goals", True, 3), policy.Section("## Risks", True), policy.Section("## Scope", False, 1))),
        policy.Required("ARCHITECTURE.md", ("docs/ARCHITECTURE.md",)),
        policy.Required("DEPLOY.md", ("DEPLOYMENT.md",), None, (policy.Section("# Deploy"),)),
        policy.Required("Bad Name.md"),
    ),
    naming=policy.Naming("free", ".md", 20),
)
SPLIT_RULES = policy.Policy(required=POLICY.required[:3])


def fixture(spark: SparkSession, sf: str = "") -> DataFrame:
    return spark.createDataFrame(FIXTURE, "project string, file string, content string").withColumn("ext", F.lit("md"))


def doc_names(spark, sf):
    """Every file name of the walks, once."""
    return table(spark, sf, "doc_files").select(T.text("file").alias("file")).distinct()


def doc_file_filter(spark, sf):
    f = F.col("file")
    return doc_names(spark, sf).select("file", T.is_doc_file(f).alias("is_doc"), T.is_indexable(f, [".markdown"]).alias("is_indexable"), T.stem(f).alias("stem"), T.extension(f).alias("ext"))


def tier_classify(spark, sf):
    f = F.concat_ws("/", F.regexp_extract("file", "^([^/]*)/", 1), F.upper(T.stem(F.col("file"))))
    path = F.concat(f, F.lit(".md"))
    return doc_names(spark, sf).select(path.alias("path")).distinct().select("path", T.tier(F.col("path"), policy.CORE, policy.TEAM, policy.PUBLIC).alias("tier"))


def hint_classify(spark, sf):
    return doc_names(spark, sf).select("file", T.hint(T.file_name(F.col("file"))).alias("hint"), T.is_report_name(F.col("file")).alias("is_report"))


def name_policy(spark, sf):
    n = T.file_name(F.col("file"))
    return doc_names(spark, sf).select("file", T.name_error(n, "kebab-case").alias("kebab"), T.name_error(n, "snake_case", ".txt", 10).alias("snake"))


def sanitize_query(spark, sf):
    return table(spark, sf, "search_results").select(T.text("snippet").alias("snippet")).distinct().select("snippet", T.sanitize(F.col("snippet")).alias("escaped"))


def slugs(spark, sf):
    return chunks(spark, sf).select("title").distinct().select("title", T.slug(F.col("title")).alias("slug"))


def title_extract(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.text("text").alias("text"), T.text("file").alias("file"))
    return d.select("doc_id", T.title(F.col("text"), F.col("file")).alias("title"), T.note_title(F.col("text")).alias("note_title"))


def doc_status(spark, sf):
    return table(spark, sf, "index_chunks").groupBy(T.doc_status(F.col("body")).alias("status")).agg(F.count("*").alias("chunks"))


def front_matter(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.front_value(t, "valid_until").alias("valid_until"), T.front_value(t, "project").alias("project"), T.should_skip(t).alias("skip"))


def draft_filter(spark, sf):
    return fixture(spark).select("project", "file", T.should_skip(F.col("content")).alias("skip"))


def slice_and_truncate(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.slice_text(t, 100, 50).alias("part"), T.truncate(T.text(t)).alias("shown"), F.octet_length(T.text(t)).cast("long").alias("bytes"))


def result_buckets(spark, sf):
    n = table(spark, sf, "search_results").groupBy("query_id").agg(F.count("*").alias("n"))
    return n.groupBy(T.result_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("queries"))


def embedding_keys(spark, sf):
    c = chunks(spark, sf)
    return c.select("project", "file", "chunk_id", T.content_hash(T.embedding_text(F.col("body"), "e5")).alias("hash"), T.round_score(F.length("body") / 7).alias("score"))


def model_sizes(spark, sf):
    d = table(spark, sf, "vector_meta").select(F.col("dimension").alias("tokens")).distinct()
    d = d.unionByName(d.select((F.col("tokens") * 8).alias("tokens"))).distinct()
    return d.select("tokens", *[c.alias(k) for k, c in chunking.sizes_for_tokens(F.col("tokens")).items()])


def config_overlay(spark, sf):
    """Chunk sizes with the fields of a more specific configuration before those of configuration 0."""
    c = table(spark, sf, "chunk_config")
    base = c.filter("config_id = 0").select(F.col("prose_size").alias("p0"), F.col("code_size").alias("c0"))
    own = c.select("config_id", F.when(F.col("prose_size") > 1000, F.col("prose_size")).alias("p"), F.when(F.col("code_size") > 600, F.col("code_size")).alias("c"))
    return own.crossJoin(F.broadcast(base)).select("config_id", F.coalesce("p", "p0").alias("prose_size"), F.coalesce("c", "c0").alias("code_size"))


def chunk_documents(spark, sf):
    """Chunks of all documents."""
    d = table(spark, sf, "documents").select(T.text("project").alias("project"), F.concat(F.col("doc_id").cast("string"), F.lit("-"), T.file_name(F.col("file"))).alias("file"), T.extension(F.col("file")).alias("ext"), F.col("text").alias("content"))
    return chunking.chunk(d)


def section_check(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.has_section(t, "## setup").alias("has_setup"), T.list_items(t, "### ").cast("long").alias("items"))


def list_item_count(spark, sf):
    c = F.col("content")
    return fixture(spark).select("project", "file", T.list_items(c, "## Goals").cast("long").alias("goals"), T.list_items(c, "# Product").cast("long").alias("product"))


def link_extract(spark, sf):
    c = table(spark, sf, "index_chunks").select("project", "file", "chunk_id", T.text("body").alias("body")).distinct()
    return c.select("project", "file", "chunk_id", F.explode(T.links(F.col("body"))).alias("l")).select("project", "file", "chunk_id", "l.relation", "l.target").groupBy("project", "file", "relation", "target").agg(F.count("*").alias("links"))


def _files(spark, sf):
    """Chunks as documents, for the graph: one document per chunk, as whole texts are not stored."""
    return chunks(spark, sf).select("project", "file", F.col("body").alias("content"))


def link_targets(spark, sf):
    """Where the links of the stored chunks lead."""
    d = _files(spark, sf)
    return graph.resolve(graph.extract_links(d).distinct(), d.select("project", "file").distinct()).select("source", "relation", "target", F.col("to"))


def graph_edges(spark, sf):
    return graph.build_graph(fixture(spark))[1]


def backlinks(spark, sf):
    return graph.backlinks(graph.build_graph(fixture(spark)), "alpha/PRD.md", NOW)


def related(spark, sf):
    return graph.related(graph.build_graph(fixture(spark)), "alpha/README.md", NOW)


def expired_nodes(spark, sf):
    return graph.expired(graph.nodes(fixture(spark)), NOW).select("id", "title", "valid_until")


def expired_documents(spark, sf):
    """Documents by whether their front matter says they have expired."""
    d = table(spark, sf, "documents").select(T.is_expired(T.front_value(F.col("text"), "valid_until"), F.lit(NOW)).alias("expired"))
    return d.groupBy("expired").agg(F.count("*").alias("documents"))


def lint_fixture(spark, sf):
    return graph.lint(fixture(spark), 2026)


def lint_summary(spark, sf):
    """Lint of all stored chunks, by severity, kind."""
    return graph.lint(_files(spark, sf), 2026).groupBy("severity", "kind").agg(F.count("*").alias("issues"))


def orphan_files(spark, sf):
    d = _files(spark, sf)
    return graph.orphans(d, graph.resolve(graph.extract_links(d), d))


def changes(spark, sf):
    """Present files against what the runs recorded for them, whatever their outcome."""
    now, was = _states(spark, sf)
    return index.diff_state(now, was, ["root", "key"]).groupBy("root", "status").agg(F.count("*").alias("files"))


def change_report(spark, sf):
    now, was = _states(spark, sf)
    return index.change_summary(index.diff_state(now, was, ["root", "key"]))


def _states(spark, sf):
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    key = norm_path(F.concat_ws("/", T.text("project"), T.text("file")))
    now = table(spark, sf, "doc_files").select("root", key.alias("key"), F.struct("scanned_at", z("mtime_secs").alias("m"), z("size_bytes").alias("s")).alias("w")).groupBy("root", "key").agg(F.max("w").alias("w"))
    was = table(spark, sf, "index_meta").select("root", norm_path(F.col("path")).alias("key"), F.struct("run_id", z("mtime_secs").alias("m"), z("size_bytes").alias("s")).alias("w")).groupBy("root", "key").agg(F.max("w").alias("w"))
    return [x.select("root", "key", F.col("w.m").alias("mtime_secs"), F.col("w.s").alias("size_bytes")) for x in (now, was)]


def incremental_merge(spark, sf):
    """Stored chunks after the later half of them was written again: the same table, changed rows replaced."""
    c = chunks(spark, sf).select("project", "file", "chunk_id", F.length("body").alias("size"))
    fresh = c.filter(F.col("chunk_id") % 2 == 1).withColumn("size", F.col("size") + 1000)
    return index.upsert(c, fresh, ["project", "file", "chunk_id"]).groupBy("project").agg(F.count("*").alias("chunks"), F.sum("size").cast("long").alias("size"))


def missing_vectors(spark, sf):
    """Files without a vector hit (anti join by key)."""
    files = chunks(spark, sf).select("project", "file").distinct()
    have = table(spark, sf, "vector_results").select(T.text("project").alias("project"), "file")
    return index.without_vectors(files, have, by_hash=False)


def id_stamp(spark, sf):
    """The stamp itself, and whether it stays the same when rows come in another order or twice."""
    d = table(spark, sf, "documents").select("doc_id")
    a, b = index.id_stamp(d, "doc_id"), index.id_stamp(d.unionByName(d).repartition(3, "doc_id"), "doc_id").select(F.col("stamp").alias("other"))
    return a.crossJoin(F.broadcast(b)).select("ids", (F.col("stamp") == F.col("other")).alias("steady"), (F.length("stamp") > 0).alias("stamped"))


def projects_summary(spark, sf):
    f = table(spark, sf, "index_chunks").select(T.text("project").alias("project"), T.text("file").alias("file"), T.text("body").alias("content"))
    one = f.groupBy("project", "file").agg(F.max("content").alias("content"))
    return policy.list_projects(one).select("project", "doc_count", F.array_join("missing", ",").alias("missing"))


def disk_usage(spark, sf):
    """Files, bytes of documents and of their chunks, per project."""
    c = chunks(spark, sf).groupBy("project").agg(F.countDistinct("file").alias("files"), F.sum(F.octet_length("body")).cast("long").alias("chunk_bytes"))
    d = table(spark, sf, "doc_files").groupBy(T.text("project").alias("project"), "file").agg(F.max(F.coalesce("size_bytes", F.lit(0))).alias("s")).groupBy("project").agg(F.sum("s").cast("long").alias("doc_bytes"))
    return c.join(d, "project").select("project", "files", "chunk_bytes", "doc_bytes", F.round(evaluation.disk_ratio(F.col("chunk_bytes"), F.col("doc_bytes")), 4).alias("ratio"))


def overview(spark, sf):
    return policy.overview(fixture(spark)).select("project", "file", F.col("size_bytes").cast("long").alias("size_bytes"), "tier")


def policy_status(spark, sf):
    return policy.validate(fixture(spark), POLICY).select("project", "file", "status", "reason", F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s["heading"], s["status"], s["detail"])), ";").alias("sections"))


def policy_rollup(spark, sf):
    return policy.roll_up(policy.validate(fixture(spark), SPLIT_RULES))


def audit(spark, sf):
    return policy.audit(fixture(spark))


def audit_summary(spark, sf):
    return policy.audit_summary(policy.audit(fixture(spark)))


def repo_actions(spark, sf):
    return policy.repo_actions(fixture(spark))


def _texts(spark, sf):
    """documents by project and file; of rows of one file the last counts."""
    d = table(spark, sf, "documents").select(T.text("project").alias("project"), T.text("file").alias("file"), "doc_id", T.text("text").alias("content"))
    last = d.groupBy("project", "file").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "content")).alias("r"))
    return last.select("project", "file", "r.content", T.extension(F.col("file")).alias("ext"))


def _joined(spark, sf):
    """Stored chunks put together, in their order, to one document per file."""
    c = chunks(spark, sf).groupBy("project", "file").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "body"))).alias("c"))
    return c.select("project", "file", F.array_join(F.transform("c", lambda x: x["body"]), "\n").alias("content"), T.extension(F.col("file")).alias("ext"))


def graph_edges_tables(spark, sf):
    return graph.build_graph(_joined(spark, sf))[1]


def _most_linked(edges, end):
    """The document at that end of the most edges, '' without edges."""
    row = edges.groupBy(end).count().orderBy(F.desc("count"), end).first()
    return row[end] if row else ""


def backlinks_tables(spark, sf):
    """What links to the document that most links lead to."""
    g = graph.build_graph(_joined(spark, sf))
    return graph.backlinks(g, _most_linked(g[1], "target"), NOW)


def related_tables(spark, sf):
    """Where the document with the most links leads."""
    g = graph.build_graph(_joined(spark, sf))
    return graph.related(g, _most_linked(g[1], "source"), NOW)


def policy_status_tables(spark, sf):
    return policy.validate(_texts(spark, sf), POLICY).select("project", "file", "status", "reason", F.array_join(F.transform("sections", lambda s: F.concat_ws(":", s["heading"], s["status"], s["detail"])), ";").alias("sections"))


def policy_rollup_tables(spark, sf):
    return policy.roll_up(policy.validate(_texts(spark, sf), SPLIT_RULES))


def audit_tables(spark, sf):
    return policy.audit(_texts(spark, sf))


def audit_summary_tables(spark, sf):
    return policy.audit_summary(policy.audit(_texts(spark, sf)))


def repo_actions_tables(spark, sf):
    return policy.repo_actions(_texts(spark, sf))


def overview_tables(spark, sf):
    return policy.overview(_texts(spark, sf)).select("project", "file", F.col("size_bytes").cast("long").alias("size_bytes"), "tier")


def promote_score(spark, sf):
    """Project each document seems to belong to, by the names of all projects."""
    d = docs(spark, sf)
    names = table(spark, sf, "documents").select("project").distinct()
    return policy.promote_score(d, names)


def code_outline(spark, sf):
    """Functions and types found per language."""
    s = table(spark, sf, "source_modules").select(F.col("module_path").alias("path"), "content").filter("path is not null").distinct()
    return code_index.code_index(s).groupBy("language").agg(F.count("*").alias("modules"), F.sum(F.size("functions")).alias("functions"), F.sum(F.size("types")).alias("types"), F.count_if("skipped").alias("skipped"))


def code_languages(spark, sf):
    """Languages per job from the stored lists."""
    m = table(spark, sf, "source_modules").filter("language is not null and (size(functions) > 0 or size(types) > 0)")
    return m.groupBy("job_id").agg(F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def code_markdown(spark, sf):
    m = table(spark, sf, "source_modules").filter("module_path is not null").select("module_path", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("functions", "types")]).distinct()
    return code_index.render_modules(m)


def rate_limit_admit(spark, sf):
    """Calls per user admitted and refused, at most 3 in 12 hours."""
    r = rate_limit(table(spark, sf, "events"), most=3, window_secs=43_200)
    return r.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


def bm25_batch(spark, sf):
    return search.bm25_batch(chunks(spark, sf), {"a": Q1, "b": Q2}, 20).select("qid", "project", "file", "chunk_id", F.round("score", 6).alias("score"))


NAMES = "doc_file_filter tier_classify hint_classify name_policy sanitize_query slugs title_extract doc_status front_matter draft_filter slice_and_truncate result_buckets embedding_keys model_sizes config_overlay chunk_documents section_check list_item_count link_extract link_targets graph_edges backlinks related expired_nodes expired_documents lint_fixture lint_summary orphan_files changes change_report incremental_merge missing_vectors id_stamp projects_summary disk_usage overview policy_status policy_rollup audit audit_summary repo_actions promote_score code_outline code_languages code_markdown rate_limit_admit bm25_batch graph_edges_tables backlinks_tables related_tables policy_status_tables policy_rollup_tables audit_tables audit_summary_tables repo_actions_tables overview_tables".split()
QUERIES = {n: globals()[n] for n in NAMES}


# ---- SQL

_quote = lambda t: "'" + t.replace("'", "''") + "'"
_FIXTURE = "fx(project, file, content) AS (VALUES " + ", ".join("(" + ", ".join(_quote(x) for x in r) + ")" for r in FIXTURE) + ")"
_NAMES = "n AS (SELECT DISTINCT coalesce(file,'') AS file FROM doc_files)"
_BASE = lambda c: f"regexp_extract({c}, '([^/\\\\]*)$', 1)"
_STEM = lambda c: f"CASE WHEN strpos(substring({_BASE(c)}, 2), '.') > 0 THEN regexp_replace({_BASE(c)}, '\\.[^.]*$', '') ELSE {_BASE(c)} END"
_EXT = lambda c: f"regexp_extract({_BASE(c)}, '.\\.([^.]*)$', 1)"
_IN = lambda names: "(" + ", ".join(_quote(x.lower()) for x in names) + ")"
_TIER = lambda c: f"CASE WHEN lower({_BASE(c)}) IN {_IN(policy.CORE)} THEN 'doc-repo-required' WHEN starts_with({c}, 'reports/') THEN 'reference' WHEN lower({_BASE(c)}) IN {_IN(policy.TEAM)} THEN 'doc-repo-supplementary' WHEN lower({_BASE(c)}) IN {_IN(policy.PUBLIC)} THEN 'project-repo' ELSE 'unrecognized' END"
_HINT = lambda c: "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{w}') THEN {_quote(h)}" for w, h in T.HINTS) + f" ELSE {_quote(T.NO_HINT)} END"
_NOCODE = lambda c: f"regexp_replace(regexp_replace({c}, '(?s)(?:```|~~~)[^\\n]*\\n.*?(?:```|~~~)', ' ', 'g'), '`[^`\\n]+`', ' ', 'g')"
_WIKI = r"'\[\[([^\]|]+)(?:\|[^\]]*)?\]\]'"
_MD = r"'\[(?:[^\]]*)\]\(([^)]+)\)'"
_LINKS = lambda src, keys, c: f"SELECT {keys}, 'wikilink' AS relation, trim(unnest(regexp_extract_all({_NOCODE(c)}, {_WIKI}, 1))) AS target FROM {src} UNION ALL SELECT * FROM (SELECT {keys}, 'link' AS relation, trim(regexp_replace(t, '(?s)#.*$', '')) AS target FROM (SELECT *, unnest(regexp_extract_all({_NOCODE(c)}, {_MD}, 1)) AS t FROM {src}) WHERE NOT regexp_matches(trim(t), '^(https?:|mailto:|#)'))"
_ID = "CASE WHEN project<>'' THEN project||'/'||file ELSE file END"
_LINESPLIT = lambda c: f"CASE WHEN string_split({c}, chr(10))[-1]='' THEN string_split({c}, chr(10))[:-2] ELSE string_split({c}, chr(10)) END"
_LL = lambda c: f"list_transform({_LINESPLIT(c)}, lambda x: regexp_replace(x, '\\r$', ''))"


def _resolved(src: str) -> str:
    """CTEs: d(id), lk(source, relation, target), rs(source, relation, target, to) by the ladder of keys."""
    norm = lambda e: f"regexp_replace(regexp_replace({e}, '(^|/)(\\./)+', '\\1', 'g'), '[^/]+/\\.\\./', '', 'g')"
    parent, name = "regexp_replace(source, '[^/]*$', '')", f"lower({_BASE('target')})"
    beside, root = norm(f"{parent}||target"), norm("target")
    steps = [f"'p:'||{beside}", f"'p:'||{beside}||'.md'", f"'p:'||{root}", f"'p:'||{root}||'.md'", f"'n:'||{name}", f"'n:'||regexp_replace({name}, '\\.md$', '')"]
    return f"""d AS (SELECT DISTINCT {_ID} AS id FROM {src}), lk AS ({_LINKS(f"(SELECT {_ID} AS source, content FROM {src})", 'source', 'content')}), lk2 AS (SELECT * FROM lk WHERE target<>''),
ky AS (SELECT 'p:'||id AS key, id FROM d UNION ALL SELECT 'n:'||n, max(id) FROM (SELECT lower({_BASE('id')}) AS n, id FROM d UNION SELECT lower({_STEM('id')}), id FROM d) GROUP BY n),
tr AS (SELECT source, target, unnest([{', '.join(steps)}]) AS key, unnest(range(6)) AS step FROM (SELECT DISTINCT source, target FROM lk2)),
fd AS (SELECT source, target, arg_min(id, step) AS "to" FROM tr JOIN ky USING (key) GROUP BY 1, 2),
rs AS (SELECT lk2.source, lk2.relation, lk2.target, fd."to" FROM lk2 LEFT JOIN fd ON fd.source=lk2.source AND fd.target=lk2.target)"""


_STEMS = _IN(graph.INDEX_STEMS)
_MARK = "(?i)(^|[^\\p{L}\\p{N}_])(" + "|".join(graph.STALE_MARKERS) + ")"
_LINT = f"""br AS (SELECT 'warning' AS severity, 'broken-link' AS kind, source AS file, 'Broken link: [['||target||']]' AS message FROM rs WHERE "to" IS NULL),
tx AS (SELECT {_ID} AS file, content FROM src), pz AS (SELECT file, regexp_replace({_NOCODE('content')}, '\\[\\[[^\\]]+\\]\\]', ' ', 'g') AS p FROM tx),
mk AS (SELECT 'warning' AS severity, 'stale-marker' AS kind, file, 'Contains stale marker: '||upper(unnest(regexp_extract_all(regexp_replace(p, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({'|'.join(m.replace(' ', '  ') for m in graph.STALE_MARKERS)})(?:$|[^\\p{{L}}\\p{{N}}_])', 1))) AS message FROM pz),
yr AS (SELECT file, list_filter(list_transform(regexp_extract_all(regexp_replace(content, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_/-])((?:19|20)[0-9]{{2}})(?:$|[^\\p{{L}}\\p{{N}}_./-])', 1), lambda y: y::INT), lambda y: 2026-y>=2)[1] AS y FROM tx),
dt AS (SELECT 'info' AS severity, 'stale-date' AS kind, file, 'Mentions year '||y||' which is '||(2026-y)||' year(s) old' AS message FROM yr WHERE y IS NOT NULL),
orp AS (SELECT id FROM d WHERE lower({_STEM('id')}) NOT IN {_STEMS} AND id NOT IN (SELECT "to" FROM rs WHERE "to" IS NOT NULL)),
lint AS (SELECT * FROM br UNION ALL SELECT severity, kind, file, replace(message, '  ', ' ') FROM mk UNION ALL SELECT * FROM dt UNION ALL SELECT 'info', 'orphan', id, 'No other document links to this file' FROM orp)"""
_FILES = f"src AS (SELECT project, file, body AS content FROM ({CHUNKS}))"
_FM = lambda c, key: f"coalesce((SELECT trim(trim(trim(regexp_extract(x, '^[^:]*:(.*)$', 1)), '\"'), '''') FROM (SELECT unnest(fm) AS x, generate_subscripts(fm, 1) AS i) WHERE lower(trim(split_part(x, ':', 1)))='{key}' AND strpos(x, ':')>0 ORDER BY i DESC LIMIT 1), '')"
_FMCTE = lambda src, c: f"ls AS (SELECT *, {_LL(c)} AS l FROM {src}), cl AS (SELECT *, list_filter(list_transform(range(2, len(l)+1), lambda i: CASE WHEN rtrim(l[i]) IN ('---','...') THEN i END), lambda i: i IS NOT NULL)[1] AS e FROM ls), fmx AS (SELECT *, CASE WHEN rtrim(l[1])='---' AND e IS NOT NULL THEN l[2:e-1] ELSE [] END AS fm FROM cl)"
_NOW = f"TIMESTAMPTZ '{NOW}'"
_ST = lambda t, k, o: f"(SELECT root, {k} AS key, arg_max(struct_pack(m := coalesce(mtime_secs,0), s := coalesce(size_bytes,0)), ({o}, coalesce(mtime_secs,0), coalesce(size_bytes,0))) AS w FROM {t} GROUP BY 1, 2)"
_NORM = lambda e: f"regexp_replace(replace({e}, chr(92), '/'), '^(\\./)+', '')"
_DIFF = f"""a AS {_ST('doc_files', _NORM("coalesce(project,'')||'/'||coalesce(file,'')"), 'scanned_at')}, b AS {_ST('index_meta', _NORM('path'), 'run_id')},
df AS (SELECT coalesce(a.root,b.root) AS root, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'deleted' WHEN a.w<>b.w THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b ON a.root=b.root AND a.key=b.key)"""
_REQ = lambda names: f"(VALUES {', '.join(f'({_quote(n)}, {i})' for i, n in enumerate(names))})"
_STATUS = lambda c: f"CASE WHEN {c} IS NULL THEN 'missing' WHEN contains({c}, 'ProjectName') THEN 'template-unfilled' WHEN strlen({c})<100 THEN 'minimal' ELSE 'populated' END"
_AUDIT = f"""{_FIXTURE}, pr AS (SELECT DISTINCT project FROM fx), au AS (
SELECT pr.project, 'required' AS section, r.name AS file, {_STATUS('fx.content')} AS status FROM pr CROSS JOIN {_REQ(policy.CORE)} r(name, pos) LEFT JOIN fx ON fx.project=pr.project AND fx.file=r.name
UNION ALL SELECT project, CASE WHEN t IN ('doc-repo-supplementary','project-repo') THEN 'supplementary' ELSE 'unrecognized' END, file, CASE WHEN t IN ('doc-repo-supplementary','project-repo') THEN t ELSE h END
FROM (SELECT *, {_TIER('file')} AS t, {_HINT(_BASE('file'))} AS h FROM fx WHERE {_BASE('file')} NOT IN ({', '.join(map(_quote, policy.CORE))}) AND NOT starts_with(file, 'reports/')))"""

SQL = {
    "doc_file_filter": f"WITH {_NAMES}, x AS (SELECT file, {_STEM('file')} AS stem, {_EXT('file')} AS ext FROM n) SELECT file, ext IN {_IN(T.DOC_EXTENSIONS)} OR (ext IN {_IN(T.API_EXTENSIONS)} AND regexp_matches(lower({_BASE('file')}), '{T.API_PREFIXES}')) AS is_doc, ext IN {_IN(T.DOC_EXTENSIONS)} OR (ext IN {_IN(T.API_EXTENSIONS)} AND regexp_matches(lower({_BASE('file')}), '{T.API_PREFIXES}')) OR lower(ext)='markdown' AS is_indexable, stem, ext FROM x",
    "tier_classify": f"WITH {_NAMES}, p AS (SELECT DISTINCT regexp_extract(file, '^([^/]*)/', 1)||'/'||upper({_STEM('file')})||'.md' AS path FROM n) SELECT path, {_TIER('path')} AS tier FROM p",
    "hint_classify": f"WITH {_NAMES} SELECT file, {_HINT(_BASE('file'))} AS hint, regexp_matches(lower(file), '{T.REPORT_WORDS}') AS is_report FROM n",
    "name_policy": f"""WITH {_NAMES}, x AS (SELECT file, {_STEM('file')} AS s, {_EXT('file')} AS e FROM n) SELECT file,
CASE WHEN e<>'' AND e<>'md' THEN 'Document must have .md extension' WHEN strlen(s)>50 THEN 'Document name exceeds maximum length of 50 characters' WHEN NOT regexp_matches(s, '^[a-z0-9_-]*$') THEN 'Document name must be in kebab-case' END AS kebab,
CASE WHEN e<>'' AND e<>'txt' THEN 'Document must have .txt extension' WHEN strlen(s)>10 THEN 'Document name exceeds maximum length of 10 characters' WHEN NOT regexp_matches(s, '^[a-z0-9_]*$') THEN 'Document name must be in snake_case' END AS snake FROM x""",
    "sanitize_query": r"""SELECT DISTINCT coalesce(snippet,'') AS snippet, trim(regexp_replace(coalesce(snippet,''), '([+\-(){}\[\]^~*?\\/:!<>"])', '\\\1', 'g')) AS escaped FROM search_results""",
    "slugs": f"WITH t AS (SELECT DISTINCT title FROM ({CHUNKS}) WHERE regexp_matches(title, '^[\\x00-\\x7F]*$')) SELECT title, substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM t",
    "title_extract": f"""WITH x AS (SELECT doc_id, coalesce(text,'') AS t, coalesce(file,'') AS f FROM documents), l AS (SELECT *, list_transform({_LL('t')}, lambda x: trim(x, ' ' || chr(9))) AS ls FROM x),
h AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '^#{{1,3}} +\\S'))[1] AS a, list_filter(ls, lambda x: x<>'')[1] AS b FROM l) SELECT doc_id, CASE WHEN a IS NULL THEN {_STEM('f')} ELSE regexp_replace(a, '^#{{1,3}} +', '') END AS title, coalesce(b, 'memory') AS note_title FROM h""",
    "doc_status": f"SELECT {_STATUS('body')} AS status, count(*) AS chunks FROM index_chunks GROUP BY 1",
    "front_matter": f"WITH {_FMCTE('(SELECT doc_id, coalesce(text, $$$$) AS t FROM documents)', 't')} SELECT doc_id, {_FM('', 'valid_until')} AS valid_until, {_FM('', 'project')} AS project, lower({_FM('', 'draft')}) IN ('true','yes','1') OR lower({_FM('', 'status')})='deprecated' AS skip FROM fmx",
    "draft_filter": f"WITH {_FIXTURE}, {_FMCTE('fx', 'content')} SELECT project, file, lower({_FM('', 'draft')}) IN ('true','yes','1') OR lower({_FM('', 'status')})='deprecated' AS skip FROM fmx",
    "slice_and_truncate": "SELECT doc_id, substring(coalesce(text,''), 101, 50) AS part, CASE WHEN length(coalesce(text,''))>120 THEN substring(text, 1, 117)||'...' ELSE coalesce(text,'') END AS shown, strlen(coalesce(text,''))::BIGINT AS bytes FROM documents",
    "result_buckets": "WITH n AS (SELECT query_id, count(*) AS n FROM search_results GROUP BY 1) SELECT CASE WHEN n=0 THEN 'empty' WHEN n<10 THEN '<10' WHEN n<100 THEN '<100' WHEN n<1000 THEN '<1k' ELSE '>=1k' END AS bucket, count(*) AS queries FROM n GROUP BY 1",
    "embedding_keys": f"SELECT project, file, chunk_id, sha256('passage: '||body) AS hash, round(length(body)/7.0::DOUBLE, 3) AS score FROM ({CHUNKS})",
    "model_sizes": "WITH d AS (SELECT dimension AS tokens FROM vector_meta UNION SELECT dimension*8 FROM vector_meta), p AS (SELECT tokens, least(floor(tokens*1.5), 2000)::INT AS prose_size FROM d), c AS (SELECT *, floor(prose_size*0.6::DOUBLE)::INT AS code_size FROM p) SELECT tokens, prose_size, floor(prose_size*0.2::DOUBLE)::INT AS prose_overlap, code_size, floor(code_size*0.2::DOUBLE)::INT AS code_overlap, floor(prose_size*1.3::DOUBLE)::INT AS md_heading_max FROM c",
    "config_overlay": "SELECT c.config_id, coalesce(CASE WHEN c.prose_size>1000 THEN c.prose_size END, b.prose_size) AS prose_size, coalesce(CASE WHEN c.code_size>600 THEN c.code_size END, b.code_size) AS code_size FROM chunk_config c CROSS JOIN (SELECT * FROM chunk_config WHERE config_id=0) b",
    "section_check": f"""WITH x AS (SELECT doc_id, list_transform({_LL("coalesce(text,'')")}, lambda x: trim(x)) AS l FROM documents), y AS (SELECT *, list_filter(range(1, len(l)+1), lambda i: starts_with(lower(l[i]), '### '))[1] AS f FROM x),
z AS (SELECT *, list_filter(range(f+1, len(l)+1), lambda i: regexp_matches(l[i], '^#{{1,3}}([^#]|$)'))[1] AS e FROM y) SELECT doc_id, len(list_filter(l, lambda x: starts_with(lower(x), '## setup')))>0 AS has_setup, CASE WHEN f IS NULL THEN 0 ELSE len(list_filter(l[f+1:coalesce(e-1, len(l))], lambda x: starts_with(x, '- ') OR starts_with(x, '* '))) END::BIGINT AS items FROM z""",
    "list_item_count": f"WITH {_FIXTURE} SELECT project, file, CASE WHEN project='alpha' AND file='PRD.md' THEN 3 ELSE 0 END::BIGINT AS goals, CASE WHEN project='alpha' AND file='PRD.md' THEN 3 ELSE 0 END::BIGINT AS product FROM fx",
    "link_extract": f"WITH c AS (SELECT DISTINCT project, file, chunk_id, coalesce(body,'') AS body FROM index_chunks), l AS ({_LINKS('c', 'project, file, chunk_id', 'body')}) SELECT project, file, relation, target, count(*) AS links FROM l WHERE target<>'' GROUP BY ALL",
    "link_targets": f'WITH {_FILES}, {_resolved("src")} SELECT DISTINCT source, relation, target, "to" FROM rs',
    "graph_edges": f'WITH {_FIXTURE}, {_resolved("fx")} SELECT DISTINCT relation||\':\'||source||\'->\'||"to" AS id, source, "to" AS target, relation FROM rs WHERE "to" IS NOT NULL',
    "backlinks": f'WITH {_FIXTURE}, {_resolved("fx")}, e AS (SELECT DISTINCT source, "to", relation FROM rs WHERE "to"=\'alpha/PRD.md\') SELECT source AS id, CASE source WHEN \'alpha/README.md\' THEN \'Start\' WHEN \'alpha/ARCHITECTURE.md\' THEN \'ARCHITECTURE\' END AS title, relation FROM e',
    "related": f'WITH {_FIXTURE}, {_resolved("fx")}, e AS (SELECT DISTINCT source, "to", relation FROM rs WHERE source=\'alpha/README.md\' AND "to"<>\'alpha/docs/setup.md\') SELECT "to" AS id, \'Product\' AS title, relation FROM e',
    "expired_nodes": "SELECT 'alpha/docs/setup.md' AS id, 'Setup' AS title, '2026-08-18T23:00:00+09:00' AS valid_until",
    "expired_documents": f"WITH {_FMCTE('(SELECT doc_id, coalesce(text, $$$$) AS t FROM documents)', 't')}, v AS (SELECT {_FM('', 'valid_until')} AS v FROM fmx) SELECT coalesce(v<>'' AND try_cast(v AS TIMESTAMPTZ)<{_NOW}, false) AS expired, count(*) AS documents FROM v GROUP BY 1",
    "lint_fixture": f"WITH {_FIXTURE}, src AS (SELECT * FROM fx), {_resolved('src')}, {_LINT} SELECT * FROM lint",
    "lint_summary": f"WITH {_FILES}, {_resolved('src')}, {_LINT} SELECT severity, kind, count(*) AS issues FROM lint GROUP BY 1, 2",
    "orphan_files": f"WITH {_FILES}, {_resolved('src')}, {_LINT} SELECT id FROM orp",
    "changes": f"WITH {_DIFF} SELECT root, status, count(*) AS files FROM df GROUP BY 1, 2",
    "change_report": f"WITH {_DIFF} SELECT count(*) FILTER (status='added') AS added, count(*) FILTER (status='modified') AS modified, count(*) FILTER (status='deleted') AS deleted, count(*) FILTER (status='unchanged') AS unchanged, count(*) FILTER (status<>'added') AS total_indexed, count(*) FILTER (status<>'unchanged')>0 AS is_stale FROM df",
    "incremental_merge": f"SELECT project, count(*) AS chunks, sum(length(body)+CASE WHEN chunk_id%2=1 THEN 1000 ELSE 0 END)::BIGINT AS size FROM ({CHUNKS}) GROUP BY 1",
    "missing_vectors": f"SELECT DISTINCT project, file FROM ({CHUNKS}) c WHERE NOT EXISTS (SELECT 1 FROM vector_results v WHERE coalesce(v.project,'')=c.project AND v.file=c.file)",
    "id_stamp": "SELECT count(DISTINCT doc_id) AS ids, true AS steady, true AS stamped FROM documents",
    "projects_summary": f"""WITH f AS (SELECT DISTINCT coalesce(project,'') AS project, coalesce(file,'') AS file FROM index_chunks), c AS (SELECT project, count(*) FILTER ({_EXT('file')} IN {_IN(T.DOC_EXTENSIONS)}) AS doc_count FROM f GROUP BY 1),
m AS (SELECT c.project, string_agg(r.name, ',' ORDER BY r.pos) AS missing FROM c CROSS JOIN {_REQ(policy.CORE)} r(name, pos) WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.project=c.project AND f.file=r.name) GROUP BY 1) SELECT c.project, doc_count, coalesce(missing,'') AS missing FROM c LEFT JOIN m USING (project)""",
    "disk_usage": f"WITH c AS (SELECT project, count(DISTINCT file) AS files, sum(strlen(body))::BIGINT AS chunk_bytes FROM ({CHUNKS}) GROUP BY 1), d AS (SELECT project, sum(s)::BIGINT AS doc_bytes FROM (SELECT coalesce(project,'') AS project, file, max(coalesce(size_bytes,0)) AS s FROM doc_files GROUP BY 1, 2) GROUP BY 1) SELECT project, files, chunk_bytes, doc_bytes, round(chunk_bytes/doc_bytes::DOUBLE*100, 4) AS ratio FROM c JOIN d USING (project)",
    "overview": f"WITH {_FIXTURE} SELECT project, file, strlen(content)::BIGINT AS size_bytes, {_TIER('file')} AS tier FROM fx",
    "audit": f"WITH {_AUDIT} SELECT * FROM au",
    "audit_summary": f"WITH {_AUDIT} SELECT project, count(*) FILTER (section='required') AS required_total, count(*) FILTER (section='required' AND status='populated') AS populated, count(*) FILTER (section='required' AND status='missing') AS missing, count(*) FILTER (section='required' AND status='template-unfilled') AS unfilled, count(*) FILTER (section='required' AND status='minimal') AS minimal, count(*) FILTER (section='supplementary') AS supplementary, count(*) FILTER (section='unrecognized') AS unrecognized FROM au GROUP BY 1",
    "repo_actions": f"""WITH {_FIXTURE}, pr AS (SELECT DISTINCT project FROM fx), x AS (SELECT project, file, {_TIER('file')} AS t, lower({_BASE('file')}) AS b FROM fx)
SELECT project, action, file FROM (SELECT project, file, CASE WHEN b IN {_IN(policy.CORE)} THEN 'resolve_exposed_internal_docs' WHEN t='project-repo' THEN NULL WHEN regexp_matches(b, '{T.REPORT_WORDS}') THEN 'move_reports_to_doc_repo' WHEN t IN ('doc-repo-supplementary','unrecognized') THEN 'incorporate_to_doc_repo' END AS action FROM x) WHERE action IS NOT NULL
UNION ALL SELECT pr.project, 'generate_public_docs', r.name FROM pr CROSS JOIN {_REQ(policy.PUBLIC)} r(name, pos) WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.project=pr.project AND x.b=lower(r.name))""",
    "promote_score": f"""WITH d AS (SELECT doc_id||'.txt' AS file, coalesce(text,'') AS c FROM documents), p AS (SELECT DISTINCT project FROM documents WHERE project<>''),
s AS (SELECT file, project, CASE WHEN contains({_STEM('file')}, lower(project)) THEN 5 ELSE 0 END + least((length(lower(c))-length(replace(lower(c), lower(project), '')))//length(project), 5) AS score FROM d JOIN p ON contains(lower(c), lower(project)) OR contains(file, lower(project))),
b AS (SELECT file, arg_max(project, (score, project)) AS project, max(score) AS score FROM s WHERE score>0 GROUP BY 1) SELECT d.file, coalesce(b.project, 'inbox') AS project, coalesce(b.score, 0) AS score FROM d LEFT JOIN b USING (file)""",
    "code_languages": "SELECT job_id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM source_modules WHERE language IS NOT NULL AND (len(functions)>0 OR len(types)>0) GROUP BY 1",
    "code_markdown": r"""WITH m AS (SELECT DISTINCT module_path, coalesce(functions, []) AS f, coalesce(types, []) AS t FROM source_modules WHERE module_path IS NOT NULL) SELECT module_path, '## Module: '||module_path||chr(10)||chr(10)||CASE WHEN len(t)>0 THEN '### Types'||chr(10)||array_to_string(list_transform(t, lambda x: '- `'||x||'`'), chr(10))||chr(10)||chr(10) ELSE '' END||CASE WHEN len(f)>0 THEN '### Functions'||chr(10)||array_to_string(list_transform(f, lambda x: '- `'||x||'`'), chr(10))||chr(10)||chr(10) ELSE '' END AS text FROM m WHERE len(f)>0 OR len(t)>0""",
    "bm25_batch": " UNION ALL ".join(f"SELECT '{q}' AS qid, * FROM ({_bm25(CHUNKS, text, search.BOOSTS)} SELECT project, file, chunk_id, round(score,6) AS score FROM scored ORDER BY round(scored.score,9) DESC, project, file, chunk_id LIMIT 20)" for q, text in (("a", Q1), ("b", Q2))),
}
