"""Links between documents: resolution, the document graph, backlinks, expiry, lint.

A link target is resolved by a ladder of candidate keys, each an equality: beside the file, with '.md', from the root, with
'.md', by file name anywhere, by stem anywhere. Candidates of all links are one table, joined once; the best step wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T

# fixed values: stems of files that need no link to them
INDEX_STEMS = ("index", "readme", "moc", "map-of-content", "home", "start", "_index")
# fixed values: words that mark stale text
STALE_MARKERS = ("WIP", "TODO", "FIXME", "DRAFT", "DEPRECATED", "DO NOT USE", "OUTDATED")


def normalise_path(path: Column) -> Column:
    """Without '.' and '..' segments; steps above the root stay out."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(walked, "/")


def extract_links(docs: DataFrame) -> DataFrame:
    """(source, relation, target as written) of every link; source is project/file. Repeated links stay."""
    return docs.select(doc_id().alias("source"), F.explode(T.links(F.col("content"))).alias("l")).select("source", "l.relation", "l.target")


def doc_id() -> Column:
    return F.concat_ws("/", F.when(F.coalesce("project", F.lit("")) != "", F.col("project")), F.col("file"))


def resolve(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links with the document they lead to, null where there is none. Names are compared in lower case for the last two steps;
    of several files of a name the last path counts."""
    ids = docs.select(doc_id().alias("id"))
    base = F.lower(T.file_name(F.col("id")))
    by_path = ids.select(F.concat(F.lit("p:"), F.col("id")).alias("key"), "id").distinct()
    by_name = ids.select(F.explode(F.array_distinct(F.array(base, F.lower(T.stem(F.col("id")))))).alias("n"), "id").groupBy("n").agg(F.max("id").alias("id")).select(F.concat(F.lit("n:"), F.col("n")).alias("key"), "id")
    keys = by_path.unionByName(by_name)
    parent = F.regexp_replace("source", "[^/]*$", "")
    name = F.lower(T.file_name(F.col("target")))
    beside, root = normalise_path(F.concat(parent, F.col("target"))), normalise_path(F.col("target"))
    steps = [F.concat(F.lit("p:"), beside), F.concat(F.lit("p:"), beside, F.lit(".md")), F.concat(F.lit("p:"), root), F.concat(F.lit("p:"), root, F.lit(".md")), F.concat(F.lit("n:"), name), F.concat(F.lit("n:"), F.regexp_replace(name, r"\.md$", ""))]
    distinct = links.select("source", "target").distinct()
    tried = distinct.select("source", "target", F.posexplode(F.array(*steps)).alias("step", "key"))
    found = tried.join(keys, "key").groupBy("source", "target").agg(F.min_by("id", "step").alias("to"))
    return links.join(found, ["source", "target"], "left")


def nodes(docs: DataFrame) -> DataFrame:
    """(id, title, valid_until, last_verified); expiry comes from the front matter."""
    c = F.col("content")
    return docs.select(doc_id().alias("id"), T.title(c, F.col("file")).alias("title"), T.front_value(c, "valid_until").alias("valid_until"), T.front_value(c, "last_verified").alias("last_verified")).dropDuplicates(["id"])


def build_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): an edge for every link that resolves, by relation once."""
    to = resolve(extract_links(docs), docs).filter(F.col("to").isNotNull())
    name = F.concat(F.col("relation"), F.lit(":"), F.col("source"), F.lit("->"), F.col("to"))
    return nodes(docs), to.select(name.alias("id"), "source", F.col("to").alias("target"), "relation").dropDuplicates(["id"])


def update_graph(old_edges: DataFrame, old_nodes: DataFrame, changed: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph after (project, file) changed: out-edges of changed documents anew, nodes and edges of documents that are gone pruned."""
    ids = docs.select(doc_id().alias("id")).distinct()
    touched = changed.select(doc_id().alias("id")).distinct()
    fresh = docs.join(changed.select("project", "file").distinct(), ["project", "file"], "left_semi")
    links = resolve(extract_links(fresh), docs).filter(F.col("to").isNotNull())
    name = F.concat(F.col("relation"), F.lit(":"), F.col("source"), F.lit("->"), F.col("to"))
    new = links.select(name.alias("id"), "source", F.col("to").alias("target"), "relation")
    kept = old_edges.join(touched.select(F.col("id").alias("source")), "source", "left_anti").select("id", "source", "target", "relation")
    edges = kept.unionByName(new).dropDuplicates(["id"])
    for end in ("source", "target"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi").select("id", "source", "target", "relation")
    kept_nodes = old_nodes.join(touched, "id", "left_anti").join(ids, "id", "left_semi")
    return kept_nodes.unionByName(nodes(fresh)), edges


def _neighbours(graph: tuple[DataFrame, DataFrame], of: str, near: str, far: str, now: str) -> DataFrame:
    n, e = graph
    alive = n.filter(~T.is_expired(F.col("valid_until"), F.lit(now))).select("id", "title")
    hits = e.filter(F.col(near) == of).select(F.col(far).alias("id"), "relation")
    return hits.join(alive, "id").select("id", "title", "relation")


def backlinks(graph: tuple[DataFrame, DataFrame], doc: str, now: str) -> DataFrame:
    """Documents that link to doc and have not expired: id, title, relation."""
    return _neighbours(graph, doc, "target", "source", now)


def related(graph: tuple[DataFrame, DataFrame], doc: str, now: str) -> DataFrame:
    """Documents that doc links to and that have not expired."""
    return _neighbours(graph, doc, "source", "target", now)


def verify(node_table: DataFrame, doc: str, now: str) -> DataFrame:
    """Nodes with doc verified now; an unknown document is an error."""
    if node_table.filter(F.col("id") == doc).isEmpty():
        raise KeyError(doc)
    return node_table.withColumn("last_verified", F.when(F.col("id") == doc, F.lit(now)).otherwise(F.col("last_verified")))


def expired(node_table: DataFrame, now: str) -> DataFrame:
    return node_table.filter(T.is_expired(F.col("valid_until"), F.lit(now)))


def orphans(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Documents no other resolves to, index-like names apart."""
    ids = docs.select(doc_id().alias("id"), F.lower(T.stem(F.col("file"))).alias("_stem")).distinct()
    return ids.filter(~F.col("_stem").isin(*INDEX_STEMS)).join(resolved.select(F.col("to").alias("id")).filter("id is not null").distinct(), "id", "left_anti").select("id")


_NOT_WORD = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def lint(docs: DataFrame, now_year: int, project: str | None = None) -> DataFrame:
    """(severity, kind, file, message): broken links, stale markers (one row a hit), stale years (first of a file), orphans."""
    if project is not None:
        docs = docs.filter(F.col("project") == project)
    issue = lambda severity, kind, message: [F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), "file", message.alias("message")]
    resolved = resolve(extract_links(docs), docs)
    broken = resolved.filter(F.col("to").isNull()).withColumnRenamed("source", "file").select(*issue("warning", "broken-link", F.concat(F.lit("Broken link: [["), F.col("target"), F.lit("]]"))))
    named = docs.select(doc_id().alias("file"), T.text("content").alias("content"))
    prose = F.regexp_replace(T.without_code(F.col("content")), r"\[\[[^\]]+\]\]", " ")
    marker = "(?i)" + _NOT_WORD[0] + "(" + "|".join(STALE_MARKERS) + ")" + _NOT_WORD[1]
    marks = named.select("file", F.explode(F.regexp_extract_all(prose, F.lit(marker), 1)).alias("m")).select(*issue("warning", "stale-marker", F.concat(F.lit("Contains stale marker: "), F.upper("m"))))
    years = F.regexp_extract_all(F.col("content"), F.lit(r"(?<![\p{L}\p{N}_/-])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_./-])"), 1)
    old = F.try_element_at(F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: F.lit(now_year) - y >= 2), F.lit(1))
    dates = named.select("file", old.alias("y")).filter("y is not null")
    dates = dates.select(*issue("info", "stale-date", F.concat(F.lit("Mentions year "), F.col("y").cast("string"), F.lit(" which is "), (F.lit(now_year) - F.col("y")).cast("string"), F.lit(" year(s) old"))))
    lonely = orphans(docs, resolved).withColumnRenamed("id", "file").select(*issue("info", "orphan", F.lit("No other document links to this file")))
    return broken.unionByName(marks).unionByName(dates).unionByName(lonely)
