"""From a question to the facts and texts that answer it: names, files and addresses are looked up in the graph, the facts
that the question's intents call for become blocks of text, and the best ranked node texts follow.

Nothing here calls a language model; `answer` takes one as a function of the context. A block of text holds every row of its
report, read partition by partition; `most` cuts it and says how many rows are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeweft.functions import text as T
from nodeweft.operators import graph, retrieval, traverse, vectors, web
from nodeweft.sources import php_text

from . import cypher

SOURCE_LIMIT = 6000
CUT = "\n... [cut]"


@dataclass
class Store:
    """The tables that questions are answered from; those that an index lacks may be None."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    concepts: DataFrame | None = None
    rules: DataFrame | None = None
    routes: DataFrame | None = None
    renders: DataFrame | None = None
    #: The folder of an index of the nodes' vectors (see operators.vectors); without one all vectors are read.
    vectors: str | None = None

    def patterns(self) -> cypher.Graph:
        """The tables as a graph for the pattern language and SQL."""
        return cypher.Graph(self.nodes, self.edges, self.concepts, self.rules, self.routes, self.renders)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


def _scalars(spark: SparkSession, **columns) -> dict:
    """The values of a question's expressions, evaluated once."""
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def resolve_name(nodes: DataFrame, asked: str, kind: str = "Function") -> str | None:
    """The exact name if the graph has it, else the longest name that the text mentions."""
    names = graph.names_of(nodes, kind)
    if names.where(F.col("name") == asked).take(1):
        return asked
    found = mentioned(nodes, asked, kind, 1)
    return found[0] if found else None


def mentioned(nodes: DataFrame, question: str, kind: str = "Function", limit: int = 5) -> list[str]:
    names = graph.names_of(nodes, kind).where(T.mentions_name(F.lit(question), F.col("name")))
    return [r[0] for r in names.orderBy(F.desc(F.length("name")), "name").limit(limit).collect()]


def mentioned_file(nodes: DataFrame, question: str) -> str | None:
    length = T.mention_length(F.lit(question), F.col("file"))
    row = graph.files_of(nodes).withColumn("n", length).where(F.col("n").isNotNull()).orderBy(F.desc("n"), "file").first()
    return row["file"] if row else None


def _lines(title: str, df: DataFrame, line, most: int | None = None, none: str | None = None) -> str | None:
    """A block of one line per row; `none` (or nothing) where there are no rows."""
    shown = [f"- {line(r)}" for r in (df if most is None else df.limit(most)).toLocalIterator()]
    if not shown:
        return none
    left = df.count() - most if most is not None and len(shown) == most else 0
    return "\n".join([title, *shown, *([f"- ... {left} more"] if left > 0 else [])])


def method_source(content: str, method: str, cls: str | None = None, limit: int = SOURCE_LIMIT) -> str | None:
    """The text of a PHP function or method, cut at `limit`; None if it isn't there or has no end."""
    for d in php_text.parse(content).definitions:
        if d.kind == "Function" and d.name == method and (cls is None or cls in d.classes) and d.closed:
            text = content[d.at : d.end]
            return text if len(text) <= limit else text[:limit] + CUT
    return None


def file_content(store: Store, file: str) -> str | None:
    if store.files is None:
        return None
    row = store.files.where(F.col("file") == file).select("content").first()
    return row[0] if row else None


def data_block(store: Store, file: str) -> str:
    """Lines of a page that touch data, and what it imports."""
    parts = []
    imports = store.edges.where((F.col("kind") == "IMPORTS") & (F.col("src") == f"module::{file}")).join(store.nodes.select(F.col("id").alias("dst"), "name"), "dst").select("name").distinct().orderBy("name")
    parts.append(_lines(f"Imports of {file}:", imports, lambda r: r["name"]))
    if store.files is not None:
        hits = evidence_lines(store.files.where(F.col("file") == file)).orderBy("lineno")
        parts.append(_lines(f"Data access in {file} (lines that look like it, not a trace):", hits, lambda r: f"line {r['lineno']}: {r['line']}"))
    return "\n".join(p for p in parts if p) or f"Nothing in {file} imports or looks like data access."


def evidence_lines(files: DataFrame, most: int = 20) -> DataFrame:
    """(file, lineno, line): the first `most` lines of each file that look like data access, cut at 120 characters."""
    split = F.split("content", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    numbered = F.transform(split, lambda line, i: F.struct((i + 1).cast("long").alias("lineno"), line.alias("line")))
    # Within the row: no line leaves its file before it has matched.
    hits = F.slice(F.filter(numbered, lambda x: T.is_data_access(x["line"])), 1, most)
    return files.select("file", F.inline(hits)).select("file", "lineno", F.substring(T.stripped(F.col("line")), 1, 120).alias("line"))


def impact_block(store: Store, name: str, hops: int, most: int | None = None) -> str:
    """Direct and transitive callers of a function."""
    direct = graph.callers(store.nodes, store.edges, name).orderBy("file", "caller", "line")
    reached = traverse.impact(store.nodes, store.edges, name, hops).orderBy("file", "name")
    return "\n".join([
        _lines(f"Direct callers of {name}:", direct, lambda r: f"{r['caller']} ({r['file']}:{r['line']})", most, f"Direct callers of {name}: none found in the graph."),
        _lines(f"Functions that reach {name} within {hops} calls:", reached, lambda r: f"{r['name']} ({r['file']})", most, f"Functions that reach {name} within {hops} calls: none found; a change stays in {name}."),
    ])


def address_blocks(store: Store, url: str) -> tuple[list[str], str | None]:
    """What is known of an address: its route, its handler's source, the views it renders; and the handler's file."""
    hit = web.resolved_urls(store.spark.createDataFrame([(url,)], "url string"), store.routes, graph.files_of(store.nodes)).first()
    if not hit["resolved"]:
        if hit["matched_pattern"] is None:
            return [f"Note: {url} matches no indexed route."], None
        return [f"Note: {url} matches route {hit['matched_pattern']}, but its target {hit['target']} isn't in the graph."], None
    file, name = hit["file"], f"{hit['class']}::{hit['method']}"
    blocks = [f"Address {url}: {name} ({file}), by route {hit['matched_pattern']}"]
    content = file_content(store, file)
    source = method_source(content, hit["method"], hit["class"]) if content else None
    if source:
        blocks.append(f"Source of {name} in {file}:\n```php\n{source}\n```")
    if store.renders is not None:
        shown = store.renders.where((F.col("source_file") == file) & F.col("resolved")).select("target_file").distinct().orderBy("target_file")
        for (view,) in shown.toLocalIterator():
            text = file_content(store, view)
            if text:
                blocks.append(f"Source of view {view}:\n```php\n{text if len(text) <= SOURCE_LIMIT else text[:SOURCE_LIMIT] + CUT}\n```")
    return blocks, file


def fact_blocks(store: Store, question: str, most: int | None = None) -> list[str]:
    """Blocks of facts for a question: impact always where a function is named, others by intent."""
    q = F.lit(question)
    s = _scalars(store.spark, url=T.url_or_path(q), intents=T.intents(q), hops=T.hop_count(q))
    intents = set(s["intents"])
    blocks: list[str | None] = [impact_block(store, name, s["hops"], most) for name in mentioned(store.nodes, question)]
    if "inherits" in intents:
        for name in mentioned(store.nodes, question, "Class", 3):
            line = lambda r: f"{r['name']} ({r['file']})"
            blocks.append(_lines(f"Classes above {name}:", traverse.ancestors_of(store.nodes, store.edges, name).orderBy("name", "file"), line, most, f"{name} extends nothing that is indexed."))
            blocks.append(_lines(f"Classes below {name}:", traverse.subclasses_of(store.nodes, store.edges, name).orderBy("name", "file"), line, most, f"No class was found that extends {name}."))
    file = None
    if s["url"] and store.routes is not None:
        found, file = address_blocks(store, s["url"])
        blocks += found
    file = file or mentioned_file(store.nodes, question)
    unnamed = "Note: the question is about {}, but names no file or page that is known."
    if store.concepts is not None and store.rules is not None:
        if "roles" in intents:
            blocks.append(_lines("Roles:", web.list_concepts(store.concepts, "Role"), lambda r: f"{r['code']} ({r['name']}), app {r['app']}, {r['source_file']}:{r['lineno']}", most))
        if "rules" in intents:
            blocks.append(_lines(f"Rules on {file}:", web.file_rules(store.concepts, store.rules, store.nodes, file), lambda r: f"role {r['code']}: {r['effect']} {r['target']} (line {r['lineno']}) {r['condition']}", most, f"No rule gates anything in {file}.") if file else unnamed.format("access rules"))
        if "matrix" in intents:
            blocks.append(_lines("Pages by role:", web.role_page_lines(store.concepts, store.rules, store.nodes).orderBy("role"), lambda r: f"{r['role']}: {r['pages']}", most, "No rule gates any page."))
    if "views" in intents and store.renders is not None:
        if file:
            shown = store.renders.where(F.col("source_file") == file).orderBy("lineno", "view_arg")
            blocks.append(_lines(f"Views of {file}:", shown, lambda r: f"line {r['lineno']}: {r['view_arg']} renders " + (r["target_file"] if r["resolved"] else "a file that isn't indexed"), most, f"{file} renders no view."))
        else:
            blocks.append(unnamed.format("views"))
    if "data_source" in intents:
        blocks.append(data_block(store, file) if file else unnamed.format("where data comes from"))
    return [b for b in blocks if b]


def ranked_context(store: Store, question: str, k: int = retrieval.TOP, query_vector: list[float] | None = None) -> DataFrame:
    """(label, rank) of the nodes that fit a question best: by words, then by vectors where these are stored, cut at k."""
    docs = store.nodes.where(F.col("kind").isin("Module", "Class", "Function"))
    hits = retrieval.tfidf_rank(docs, "id", F.concat_ws(" ", "name", "docstring"), question, k)
    label = docs.select("id", T.context_label(F.col("kind"), F.col("name"), F.col("file"), F.col("docstring")).alias("label"))
    by_text = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc"))).join(label, F.col("doc") == F.col("id")).select("label", "rank")
    if query_vector is None or "embedding" not in docs.columns:
        return by_text
    near = vectors.search(store.spark, store.vectors, query_vector, k) if store.vectors else retrieval.vector_topk(docs, "id", "embedding", query_vector, k)
    near = near.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")))
    return retrieval.hybrid(by_text, near.join(label, "id").select("label", "rank"), k)


def context(store: Store, question: str, k: int = retrieval.TOP, query_vector: list[float] | None = None) -> list[str]:
    return [r[0] for r in ranked_context(store, question, k, query_vector).orderBy("rank").collect()]


def answer(store: Store, question: str, model: Callable[[str, str], str] | None = None, embed: Callable[[str], list[float]] | None = retrieval.hashed_embedding) -> str:
    """The context of a question, or what `model(question, context)` makes of it. `embed` must be the model that the stored
    vectors are made by; None leaves vectors out."""
    text = "\n\n".join([*fact_blocks(store, question), "\n".join(context(store, question, query_vector=embed(question) if embed else None))])
    return model(question, text) if model else text


def summary(store: Store) -> str:
    """The modules of each top folder, a line each."""
    text, last = [], None
    for folder, line in graph.folder_modules(store.nodes).orderBy("folder", "line").toLocalIterator():
        text += ([] if last == folder else [*([""] if last is not None else []), f"## {folder}/"]) + [line]
        last = folder
    return "\n".join(text) or "There are no modules yet."
