"""The engine's own queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeweft.functions import text as T
from nodeweft.operators import chats, graph, resolve, retrieval, traverse, vectors, web
from nodeweft.operators.rows import latest_rows
from nodeweft.session import shared_folder, stage
from nodeweft.sources import facts as facts_of
from nodeweft.sources.tables import table
from nodeweft.sources.tree import dotted_module, manifest, suffix_language
from nodeweft.streaming.incremental import diff_counts, file_diff

from . import ask, cypher, derived, export, fixtures
from .oracle import oracle_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PART = "small ring"
#: A route table over the addresses that messages ask about.
ROUTES = (
    ("(:any)/config", "GET", "App\\Pages\\Config::show/$1"),
    ("(:any)/edit", "GET", "App\\Pages\\Edit::$1"),
    ("(:any)/list", "GET", "App\\Pages\\Listing::"),
    ("(:any)/show/(:num)", "GET", "App\\Pages\\Show::$1/$2"),
    ("ledger/(:any)", "GET", "\\App\\Ledger::$1"),
    ("order/new", "POST", "App\\Order::create"),
    ("unit/show/(:num)", "GET", "App\\Unit::page$1"),
)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def current_nodes(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    keep = [c for c in columns if c != "id"]
    return latest_rows(table(spark, folder, "nodes", "id", "indexed_at", *keep), ["id"], ["indexed_at"], keep)


def current_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    keep = [c for c in columns if c != "file"] or ["content"]
    return latest_rows(table(spark, folder, "files", "file", "indexed_at", *keep), ["file"], ["indexed_at"], keep)


def _impact(hops: int) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return traverse.impact(stage(derived.part_nodes(spark, folder), "nodes"), stage(derived.part_edges(spark, folder), "edges"), PART, hops)

    run.__name__ = f"impact_{hops}hop"
    query(run)


for _h in (3, 5, 10):
    _impact(_h)


@query
def impact_walk_5(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.impact(derived.part_nodes(spark, folder), derived.part_edges(spark, folder), PART, 5, kernel="walk")


@query
def ancestors_5(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.ancestors_of(derived.part_nodes(spark, folder), derived.part_edges(spark, folder), "199")


@query
def subclasses_5(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.subclasses_of(derived.part_nodes(spark, folder), derived.part_edges(spark, folder), "3")


@query
def callers(spark: SparkSession, folder: str) -> DataFrame:
    return graph.callers(derived.part_nodes(spark, folder), derived.part_edges(spark, folder), PART)


@query
def neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return graph.neighbors(derived.part_edges(spark, folder), "function::part::7")


@query
def node_stats(spark: SparkSession, folder: str) -> DataFrame:
    return graph.node_stats(current_nodes(spark, folder, "kind"))


@query
def edge_stats(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_stats(derived.part_edges(spark, folder))


@query
def function_names(spark: SparkSession, folder: str) -> DataFrame:
    return graph.names_of(current_nodes(spark, folder, "kind", "name"))


@query
def module_files(spark: SparkSession, folder: str) -> DataFrame:
    return graph.files_of(current_nodes(spark, folder, "kind", "file"))


@query
def label_scan(spark: SparkSession, folder: str) -> DataFrame:
    return current_nodes(spark, folder, "kind", "name", "file").where(F.col("kind") == "Class").select("id", "name", "file")


@query
def node_upsert(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "nodes", "id", "kind", "name", "file", "lineno", "indexed_at")
    # What was indexed on even days is in the store, the rest arrives.
    even = F.pmod(F.dayofyear("indexed_at"), F.lit(2)) == 0
    return graph.upsert(nodes.where(even), nodes.where(~even), ["id"], "indexed_at").select("id", "kind", "name", "file", "lineno")


@query
def edge_upsert_dedup(spark: SparkSession, folder: str) -> DataFrame:
    edges = derived.part_edges(spark, folder)
    nodes = derived.part_nodes(spark, folder).where(F.col("file") != "Brand#11")
    return graph.upsert_edges(edges, edges, nodes)


@query
def delete_by_file(spark: SparkSession, folder: str) -> DataFrame:
    gone = spark.createDataFrame([("Brand#11",), ("Brand#12",)], "file string")
    return graph.delete_files(derived.part_nodes(spark, folder), derived.part_edges(spark, folder), gone)[1]


@query
def concept_upsert(spark: SparkSession, folder: str) -> DataFrame:
    # Segments of customers below the middle key are stored, those of the others arrive.
    concepts = table(spark, folder, "customer", "c_custkey", "c_mktsegment").select(F.concat(F.lit("concept::app::"), "c_mktsegment").alias("id"), F.col("c_mktsegment").alias("code"), (F.col("c_custkey") % 2).alias("half"))
    per = concepts.groupBy("id", "code", "half").agg(F.count("*").alias("lineno"))
    old, new = (per.where(F.col("half") == h).where(F.col("code") != left).drop("half") for h, left in ((0, "BUILDING"), (1, "MACHINERY")))
    return graph.load_concepts(old, new)


@query
def rule_lww(spark: SparkSession, folder: str) -> DataFrame:
    concepts, targets, rules = derived.segment_rules(spark, folder)
    return graph.load_rules(concepts, targets, rules).select("concept_id", "target_id", "effect")


def _loaded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    concepts, targets, rules = derived.segment_rules(spark, folder)
    return concepts, targets, graph.load_rules(concepts, targets, rules)


@query
def role_rules(spark: SparkSession, folder: str) -> DataFrame:
    concepts, targets, rules = _loaded(spark, folder)
    return web.concept_rules(concepts, rules, targets, "BUILDING").select("target", "effect")


@query
def file_rules(spark: SparkSession, folder: str) -> DataFrame:
    concepts, targets, rules = _loaded(spark, folder)
    return web.file_rules(concepts, rules, targets, "NATION_3").select("code", "effect")


@query
def role_matrix(spark: SparkSession, folder: str) -> DataFrame:
    concepts, targets, rules = _loaded(spark, folder)
    return web.role_matrix(web.role_pages(concepts, rules, targets), ["AUTOMOBILE", "BUILDING", "MACHINERY"])


@query
def role_pages_list(spark: SparkSession, folder: str) -> DataFrame:
    concepts, targets, rules = _loaded(spark, folder)
    return web.role_page_lines(concepts, rules, targets)


@query
def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(current_files(spark, folder))


@query
def stored_hashes(spark: SparkSession, folder: str) -> DataFrame:
    # A scan's hash of the raw bytes goes before that of the text; every third file stands for one with such a hash.
    files = current_files(spark, folder)
    scanned = F.when(F.length("file") % 3 == 0, F.sha1(F.concat("content", F.lit("\xff"))))
    return manifest(files.withColumn("sha1", scanned))


def _versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, folder, "files", "file", "content", "indexed_at")
    first = files.groupBy("file").agg(F.min_by("content", F.struct("indexed_at", "content")).alias("content"))
    return manifest(first.where(~F.col("file").startswith("lumen"))), manifest(current_files(spark, folder).where(~F.col("file").startswith("maple_api")))


@query
def file_diff_status(spark: SparkSession, folder: str) -> DataFrame:
    return file_diff(*_versions(spark, folder)).select("file", "status")


@query
def file_diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    return diff_counts(file_diff(*_versions(spark, folder)))


@query
def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.tfidf_rank(table(spark, folder, "documents", "doc_id", "text"), "doc_id", F.col("text"), "which function renders the ledger page")
    return hits.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query
def term_stats(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.document_frequencies(retrieval.term_frequencies(table(spark, folder, "documents", "doc_id", "text"), "doc_id", F.col("text")))


def _query_vector(spark: SparkSession, folder: str) -> list[float]:
    return table(spark, folder, "embeddings", "vec_id", "embedding").where("vec_id = 1").select("embedding").first()[0]


@query
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = retrieval.vector_topk(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _query_vector(spark, folder))
    return hits.select(F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"))


@query
def vector_index_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The exact search through an index, which reads only the lists that it can't rule out."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.build_index(rows, "vec_id", "embedding", 64, path, lists=16)
    hits = vectors.search(spark, path, _query_vector(spark, folder), probes=2, exact=True)
    return hits.select(F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"))


@query
def hybrid_topk(spark: SparkSession, folder: str) -> DataFrame:
    w = lambda *c: F.row_number().over(Window.orderBy(*c))
    text = retrieval.tfidf_rank(table(spark, folder, "documents", "doc_id", "text"), "doc_id", F.col("text"), "schedule voucher total", k=8)
    near = retrieval.vector_topk(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", _query_vector(spark, folder), k=10)
    return retrieval.hybrid(text.select(F.concat(F.lit("d"), F.col("doc").cast("string")).alias("label"), w(F.desc("score"), "doc").alias("rank")), near.select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("label"), w("distance", "id").alias("rank")))


@query
def hybrid_context(spark: SparkSession, folder: str) -> DataFrame:
    """The context of a question over stored vectors; a vector of the graph stands for the question's."""
    nodes = stage(current_nodes(spark, folder, "kind", "name", "file", "docstring", "embedding"), "nodes")
    x = F.col("embedding")
    usable = (F.size(x) == 384) & ~F.exists(x, F.isnan) & F.exists(x, lambda v: v != 0)
    asked = nodes.where((F.col("kind") == "Class") & usable).orderBy("id").select(x).first()[0]
    return ask.ranked_context(ask.Store(nodes, nodes.limit(0)), "which class renders the ledger page", 8, asked)


@query
def embed_hashed(spark: SparkSession, folder: str) -> DataFrame:
    docs = current_nodes(spark, folder, "kind", "name", "docstring").where(F.col("kind") == "Class")
    made = docs.select("id", F.posexplode(retrieval.embed(F.coalesce("docstring", F.lit("")))).alias("place", "value")).where("value <> 0")
    return made.select("id", F.col("place").cast("long").alias("place"), F.round(F.col("value").cast("double"), 6).alias("value"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "messages", "question").select("question").where(F.col("question").isNotNull()).distinct()
    return q.select(T.url_or_path(F.col("question")).alias("url")).where(F.col("url").isNotNull()).distinct()


def _routes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, "explicit", "app/Config/Routes.php", i) for i, r in enumerate(ROUTES)], "pattern string, http_method string, target string, kind string, source_file string, lineno long")


@query
def url_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder)


@query
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    made = F.concat(F.lit("https://h.example"), "url", F.lit("/?x=1#top"))
    return _asked(spark, folder).select("url", T.normalized_url(made).alias("path"))


@query
def route_match(spark: SparkSession, folder: str) -> DataFrame:
    return web.matched_routes(_asked(spark, folder), _routes(spark)).select("url", "pattern", "target")


@query
def route_resolve(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.createDataFrame([("app/Pages/Edit.php",), ("app\\Ledger.php",)], "file string")
    return web.resolved_urls(_asked(spark, folder), _routes(spark), files).withColumnRenamed("class", "class_name")


@query
def route_patterns(spark: SparkSession, folder: str) -> DataFrame:
    # Eleven placeholders, and slashes around a pattern.
    deep = F.concat(F.lit("/"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit("x"), i.cast("string"))), "/"), F.lit("/"))
    urls = table(spark, folder, "part", "p_partkey").select(deep.alias("url")).unionByName(spark.createDataFrame([("/order/new",)], "url string"))
    routes = spark.createDataFrame([("/" + "/".join(["(:any)"] * 11) + "/", "GET", "App\\Deep::go/$11/$2/$9"), ("/order/new/", "POST", "App\\Order::create")], "pattern string, http_method string, target string")
    return web.matched_routes(urls, routes).select("url", "pattern", "target")


@query
def route_load(spark: SparkSession, folder: str) -> DataFrame:
    return graph.load_routes(_routes(spark)).select("id", "pattern")


@query
def convention_routes(spark: SparkSession, folder: str) -> DataFrame:
    files = current_files(spark, folder, "sha1").select(F.regexp_replace("file", "^[^/]+/", "").alias("file")).distinct()
    return web.convention_routes(files).select("pattern", "target").distinct()


@query
def import_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """The operator over import facts; the lines are read by a pattern here, so that files which don't parse count too."""
    files = current_files(spark, folder).where(F.col("file").endswith(".py"))
    lines = files.select("file", F.posexplode(F.split("content", "\n")).alias("i", "line")).where(F.col("line").rlike(r"^from [\w.]+ import \w+"))
    text = F.lit(None).cast("string")
    asked = lines.select(
        F.lit("from").alias("what"), "file", F.regexp_extract("line", r"^from ([\w.]+) import (\w+)", 1).alias("target"), F.regexp_extract("line", r"^from ([\w.]+) import (\w+)", 2).alias("name"), F.regexp_extract("line", r"^from ([\w.]+) import (\w+)", 2).alias("text"), F.lit(0).cast("long").alias("level"), F.col("i").cast("long").alias("ord"), text.alias("lang")
    )
    edges, _ = resolve.resolve_imports(asked, files.select("file"))
    return edges.select(F.substring("src", 9, 1 << 20).alias("file"), "dst")


@query
def module_names(spark: SparkSession, folder: str) -> DataFrame:
    return current_files(spark, folder, "sha1").where(F.col("file").endswith(".py")).select("file", dotted_module(F.col("file")).alias("dotted"))


@query
def file_languages(spark: SparkSession, folder: str) -> DataFrame:
    return current_files(spark, folder, "sha1").groupBy(suffix_language("file").alias("lang")).agg(F.count("*").alias("n"))


@query
def unambiguous_resolve(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part", "p_partkey", "p_name", "p_brand").select(F.concat_ws("|", "p_name", "p_brand").alias("name"), "p_partkey")
    return resolve.unambiguous(parts, "name", "p_partkey")


@query
def ranked_resolution(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_brand", "p_type").withColumnRenamed("p_partkey", "k")
    same_file = resolve.least_other(part, ["p_name", "p_brand"], "k", "hit").withColumn("rank", F.lit(1))
    same_type = resolve.least_other(part, ["p_name", "p_type"], "k", "hit").withColumn("rank", F.lit(2))
    found = same_file.unionByName(same_type)
    return resolve.first_ranked(found, ["k"], [F.col("rank"), F.col("hit")])


@query
def method_lookup(spark: SparkSession, folder: str) -> DataFrame:
    classes = table(spark, folder, "part", "p_partkey", "p_brand")
    bases = classes.where("p_partkey >= 4").select(F.concat(F.lit("class::f::"), F.col("p_partkey").cast("string")).alias("src"), F.concat(F.lit("class::f::"), F.expr("p_partkey div 4").cast("string")).alias("dst"), F.lit(0).alias("ord"))
    methods = classes.where("p_brand < 'Brand#2'").select(F.concat(F.lit("function::f::"), F.col("p_partkey").cast("string"), F.lit(".run")).alias("id"))
    return resolve.inherited_methods(resolve.ancestors(bases), methods).select(F.col("class").alias("class_name"), "fid")


@query
def mentioned_names(spark: SparkSession, folder: str) -> DataFrame:
    names = graph.names_of(current_nodes(spark, folder, "kind", "name"), "Class")
    question = F.lit("What does LedgerStore do, and why is the order total wrong in PriceJob?")
    return resolve.longest_first(names.where(T.mentions_name(question, F.col("name"))), "name", 5)


@query
def mentioned_file(spark: SparkSession, folder: str) -> DataFrame:
    files = current_files(spark, folder, "sha1").select("file")
    length = T.mention_length(F.lit("Which rules gate the ledger store page?"), F.col("file"))
    return files.select("file", length.alias("length")).where(F.col("length").isNotNull()).orderBy(F.desc("length"), "file").limit(1)


@query
def question_intents(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "messages", "question").where(F.col("question").isNotNull()).select("question").distinct()
    return q.select("question", F.array_join(T.intents(F.col("question")), ",").alias("intents"))


@query
def hop_counts(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "part", "p_partkey", "p_size")
    question = F.concat(F.lit("impact within "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " hops").otherwise(" steps"))
    return keys.select("p_partkey", T.hop_count(question).cast("long").alias("hops"))


@query
def data_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return ask.evidence_lines(current_files(spark, folder))


@query
def top_folder_groups(spark: SparkSession, folder: str) -> DataFrame:
    modules = current_nodes(spark, folder, "kind", "name", "file").where(F.col("kind") == "Module")
    return graph.folder_groups(modules)


@query
def top_folder_forms(spark: SparkSession, folder: str) -> DataFrame:
    files = current_files(spark, folder, "sha1").select("file")
    forms = F.array(F.col("file"), F.concat(F.lit("/"), "file"), F.replace("file", F.lit("/"), F.lit("\\")), F.lit("/"), F.lit(None))
    return files.select(F.explode(forms).alias("path")).select("path", T.top_folder(F.col("path")).alias("folder")).distinct()


@query
def app_names(spark: SparkSession, folder: str) -> DataFrame:
    files = current_files(spark, folder, "sha1").select("file").where(F.col("file").isNotNull())
    forms = files.select(F.explode(F.array("file", F.replace("file", F.lit("/"), F.lit("\\")), F.concat(F.lit("Modules/"), "file"))).alias("path"))
    return forms.select("path", T.app_of(F.col("path")).alias("app")).distinct()


@query
def qualified_targets(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part", "p_partkey", "p_brand", "p_size")
    name = F.replace("p_brand", F.lit("#"), F.lit(""))
    target = F.concat(F.when(F.col("p_size") % 3 == 0, "\\Core\\").when(F.col("p_size") % 3 == 1, "Sub\\").otherwise(""), name, F.lit("::go"))
    namespace = F.when(F.col("p_partkey") % 3 == 0, "App\\Pages").when(F.col("p_partkey") % 3 == 1, "App\\Pages\\")
    return p.select("p_partkey", T.qualified_target(target, namespace).alias("target"), T.class_file(F.concat(F.lit("App\\"), name)).alias("file"), T.lower_first(name).alias("first"))


@query
def file_titles(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "messages", "question").where(F.col("question").isNotNull()).distinct()
    return q.select("question", T.file_title(F.col("question")).alias("title"), T.slug(F.col("question")).alias("slug"))


@query
def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    return graph.folder_modules(current_nodes(spark, folder, "kind", "name", "file", "docstring"))


@query
def chat_list(spark: SparkSession, folder: str) -> DataFrame:
    chat = latest_rows(table(spark, folder, "chats"), ["id"], ["updated_at"])
    path = table(spark, folder, "chats", "repo_db_path").where(F.col("repo_db_path").isNotNull()).agg(F.min("repo_db_path")).first()[0]
    return chats.list_chats(chat, path).select("id", "updated_at")


@query
def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages", "id", "chat_id", "seq", "question", "answer").distinct()
    first = m.agg(F.min("chat_id")).first()[0]
    return chats.chat_messages(m, first).select("id", "seq", "question", "answer")


@query
def chat_next_seq(spark: SparkSession, folder: str) -> DataFrame:
    return chats.next_seq(table(spark, folder, "messages", "chat_id", "seq"))


@query
def chat_titles(spark: SparkSession, folder: str) -> DataFrame:
    return chats.titles(table(spark, folder, "messages", "id", "chat_id", "seq", "question"))


@query
def stored_answers(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages", "id", "answer").where(F.col("answer").isNotNull()).distinct()
    return m.select("id", T.stored_answer(F.col("answer")).alias("a")).select("id", "a.type", "a.content", "a.detail")


@query
def registry_latest(spark: SparkSession, folder: str) -> DataFrame:
    return chats.registered(table(spark, folder, "registry")).select("db_path", "name")


@query
def vault_adjacency(spark: SparkSession, folder: str) -> DataFrame:
    links = graph.vault_links(derived.part_nodes(spark, folder), derived.part_edges(spark, folder))
    return links.select("id", "kind", "direction", F.size("titles").cast("long").alias("n"))


@query
def vault_notes(spark: SparkSession, folder: str) -> DataFrame:
    return export.vault_notes(derived.part_nodes(spark, folder), derived.part_edges(spark, folder))


@query
def vault_titles(spark: SparkSession, folder: str) -> DataFrame:
    # Titles agree once what can't stand in a file's name is replaced: the numbers tell them apart.
    p = table(spark, folder, "part", "p_partkey", "p_name")
    nodes = p.select(F.concat(F.lit("function::"), "p_name", F.expr("repeat(':', cast(p_partkey % 7 as int))"), F.expr("repeat('/', cast(6 - p_partkey % 7 as int))"), F.lit("::"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("id"), F.lit("Function").alias("kind"))
    titled = graph.titled_nodes(nodes.withColumn("id", F.regexp_replace("id", "::[0-9]+$", "")).distinct())
    return titled.select("id", "title")


@query
def export_capped(spark: SparkSession, folder: str) -> DataFrame:
    nodes = derived.part_nodes(spark, folder).where(F.col("kind") == "Function")
    return graph.exported(nodes, derived.part_edges(spark, folder), 500)[1]


@query
def export_whole(spark: SparkSession, folder: str) -> DataFrame:
    nodes = derived.part_nodes(spark, folder).where(F.col("kind") == "Function")
    return graph.exported(nodes, derived.part_edges(spark, folder), None)[1]


def _patterns(spark: SparkSession, folder: str) -> cypher.Graph:
    return cypher.Graph(derived.part_nodes(spark, folder), derived.part_edges(spark, folder))


@query
def cypher_callers(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder).run("MATCH (a:Function)-[:CALLS]->(b:Function {name: $name}) RETURN DISTINCT a.name AS caller, a.file AS file", name=PART)


@query
def cypher_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder).run("MATCH (n:Function) WHERE n.file = 'Brand#11' RETURN n.name AS name, count(n) AS n ORDER BY n DESC, name LIMIT 20")


@query
def cypher_reach(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder).run("MATCH (a:Function)-[:CALLS*1..3]->(b:Function) WHERE b.name = $name RETURN DISTINCT a.name AS name, a.file AS file", name=PART)


@query
def cypher_reach_map(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder).run("MATCH (a:Function)-[:CALLS*1..3]->(b:Function {name: $name}) RETURN DISTINCT a.name AS name, a.file AS file", name=PART)


@query
def cypher_reach_both(spark: SparkSession, folder: str) -> DataFrame:
    return _patterns(spark, folder).run("MATCH (a:Function)-[:CALLS*1..3]->(b:Function) WHERE a.file = 'Brand#11' AND b.name = $name RETURN DISTINCT a.name AS name, a.file AS file", name=PART)


@query
def cypher_rules(spark: SparkSession, folder: str) -> DataFrame:
    concepts, targets, rules = _loaded(spark, folder)
    g = cypher.Graph(targets, spark.createDataFrame([], "src string, dst string, kind string"), concepts=concepts, rules=rules)
    return g.run("MATCH (c:Concept {code: 'BUILDING'})-[r:RULE]->(t:Module) RETURN t.name AS target, r.effect AS effect")


@query
def cypher_write(spark: SparkSession, folder: str) -> DataFrame:
    g = _patterns(spark, folder).write("MATCH (n:Function) WHERE n.file = 'Brand#11' SET n.docstring = 'seen', n.lineno = 7")
    g = g.write("MERGE (n:Function {id: 'function::part::1'}) SET n.file = 'moved'").write("CREATE (:Class {id: 'class::new', name: 'New', file: 'x'})")
    g = g.write("MATCH (a:Class {id: 'class::new'}), (a)-[:INHERITS]->(b:Class) MERGE (a)-[:INHERITS]->(b)").write("MATCH (n:Class) WHERE n.file = 'Brand#12' DETACH DELETE n")
    return g.nodes.select("id", "kind", "name", "file", "lineno", "docstring")


def _extracted(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = stage(current_files(spark, folder), "files")
    return files, stage(facts_of.file_facts(files), "facts")


@query
def source_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return resolve.graph_nodes(facts_of.file_facts(current_files(spark, folder))).select("id", "kind", "name", "file", "lineno", "docstring")


@query
def source_php_definitions(spark: SparkSession, folder: str) -> DataFrame:
    files = current_files(spark, folder).where(F.col("file").endswith(".php"))
    nodes = resolve.graph_nodes(facts_of.file_facts(files))
    return nodes.where(F.col("kind").isin("Class", "Function")).select("id", "kind", "name", "file")


@query
def source_php_edges(spark: SparkSession, folder: str) -> DataFrame:
    files = stage(current_files(spark, folder).where(F.col("file").endswith(".php")), "files")
    return resolve.build_graph(files, stage(facts_of.file_facts(files), "facts"))[1]


@query
def source_edges(spark: SparkSession, folder: str) -> DataFrame:
    files, facts = _extracted(spark, folder)
    return resolve.build_graph(files, facts)[1]


def _written(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = stage(derived.written_files(spark, folder), "files")
    return resolve.build_graph(files, stage(facts_of.file_facts(files), "facts"))


@query
def written_definitions(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder)[0].select("id", "kind", "name", "file", "docstring")


@query
def written_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder)[1]


@query
def written_impact(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.impact(*_written(spark, folder), "f_7", 3)


@query
def written_callers(spark: SparkSession, folder: str) -> DataFrame:
    return graph.callers(*_written(spark, folder), "f_7").select("caller", "file")


@query
def written_subclasses(spark: SparkSession, folder: str) -> DataFrame:
    return traverse.subclasses_of(*_written(spark, folder), "C_3")


@query
def source_rules(spark: SparkSession, folder: str) -> DataFrame:
    facts = stage(facts_of.file_facts(current_files(spark, folder)), "facts")
    # The tables define no role constants; the codes of the conditions stand in for a catalog.
    codes = facts.where(F.col("what") == "gate").select(F.col("name").alias("code")).distinct()
    concepts = codes.select(F.concat(F.lit("concept::app::"), "code").alias("id"), F.lit("Role").alias("kind"), "code", F.col("code").alias("name"))
    return web.branch_rules(facts, concepts).select("concept_id", "target_id", "target_kind", "effect", "condition")


@query
def source_views(spark: SparkSession, folder: str) -> DataFrame:
    files, facts = _extracted(spark, folder)
    return web.view_renders(facts, files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | fixtures.queries()


__all__ = ["current_files", "current_nodes", "oracle_sql", "queries"]
