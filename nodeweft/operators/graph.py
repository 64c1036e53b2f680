"""The graph's tables: loading, deleting, counting, listing and exporting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweft.functions.text import note_title, top_folder
from nodeweft.operators.resolve import unique_titles
from nodeweft.operators.rows import latest_rows
from nodeweft.schema import EDGE_KINDS, NODE_KINDS, render_id, route_id


def kind_rank(kind: str = "kind"):
    return F.array_position(F.array(*map(F.lit, NODE_KINDS)), F.col(kind))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of `old` and `new`, one per key: a new row replaces an old one, and among new rows of a key the last by `order`
    (default: the greatest content) holds."""
    tagged = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest_rows(tagged, keys, ["_new", *([order] if order else [])]).drop("_new")


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges whose two ends are nodes."""
    ids = nodes.select("id").distinct()
    both = old.select("src", "dst", "kind").unionByName(new.select("src", "dst", "kind"))
    return both.dropDuplicates(["src", "dst", "kind"]).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def load_concepts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Concepts by id; a new one replaces an old one."""
    return upsert(old, new, ["id"])


def load_rules(concepts: DataFrame, nodes: DataFrame, rules: DataFrame, order: str = "ord") -> DataFrame:
    """One rule per (concept_id, target_id), the last by `order`; rules with an unknown end are dropped."""
    known = rules.join(concepts.select(F.col("id").alias("concept_id")), "concept_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return latest_rows(known, ["concept_id", "target_id"], [order]).drop(order)


def load_routes(routes: DataFrame) -> DataFrame:
    made = routes.withColumn("id", route_id(F.col("kind"), F.col("source_file"), F.col("lineno"), F.col("http_method"), F.col("pattern")))
    return latest_rows(made, ["id"], ["target"])


def load_renders(renders: DataFrame) -> DataFrame:
    """Renders by id; ids are cut at 300 characters, so longer ones that agree so far are one."""
    made = renders.withColumns({"id": render_id(F.col("source_file"), F.col("lineno"), F.col("view_arg")), "target_file": F.coalesce("target_file", F.lit(""))})
    return latest_rows(made, ["id"], ["lineno"])


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of `files` (file) and without every edge that touches one of them."""
    kept = nodes.join(files.select("file").distinct(), "file", "left_anti").select(*nodes.columns)
    gone = nodes.join(files.select("file").distinct(), "file", "left_semi").select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return kept, left.select(*edges.columns)


def _counts(df: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    listed = df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(kinds)], "kind string, rank int")
    counted = df.groupBy("kind").agg(F.count("*").alias("n"))
    return listed.join(F.broadcast(counted), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def node_stats(nodes: DataFrame) -> DataFrame:
    """(kind, n) for each node kind, those without nodes included."""
    return _counts(nodes.where(F.col("kind").isin(*NODE_KINDS)), NODE_KINDS)


def edge_stats(edges: DataFrame) -> DataFrame:
    return _counts(edges.where(F.col("kind").isin(*EDGE_KINDS)), EDGE_KINDS)


def callers(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(caller, file, line), once for each pair of a caller and a called function of that name."""
    called = nodes.where((F.col("kind") == "Function") & (F.col("name") == name)).select(F.col("id").alias("dst"))
    calls = edges.where(F.col("kind") == "CALLS").select("src", "dst").distinct().join(called, "dst", "left_semi")
    by = nodes.where(F.col("kind") == "Function").select(F.col("id").alias("src"), F.col("name").alias("caller"), "file", F.col("lineno").alias("line"))
    return calls.join(by, "src").select("caller", "file", "line")


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    """(id, kind, direction) of a node's edges, outgoing and incoming."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "kind", F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("dst") == node).select(F.col("src").alias("id"), "kind", F.lit("in").alias("direction")))


def names_of(nodes: DataFrame, kind: str = "Function") -> DataFrame:
    return nodes.where(F.col("kind") == kind).select("name").distinct()


def files_of(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("kind") == "Module").select("file").distinct()


def folder_groups(nodes: DataFrame, path: str = "file", entry: str = "name") -> DataFrame:
    """(folder, n, first): how many different modules each top folder holds, and the first of them."""
    return nodes.groupBy(top_folder(F.col(path)).alias("folder")).agg(F.count_distinct(entry).alias("n"), F.min(entry).alias("first"))


def folder_modules(nodes: DataFrame) -> DataFrame:
    """(folder, line): for each module its name, file and the first line of its documentation, cut at 140 characters."""
    doc = F.substring(F.get(F.split(F.regexp_replace(F.coalesce("docstring", F.lit("")), r"(?U)^\s+|\s+$", ""), r"\r\n|\n|\r"), F.lit(0)), 1, 140)
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("file", F.lit("")), F.lit(")"), F.when(doc == "", "").otherwise(F.concat(F.lit(": "), doc)))
    return nodes.where(F.col("kind") == "Module").select(top_folder(F.col("file")).alias("folder"), line.alias("line"))


def exported(nodes: DataFrame, edges: DataFrame, limit: int | None = 500, order: str = "id") -> tuple[DataFrame, DataFrame]:
    """The first `limit` nodes by kind and order, and the edges among them; with None the whole graph, without edges to
    nodes it doesn't hold."""
    kept = nodes.orderBy(kind_rank(), order).limit(limit) if limit is not None else nodes
    ids = kept.select("id") if limit is None else F.broadcast(kept.select("id"))
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return kept, inner.select(*edges.columns)


def titled_nodes(nodes: DataFrame) -> DataFrame:
    """`nodes` with a title of their own each, which can name a file."""
    return unique_titles(nodes.withColumn("_t", note_title(F.col("id"), F.col("kind"))), "_t", "id", "title").drop("_t")


def vault_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, direction, titles): each node's neighbours by kind of edge and direction, as sorted unique titles."""
    titles = titled_nodes(nodes.select("id", "kind")).select("id", "title")
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "kind", F.lit("out").alias("direction")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "kind", F.lit("in").alias("direction")))
    named = both.join(titles.withColumnRenamed("id", "other"), "other")
    return named.groupBy("id", "kind", "direction").agg(F.array_sort(F.collect_set("title")).alias("titles"))
