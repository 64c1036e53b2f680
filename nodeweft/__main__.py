"""Command line: python -m nodeweft COMMAND --store FOLDER ...

    index ROOT        parse a source tree; only files whose hash changed are parsed again
    stats             counts by kind
    callers NAME      direct callers
    impact NAME       transitive callers (--hops)
    roles [CODE]      roles, or the rules of one
    routes URL        the handler of an address
    cypher QUERY      a pattern query
    sql QUERY         Spark SQL over the tables
    ask QUESTION      facts and context for a question
    visualize FILE    a page with a drawing (--limit)
    vault FOLDER      linked notes
    serve             a JSON API on the local host (--port)
"""

from __future__ import annotations

import argparse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweft.operators import graph, resolve, retrieval, traverse, vectors, web
from nodeweft.plans import ask, export, serve
from nodeweft.session import build_session, read_text, release, share, stage, write_text
from nodeweft.sources import facts as facts_of
from nodeweft.sources.tree import manifest, scan_tree, uploaded
from nodeweft.streaming.incremental import file_diff, has_changes, merged_facts

TABLES = ("files", "facts", "manifest", "nodes", "edges", "concepts", "rules", "routes", "renders")


class Folder:
    """Snapshots of an index: each is a folder of its own, and a small file names the one that holds."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> str | None:
        return read_text(f"{self.path}/CURRENT")

    def read(self, name: str) -> DataFrame:
        if not self.current():
            raise SystemExit("there is no index yet")
        return self.spark.read.parquet(f"{self.path}/{self.current()}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> None:
        snapshot = uuid.uuid4().hex
        for name, df in tables.items():
            writer = df.write.partitionBy("kind") if name in ("nodes", "edges") else df.write
            writer.parquet(f"{self.path}/{snapshot}/{name}")
        if "embedding" in tables["nodes"].columns:
            shown = tables["nodes"].where(F.col("kind").isin("Module", "Class", "Function"))
            vectors.build_index(shown, "id", "embedding", retrieval.DIMENSIONS, f"{self.path}/{snapshot}/vectors")
        write_text(f"{self.path}/CURRENT", snapshot)

    def store(self) -> ask.Store:
        tables = [self.read(t) for t in ("nodes", "edges", "files", "concepts", "rules", "routes", "renders")]
        return ask.Store(*tables, vectors=f"{self.path}/{self.current()}/vectors" if "embedding" in tables[0].columns else None)


def index(spark: SparkSession, root: str, folder: Folder, full: bool = False, upload: list[dict] | None = None, embed=retrieval.hashed_embedding) -> dict:
    """Parses a tree (or an upload) into a new snapshot, with vectors of names and documentation by `embed` (None stores
    none); without changes nothing is written. Returns the counts of file states, of render calls and of those resolved, and
    what an upload left out."""
    skipped: list[dict] = []
    files = stage(uploaded(spark, upload, skipped) if upload is not None else scan_tree(spark, root, ".py").unionByName(scan_tree(spark, root, ".php")), "files")
    fresh = full or not folder.current()
    diff = file_diff(folder.read("manifest") if not fresh else manifest(files).limit(0), manifest(files))
    counts: dict = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
    if skipped:
        counts["skipped"] = skipped
    if not fresh and not has_changes(diff):
        return counts
    facts = facts_of.file_facts(files) if fresh else merged_facts(folder.read("facts"), folder.read("manifest"), files, facts_of.file_facts)
    facts = stage(facts, "facts")
    nodes, edges = resolve.build_graph(files, facts)
    if embed is not None:
        nodes = nodes.withColumn("embedding", retrieval.embed(F.concat_ws(" ", "name", "docstring"), embed))
    nodes, edges = stage(nodes, "nodes"), stage(edges, "edges")
    concepts = stage(web.role_catalog(facts), "concepts")
    rules = graph.load_rules(concepts, nodes, web.branch_rules(facts, concepts))
    routes = graph.load_routes(web.explicit_routes(facts).unionByName(web.convention_routes(files.select("file"))))
    renders = stage(graph.load_renders(web.view_renders(facts, files)), "renders")
    seen = web.render_counts(renders).first()
    if seen["renders"]:
        counts |= seen.asDict()
    folder.write({"files": files, "facts": facts, "manifest": manifest(files), "nodes": nodes, "edges": edges, "concepts": concepts, "rules": rules, "routes": routes, "renders": renders})
    release()
    return counts


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="nodeweft", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices="index stats callers impact roles routes cypher sql ask visualize vault serve".split())
    p.add_argument("what", nargs="?", default="")
    p.add_argument("--store", default=".nodeweft")
    p.add_argument("--hops", type=int, default=3)
    p.add_argument("--limit", type=int, default=500)
    p.add_argument("--port", type=int, default=8765)
    p.add_argument("--full", action="store_true", help="parse everything anew")
    p.add_argument("--master")
    a = p.parse_args(argv)
    spark = build_session(master=a.master)
    share(f"{a.store}/work")
    folder = Folder(spark, a.store)
    show = lambda df: df.show(a.limit, truncate=False)
    if a.command == "index":
        print(index(spark, a.what or ".", folder, a.full))
        return
    if a.command == "serve":
        service = serve.Service(spark, f"{a.store}/chats", lambda path: Folder(spark, path).store(), lambda path, root, files: index(spark, root, Folder(spark, path), upload=files))
        service.repo = a.store if folder.current() else ""
        with serve.server(service, port=a.port) as http:
            print(f"http://127.0.0.1:{a.port}")
            http.serve_forever()
        return
    s = folder.store()
    if a.command == "stats":
        show(graph.node_stats(s.nodes).unionByName(graph.edge_stats(s.edges)))
    elif a.command in ("callers", "impact"):
        name = ask.resolve_name(s.nodes, a.what) or a.what
        show(graph.callers(s.nodes, s.edges, name) if a.command == "callers" else traverse.impact(s.nodes, s.edges, name, a.hops).orderBy("file", "name"))
    elif a.command == "roles":
        show(web.concept_rules(s.concepts, s.rules, s.nodes, a.what) if a.what else web.list_concepts(s.concepts))
    elif a.command == "routes":
        show(web.resolved_urls(spark.createDataFrame([(a.what,)], "url string"), s.routes, s.nodes.where(F.col("kind") == "Module")) if a.what else s.routes.orderBy("pattern"))
    elif a.command == "cypher":
        show(s.patterns().run(a.what))
    elif a.command == "sql":
        show(s.patterns().sql(a.what))
    elif a.command == "ask":
        print(ask.answer(s, a.what))
    elif a.command == "visualize":
        with open(a.what or "graph.html", "w", encoding="utf-8") as f:
            f.write(export.html_page(s.nodes, s.edges, a.limit))
    else:
        export.write_vault(s.nodes, s.edges, a.what or "vault")


if __name__ == "__main__":
    main()
