"""Reachability over edges: impact, ancestors, subclasses.

Two kernels give the same rows. `frontier`, the default, goes hop by hop: a join of the new ids with the edges, duplicates
dropped, ids seen before taken away, the hop written to the shared folder; its work is bounded by the edges, so hubs and
depth don't matter. `walk` is a recursive query: one plan without a write between hops, but it lists walks, so it is for
sparse graphs and few hops only (spark.sql.cteRecursionRowLimit bounds its rows and fails beyond). Ids seen start empty, not
with the seeds: a seed on a cycle, or called by another seed, belongs to the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeweft.operators.rows import broadcast_if_small
from nodeweft.session import stage

MOST_HOPS = 10
BROADCAST_ROWS = 100_000


def clamp_hops(hops: int, most: int = MOST_HOPS) -> int:
    return max(1, min(int(hops), most))


def frontier(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(id, depth): all ids reached from `seeds` (id) along `edges` (src to dst) in 1..hops steps, with the least."""
    # Every hop reads the edges: only their ends are kept, once.
    edges = stage(edges.select("src", "dst"), "hop-edges")
    current, found = broadcast_if_small(seeds.select("id").distinct(), BROADCAST_ROWS), None
    for depth in range(1, hops + 1):
        grown = edges.join(current, edges["src"] == current["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        if found is not None:
            grown = grown.join(found.select("id"), "id", "left_anti")
        grown = stage(grown.withColumn("depth", F.lit(depth)), f"hop-{depth}")
        found = grown if found is None else found.unionByName(grown)
        # Counted from the files' footers.
        new = grown.count() if depth < hops else 0
        if not new:
            break
        current = F.broadcast(grown.select("id")) if new <= BROADCAST_ROWS else grown.select("id")
    return found


def walk(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """The same ids by one recursive query over walks."""
    spark = seeds.sparkSession
    query = f"""
        WITH RECURSIVE r(id, depth) AS (
          SELECT id, 0 FROM {{seeds}} UNION ALL
          SELECT e.dst, r.depth + 1 FROM r JOIN {{edges}} e ON e.src = r.id WHERE r.depth < {int(hops)}
        ) SELECT id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY id"""
    return spark.sql(query, seeds=seeds.select("id").distinct(), edges=edges.select("src", "dst").distinct())


def reach(seeds: DataFrame, edges: DataFrame, hops: int, kernel: str | None = None) -> DataFrame:
    return (walk if kernel == "walk" else frontier)(seeds, edges, hops)


def _named(nodes: DataFrame, kind: str, name: str) -> DataFrame:
    return nodes.where((F.col("kind") == kind) & (F.col("name") == name)).select("id")


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def impact(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 3, kernel: str | None = None) -> DataFrame:
    """(name, file) of every function that reaches a function called `name` over CALLS within the hops (1 to 10)."""
    calls = _reverse(edges.where(F.col("kind") == "CALLS"))
    reached = reach(_named(nodes, "Function", name), calls, clamp_hops(hops), kernel)
    return nodes.where(F.col("kind") == "Function").join(reached.select("id"), "id", "left_semi").select("name", "file").distinct()


def ancestors_of(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 5, kernel: str | None = None) -> DataFrame:
    """(name, file) of the classes above a class, up to five levels."""
    reached = reach(_named(nodes, "Class", name), edges.where(F.col("kind") == "INHERITS"), hops, kernel)
    return nodes.where(F.col("kind") == "Class").join(reached.select("id"), "id", "left_semi").select("name", "file").distinct()


def subclasses_of(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 5, kernel: str | None = None) -> DataFrame:
    """(name, file) of the classes below a class, up to five levels."""
    reached = reach(_named(nodes, "Class", name), _reverse(edges.where(F.col("kind") == "INHERITS")), hops, kernel)
    return nodes.where(F.col("kind") == "Class").join(reached.select("id"), "id", "left_semi").select("name", "file").distinct()
