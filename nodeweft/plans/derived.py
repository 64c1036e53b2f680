"""A graph over the business tables, on which traversals can be checked against SQL.

Functions are parts (named by p_name, filed under p_brand); a part calls another where the two follow each other in an
order with a quantity over 45; classes inherit by integer division of the key; roles are market segments with rules on
nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweft.sources.tables import table


def part_nodes(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part", "p_partkey", "p_name", "p_brand")
    key = F.col("p_partkey").cast("string")
    base = p.select(F.concat(F.lit("part::"), key).alias("pid"), "p_name", "p_brand")
    functions = base.select(F.concat(F.lit("function::"), "pid").alias("id"), F.lit("Function").alias("kind"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"))
    classes = base.select(F.concat(F.lit("class::"), "pid").alias("id"), F.lit("Class").alias("kind"), F.substring("pid", 7, 20).alias("name"), F.col("p_brand").alias("file"))
    return functions.unionByName(classes).withColumns({"lineno": F.lit(0).cast("long"), "docstring": F.lit("")})


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    a = line.where("l_quantity > 45").select("l_orderkey", F.col("l_partkey").alias("a"), (F.col("l_linenumber") + 1).alias("l_linenumber"))
    b = line.select("l_orderkey", F.col("l_partkey").alias("b"), "l_linenumber")
    name = lambda kind, c: F.concat(F.lit(f"{kind}::part::"), c.cast("string"))
    calls = a.join(b, ["l_orderkey", "l_linenumber"]).where("a <> b").select(name("function", F.col("a")).alias("src"), name("function", F.col("b")).alias("dst")).distinct()
    k = F.col("p_partkey")
    inherits = table(spark, folder, "part", "p_partkey").where(k >= 4).select(name("class", k).alias("src"), name("class", F.expr("p_partkey div 4")).alias("dst"))
    return calls.withColumn("kind", F.lit("CALLS")).unionByName(inherits.withColumn("kind", F.lit("INHERITS")))


def written_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content): the same graph as Python source, a module for each brand, so that parsing and resolution can be
    checked against SQL over the edges that were written down. A function `f_1` calls, a class `C_1` extends, and what
    another module holds is imported."""
    key = F.col("p_partkey").cast("string")
    own = table(spark, folder, "part", "p_partkey", "p_brand").select(key.alias("k"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("m"))
    ends = part_edges(spark, folder).select("kind", F.substring_index("src", "::", -1).alias("a"), F.substring_index("dst", "::", -1).alias("b"))
    edges = ends.join(own.select(F.col("k").alias("a"), "m"), "a").join(own.select(F.col("k").alias("b"), F.col("m").alias("n")), "b")
    name = F.concat(F.when(F.col("kind") == "CALLS", "f_").otherwise("C_"), "b")
    imports = edges.where("m <> n").select("m", F.concat(F.lit("from pkg."), "n", F.lit(" import "), name).alias("line")).distinct()
    heads = imports.groupBy("m").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("head"))
    calls = edges.where("kind = 'CALLS'").groupBy(F.col("a").alias("k")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("    f_"), "b", F.lit("()\n")))), "").alias("calls"))
    bases = edges.where("kind = 'INHERITS'").select(F.col("a").alias("k"), F.concat(F.lit("(C_"), "b", F.lit(")")).alias("base"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    body = F.concat(F.lit("class C_"), "k", empty("base"), F.lit(":\n    pass\n\n\ndef f_"), "k", F.lit("():\n    \"\"\"Part "), "k", F.lit('."""\n'), empty("calls"))
    bodies = own.join(calls, "k", "left").join(bases, "k", "left").groupBy("m").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", body.alias("t"))))["t"], "\n\n").alias("body"))
    written = bodies.join(heads, "m", "left").select(F.concat(F.lit("pkg/"), "m", F.lit(".py")).alias("file"), F.concat_ws("\n\n\n", "head", "body").alias("content"))
    return written.unionByName(spark.range(1).select(F.lit("pkg/__init__.py").alias("file"), F.lit("").alias("content")))


def segment_rules(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, targets, rules): roles are market segments, targets nations, the effect goes by the order's status."""
    c = table(spark, folder, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    o = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    role = F.concat(F.lit("concept::app::"), "c_mktsegment")
    concepts = c.select(role.alias("id"), F.lit("Role").alias("kind"), F.col("c_mktsegment").alias("code")).distinct()
    targets = table(spark, folder, "nation", "n_nationkey", "n_name").select(F.concat(F.lit("module::"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("Module").alias("kind"), F.col("n_name").alias("name"), F.col("n_name").alias("file"))
    effect = F.when(F.col("o_orderstatus") == "F", "allow").when(F.col("o_orderstatus") == "O", "deny").otherwise("checked")
    rules = o.join(c, o["o_custkey"] == c["c_custkey"]).select(role.alias("concept_id"), F.concat(F.lit("module::"), F.col("c_nationkey").cast("string")).alias("target_id"), effect.alias("effect"), F.lit("").alias("condition"), F.lit(0).cast("long").alias("lineno"), F.struct("o_orderdate", "o_orderkey").alias("ord"))
    return concepts, targets, rules
