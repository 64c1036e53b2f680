"""Names to edges: joins that turn the facts of files into the nodes and edges of the graph.

Each rule set is a list of ranked candidates; a candidate exists where an equi-join on ids (or names) finds a node, and the
lowest rank wins. Nothing is looked up row by row, so the cost is that of the joins however many call sites there are.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nodeweft.schema import class_id, external_id, function_id, module_id
from nodeweft.session import stage
from nodeweft.sources.tree import dotted_module

#: After so many levels of base classes the ancestors found so far become one table again, so plans stay small.
FOLDED_LEVELS = 20


def unambiguous(named: DataFrame, name: str, value: str) -> DataFrame:
    """(name, value) for each name that exactly one distinct value bears."""
    return named.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(value).alias(value), F.max(value).alias("_last")).where(F.col(value) == F.col("_last")).drop("_last")


def first_ranked(candidates: DataFrame, key: list[str], rank: list[Column]) -> DataFrame:
    """The first row of each key by `rank`, which must order totally."""
    fields = [F.col(c) for c in candidates.columns if c not in key]
    best = candidates.groupBy(*key).agg(F.min_by(F.struct(*fields), F.struct(*rank)).alias("_b"))
    return best.select(*key, *[F.col("_b").getField(c).alias(c) for c in candidates.columns if c not in key])


def least_other(rows: DataFrame, group: list[str], key: str, out: str) -> DataFrame:
    """(key, out): for each row the least other `key` among the rows of equal `group`; rows without one are left out, as are
    null groups and keys.

    The two least keys of a group answer for all its rows, so the cost is that of the rows, not of the pairs in a group.
    """
    known = rows.where(F.col(key).isNotNull()).select(*group, key)
    first = known.groupBy(*group).agg(F.min(key).alias("_first"))
    second = known.join(first, group).where(F.col(key) > F.col("_first")).groupBy(*group).agg(F.min("_first").alias("_first"), F.min(key).alias("_second"))
    return known.join(second, group).select(key, F.when(F.col(key) == F.col("_first"), F.col("_second")).otherwise(F.col("_first")).alias(out))


def graph_nodes(facts: DataFrame) -> DataFrame:
    """Modules, classes, functions and externals. Of several definitions of an id the last gives the attributes; `ord` is
    the place of the first."""
    own = facts.where(F.col("what").isin("module", "Class", "Function")).select(
        F.when(F.col("what") == "module", module_id(F.col("file"))).when(F.col("what") == "Class", class_id(F.col("file"), F.col("qualname"))).otherwise(function_id(F.col("file"), F.col("qualname"))).alias("id"),
        F.when(F.col("what") == "module", "Module").otherwise(F.col("what")).alias("kind"),
        "name",
        "file",
        F.coalesce("lineno", F.lit(0)).alias("lineno"),
        F.coalesce("end_lineno", F.lit(0)).alias("end_lineno"),
        F.coalesce("text", F.lit("")).alias("docstring"),
        "ord",
    )
    latest = own.groupBy("id").agg(F.max_by(F.struct("kind", "name", "file", "lineno", "end_lineno", "docstring"), "ord").alias("r"), F.min("ord").alias("ord"))
    return latest.select("id", "r.*", "ord")


def external_nodes(imports: DataFrame) -> DataFrame:
    """A node for each imported name that no file of the tree provides."""
    names = imports.where(F.col("dst").startswith("external::")).select(F.col("dst").alias("id")).distinct()
    name = F.substring("id", len("external::") + 1, 1 << 20)
    return names.select("id", F.lit("External").alias("kind"), name.alias("name"), F.lit("").alias("file"), F.lit(0).cast("long").alias("lineno"), F.lit(0).cast("long").alias("end_lineno"), F.lit("").alias("docstring"), F.lit(0).cast("long").alias("ord"))


def module_index(files: DataFrame) -> DataFrame:
    """(dotted, target): the file of each dotted module name; of several files the last in order."""
    return files.where(F.col("file").endswith(".py")).groupBy(dotted_module(F.col("file")).alias("dotted")).agg(F.max("file").alias("target"))


def resolve_imports(facts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(IMPORTS edges, import bindings). A dotted name that no file provides is external, unless it is relative."""
    index = module_index(files)
    wanted = facts.where(F.col("what").isin("import", "from")).join(index, facts["target"] == index["dotted"], "left").select("file", "ord", "what", "name", facts["target"].alias("dotted_name"), index["target"].alias("hit"), "text", F.coalesce("level", F.lit(0)).alias("level"))
    external = F.when((F.col("dotted_name") != "") & (F.col("level") == 0), external_id(F.col("dotted_name")))
    edges = wanted.select(module_id(F.col("file")).alias("src"), F.coalesce(F.when(F.col("hit").isNotNull(), module_id(F.col("hit"))), external).alias("dst"))
    bound = wanted.where(F.col("hit").isNotNull() & (F.col("name") != "")).select("file", F.col("name").alias("local_name"), F.when(F.col("what") == "import", "module").otherwise("symbol").alias("kind"), F.col("hit").alias("target_module"), F.col("text").alias("orig_name"), "ord")
    bindings = bound.groupBy("file", "local_name").agg(F.max_by(F.struct("kind", "target_module", "orig_name"), "ord").alias("b")).select("file", "local_name", "b.*")
    php = facts.where(F.col("what") == "use").select(module_id(F.col("file")).alias("src"), external_id(F.col("target")).alias("dst"))
    required = facts.where(F.col("what") == "require").join(files.select(F.col("file").alias("text")).distinct().withColumn("known", F.lit(True)), "text", "left")
    php = php.unionByName(required.select(module_id(F.col("file")).alias("src"), F.when(F.col("known"), module_id(F.col("text"))).otherwise(external_id(F.col("target"))).alias("dst")))
    return edges.unionByName(php).where(F.col("dst").isNotNull()).distinct(), bindings


def resolve_bases(facts: DataFrame, nodes: DataFrame, bindings: DataFrame) -> DataFrame:
    """(src, dst, ord) INHERITS: a class of the same file, else an imported one (Python) or the only one so named (PHP)."""
    classes = nodes.where(F.col("kind") == "Class").select("id", "name")
    bases = facts.where(F.col("what") == "base").select(class_id(F.col("file"), F.col("qualname")).alias("src"), "file", "lang", "target", "ord")
    same = bases.withColumn("dst", class_id(F.col("file"), F.col("target"))).withColumn("rank", F.lit(1))
    imported = (
        bases.where(F.col("lang") == "python")
        .join(bindings.where(F.col("kind") == "symbol").select("file", F.col("local_name").alias("target"), "target_module", "orig_name"), ["file", "target"])
        .select(*bases.columns, class_id(F.col("target_module"), F.col("orig_name")).alias("dst"), F.lit(2).alias("rank"))
    )
    only = bases.where(F.col("lang") == "php").join(unambiguous(classes, "name", "id").select(F.col("name").alias("target"), F.col("id").alias("dst")), "target").select(*bases.columns, "dst", F.lit(3).alias("rank"))
    found = same.unionByName(imported).unionByName(only).join(classes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return first_ranked(found.select("src", "ord", "rank", "dst"), ["src", "ord"], [F.col("rank"), F.col("dst")]).select("src", "dst", "ord")


def ancestors(bases: DataFrame) -> DataFrame:
    """(id, ancestor, depth, path): every class above a class, nearest first, equal depths in the order of declaration.

    A loop over levels of a join and an anti-join, each level written to the shared folder, until no class is new.
    """
    step = bases.select(F.col("src"), F.col("dst"), F.lpad(F.col("ord").cast("string"), 10, "0").alias("o"))
    frontier = stage(step.where("src <> dst").groupBy("src", "dst").agg(F.min("o").alias("path")).select(F.col("src").alias("id"), F.col("dst").alias("ancestor"), F.lit(1).alias("depth"), "path"), "ancestors")
    found = frontier
    for depth in itertools.count(2):
        grown = frontier.join(step, frontier["ancestor"] == step["src"]).select("id", step["dst"].alias("ancestor"), F.concat_ws("/", "path", "o").alias("path")).where("id <> ancestor")
        grown = grown.groupBy("id", "ancestor").agg(F.min("path").alias("path")).join(found.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        frontier = stage(grown.select("id", "ancestor", F.lit(depth).alias("depth"), "path"), "ancestors")
        if not frontier.take(1):
            break
        found = found.unionByName(frontier)
        if depth % FOLDED_LEVELS == 0:
            found = stage(found, "ancestors")
    return found


def inherited_methods(above: DataFrame, functions: DataFrame) -> DataFrame:
    """(class, method, fid): the nearest ancestor's method of each name."""
    place = F.split("id", "::", 3)
    methods = functions.select(F.col("id").alias("fid"), F.get(place, F.lit(1)).alias("f"), F.get(place, F.lit(2)).alias("q")).where(F.instr("q", ".") > 0)
    methods = methods.select("fid", class_id(F.col("f"), F.regexp_replace("q", r"\.[^.]*$", "")).alias("ancestor"), F.element_at(F.split("q", r"\."), -1).alias("method"))
    joined = above.join(methods, "ancestor").select(F.col("id").alias("class"), "method", "depth", "path", "fid")
    return first_ranked(joined, ["class", "method"], [F.col("depth"), F.col("path"), F.col("fid")]).select("class", "method", "fid")


def resolve_calls(facts: DataFrame, nodes: DataFrame, bindings: DataFrame, bases: DataFrame) -> DataFrame:
    """(src, dst) CALLS by ranked candidates: own class, ancestors, same file, import bindings; for PHP the only function
    of a name in the whole tree. Calls of oneself are left out."""
    functions = nodes.where(F.col("kind") == "Function")
    ids = functions.select(F.col("id").alias("dst"))
    inherited = inherited_methods(ancestors(bases), functions)
    calls = facts.where(F.col("what") == "call").select("file", "lang", "container", "target", F.col("extra").alias("how"), "receiver", F.when(F.col("classes") != "", F.col("classes")).alias("classes"), "ord")
    in_class = calls.where(F.col("classes").isNotNull()).withColumn("class", class_id(F.col("file"), F.col("classes")))

    # The class that `Name::method()` means: one of the same file, else the only class of that name.
    classes = nodes.where(F.col("kind") == "Class").select("id", "name")
    scoped = in_class.where((F.col("how") == "scoped") & ~F.col("receiver").isin("parent", "self", "static"))
    here = scoped.withColumn("hit", class_id(F.col("file"), F.col("receiver"))).join(classes.select(F.col("id").alias("hit")), "hit", "left_semi")
    only = unambiguous(classes, "name", "id").select(F.col("name").alias("receiver"), F.col("id").alias("there"))
    named = scoped.join(here.select("file", "ord", "hit"), ["file", "ord"], "left").join(only, "receiver", "left").withColumn("class", F.coalesce("hit", "there")).where(F.col("class").isNotNull()).select(*in_class.columns)
    own = in_class.where(F.col("how").isin("self", "this") | (F.col("how") == "scoped") & F.col("receiver").isin("self", "static")).unionByName(named)
    upward = own.unionByName(in_class.where((F.col("how") == "super") | (F.col("how") == "scoped") & (F.col("receiver") == "parent")))

    place = F.split("class", "::", 3)
    keys = ["file", "ord", "container"]
    first_in_file = first_ranked(functions.select("file", F.col("name").alias("target"), "id", "ord"), ["file", "target"], [F.col("ord"), F.col("id")]).select("file", "target", F.col("id").alias("dst"))
    plain = calls.where((F.col("lang") == "python") | (F.col("how") == "function"))
    symbol = bindings.where(F.col("kind") == "symbol").select("file", F.col("local_name").alias("target"), "target_module", "orig_name")
    module = bindings.where(F.col("kind") == "module").select("file", F.col("local_name").alias("receiver"), "target_module")
    ranked = [
        own.select(*keys, function_id(F.get(place, F.lit(1)), F.concat_ws(".", F.get(place, F.lit(2)), F.col("target"))).alias("dst"), F.lit(1).alias("rank")).join(ids, "dst", "left_semi").select(*keys, "dst", "rank"),
        upward.join(inherited.withColumnRenamed("method", "target"), ["class", "target"]).select(*keys, F.col("fid").alias("dst"), F.lit(2).alias("rank")),
        plain.join(first_in_file, ["file", "target"]).select(*keys, "dst", F.lit(3).alias("rank")),
        calls.where(F.col("how") == "name").join(symbol, ["file", "target"]).select(*keys, function_id(F.col("target_module"), F.col("orig_name")).alias("dst"), F.lit(4).alias("rank")).join(ids, "dst", "left_semi").select(*keys, "dst", "rank"),
        calls.where(F.col("how").isin("attribute", "self") & (F.col("receiver") != "")).join(module, ["file", "receiver"]).select(*keys, function_id(F.col("target_module"), F.col("target")).alias("dst"), F.lit(5).alias("rank")).join(ids, "dst", "left_semi").select(*keys, "dst", "rank"),
        calls.where(F.col("how") == "function").join(unambiguous(functions, "name", "id").select(F.col("name").alias("target"), F.col("id").alias("dst")), "target").select(*keys, "dst", F.lit(6).alias("rank")),
    ]
    best = first_ranked(reduce(DataFrame.unionByName, ranked), keys, [F.col("rank"), F.col("dst")])
    return best.where(F.col("dst") != F.col("container")).select(F.col("container").alias("src"), "dst").distinct()


def build_graph(files: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree of files from its facts. Give `facts` as a staged table: every rule reads it."""
    nodes = stage(graph_nodes(facts), "nodes")
    imports, bindings = resolve_imports(facts, files)
    imports, bindings = stage(imports, "imports"), stage(bindings, "bindings")
    bases = stage(resolve_bases(facts, nodes, bindings), "bases")
    contains = facts.where(F.col("what").isin("Class", "Function")).select(F.col("container").alias("src"), F.when(F.col("what") == "Class", class_id(F.col("file"), F.col("qualname"))).otherwise(function_id(F.col("file"), F.col("qualname"))).alias("dst"))
    kinds = {"CONTAINS": contains.distinct(), "IMPORTS": imports, "INHERITS": bases.select("src", "dst").distinct(), "CALLS": resolve_calls(facts, nodes, bindings, bases)}
    edges = reduce(DataFrame.unionByName, [df.select("src", "dst", F.lit(kind).alias("kind")) for kind, df in kinds.items()])
    return nodes.unionByName(external_nodes(imports)), edges


def longest_first(names: DataFrame, column: str, limit: int) -> DataFrame:
    """The `limit` longest values, ties in order of the text."""
    return names.orderBy(F.desc(F.char_length(column)), column).limit(limit)


def unique_titles(df: DataFrame, title: str, key: str, out: str, rows_a_part: int = 1_000_000) -> DataFrame:
    """`df` with titles made unique: one of equal titles stays, the others get " 2", " 3" and so on. The numbers depend on
    the keys alone.

    Of many rows, equal titles are numbered in parts by a hash of the key, each behind the ones before it: as many parts as
    keep each at `rows_a_part` even if all rows bear one title.
    """
    n = F.row_number().over(Window.partitionBy(title).orderBy(key))
    numbered = lambda df, n: df.withColumn(out, F.when(n == 1, F.col(title)).otherwise(F.concat_ws(" ", title, n.cast("string"))))
    parts = -(-df.count() // rows_a_part)
    if parts <= 1:
        return numbered(df, n)
    split = df.withColumns({"_l": F.col(title), "_p": F.pmod(F.xxhash64(key), F.lit(parts))})
    sizes = split.groupBy("_l", "_p").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    placed = split.join(sizes.select("_l", "_p", F.coalesce(before, F.lit(0)).alias("_before")), ["_l", "_p"])
    n = F.col("_before") + F.row_number().over(Window.partitionBy("_l", "_p").orderBy(key))
    return numbered(placed, n).drop("_l", "_p", "_before")
