"""Routes, roles and views: what an application's PHP files say about its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweft.functions.text import app_of, basename, class_file, lower_first, normalized_url, qualified_target, split_target
from nodeweft.operators.resolve import first_ranked, unambiguous
from nodeweft.operators.rows import broadcast_if_small
from nodeweft.schema import concept_id

BROADCAST_ROWS = 50_000
#: Modules whose controllers lie in one inner folder that is part of the address.
NESTED_MODULES = (("Ilabo", "Bo"),)


def explicit_routes(facts: DataFrame) -> DataFrame:
    """Routes that routing files declare, targets qualified by the group's or else the file's namespace."""
    defaults = facts.where(F.col("what") == "namespace").groupBy("file").agg(F.min_by("target", "ord").alias("default_namespace"))
    routes = facts.where(F.col("what") == "route").join(defaults, "file", "left")
    return routes.select(F.col("name").alias("pattern"), F.col("extra").alias("http_method"), qualified_target(F.col("target"), F.coalesce("text", "default_namespace")).alias("target"), F.lit("explicit").alias("kind"), F.col("file").alias("source_file"), "lineno")


def convention_routes(files: DataFrame, nested: tuple[tuple[str, str], ...] = NESTED_MODULES) -> DataFrame:
    """Routes that follow from a controller's path: module/controller and module/controller/(:any). In the modules of
    `nested`, only controllers below the named folder have routes, and that folder is part of the address."""
    path = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    plain = r"(?i)^app/Modules/([^/]+)/Controllers/([^/]+)\.php$"
    module, controller = F.regexp_extract(path, plain, 1), F.regexp_extract(path, plain, 2)
    found = files.where(path.rlike(plain) & ~F.lower(module).isin(*[m.lower() for m, _ in nested])).select(
        F.lower(module).alias("prefix"), controller.alias("controller"), F.concat(F.lit("App\\Modules\\"), module, F.lit("\\Controllers\\"), controller).alias("cls"), F.lit("app/Config/Routes.php").alias("source_file")
    )
    for m, folder in nested:
        deep = rf"(?i)^app/Modules/{m}/Controllers/{folder}/([^/]+)\.php$"
        inner = F.regexp_extract(path, deep, 1)
        found = found.unionByName(
            files.where(path.rlike(deep)).select(F.lit(f"{m}/{folder}".lower()).alias("prefix"), inner.alias("controller"), F.concat(F.lit(f"App\\Modules\\{m}\\Controllers\\{folder}\\"), inner).alias("cls"), F.lit(f"app/Modules/{m}/Config/Routes.php").alias("source_file"))
        )
    at = F.concat_ws("/", "prefix", lower_first(F.col("controller")))
    both = F.array(F.struct(at.alias("pattern"), F.concat("cls", F.lit("::index")).alias("target")), F.struct(F.concat(at, F.lit("/(:any)")).alias("pattern"), F.concat("cls", F.lit("::$1")).alias("target")))
    return found.select("source_file", F.inline(both)).select("pattern", F.lit("GET").alias("http_method"), "target", F.lit("convention").alias("kind"), "source_file", F.lit(0).cast("long").alias("lineno"))


def pattern_regex(pattern: Column) -> Column:
    """A route pattern, without outer slashes, as a case-insensitive regular expression: (:any) and (:num) capture, all else
    is literal."""
    quoted = F.regexp_replace(F.regexp_replace(pattern, "^/+|/+$", ""), r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(quoted, F.lit(r"\(:any\)"), F.lit("(.*)")), F.lit(r"\(:num\)"), F.lit(r"(\d+)")), F.lit("$"))


def substituted(target: Column, url: Column, regex: Column, groups: Column) -> Column:
    """`$1`, `$2`, ... of a target replaced by what the pattern captured, one after the other, however many there are."""
    # All captures come from one match: the groups' texts, told apart by a character that no address holds.
    order = F.array_join(F.transform(F.sequence(F.lit(1), groups), lambda k: F.concat(F.lit("$"), k.cast("string"))), "\0")
    captured = F.split(F.call_function("regexp_replace", url, regex, order), "\0")
    numbered = F.transform(captured, lambda text, k: F.struct(F.concat(F.lit("$"), (k + 1).cast("string")).alias("mark"), text.alias("text")))
    filled = F.aggregate(numbered, target, lambda out, g: F.replace(out, g["mark"], g["text"]))
    return F.when(groups > 0, filled).otherwise(target)


def matched_routes(urls: DataFrame, routes: DataFrame, url: str = "url") -> DataFrame:
    """(url, path, pattern, target, http_method) of the first route that matches each URL, in byte order of the pattern.

    An equi-join: a route whose pattern begins with a whole literal segment meets only the paths that begin with it; the
    others meet every distinct path, as they must. A prefix test comes before the regular expression. The routes are
    broadcast if their count allows it.
    """
    asked = urls.select(F.col(url).alias("url"), normalized_url(F.col(url)).alias("path"))
    paths = asked.where(F.col("path").isNotNull()).select("path").distinct()
    table = routes.where(F.col("pattern").isNotNull()).select("pattern", "target", "http_method", F.coalesce("id", F.lit("")).alias("id") if "id" in routes.columns else F.lit("").alias("id")).withColumns(
        {"regex": pattern_regex(F.col("pattern")), "groups": F.size(F.regexp_extract_all("pattern", F.lit(r"\(:(any|num)\)"), F.lit(0))), "literal": F.lower(F.regexp_replace(F.regexp_replace("pattern", "^/+|/+$", ""), r"\(:.*$", ""))}
    )
    whole = (F.instr("literal", "/") > 0) | (F.col("groups") == 0)
    table = table.withColumn("key", F.when(whole, F.substring_index("literal", "/", 1)).otherwise("*"))
    keyed = paths.withColumn("key", F.explode(F.array_distinct(F.array(F.lower(F.substring_index("path", "/", 1)), F.lit("*")))))
    hits = keyed.join(broadcast_if_small(table, BROADCAST_ROWS), "key").where(F.lower(F.col("path")).startswith(F.col("literal")) & F.rlike(F.col("path"), F.col("regex")))
    best = first_ranked(hits.select("path", "pattern", "http_method", "id", "target", "regex", "groups"), ["path"], [F.col("pattern"), F.col("http_method"), F.col("id")])
    filled = best.withColumn("target", substituted(F.col("target"), F.col("path"), F.col("regex"), F.col("groups")))
    return asked.join(filled, "path").select("url", "path", "pattern", "target", "http_method")


def resolved_urls(urls: DataFrame, routes: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """(url, resolved, matched_pattern, target, class, method, file): the handler of each distinct URL.

    Resolved is an address whose route names a class that a known file holds; its class is given without namespace. Where the
    target has no class or no such file, the pattern and the filled target are told and the rest is null; where no route
    matches, all is null. Files are known by their paths with forward slashes and given as they are stored.
    """
    hits = matched_routes(urls, routes, url)
    cls, method = split_target(F.col("target"))
    parts = hits.select("url", F.col("pattern").alias("matched_pattern"), "target", cls.alias("cls"), method.alias("m"), class_file(cls).alias("wanted"))
    known = files.where(F.col("file").isNotNull()).groupBy(F.replace("file", F.lit("\\"), F.lit("/")).alias("wanted")).agg(F.max("file").alias("file"))
    found = parts.join(known, "wanted", "left").withColumn("resolved", F.col("file").isNotNull())
    when = lambda c: F.when(F.col("resolved"), c)
    found = found.select("url", "resolved", "matched_pattern", "target", when(F.substring_index("cls", "\\", -1)).alias("class"), when(F.col("m")).alias("method"), "file")
    return urls.select(F.col(url).alias("url")).distinct().join(found.distinct(), "url", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def role_catalog(facts: DataFrame) -> DataFrame:
    """Concepts: role constants, the first definition of a code in the whole tree."""
    roles = facts.where(F.col("what") == "role").select("file", "ord", "name", F.col("target").alias("code"), app_of(F.col("file")).alias("app"), "lineno").withColumn("key", F.upper("code"))
    first = first_ranked(roles, ["key"], [F.col("file"), F.col("ord")])
    return first.select(concept_id(F.col("app"), F.col("code")).alias("id"), F.lit("Role").alias("kind"), "code", "name", "app", F.col("file").alias("source_file"), "lineno")


def list_concepts(concepts: DataFrame, kind: str | None = None) -> DataFrame:
    """All concepts in order, with their kind; or those of one kind, without it."""
    columns = ["code", "name", "app", "source_file", "lineno"]
    if kind:
        return concepts.where(F.col("kind") == kind).select(*columns).orderBy("app", "code")
    return concepts.select("kind", *columns).orderBy("kind", "app", "code")


def branch_rules(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept_id, target_id, target_kind, effect, condition, lineno, ord) of conditions that mention a known role."""
    keys = concepts.select(F.col("id").alias("concept_id"), F.explode(F.array_distinct(F.array(F.upper("code"), F.upper("name")))).alias("name"))
    gates = facts.where(F.col("what") == "gate").join(keys, "name")
    rules = gates.select("concept_id", F.col("target").alias("target_id"), F.col("receiver").alias("target_kind"), F.col("extra").alias("effect"), F.col("text").alias("condition"), "lineno", F.struct("file", "ord").alias("ord"))
    return first_ranked(rules, ["concept_id", "target_id", "effect", "lineno"], [F.col("ord")]).select(*rules.columns)


def concept_rules(concepts: DataFrame, rules: DataFrame, nodes: DataFrame, code: str) -> DataFrame:
    """(target, file, effect, condition, lineno) of a role's rules."""
    wanted = concepts.where(F.col("code") == code).select(F.col("id").alias("concept_id"))
    joined = rules.join(wanted, "concept_id", "left_semi").join(nodes.select(F.col("id").alias("target_id"), F.col("name").alias("target"), "file"), "target_id")
    return joined.select("target", "file", "effect", "condition", "lineno").orderBy("effect", "target", "file", "lineno")


def file_rules(concepts: DataFrame, rules: DataFrame, nodes: DataFrame, file: str) -> DataFrame:
    """(code, target, effect, condition, lineno) of the rules on a file."""
    targets = nodes.where(F.col("file") == file).select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    joined = rules.join(targets, "target_id").join(concepts.select(F.col("id").alias("concept_id"), "code"), "concept_id")
    return joined.select("code", "target", "effect", "condition", "lineno").orderBy("lineno", "code", "target")


def role_pages(concepts: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(role, file, effect), distinct."""
    joined = rules.join(concepts.where(F.col("kind") == "Role").select(F.col("id").alias("concept_id"), F.col("code").alias("role")), "concept_id").join(nodes.select(F.col("id").alias("target_id"), "file"), "target_id")
    return joined.select("role", "file", "effect").distinct()


def role_page_lines(concepts: DataFrame, rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """(role, pages): every page of a role with its effect, as one line. Only the finished line of a role comes together."""
    page = F.concat("file", F.lit(" ("), "effect", F.lit(")"))
    return role_pages(concepts, rules, nodes).groupBy("role").agg(F.array_join(F.array_sort(F.collect_list(page)), "; ").alias("pages"))


def role_matrix(pages: DataFrame, roles: list[str]) -> DataFrame:
    """One row per file and a column per role with its effect (the greatest, if several)."""
    return pages.groupBy("file").pivot("role", roles).agg(F.max("effect"))


def render_counts(renders: DataFrame) -> DataFrame:
    """(renders, resolved): how many view calls there are and of how many the file is known."""
    return renders.agg(F.count("*").alias("renders"), F.count_if("resolved").alias("resolved"))


def view_renders(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Renders: a path is looked up exactly; a bare name in the caller's Views folder, else as the only file of that name."""
    known = files.select(F.col("file").alias("known")).where(F.col("known").endswith(".php")).distinct()
    views = facts.where(F.col("what") == "view").select(F.col("file").alias("source_file"), F.col("extra").alias("source_kind"), "lineno", F.col("target").alias("view_arg"), "ord")
    path = F.regexp_replace(F.replace(F.col("view_arg"), F.lit("\\"), F.lit("/")), "^/+", "")
    path = F.regexp_replace(path, "(?i)^app/", "app/")
    exact = F.when(F.lower(path).endswith(".php"), path).otherwise(F.concat(path, F.lit(".php")))
    is_path = F.col("view_arg").rlike(r"[\\/]")
    folder = F.when(F.instr("source_file", "/Controllers") > 0, F.concat(F.regexp_replace("source_file", "/Controllers(?!.*/Controllers).*$", ""), F.lit("/Views"))).otherwise(F.regexp_replace("source_file", "/?[^/]*$", ""))
    wanted = F.when(is_path, exact).otherwise(F.concat(folder, F.lit("/"), F.col("view_arg"), F.lit(".php")))
    only = unambiguous(known.withColumn("base", basename(F.col("known"))), "base", "known").select("base", F.col("known").alias("only"))
    found = views.withColumns({"wanted": wanted, "base": F.when(~is_path, F.concat("view_arg", F.lit(".php")))}).join(known.withColumnRenamed("known", "wanted").withColumn("hit", F.lit(True)), "wanted", "left").join(only, "base", "left")
    target = F.when(F.col("hit"), F.col("wanted")).otherwise(F.col("only"))
    return found.select("source_file", "source_kind", "lineno", "view_arg", target.alias("target_file"), target.isNotNull().alias("resolved"))
