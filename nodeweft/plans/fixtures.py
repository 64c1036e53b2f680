"""Small sources with known facts: queries over them run the operators from parsing to answers, and their SQL lists the rows
that the rules give by hand. The folder of a query is not read."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeweft.operators import chats, graph, resolve, retrieval, traverse, web
from nodeweft.session import shared_folder, stage
from nodeweft.sources import facts as facts_of
from nodeweft.sources import tree
from nodeweft.streaming.incremental import file_diff, merged_facts

from . import ask, cypher

PYTHON = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return 0\n",
    "pkg/util.py": "import os\ndef helper(x):\n    return os.path.join(x)\ndef loop(n):\n    return loop(n - 1)\n",
    "pkg/app.py": "from pkg.base import Base\nfrom . import util\nimport pkg.util as u\n\nclass App(Base):\n    def step(self):\n        super().step()\n        return u.helper(self.go())\n"
    "    def go(self):\n        return later()\n\ndef later():\n    return thing.run()\n\nvalue = later()\n",
}
GUARD, PAGES, HOME = "app/Modules/Icab/Guard.php", "app/Modules/Icab/Controllers/Configuration.php", "app/Config/Routes.php"
PHP = {
    GUARD: "<?php\ndefine('ICAB_ADMIN_CODE', 'ADM');\nclass Guard {\n  public function check($roleCd) {\n    if ($roleCd == ICAB_ADMIN_CODE) {\n      $redirectFlag = TRUE;\n    }\n  }\n"
    "  public function open($roleCd) {\n    if ($roleCd == 'ADM') { $denyFlag = false; }\n    if ($user == 'ADM') { $denyFlag = true; }\n    if ($roleCd == 'ADM' && $x) { return 1; }\n  }\n}\n",
    "app/Modules/Other/Roles.php": "<?php\ndefine('OTHER_ADMIN_CODE', 'adm');\ndefine('OTHER_READER_ROLE_CD', 'RD');\ndefine('LIMIT', 5);\n",
    PAGES: "<?php\nnamespace App\\Modules\\Icab\\Controllers;\nclass Configuration extends Base {\n  public function index() {\n    return view('list');\n  }\n"
    "  public function edit($id) {\n    echo view('menu');\n    echo view('lone');\n    $this->stop();\n    return view('App\\Modules\\Icab\\Views\\list');\n  }\n  private function stop() { return parent::done(); }\n}\n",
    "app/Base.php": "<?php\nuse Core\\Menu;\nrequire 'Modules/A/Views/menu.php';\nclass Base {\n  /** Ends it. */\n  function done() { return only_here(1); }\n}\nfunction only_here($n) { return only_here($n - 1); }\n",
    "app/Modules/Ilabo/Controllers/Bo/Users.php": "<?php class Users {}",
    "app/Modules/Ilabo/Controllers/Front.php": "<?php class Front {}",
    "app/Modules/Icab/Views/list.php": "<ul></ul>",
    "app/Modules/A/Views/menu.php": "<a></a>",
    "app/Modules/B/Views/menu.php": "<b></b>",
    "app/Modules/B/Views/lone.php": "<i></i>",
    HOME: "<?php\n$routes->setDefaultNamespace('App\\Pages');\n$routes->get('/home/', 'Home::index');\n$routes->group('api', ['namespace' => 'App\\Api'], function ($routes) {\n"
    "  $routes->post('/item/(:num)', 'Item::show/$1');\n  $routes->group('v2', function ($routes) {\n    $routes->add('ping', '\\Core\\Ping::go');\n  });\n});\n",
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
EXPECTED: dict[str, str] = {}


def _rows(columns: str, *rows: tuple) -> str:
    """SQL for literal rows; whole numbers are bigint."""

    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float):
            return f"{v}::DOUBLE"
        if isinstance(v, int):
            return f"{v}::BIGINT"
        return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in str(v).split("\n"))

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({columns})"


def fixture(columns: str, *rows: tuple):
    def keep(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(spark)
        EXPECTED[f.__name__] = _rows(columns, *rows)
        return f

    return keep


#: The tables of the sources, by session: some dozens of rows, parsed and resolved once.
_made: dict[tuple, tuple[DataFrame, ...]] = {}


def _once(spark: SparkSession, key: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    at = (spark.sparkContext.applicationId, key)
    if at not in _made:
        _made[at] = tuple(spark.createDataFrame(df.collect(), df.schema) for df in make())
    return _made[at]


def _files(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(sources.items()), "file string, content string")


def _facts(spark: SparkSession, sources: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    files = _files(spark, sources)
    return files, _once(spark, f"facts {next(iter(sources))}", lambda: (facts_of.file_facts(files),))[0]


def _graph(spark: SparkSession, sources: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    return _once(spark, f"graph {next(iter(sources))}", lambda: resolve.build_graph(*_facts(spark, sources)))


def _fn(file: str, qualname: str) -> str:
    return f"function::pkg/{file}.py::{qualname}"


@fixture(
    "id, kind, name, file, lineno, end_lineno",
    ("class::pkg/base.py::Base", "Class", "Base", "pkg/base.py", 1, 5),
    (_fn("base", "Base.run"), "Function", "run", "pkg/base.py", 2, 3),
    (_fn("base", "Base.step"), "Function", "step", "pkg/base.py", 4, 5),
    (_fn("util", "helper"), "Function", "helper", "pkg/util.py", 2, 3),
    (_fn("util", "loop"), "Function", "loop", "pkg/util.py", 4, 5),
    ("class::pkg/app.py::App", "Class", "App", "pkg/app.py", 5, 10),
    (_fn("app", "App.step"), "Function", "step", "pkg/app.py", 6, 8),
    (_fn("app", "App.go"), "Function", "go", "pkg/app.py", 9, 10),
    (_fn("app", "later"), "Function", "later", "pkg/app.py", 12, 13),
)
def python_definitions(spark: SparkSession) -> DataFrame:
    nodes = _graph(spark, PYTHON)[0].where(F.col("kind").isin("Class", "Function"))
    return nodes.select("id", "kind", "name", "file", "lineno", "end_lineno")


@fixture("id, kind, name", *((f"module::pkg/{m}.py", "Module", f"pkg/{m}.py") for m in ("__init__", "base", "util", "app")), ("external::os", "External", "os"))
def python_modules(spark: SparkSession) -> DataFrame:
    return _graph(spark, PYTHON)[0].where(F.col("kind").isin("Module", "External")).select("id", "kind", "name")


@fixture(
    "src, dst, kind",
    ("module::pkg/base.py", "class::pkg/base.py::Base", "CONTAINS"),
    ("class::pkg/base.py::Base", _fn("base", "Base.run"), "CONTAINS"),
    ("class::pkg/base.py::Base", _fn("base", "Base.step"), "CONTAINS"),
    ("module::pkg/app.py", "class::pkg/app.py::App", "CONTAINS"),
    ("class::pkg/app.py::App", _fn("app", "App.step"), "CONTAINS"),
    ("class::pkg/app.py::App", _fn("app", "App.go"), "CONTAINS"),
    ("module::pkg/app.py", _fn("app", "later"), "CONTAINS"),
    ("module::pkg/util.py", _fn("util", "helper"), "CONTAINS"),
    ("module::pkg/util.py", _fn("util", "loop"), "CONTAINS"),
    ("module::pkg/app.py", "module::pkg/base.py", "IMPORTS"),
    ("module::pkg/app.py", "module::pkg/__init__.py", "IMPORTS"),
    ("module::pkg/app.py", "module::pkg/util.py", "IMPORTS"),
    ("module::pkg/util.py", "external::os", "IMPORTS"),
    ("class::pkg/app.py::App", "class::pkg/base.py::Base", "INHERITS"),
    (_fn("base", "Base.run"), _fn("base", "Base.step"), "CALLS"),
    (_fn("app", "App.step"), _fn("base", "Base.step"), "CALLS"),
    (_fn("app", "App.step"), _fn("util", "helper"), "CALLS"),
    (_fn("app", "App.step"), _fn("app", "App.go"), "CALLS"),
    (_fn("app", "App.go"), _fn("app", "later"), "CALLS"),
)
def python_edges(spark: SparkSession) -> DataFrame:
    return _graph(spark, PYTHON)[1]


@fixture(
    "file, local_name, kind, target_module, orig_name",
    ("pkg/app.py", "Base", "symbol", "pkg/base.py", "Base"),
    ("pkg/app.py", "util", "symbol", "pkg/__init__.py", "util"),
    ("pkg/app.py", "u", "module", "pkg/util.py", None),
)
def python_bindings(spark: SparkSession) -> DataFrame:
    files, facts = _facts(spark, PYTHON)
    return resolve.resolve_imports(facts, files)[1]


@fixture("caller, file, line", ("run", "pkg/base.py", 2), ("step", "pkg/app.py", 6))
def python_callers(spark: SparkSession) -> DataFrame:
    return graph.callers(*_graph(spark, PYTHON), "step")


@fixture("seed, hops, name, file", ("later", 1, "go", "pkg/app.py"), ("later", 3, "go", "pkg/app.py"), ("later", 3, "step", "pkg/app.py"), ("step", 3, "run", "pkg/base.py"), ("step", 3, "step", "pkg/app.py"))
def python_impact(spark: SparkSession) -> DataFrame:
    nodes, edges = _graph(spark, PYTHON)
    found = [traverse.impact(nodes, edges, seed, hops).select(F.lit(seed).alias("seed"), F.lit(hops).cast("long").alias("hops"), "name", "file") for seed, hops in (("later", 1), ("later", 3), ("step", 3))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@fixture("direction, name, file", ("above", "Base", "pkg/base.py"), ("below", "App", "pkg/app.py"))
def python_inheritance(spark: SparkSession) -> DataFrame:
    nodes, edges = _graph(spark, PYTHON)
    above = traverse.ancestors_of(nodes, edges, "App").select(F.lit("above").alias("direction"), "name", "file")
    return above.unionByName(traverse.subclasses_of(nodes, edges, "Base").select(F.lit("below").alias("direction"), "name", "file"))


@fixture("name", ("go",), ("step",))
def python_cypher(spark: SparkSession) -> DataFrame:
    return cypher.Graph(*_graph(spark, PYTHON)).run("MATCH (a:Function)-[:CALLS*1..3]->(b:Function {name: 'later'}) RETURN DISTINCT a.name AS name")


@fixture(
    "id, docstring",
    (f"function::{GUARD}::Guard.check", ""),
    (f"function::{GUARD}::Guard.open", ""),
    (f"function::{PAGES}::Configuration.index", ""),
    (f"function::{PAGES}::Configuration.edit", ""),
    (f"function::{PAGES}::Configuration.stop", ""),
    ("function::app/Base.php::Base.done", "Ends it."),
    ("function::app/Base.php::only_here", ""),
)
def php_functions(spark: SparkSession) -> DataFrame:
    return _graph(spark, PHP)[0].where("kind = 'Function'").select("id", "docstring")


@fixture(
    "src, dst, kind",
    (f"class::{PAGES}::Configuration", "class::app/Base.php::Base", "INHERITS"),
    (f"function::{PAGES}::Configuration.edit", f"function::{PAGES}::Configuration.stop", "CALLS"),
    (f"function::{PAGES}::Configuration.stop", "function::app/Base.php::Base.done", "CALLS"),
    ("function::app/Base.php::Base.done", "function::app/Base.php::only_here", "CALLS"),
    ("module::app/Base.php", "external::Core\\Menu", "IMPORTS"),
    ("module::app/Base.php", "module::app/Modules/A/Views/menu.php", "IMPORTS"),
)
def php_edges(spark: SparkSession) -> DataFrame:
    return _graph(spark, PHP)[1].where("kind <> 'CONTAINS'")


@fixture(
    "id, kind, code, name, app, source_file, lineno",
    ("concept::Icab::ADM", "Role", "ADM", "ICAB_ADMIN_CODE", "Icab", GUARD, 2),
    ("concept::Other::RD", "Role", "RD", "OTHER_READER_ROLE_CD", "Other", "app/Modules/Other/Roles.php", 3),
)
def role_concepts(spark: SparkSession) -> DataFrame:
    return web.role_catalog(_facts(spark, PHP)[1])


@fixture(
    "kind, code, app",
    ("Role", "ADM", "Icab"),
    ("Role", "RD", "Other"),
    (None, "ADM", "Icab"),
    (None, "RD", "Other"),
)
def role_list(spark: SparkSession) -> DataFrame:
    concepts = web.role_catalog(_facts(spark, PHP)[1])
    return web.list_concepts(concepts).select("kind", "code", "app").unionByName(web.list_concepts(concepts, "Role").select(F.lit(None).cast("string").alias("kind"), "code", "app"))


@fixture(
    "concept_id, target_id, target_kind, effect, condition, lineno",
    ("concept::Icab::ADM", f"function::{GUARD}::Guard.check", "Function", "deny", "($roleCd == ICAB_ADMIN_CODE)", 5),
    ("concept::Icab::ADM", f"function::{GUARD}::Guard.open", "Function", "allow", "($roleCd == 'ADM')", 10),
    ("concept::Icab::ADM", f"function::{GUARD}::Guard.open", "Function", "checked", "($roleCd == 'ADM' && $x)", 12),
)
def role_gates(spark: SparkSession) -> DataFrame:
    facts = _facts(spark, PHP)[1]
    return web.branch_rules(facts, web.role_catalog(facts)).drop("ord")


@fixture("concept_id, target_id, effect, lineno", ("concept::Icab::ADM", f"function::{GUARD}::Guard.check", "deny", 5), ("concept::Icab::ADM", f"function::{GUARD}::Guard.open", "checked", 12))
def role_gates_loaded(spark: SparkSession) -> DataFrame:
    """One rule per concept and target: the last one holds."""
    files, facts = _facts(spark, PHP)
    concepts = web.role_catalog(facts)
    return graph.load_rules(concepts, resolve.graph_nodes(facts), web.branch_rules(facts, concepts)).select("concept_id", "target_id", "effect", "lineno")


@fixture(
    "pattern, http_method, target, kind, source_file, lineno",
    ("home", "GET", "App\\Pages\\Home::index", "explicit", HOME, 3),
    ("api/item/(:num)", "POST", "App\\Api\\Item::show/$1", "explicit", HOME, 5),
    ("api/v2/ping", "ADD", "\\Core\\Ping::go", "explicit", HOME, 7),
)
def routes_declared(spark: SparkSession) -> DataFrame:
    return web.explicit_routes(_facts(spark, PHP)[1])


_PAGE, _BO = "App\\Modules\\Icab\\Controllers\\Configuration::", "App\\Modules\\Ilabo\\Controllers\\Bo\\Users::"


@fixture(
    "pattern, target, source_file",
    ("icab/configuration", f"{_PAGE}index", HOME),
    ("icab/configuration/(:any)", f"{_PAGE}$1", HOME),
    ("ilabo/bo/users", f"{_BO}index", "app/Modules/Ilabo/Config/Routes.php"),
    ("ilabo/bo/users/(:any)", f"{_BO}$1", "app/Modules/Ilabo/Config/Routes.php"),
)
def routes_by_convention(spark: SparkSession) -> DataFrame:
    return web.convention_routes(_files(spark, PHP)).select("pattern", "target", "source_file")


@fixture(
    "url, resolved, matched_pattern, class_name, method",
    ("https://h.example/icab/configuration?x=1", True, "icab/configuration", "Configuration", "index"),
    ("/icab/configuration/edit", True, "icab/configuration/(:any)", "Configuration", "edit"),
    ("/icab/configuration/edit/5", True, "icab/configuration/(:any)", "Configuration", "edit/5"),
    ("/api/item/7", False, "api/item/(:num)", None, None),
    ("/nope", False, None, None, None),
)
def routes_resolved(spark: SparkSession) -> DataFrame:
    files, facts = _facts(spark, PHP)
    asked = spark.createDataFrame([(u,) for u in ("https://h.example/icab/configuration?x=1", "/icab/configuration/edit", "/icab/configuration/edit/5", "/api/item/7", "/nope")], "url string")
    routes = graph.load_routes(web.explicit_routes(facts).unionByName(web.convention_routes(files)))
    return web.resolved_urls(asked, routes, files).select("url", "resolved", "matched_pattern", F.col("class").alias("class_name"), "method")


@fixture(
    "source_file, source_kind, lineno, view_arg, target_file, resolved",
    (PAGES, "Function", 5, "list", "app/Modules/Icab/Views/list.php", True),
    (PAGES, "Function", 8, "menu", None, False),
    (PAGES, "Function", 9, "lone", "app/Modules/B/Views/lone.php", True),
    (PAGES, "Function", 11, "App\\Modules\\Icab\\Views\\list", "app/Modules/Icab/Views/list.php", True),
)
def views_rendered(spark: SparkSession) -> DataFrame:
    files, facts = _facts(spark, PHP)
    return web.view_renders(facts, files)


@fixture(
    "id, target_file",
    (f"render::{PAGES}::5::list", "app/Modules/Icab/Views/list.php"),
    (f"render::{PAGES}::8::menu", ""),
    (f"render::{PAGES}::9::lone", "app/Modules/B/Views/lone.php"),
    (f"render::{PAGES}::11::App\\Modules\\Icab\\Views\\list", "app/Modules/Icab/Views/list.php"),
)
def views_loaded(spark: SparkSession) -> DataFrame:
    files, facts = _facts(spark, PHP)
    return graph.load_renders(web.view_renders(facts, files)).select("id", "target_file")


RELATIVE = {
    "a/b/c/d.py": "from . import x\nfrom .x import y\nfrom .. import z as w\nfrom ..z.q import r\nfrom ... import top\nfrom .... import above\nfrom ..... import beyond\nimport a.b.z\nimport a.b.z as m, os.path\n",
    "a/b/c/__init__.py": "",
    "a/b/c/x.py": "",
    "a/b/__init__.py": "",
    "a/b/z/q.py": "",
    "a/b/z/__init__.py": "",
    "a/__init__.py": "",
}


@fixture(
    "dst",
    ("module::a/b/c/__init__.py",),
    ("module::a/b/c/x.py",),
    ("module::a/b/__init__.py",),
    ("module::a/b/z/q.py",),
    ("module::a/__init__.py",),
    ("module::a/b/z/__init__.py",),
    ("external::os.path",),
)
def relative_imports(spark: SparkSession) -> DataFrame:
    """Levels go up from the file's folder; what no file provides is external, unless it is relative."""
    files, facts = _facts(spark, RELATIVE)
    return resolve.resolve_imports(facts, files)[0].select("dst")


@fixture("local_name, kind, target_module, orig_name", ("x", "symbol", "a/b/c/__init__.py", "x"), ("y", "symbol", "a/b/c/x.py", "y"), ("w", "symbol", "a/b/__init__.py", "z"), ("r", "symbol", "a/b/z/q.py", "r"), ("top", "symbol", "a/__init__.py", "top"), ("m", "module", "a/b/z/__init__.py", None))
def relative_bindings(spark: SparkSession) -> DataFrame:
    files, facts = _facts(spark, RELATIVE)
    return resolve.resolve_imports(facts, files)[1].drop("file")


DOCUMENTED = {
    "d.php": "<?php\n/**\n * First line.\n *\n *   Second line.\n * @return int\n */\n#[Pure]\nfunction one() {}\n/* plain */ function two() {}\n/** kept */\n\nfunction three() {}\n// between\nfunction four() {}\n/** far */\n$x = 1;\nfunction five() {}\n"
    "define('X_ADMIN_CODE', 'A'); define('ROLE_KEY', 'B'); define('x_role_key_usr', 'C'); define('ADMIN', 'D'); define('SERVICE_TARIF_ROLE_CD', 'E'); define('READER_CODE_2', F);\n"
    "class K { function m($a) { if ($a) { return '}'; } } }\nfunction m() { return 2; }\n",
}


@fixture("name, docstring", ("one", "First line.\nSecond line.\n@return int"), ("two", ""), ("three", "kept"), ("four", ""), ("five", ""), ("m", ""), ("m", ""))
def documentation(spark: SparkSession) -> DataFrame:
    """Only the `/**` comment directly before a declaration counts, without stars and blank lines."""
    return _graph(spark, DOCUMENTED)[0].where("kind = 'Function'").select("name", "docstring")


@fixture("name, code", ("X_ADMIN_CODE", "A"), ("x_role_key_usr", "C"), ("SERVICE_TARIF_ROLE_CD", "E"), ("READER_CODE_2", "READER_CODE_2"))
def role_constants(spark: SparkSession) -> DataFrame:
    """A noun and a suffix in either order, whatever the case; a value that isn't a literal gives way to the name."""
    return web.role_catalog(_facts(spark, DOCUMENTED)[1]).select("name", "code")


@fixture("cls, method, source", ("K", "m", "function m($a) { if ($a) { return '}'; } }"), ("", "two", "function two() {}"), ("K", "two", None))
def method_sources(spark: SparkSession) -> DataFrame:
    rows = [(cls, method, ask.method_source(DOCUMENTED["d.php"], method, cls or None)) for cls, method in (("K", "m"), ("", "two"), ("K", "two"))]
    return spark.createDataFrame(rows, "cls string, method string, source string")


#: A tree as bytes: what is scanned of it, and what isn't.
TREE = {
    "a.py": b"x = 1\n",
    "pkg/__init__.py": b"",
    "pkg/deep/er/b.py": b"s = '\xff'\n",
    "pkg/c.php": b"<?php\n",
    "pkg/d.PY": b"x",
    ".hidden/e.py": b"x",
    "node_modules/f.py": b"x",
    "own_env/pyvenv.cfg": b"",
    "own_env/lib/g.py": b"x",
    "vendor/h.php": b"<?php",
    "vendor/i.py": b"y = 2\n",
}


@fixture(
    "file, lang, content, sha1",
    *((f, "python", TREE[f].decode(errors="ignore"), hashlib.sha1(TREE[f]).hexdigest()) for f in ("a.py", "pkg/__init__.py", "pkg/deep/er/b.py", "vendor/i.py")),
    ("pkg/c.php", "php", "<?php\n", hashlib.sha1(b"<?php\n").hexdigest()),
)
def scanned_tree(spark: SparkSession) -> DataFrame:
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    system, base = tree.file_system(root)
    for file, data in TREE.items():
        system.create_dir(f"{base}/{file}".rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(f"{base}/{file}") as f:
            f.write(data)
    return tree.scan_tree(spark, root, ".py").unionByName(tree.scan_tree(spark, root, ".php"))


@fixture("path, reason", ("../x.py", "outside the upload"), ("/etc/y.py", "outside the upload"), ("d.js", "not a source file"), (".git/c.py", "in a skipped directory"), ("big.py", "over 2097152 bytes"), ("a/b.py", None), ("a/c.php", None))
def upload_rules(spark: SparkSession) -> DataFrame:
    items = [{"path": p, "content": "x"} for p in ("../x.py", "/etc/y.py", "a/b.py", ".git/c.py", "d.js", "a/./c.php")] + [{"path": "big.py", "content": "x" * (tree.UPLOAD_LIMIT + 1)}]
    skipped: list[dict] = []
    kept = tree.uploaded(spark, items, skipped).select(F.col("file").alias("path"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(spark.createDataFrame([(s["path"], s["reason"]) for s in skipped], "path string, reason string"))


@fixture(
    "src, dst, kind",
    ("function::a.py::g", "function::b.py::h", "CALLS"),
    ("module::a.py", "function::a.py::g", "CONTAINS"),
    ("module::b.py", "function::b.py::h", "CONTAINS"),
    ("module::d.py", "function::d.py::k", "CONTAINS"),
    ("module::a.py", "module::b.py", "IMPORTS"),
)
def incremental_edges(spark: SparkSession) -> DataFrame:
    """b.py changes, c.py goes, d.py comes; a.py isn't parsed again, and its call is resolved anew."""
    before = _files(spark, {"a.py": "from b import f, h\ndef g(): h()\n", "b.py": "def f(): pass\n", "c.py": "def g(): pass\n"})
    after = _files(spark, {"a.py": "from b import f, h\ndef g(): h()\n", "b.py": "def h(): pass\n", "d.py": "def k(): pass\n"})
    old = facts_of.file_facts(before)
    return resolve.build_graph(after, stage(merged_facts(old, tree.manifest(before), after, facts_of.file_facts), "facts"))[1]


def _chats(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    c = spark.createDataFrame([], "id string, repo_db_path string, title string, created_at double, updated_at double")
    m = spark.createDataFrame([], "id long, chat_id string, seq long, question string, answer string, type string, detail string, image_data_url string, context_question string, created_at double")
    for key, title in (("x", ""), ("y", "named"), ("z", "")):
        c = chats.create_chat(c, "/db", title, now=1.0, chat_id=key)
    for k, (key, question, context) in enumerate((("x", "Who calls\nf?", None), ("x", "And g?", "And g of the page?"), ("y", "Why?", None), ("x", "Thanks", None), ("z", " ", None))):
        c, m = chats.add_message(c, m, key, question, f"answer {k}", now=2.0 + k, context_question=context)
    m = chats.delete_message(m, "x", 1)
    c, m = chats.add_message(c, m, "x", "Again", "answer", now=9.0)
    return chats.delete_chat(c, m, "y")


@fixture("id, title, created_at, updated_at", ("x", "Who calls f?", 1.0, 9.0), ("z", "(image)", 1.0, 6.0))
def chats_kept(spark: SparkSession) -> DataFrame:
    return chats.list_chats(_chats(spark)[0], "/db").select("id", "title", "created_at", "updated_at")


@fixture("id, chat_id, seq, question, answer, context_question", (1, "x", 0, "Who calls\nf?", "answer 0", "Who calls\nf?"), (4, "x", 2, "Thanks", "answer 3", "Thanks"), (5, "z", 0, " ", "answer 4", " "), (6, "x", 3, "Again", "answer", "Again"))
def chat_turns(spark: SparkSession) -> DataFrame:
    """A deleted turn leaves a gap; the next one is numbered behind the last."""
    return _chats(spark)[1].select("id", "chat_id", "seq", "question", "answer", "context_question")


@fixture("name, type", *((k, "NODE") for k in ("Module", "Class", "Function", "External", "Concept")), *((k, "REL") for k in ("CONTAINS", "IMPORTS", "CALLS", "INHERITS", "RULE")))
def catalog_tables(spark: SparkSession) -> DataFrame:
    nodes, edges = _graph(spark, PHP)
    facts = _facts(spark, PHP)[1]
    concepts = web.role_catalog(facts)
    return cypher.Graph(nodes, edges, concepts, web.branch_rules(facts, concepts)).run("CALL show_tables()")


@fixture("property_id, name, type", (0, "src", "string"), (1, "dst", "string"), (2, "kind", "string"))
def catalog_columns(spark: SparkSession) -> DataFrame:
    return cypher.Graph(*_graph(spark, PHP)).run("CALL table_info('CALLS')").withColumn("property_id", F.col("property_id").cast("long"))


@fixture("block", ("Direct callers of later:\n- go (pkg/app.py:9)\nFunctions that reach later within 2 calls:\n- go (pkg/app.py)\n- step (pkg/app.py)",), ("App extends:\n- Base (pkg/base.py)".replace("App extends", "Classes above App"),), ("No class was found that extends App.",))
def fact_blocks(spark: SparkSession) -> DataFrame:
    blocks = ask.fact_blocks(ask.Store(*_graph(spark, PYTHON)), "What breaks within 2 hops if I change later, and what does App inherit?")
    return spark.createDataFrame([(b,) for b in blocks], "block string")


@fixture("renders, resolved", (4, 3))
def views_counted(spark: SparkSession) -> DataFrame:
    files, facts = _facts(spark, PHP)
    return web.render_counts(web.view_renders(facts, files))


@fixture("doc, score", ("D1", 0.734608), ("D2", 0.146944))
def tfidf_scores(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame([("D1", "load graph nodes"), ("D2", "graph store"), ("D3", "render page")], "id string, text string")
    return retrieval.tfidf_rank(docs, "id", F.col("text"), "load the graph").select("doc", F.round("score", 6).alias("score"))


@fixture("file, status", ("a.py", "unchanged"), ("b.py", "changed"), ("c.py", "removed"), ("d.py", "changed"))
def manifest_diff(spark: SparkSession) -> DataFrame:
    old = spark.createDataFrame([("a.py", "h1"), ("b.py", "h2"), ("c.py", "h4")], "file string, sha1 string")
    return file_diff(old, spark.createDataFrame([("a.py", "h1"), ("b.py", "h3"), ("d.py", "h5")], "file string, sha1 string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"fixture_{name}": f for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {f"fixture_{name}": sql for name, sql in EXPECTED.items()}
