import textwrap

import pytest

from nodeweft.operators import resolve, traverse
from nodeweft.sources import facts, php_text, python_text, tree
from nodeweft.sources.tree import scan_tree, uploaded

P1 = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def run(self):\n        return self.step()\n    def step(self):\n        return 0\n",
    "pkg/util.py": "import os\ndef helper(x):\n    return os.path.join(x)\ndef loop(n):\n    return loop(n - 1)\n",
    "pkg/app.py": textwrap.dedent(
        """\
        from pkg.base import Base
        from . import util
        import pkg.util as u

        class App(Base):
            def step(self):
                super().step()
                return u.helper(self.go())
            def go(self):
                return later()

        def later():
            return thing.run()

        value = later()
        """
    ),
}


@pytest.fixture(scope="module")
def p1(spark):
    files = spark.createDataFrame(list(P1.items()), "file string, content string")
    table = facts.file_facts(files).cache()
    nodes, edges = resolve.build_graph(files, table)
    return nodes.cache(), edges.cache()


def test_python_nodes_and_edges(p1, rows):
    nodes, edges = p1
    kinds = dict(rows(nodes.groupBy("kind").count()))
    assert kinds == {"Module": 4, "Class": 2, "Function": 7, "External": 1}
    of = lambda kind: rows(edges.where(f"kind = '{kind}'"), "src", "dst")
    assert len(of("CONTAINS")) == 9
    assert of("IMPORTS") == [("module::pkg/app.py", f"module::pkg/{m}.py") for m in ("__init__", "base", "util")] + [("module::pkg/util.py", "external::os")]
    assert of("INHERITS") == [("class::pkg/app.py::App", "class::pkg/base.py::Base")]
    f = "function::pkg/{}.py::{}".format
    assert of("CALLS") == sorted(
        [(f("base", "Base.run"), f("base", "Base.step")), (f("app", "App.step"), f("base", "Base.step")), (f("app", "App.step"), f("util", "helper")), (f("app", "App.step"), f("app", "App.go")), (f("app", "App.go"), f("app", "later"))], key=repr
    )


def test_python_traversal(p1, rows):
    nodes, edges = p1
    assert rows(traverse.impact(nodes, edges, "later", 1)) == [("go", "pkg/app.py")]
    assert rows(traverse.impact(nodes, edges, "later", 3)) == [("go", "pkg/app.py"), ("step", "pkg/app.py")]
    assert rows(traverse.impact(nodes, edges, "step", 3)) == [("run", "pkg/base.py"), ("step", "pkg/app.py")]
    assert rows(traverse.ancestors_of(nodes, edges, "App"), "name") == [("Base",)]
    assert rows(traverse.subclasses_of(nodes, edges, "Base"), "name") == [("App",)]


def test_broken_and_empty_files(spark, rows):
    files = spark.createDataFrame([("a.py", "def f(:"), ("b.py", None), ("c.php", None), ("d.txt", "x"), (None, "x")], "file string, content string")
    assert rows(facts.file_facts(files), "what", "file") == [("module", "a.py"), ("module", "b.py"), ("module", "c.php")]
    nodes, edges = resolve.build_graph(files, facts.file_facts(files).cache())
    assert nodes.count() == 3 and edges.count() == 0


PHP = """<?php
namespace App;
use Core\\Menu;
use Core\\{A, B};
require 'lib/util.php';
require __DIR__ . '/x.php';
/** Adds. */
function add($a) { return helper($a); }
function helper($a) { $s = "function fake() { {$a["k"]} }"; return $s; }
class Base {
    /** Runs it. */
    public static function run() { return static::step(); }
    protected static function step() { return 1; }
}
final class Child extends Base implements X {
    // not documentation
    function go() {
        $q = <<<SQL
        select function from price /** no */
        SQL;
        $f = function () { return add(1); };
        parent::run();
        $this->stop();
        $other->stop();
        return Base::run();
    }
    /** Stops.
     * @return int */
    #[Deprecated]
    private function stop() { return new class { function inner() {} }; }
    /** far */

    // between
    function undocumented() {}
}
"""


def test_php_definitions():
    found = {(d.kind, d.qualname): d.doc for d in php_text.parse(PHP).definitions}
    assert found == {
        ("Function", "add"): "Adds.",
        ("Function", "helper"): "",
        ("Class", "Base"): "",
        ("Function", "Base.run"): "Runs it.",
        ("Function", "Base.step"): "",
        ("Class", "Child"): "",
        ("Function", "Child.go"): "",
        ("Function", "Child.stop"): "Stops.\n@return int",
        ("Function", "Child.stop.inner"): "",
        ("Function", "Child.undocumented"): "",
    }


def test_php_edges(spark, rows):
    files = spark.createDataFrame([("a.php", PHP), ("lib/util.php", "<?php function only() {}"), ("b.php", "<?php function use_it() { only(); }")], "file string, content string")
    nodes, edges = resolve.build_graph(files, facts.file_facts(files).cache())
    f = "function::a.php::{}".format
    calls = rows(edges.where("kind = 'CALLS'"), "src", "dst")
    assert set(calls) == {
        (f("add"), f("helper")), (f("Base.run"), f("Base.step")), (f("Child.go"), f("add")), (f("Child.go"), f("Base.run")), (f("Child.go"), f("Child.stop")), ("function::b.php::use_it", "function::lib/util.php::only"),
    }
    assert rows(edges.where("kind = 'INHERITS'"), "src", "dst") == [("class::a.php::Child", "class::a.php::Base")]
    imports = rows(edges.where("kind = 'IMPORTS'"), "dst")
    assert ("module::lib/util.php",) in imports and ("external::Core\\Menu",) in imports


def test_php_never_fails():
    for text in ("", "<?php", "<?php '", '<?php "{$a["', "<?php <<<X\nabc", "<?php /*", "<?php class", "<?php function (", "<?php } } {", "plain html", "<?php ?> html <?php function f() {"):
        php_text.parse(text)
    assert [d.name for d in php_text.parse("<?php ?> html function g() {} <?php function f() {").definitions] == ["f"]


def test_python_lexer_agrees_with_the_parser():
    import ast

    text = textwrap.dedent(
        '''\
        def a(x: "q:" = ":", *, y={1:2}) -> dict[str, "a:b"]: "one line"
        class A:
            """c"""
            if 1:
                async def b(self): r"""doc
                more"""; return 1
            else:
                @deco(
                    "x")
                def b(self,
                      q=f"{x['a']!r:>{w}} def z(): "):
                    # comment
                    "part" 'two' \\
                    "three"
                    def inner():
                        ("paren doc")
                        def deep(): pass
                    return """def fake():
            'x'
        """
            def after(self):
                f"not doc"
        def g():
        \tb"bytes"
        def h(): x = "str"; "no"
        def k():

            # c

            """late"""
        '''
    )

    def expected(node, scope):
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = [*scope, child.name]
                if not isinstance(child, ast.ClassDef):
                    yield ".".join(inner), ast.get_docstring(child)
            yield from expected(child, inner)

    found = [(f.qualname, f.doc) for f in python_text.functions(text)]
    assert sorted(found, key=repr) == sorted(expected(ast.parse(text), []), key=repr)


def test_scan_tree(spark, tmp_path, rows, monkeypatch):
    for path, text in {"a.py": "x", "_b/__init__.py": "", ".hidden/c.py": "x", "env1/pyvenv.cfg": "", "env1/d.py": "x", "node_modules/e.py": "x", "f.PY": "x", "vendor/g.php": "<?php", "h.php": "<?php"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "bad.py").write_bytes(b"x = '\xff'")
    got = rows(scan_tree(spark, str(tmp_path), ".py"), "file", "content")
    assert got == [("_b/__init__.py", ""), ("a.py", "x"), ("bad.py", "x = ''")]
    assert rows(scan_tree(spark, str(tmp_path), ".php"), "file") == [("h.php",)]
    (tmp_path / "deep/er/x").mkdir(parents=True)
    (tmp_path / "deep/er/x/k.py").write_text("x")
    # Listed by the executors from the second directory on.
    monkeypatch.setattr(tree, "LISTED_HERE", 2)
    assert rows(scan_tree(spark, str(tmp_path), ".py"), "file", "content") == [*got[:2], got[2], ("deep/er/x/k.py", "x")]


def test_upload(spark, rows):
    items = [{"path": "../x.py", "content": "x"}, {"path": "/etc/y.py", "content": "x"}, {"path": "a/b.py", "content": "x"}, {"path": ".git/c.py", "content": "x"}, {"path": "d.js", "content": "x"}]
    skipped = []
    items.append({"path": "big.py", "content": "x" * (2 * 1024 * 1024 + 1)})
    assert rows(uploaded(spark, items, skipped), "file") == [("a/b.py",)]
    assert [(s["path"], s["reason"]) for s in skipped] == [("../x.py", "outside the upload"), ("/etc/y.py", "outside the upload"), (".git/c.py", "in a skipped directory"), ("d.js", "not a source file"), ("big.py", "over 2097152 bytes")]
    with pytest.raises(ValueError):
        uploaded(spark, [])
