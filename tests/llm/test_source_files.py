import base64
import random

import pytest

from nodeweft.llm import authored, doc_pairs
from nodeweft.llm.doc_pairs import says_something

ORDINARY = "import os\n\n\ndef total(rows):\n    \"\"\"Adds the open amounts of all rows.\"\"\"\n    return sum(r['amount'] for r in rows if r['open'])\n\n\ndef close(rows, when):\n    for row in rows:\n        row['closed_at'] = when\n    return rows\n"
PACKED = "".join(f"def {a}{b}(f,g={i}):q=[f]*g;return q[:{i}]\n" for i, (a, b) in enumerate((a, b) for a in "abcd" for b in "xyz"))


def label(file, content):
    e = authored.file_evidence(file, content)
    k = max(range(5), key=lambda i: e[i])
    return authored.LABELS[k] if e[k] > 2 else "handwritten"


@pytest.mark.parametrize("head", ["# @generated by tool", "# This file was produced automatically by x; manual changes will be lost.", "# Code generated by x 1.2. DO NOT EDIT.", "# source: a.proto (written by the x compiler)", "# Autogenerado por x. No editar.", "# Automatisch erzeugt von x - nicht von Hand aendern.", "# Ce fichier est genere par x, ne pas modifier.", "# compiled from templates/a.tpl, any edit here is overwritten"])
def test_generated_heads(head):
    assert label("src/a.py", head + "\n" + ORDINARY) == "generated"


@pytest.mark.parametrize("head", ["# Copied from lib 2.1, local changes: none", "# This file is part of the lib package.\n# For the full licence text see the LICENSE file shipped with lib.", "# lib v1.2.3\n#  (c) the lib contributors\n#  BSD-2-Clause", "# @package lib\n# @license MIT", "# lib - small parsing library", "# Vendored from https://code.example at tag 1.2"])
def test_vendored_heads(head):
    assert label("src/a.py", head + "\n" + ORDINARY) == "vendored"


@pytest.mark.parametrize(
    "text",
    ["", "# Copyright (c) Firm. Internal use only.\n", "# Written by the stock team; replaces the generated importer of last year.\n# Do not edit the constants without asking finance.\n", "BANNER = '# Code generated by our step. DO NOT EDIT.'\n", "# The vendor sends us this list by mail.\n# Licence keys are checked in the module.\n"]
    + ["SQL = '" + "select a.b, c.d from e, " * 40 + "'\n", "CODES = {\n" + "".join(f"    'name_{i}' : 'value',\n" for i in range(60)) + "}\n"],
)
def test_decoys(text):
    assert label("src/code_generator.py", text + ORDINARY) == "handwritten"


def test_packed_and_data():
    assert label("src/a.py", PACKED) == "minified"
    data = base64.b64encode(random.Random(1).randbytes(900)).decode()
    assert label("src/a.py", f'import base64\nDATA = base64.b64decode("""{data}""")\n') == "blob"
    assert label("a.php", "<?php\nreturn array(" + ",".join(str(i * 7919 % 10000) for i in range(300)) + ");") == "blob"
    assert label("a.php", '<?php\n$x = "' + "".join(f"\\x{i % 256:02x}" for i in range(400)) + '";') == "blob"


FILES = "file string, content string, indexed_at int, extra int"


def test_directories_speak_for_their_files(spark, rows):
    data = [
        ("r/src/a.py", ORDINARY, 1, 0), ("r/src/b.py", "# @generated by x\n" + ORDINARY, 1, 0), ("r/src/c.py", ORDINARY, 1, 0), ("r/lib/third_party/zip/src/d.py", ORDINARY, 1, 0), ("r/vendor_portal/e.py", ORDINARY, 1, 0),
        ("r/app/generated/f.py", "def f():\n    pass\n", 1, 0), ("r/app/g.py", ORDINARY, 1, 0), ("r/h.py", ORDINARY, 2, 0), ("r/h.py", "# @generated by x\n", 1, 0), ("r/h.py", ORDINARY, 2, 0), ("i.py", None, 1, 0), ("r/cache/views/j.php", "", None, 0), (None, ORDINARY, 1, 0),
        ("r/lib/zip-1.2.0/k.py", "# Copyright (c) Firm. Internal use only.\n" + ORDINARY, 1, 0),
    ]
    found = rows(authored.foreign_files(spark.createDataFrame(data, FILES)))
    assert found == [("r/app/generated/f.py",), ("r/cache/views/j.php",), ("r/lib/third_party/zip/src/d.py",), ("r/src/b.py",)]


def test_siblings_agree(spark, rows):
    marked = "# Copied from lib 2.1, local changes: none\n" + ORDINARY
    data = [(f"r/odd/{k}.py", marked, 1, 0) for k in range(9)] + [("r/odd/plain.py", "x = 1\n", 1, 0)] + [(f"r/own/{k}.py", ORDINARY, 1, 0) for k in range(9)] + [("r/own/marked.py", marked, 1, 0)]
    found = {f for (f,) in rows(authored.foreign_files(spark.createDataFrame(data, FILES)))}
    assert "r/odd/plain.py" in found and "r/own/marked.py" in found and not any(f.startswith("r/own/") and "marked" not in f for f in found)


def test_marginals_equal_enumeration(spark):
    """The two sweeps give the exact marginals of a small tree."""
    import itertools

    import numpy as np

    files = {"a/x.py": "# @generated by x\nx = 1\n", "a/b/y.py": "y = 1\n", "a/b/z.py": ORDINARY}
    e = {f: np.exp(authored.file_evidence(f, c)) for f, c in files.items()}
    dd, fd = np.array(authored.DIRECTORY_IN_DIRECTORY), np.array(authored.FILE_IN_DIRECTORY)
    total = dict.fromkeys(files, 0.0)
    mass = 0.0
    for a, b, x, y, z in itertools.product(range(5), repeat=5):
        p = authored.ROOT[a] * dd[a, b] * fd[a, x] * fd[b, y] * fd[b, z] * e["a/x.py"][x] * e["a/b/y.py"][y] * e["a/b/z.py"][z]
        mass += p
        for f, k in zip(files, (x, y, z), strict=True):
            total[f] += p * (k == 0)
    got = {r["file"]: r["p_handwritten"] for r in authored.file_labels(spark.createDataFrame([(f, c, 1, 0) for f, c in files.items()], FILES)).collect()}
    assert all(abs(got[f] - total[f] / mass) < 1e-9 for f in files)


def test_no_files(spark):
    assert authored.file_labels(spark.createDataFrame([], FILES)).count() == 0


@pytest.mark.parametrize("doc", ["", "TODO", "-", "...", "N/A", "Description", "_summary_", "Short description of the function", "Loads the order.", "load_order()", "Method load_order", "To load the order", "order loading", "This function loads an order.", ":param x:\n:return:", "@param int $x\n@return void", "Args:\n    x:\n    y:", "Parameters\n----------\nx : int", "Load order\n@param $x", ":rtype: None", "FIXME describe this", "@param int $rows the rows"])
def test_says_nothing(doc):
    assert not says_something(doc, "load_order")


@pytest.mark.parametrize("doc", ["Idempotent.", "Newest first.", "None if the order is locked.", "TODO list entries are skipped.", "@return array rows keyed by id, newest first", "@param int $x the order to use", ":returns: the saved order", "Loads the order; returns None when it is gone.", "Args:\n    x: an order, may be None", "Cents, not euros.", "Übersetzt die Bestellung", "保存订单"])
def test_says_something(doc):
    assert says_something(doc, "load_order")


def test_documented_functions(spark, rows):
    php = "<?php\nclass K {\n  /** Keeps gaps. */\n  function a() { $s = '/** x */ function fake() {'; }\n  /** a */\n  function b() {}\n  // Real remark\n  function c() {}\n}\n/** Newest first. */\nfunction d() {}\n"
    py = 'class K:\n    def a(self):\n        """Old remark on rows."""\n    def a(self):\n        pass\n\nasync def b():\n    r"""Cents, not euros."""\n    def inner():\n        "Sorted by date."\n'
    data = [("x.php", php, 1, 0), ("y.py", py, 1, 0), ("y.py", "def z():\n    'Gone by now.'\n", 0, 0), ("bad.py", "def f(:\n    'Sorted by date.'\n", 1, 0), ("n.py", None, 1, 0), ("e.py", "", 1, 0), ("t.txt", php, 1, 0), (None, py, 1, 0), ("x.php", php, 1, 0)]
    df = spark.createDataFrame(data, FILES)
    assert rows(doc_pairs.documented_functions(df, code=False), "node_id") == [("function::x.php::K.a",), ("function::x.php::d",), ("function::y.py::b",), ("function::y.py::b.inner",)]
    code = dict(rows(doc_pairs.documented_functions(df), "node_id", "code"))
    assert code["function::x.php::d"] == "function d() {}" and code["function::y.py::b.inner"].startswith("def inner():")
    assert doc_pairs.documented_functions(df.limit(0)).count() == 0


def test_large_trees_give_the_same_beliefs(spark):
    """Trees swept whole and trees swept level by level agree, also where they stand side by side."""
    rng = random.Random(3)
    names = ["a", "b", "generated", "vendor", "lib-1.2.0", "src"]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randrange(1, 7))) + f"/f{i}.py" for i in range(120)} | {"top.py"}
    heads = ["", "# @generated by x\n", "# Copied from lib 2.1, local changes: none\n"]
    df = spark.createDataFrame([(p, rng.choice(heads) + ORDINARY, 1, 0) for p in sorted(paths)], FILES)
    results = [{r["file"]: (r["label"], round(r["p_handwritten"], 9)) for r in authored.file_labels(df, most).collect()} for most in (100_000, 8, 0)]
    assert results[0] == results[1] == results[2] and len(results[0]) == len(paths)
