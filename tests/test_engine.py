import math
import os
import random

import numpy as np
import pytest

from nodeweft import session
from nodeweft.functions import text as T
from nodeweft.operators import chats, graph, resolve, retrieval, traverse, vectors, web
from nodeweft.operators.rows import latest_rows
from nodeweft.plans import ask, cypher, export, queries
from nodeweft.sources import facts
from nodeweft.sources.tree import manifest
from nodeweft.streaming.incremental import diff_counts, file_diff, merged_facts, watch
from pyspark.sql import functions as F

from tests.oracle import same


def scalar(spark, column):
    return spark.range(1).select(column).first()[0]


def closure(edges, seeds, hops):
    found, current = set(), set(seeds)
    for _ in range(hops):
        current = {b for a, b in edges if a in current} - found
        found |= current
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_kernels_agree_on_cyclic_graphs(spark, rows, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(22)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    seeds = spark.createDataFrame([("n0",), ("n1",)], "id string")
    for hops in (1, 4):
        want = sorted((x,) for x in closure(pairs, {"n0", "n1"}, hops))
        assert rows(traverse.frontier(seeds, edges, hops), "id") == want
        assert rows(traverse.walk(seeds, edges, hops), "id") == want


def test_traversal_of_nothing(spark):
    none = spark.createDataFrame([], "src string, dst string, kind string")
    nodes = spark.createDataFrame([], "id string, kind string, name string, file string")
    assert traverse.impact(nodes, none, "x", 99, "frontier").count() == 0
    assert traverse.impact(nodes, none, "x", -1, "walk").count() == 0


def test_latest_rows(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), (None, 2, None)], "k string, at int, v string")
    assert rows(latest_rows(df, ["k"], ["at"], ["v"])) == sorted([("a", "y"), ("b", "z"), (None, None)], key=repr)
    tie = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "k string, at int, v string")
    assert latest_rows(tie, ["k"], ["at"]).count() == 1
    assert latest_rows(df.limit(0), ["k"], ["at"]).count() == 0


def test_upserts_and_deletes(spark, rows):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, v string")
    new = spark.createDataFrame([("b", "2"), ("c", "2")], "id string, v string")
    assert rows(graph.upsert(old, new, ["id"])) == [("a", "1"), ("b", "2"), ("c", "2")]
    nodes = spark.createDataFrame([("a", "x.py"), ("b", "y.py")], "id string, file string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("a", "z", "CALLS"), ("b", "a", "CALLS")], "src string, dst string, kind string")
    assert rows(graph.upsert_edges(edges, edges, nodes), "src", "dst") == [("a", "b"), ("b", "a")]
    kept, left = graph.delete_files(nodes, edges, spark.createDataFrame([("y.py",)], "file string"))
    assert rows(kept, "id") == [("a",)] and rows(left, "src", "dst") == [("a", "z")]


def test_rules_last_write_wins(spark, rows):
    concepts = spark.createDataFrame([("c",)], "id string")
    nodes = spark.createDataFrame([("t",)], "id string")
    rules = spark.createDataFrame([("c", "t", "allow", 1), ("c", "t", "deny", 2), ("c", "gone", "deny", 3)], "concept_id string, target_id string, effect string, ord int")
    assert rows(graph.load_rules(concepts, nodes, rules)) == [("c", "t", "deny")]


def test_long_render_ids_are_cut(spark, rows):
    df = spark.createDataFrame([("s", 1, "v" * 400, None), ("s", 1, "v" * 401, "x")], "source_file string, lineno long, view_arg string, target_file string")
    assert [len(r[0]) for r in rows(graph.load_renders(df), "id")] == [300]


def test_stats_list_absent_kinds(spark, rows):
    nodes = spark.createDataFrame([("a", "Class")], "id string, kind string")
    assert dict(rows(graph.node_stats(nodes))) == {"Module": 0, "Class": 1, "Function": 0, "External": 0}


def test_tfidf_fixture(spark, rows):
    docs = spark.createDataFrame([("D1", "load graph nodes"), ("D2", "graph store"), ("D3", "render page"), ("D4", None)], "id string, text string")
    three = docs.where("text is not null")
    got = retrieval.tfidf_rank(three, "id", F.col("text"), "load the graph").collect()
    assert [(r[0], round(r[1], 6)) for r in got] == [("D1", 0.734608), ("D2", 0.146944)]
    assert retrieval.tfidf_rank(docs, "id", F.col("text"), "the of").count() == 0
    assert retrieval.tfidf_rank(docs.limit(0), "id", F.col("text"), "graph").count() == 0


def test_vector_topk(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [3.0, 3.0])], "id int, v array<float>")
    got = [(r[0], round(r[1], 6)) for r in retrieval.vector_topk(df, "id", "v", [2.0, 0.0], 3).collect()]
    assert got == [(1, 0.0), (6, round(1 - math.sqrt(0.5), 6)), (2, 1.0)]


def test_hybrid_and_embedding(spark):
    text = spark.createDataFrame([("a", 1), ("b", 2)], "label string, rank int")
    near = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3)], "label string, rank int")
    assert [r[0] for r in retrieval.hybrid(text, near, 3).orderBy("rank").collect()] == ["a", "b", "c"]
    vectors = [r[0] for r in spark.createDataFrame([("load graph",), ("",), (None,)], "t string").select(retrieval.embed(F.col("t"))).collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in vectors) and vectors[1] == vectors[2]


def test_text_functions(spark):
    get = lambda c: scalar(spark, c)
    assert get(T.tokens(F.lit("What does get_app_URL do in x2 of the Foo?"))) == ["get_app_url", "foo"]
    assert get(T.hop_count(F.lit("within 25 Hops"))) == 10 and get(T.hop_count(F.lit("0 levels"))) == 1 and get(T.hop_count(F.lit("soon"))) == 3
    assert get(T.normalized_url(F.lit(" https://h.example/icab/x?y=1#z "))) == "icab/x"
    assert get(T.url_or_path(F.lit("see N/A or /icab/conf-1.x now"))) == "/icab/conf-1.x"
    assert get(T.app_of(F.lit("app/Modules/Icab/G.php"))) == "Icab" and get(T.app_of(F.lit("lib/x.php"))) == "lib"
    assert get(T.class_file(F.lit("\\App\\M\\K"))) == "app/M/K.php"
    assert get(T.file_title(F.lit("a/b:c"))) == "a_b_c" and get(T.file_title(F.lit(" "))) == "untitled"
    assert get(T.slug(F.lit("__a b__"))) == "a_b" and get(T.slug(F.lit("?"))) == "repo"
    assert get(T.chat_title(F.lit(""))) == "(image)" and len(get(T.chat_title(F.lit("x" * 99)))) == 60
    assert get(T.qualified_target(F.lit("Home::index"), F.lit("App\\C\\"))) == "App\\C\\Home::index"
    assert get(T.mentions_name(F.lit("why does get app url fail"), F.lit("get_app_url"))) and not get(T.mentions_name(F.lit("go on"), F.lit("g")))
    for raw, want in {
        '{"type":"x","content":"c"}': ("answer", "c", ""),
        '{"type":"clarify","content":"  which? ","detail":" d\\n"}': ("clarify", "which?", "d"),
        '{"content":"  "}': ("answer", '{"content":"  "}', ""),
        '{"type":"answer"}': ("answer", '{"type":"answer"}', ""),
        '{"content":null}': ("answer", "None", ""),
        '{"content":5}': ("answer", "5", ""),
        '["content"]': ("answer", '["content"]', ""),
        "": ("answer", "", ""),
    }.items():
        assert tuple(get(T.stored_answer(F.lit(raw)))) == want
    assert get(T.stored_answer(F.lit("{no"))).content == "{no"


WEB = {
    "app/Modules/Icab/Guard.php": "<?php\ndefine('ICAB_ADMIN_CODE', 'ADM');\nclass Guard {\n  public function check($roleCd) {\n    if ($roleCd == ICAB_ADMIN_CODE) {\n      $redirectFlag = TRUE;\n    }\n  }\n}\n",
    "app/Modules/Icab/Controllers/Configuration.php": "<?php class Configuration { function index() { return view('list') . view('menu') . view('App\\Modules\\Icab\\Views\\list') . view($x); } }",
    "app/Modules/Icab/Views/list.php": "<?php",
    "a/menu.php": "<?php",
    "b/menu.php": "<?php",
    "app/Config/Routes.php": "<?php\n$routes->setDefaultNamespace('App\\C');\n$routes->get('home', 'Home::index');\n$routes->group('admin', ['namespace' => 'App\\Admin'], function ($r) {\n  $r->post('save/(:num)', 'Save::run/$1');\n  $r->get($dynamic, 'X::y');\n});\n$routes->get('abs', '\\Full\\K::m');\n",
}


@pytest.fixture(scope="module")
def web_facts(spark):
    files = spark.createDataFrame(list(WEB.items()), "file string, content string")
    return files, facts.file_facts(files).cache()


def test_roles_and_gates(web_facts, rows):
    concepts = web.role_catalog(web_facts[1])
    assert rows(concepts, "id", "kind", "code", "name", "app", "lineno") == [("concept::Icab::ADM", "Role", "ADM", "ICAB_ADMIN_CODE", "Icab", 2)]
    rules = web.branch_rules(web_facts[1], concepts)
    assert rows(rules, "target_id", "effect", "condition", "lineno") == [("function::app/Modules/Icab/Guard.php::Guard.check", "deny", "($roleCd == ICAB_ADMIN_CODE)", 5)]


def test_routes(spark, web_facts, rows):
    files, f = web_facts
    explicit = web.explicit_routes(f)
    assert rows(explicit, "pattern", "http_method", "target") == [("abs", "GET", "\\Full\\K::m"), ("admin/save/(:num)", "POST", "App\\Admin\\Save::run/$1"), ("home", "GET", "App\\C\\Home::index")]
    routes = graph.load_routes(explicit.unionByName(web.convention_routes(files)))
    urls = spark.createDataFrame([("https://h.example/icab/configuration?x=1",), ("/icab/configuration/edit",), ("/icab/configuration/edit/5",), ("/nope",), (None,)], "url string")
    got = {r["url"]: (r["resolved"], r["matched_pattern"], r["method"]) for r in web.resolved_urls(urls, routes, files).collect()}
    assert got["https://h.example/icab/configuration?x=1"] == (True, "icab/configuration", "index")
    assert got["/icab/configuration/edit"] == (True, "icab/configuration/(:any)", "edit")
    assert got["/icab/configuration/edit/5"] == (True, "icab/configuration/(:any)", "edit/5")
    assert got["/nope"] == (False, None, None)


def test_placeholders_are_replaced_in_turn(spark, rows):
    routes = spark.createDataFrame([("x/(:any)/(:num)", "T::$2-$1-$3", "GET"), ("x/config", "never", "GET"), ("y.z", "dot", "GET")], "pattern string, target string, http_method string")
    urls = spark.createDataFrame([("x/a/7",), ("X/b/8",), ("yqz",), ("y.z",)], "url string")
    assert rows(web.matched_routes(urls, routes), "url", "target") == [("X/b/8", "T::8-b-$3"), ("x/a/7", "T::7-a-$3"), ("y.z", "dot")]


def test_addresses_without_a_file(spark, rows):
    """Outer slashes of a pattern don't count; a target without class or without file keeps its pattern and its text."""
    routes = spark.createDataFrame([("/order/new/", "\\App\\Order::", "GET"), ("bare", "Closure", "GET"), ("gone/(:num)", "App\\Gone::at/$1", "GET"), ("odd", "App\\Order::a:b", "GET")], "pattern string, target string, http_method string")
    urls = spark.createDataFrame([("/order/new",), ("bare",), ("/gone/7/",), ("odd",), (None,)], "url string")
    files = spark.createDataFrame([("app\\Order.php",), ("app\\Order.php",), (None,)], "file string")
    got = rows(web.resolved_urls(urls, routes, files), "url", "resolved", "matched_pattern", "target", "class", "method", "file")
    assert got == sorted([("/order/new", True, "/order/new/", "\\App\\Order::", "Order", "index", "app\\Order.php"), ("bare", False, "bare", "Closure", None, None, None), ("/gone/7/", False, "gone/(:num)", "App\\Gone::at/7", None, None, None), ("odd", True, "odd", "App\\Order::a:b", "Order", "a:b", "app\\Order.php"), (None, False, None, None, None, None, None)], key=repr)
    assert web.resolved_urls(urls.limit(0), routes, files).count() == 0


def test_manifest_goes_by_raw_bytes(spark, rows):
    files = spark.createDataFrame([("a.py", "x", "raw"), ("b.py", "x", None), ("c.py", None, "raw")], "file string, content string, sha1 string")
    assert rows(manifest(files)) == [("a.py", "raw"), ("b.py", "11f6ad8ec52a2984abaafd7c3b516503785c2072")]


def test_evidence_lines(spark, rows):
    lines = ["$x = $this -> db ;", "select 1 from t", "$q->Table('t')", "$q -> table ('t')", "Model::all()", "class A extends UserModel {", "new UserModel", "use App\\Models\\User;", "find (1)", "$q->where(1)", "$_GET['a']", "$_FILES"]
    files = spark.createDataFrame([("a.php", "\r\n".join(lines)), ("b.php", "\n" + "\n".join(["  find(1)" + "x" * 200] * 30)), ("c.php", None), ("d.php", "")], "file string, content string")
    got = sorted(rows(ask.evidence_lines(files), "file", "lineno", "line"))
    assert [n for f, n, _ in got if f == "a.php"] == [1, 4, 5, 6, 8, 9, 10, 11]
    assert [n for f, n, _ in got if f == "b.php"] == list(range(2, 22)) and {len(t) for f, _, t in got if f == "b.php"} == {120} and len(got) == 28


def test_views(web_facts, rows):
    got = rows(web.view_renders(web_facts[1], web_facts[0]), "view_arg", "target_file", "resolved")
    assert ("list", "app/Modules/Icab/Views/list.php", True) in got and ("menu", None, False) in got
    assert ("App\\Modules\\Icab\\Views\\list", "app/Modules/Icab/Views/list.php", True) in got and len(got) == 3


def test_file_diff(spark, rows):
    old = spark.createDataFrame([("a.py", "h1"), ("b.py", "h2"), ("c.py", "h4")], "file string, sha1 string")
    new = spark.createDataFrame([("a.py", "h1"), ("b.py", "h3"), ("d.py", "h5")], "file string, sha1 string")
    diff = file_diff(old, new)
    assert rows(diff) == [("a.py", "unchanged"), ("b.py", "changed"), ("c.py", "removed"), ("d.py", "changed")]
    assert dict(rows(diff_counts(diff))) == {"unchanged": 1, "changed": 2, "removed": 1}


def test_incremental_equals_fresh(spark, rows):
    before = spark.createDataFrame([("a.py", "from b import f\ndef g(): f()"), ("b.py", "def f(): pass"), ("c.py", "x = 1")], "file string, content string")
    after = spark.createDataFrame([("a.py", "from b import f\ndef g(): f()"), ("b.py", "def h(): pass"), ("d.py", "def k(): k2()\ndef k2(): pass")], "file string, content string")
    old = facts.file_facts(before).cache()
    merged = merged_facts(old, manifest(before), after, facts.file_facts).cache()
    fresh = facts.file_facts(after).cache()
    assert rows(merged) == rows(fresh)
    assert rows(resolve.build_graph(after, merged)[1]) == rows(resolve.build_graph(after, fresh)[1])


def test_stream_of_snapshots(spark, tmp_path, rows):
    df = spark.createDataFrame([("a.py", "x", 1), ("a.py", "y", 2), ("b.py", "z", 1)], "file string, content string, indexed_at int")
    df.write.parquet(str(tmp_path / "in"))
    seen = {}
    watch(spark, str(tmp_path / "in"), "file string, content string, indexed_at int", lambda b, n: seen.update({n: rows(b, "file", "content")}), str(tmp_path / "cp")).awaitTermination(60)
    assert seen == {0: [("a.py", "y"), ("b.py", "z")]}


def test_chats(spark, rows):
    c = spark.createDataFrame([], "id string, repo_db_path string, title string, created_at double, updated_at double")
    m = spark.createDataFrame([], "id long, chat_id string, seq long, question string, answer string, type string, detail string, image_data_url string, context_question string, created_at double")
    c = chats.create_chat(c, "/db", now=1.0, chat_id="x")
    for k in range(3):
        c, m = chats.add_message(c, m, "x", f"question {k}", "answer", now=2.0 + k)
    assert rows(chats.chat_messages(m, "x"), "seq", "context_question") == [(k, f"question {k}") for k in range(3)]
    assert rows(c, "title", "updated_at") == [("question 0", 4.0)]
    m = chats.delete_message(m, "x", 1)
    assert rows(chats.next_seq(m)) == [("x", 3)]
    with pytest.raises(ValueError):
        chats.add_message(c, m, "unknown", "q", "a", now=1.0)
    c, m = chats.delete_chat(c, m, "x")
    assert c.count() == m.count() == 0


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([("a", "Function", "f", "x.py", "", 3), ("b", "Function", "g", "x.py", "", 7), ("c", "Function", "h", "y.py", "", 1), ("k", "Class", "K", "y.py", "</script>", 2)], "id string, kind string, name string, file string, docstring string, lineno long")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS"), ("c", "a", "CALLS"), ("k", "c", "CONTAINS")], "src string, dst string, kind string")
    return cypher.Graph(nodes, edges)


def test_cypher(small, rows):
    run = lambda q, **p: rows(small.run(q, **p))
    assert run("MATCH (a:Function)-[:CALLS]->(b {name: $n}) RETURN a.name AS n", n="g") == [("f",)]
    assert run("MATCH (b)<-[:CALLS]-(a) WHERE b.file = 'y.py' AND NOT a.name = 'x' RETURN a.name, b.name") == [("g", "h")]
    assert run("MATCH (a:Function {name: 'f'})-[:CALLS*1..2]->(b) RETURN DISTINCT b.name AS n") == [("g",), ("h",)]
    assert run("MATCH (a:Function)-[:CALLS*]->(b) WHERE b.name = 'f' RETURN a.name") == [("f",), ("g",), ("h",)]
    assert run("MATCH (k:Class)-[r:CONTAINS]->(a), (a)-[:CALLS]->(b) RETURN k.name, r.kind, b.name") == [("K", "CONTAINS", "f")]
    assert run("MATCH (n:Function) RETURN n.file AS file, count(n) AS n ORDER BY n DESC LIMIT 1") == [("x.py", 2)]
    assert run("MATCH (n) RETURN count(*) AS n") == [(4,)]
    assert run("MATCH (n:Function) WHERE n.name STARTS WITH 'f' OR n.name =~ '[h-k]' RETURN n.name") == [("f",), ("h",)]
    assert len(run("CALL show_tables()")) == 8
    assert rows(small.delete("MATCH (n {file: 'y.py'}) DETACH DELETE n").edges) == [("a", "b", "CALLS")]
    assert rows(small.sql("SELECT count(*) FROM calls WHERE src = :s", s="a")) == [(1,)]


def test_cypher_starts_from_the_bound_end(small, monkeypatch):
    """A bounded length is walked from the end that a property or a condition binds."""
    starts = []
    whole = cypher._pairs
    monkeypatch.setattr(cypher, "_pairs", lambda ends, edges, hops: starts.append(sorted(r[0] for r in ends.collect())) or whole(ends, edges, hops))
    for text in ("MATCH (a:Function)-[:CALLS*1..2]->(b {name: 'f'})", "MATCH (a:Function)-[:CALLS*1..2]->(b) WHERE b.name = 'f'", "MATCH (a:Function)-[:CALLS*1..2]->(b) WHERE a.file <> b.name AND b.name = 'f' AND a.name <> 'x'"):
        assert sorted(r[0] for r in small.run(text + " RETURN a.name AS n").collect()) == ["g", "h"]
    assert starts[:2] == [["a"], ["a"]]
    assert sorted(tuple(r) for r in small.run("MATCH (a:Function)-[:CALLS]->(b) WHERE a.name = 'f' AND b.name = 'g' OR a.name = 'h' RETURN a.name, b.name").collect()) == [("f", "g"), ("h", "f")]


def test_cypher_writes(small, rows):
    g = small.write("CREATE (:Function {id: 'z', name: 'zed', file: 'z.py'})").write("MATCH (a {name: 'zed'}), (a)-[:CALLS]->(b) MERGE (a)-[:CALLS]->(b)")
    assert rows(g.nodes.where("id = 'z'"), "name", "file", "docstring") == [("zed", "z.py", None)]
    g = small.write("MATCH (a:Class)-[:CONTAINS]->(b) MERGE (b)-[:CALLS]->(b)")
    assert ("c", "c", "CALLS") in rows(g.edges)
    assert rows(small.write("MERGE (n:Function {id: 'a'}) SET n.name = 'ff', n.docstring = 'd'").nodes.where("id = 'a'"), "name", "docstring") == [("ff", "d")]
    assert rows(small.write("MERGE (n:Function {id: 'new', name: 'n'})").nodes.where("id = 'new'"), "kind", "name") == [("Function", "n")]
    assert rows(small.write("MATCH (n) WHERE n.file = 'y.py' SET n.file = 'w.py'").nodes.where("file = 'w.py'"), "id") == [("c",), ("k",)]
    assert small.write("MATCH (n {file: 'y.py'}) DETACH DELETE n").nodes.count() == 2
    for bad in ("CREATE (:Function {id: 'a'})", "CREATE (:Nope {id: 'q'})", "MERGE (n:Function {name: 'a'})", "MERGE (n:Function {id: 'a'}) SET n.kind = 'Class'", "MATCH (a)-[r:CALLS]->(b) DELETE r", "MATCH (a) RETURN a.id", "MERGE (n:Function {id: 'a', size: 3})"):
        with pytest.raises(cypher.CypherError):
            small.write(bad)


def test_releasing_staged_tables(spark, tmp_path):
    made = session.stage(spark.range(3), "gone")
    folder = session.shared_folder(spark)
    assert made.count() == 3 and any(f.startswith("gone-") for f in os.listdir(folder))
    session.release()
    assert not any(f.startswith("gone-") for f in os.listdir(folder))
    session.write_text(str(tmp_path / "t"), "one")
    session.write_text(str(tmp_path / "t"), "zwölf")
    assert session.read_text(str(tmp_path / "t")) == "zwölf" and session.read_text(str(tmp_path / "u")) is None


def test_cypher_over_roles(small, rows):
    concepts, rules = small.nodes.sparkSession.createDataFrame([("c1", "Role", "ADM")], "id string, kind string, code string"), small.nodes.sparkSession.createDataFrame([("c1", "a", "deny", "x", 3)], "concept_id string, target_id string, effect string, condition string, lineno long")
    g = cypher.Graph(small.nodes, small.edges, concepts, rules)
    assert rows(g.run("MATCH (c:Concept)-[r:RULE]->(t:Function) WHERE c.code = 'ADM' RETURN t.name, r.effect, r.lineno")) == [("f", "deny", 3)]
    assert len(g.run("CALL show_tables()").collect()) == 10 and g.run("CALL table_info('RULE')").count() == 5
    with pytest.raises(cypher.CypherError):
        small.run("MATCH (c:Concept) RETURN c.code")


@pytest.mark.parametrize("text", ["MATCH (a RETURN a", "MATCH (a)--(b) RETURN a.id", "CREATE (n)", "MATCH (a) RETURN a.id; DROP", "MATCH (a)-[:CALLS*0..3]->(b) RETURN a.id", "MATCH (a)-[:NOPE]->(b) RETURN a.id", "MATCH (a {id: $x}) RETURN a.id"])
def test_cypher_refuses(small, text):
    with pytest.raises(cypher.CypherError):
        small.run(text)


def test_exports(small, tmp_path, rows):
    page = export.html_page(small.nodes, small.edges, 3)
    assert page.count("</script>") == 1 and '"f"' in page
    export.write_vault(small.nodes, small.edges, str(tmp_path))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a (Function).md", "b (Function).md", "c (Function).md", "k (Class).md"]
    assert (tmp_path / "k (Class).md").read_text() == '---\nkind: Class\nfile: "y.py"\ntags: [nodeweft, Class]\n---\n\n# K\n\n*Class* in `y.py`\n\n</script>\n\n## Contains\n- [[c (Function)]]\n'
    assert "## Calls\n- [[a (Function)]]\n\n## Called By\n- [[b (Function)]]\n" in (tmp_path / "c (Function).md").read_text()
    kept, inner = graph.exported(small.nodes, small.edges, 2)
    assert rows(kept, "id") == [("a",), ("k",)] and inner.count() == 0
    titles = resolve.unique_titles(small.nodes.withColumn("t", F.lit("same")), "t", "id", "title")
    assert {t for (t,) in rows(titles, "title")} == {"same", "same 2", "same 3", "same 4"}
    many = small.nodes.sparkSession.range(1000).select(F.lit("same").alias("t"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"))
    assert {t for (t,) in rows(resolve.unique_titles(many, "t", "id", "title", rows_a_part=64), "title")} == {"same", *(f"same {n}" for n in range(2, 1001))}
    assert graph.exported(small.nodes, small.edges.unionByName(small.edges.limit(1).replace("a", "gone")), None)[1].count() == 4


def test_ask_about_an_address(spark):
    pages, home = "app/Pages/List.php", "<?php namespace App\\Pages;\nclass Listing { function go() { $r = $this->db->table('t')->get(); return view('list'); } }"
    sources = {pages: home, "app/Pages/list.php": "<ul>"}
    files = spark.createDataFrame(list(sources.items()), "file string, content string")
    table = facts.file_facts(files).cache()
    nodes, edges = resolve.build_graph(files, table)
    routes = spark.createDataFrame([("list", "App\\Pages\\List::go", "GET"), ("gone", "App\\Gone::go", "GET")], "pattern string, target string, http_method string")
    concepts, rules = spark.createDataFrame([], "id string, kind string, code string, name string, app string, source_file string, lineno long"), spark.createDataFrame([], "concept_id string, target_id string, effect string, condition string, lineno long")
    store = ask.Store(nodes, edges, files, concepts, rules, routes, web.view_renders(table, files).cache())
    text = "\n".join(ask.fact_blocks(store, "Which rules gate /list, where does its data come from and what view does it render?"))
    for part in ("Address /list: List::go (app/Pages/List.php), by route list", "Source of view app/Pages/list.php:\n```php\n<ul>\n```", f"No rule gates anything in {pages}.", "line 2: list renders app/Pages/list.php", "line 2: class Listing"):
        assert part in text
    assert ask.fact_blocks(store, "Who reads /gone now")[0] == "Note: /gone matches route gone, but its target App\\Gone::go isn't in the graph."
    assert ask.fact_blocks(store, "Who reads /nothing now")[0] == "Note: /nothing matches no indexed route."
    assert ask.fact_blocks(store, "Which rules are there, and which view?") == ["Note: the question is about access rules, but names no file or page that is known.", "Note: the question is about views, but names no file or page that is known."]


def test_vector_index(spark, tmp_path, rows):
    """Few lists hold nearly all of the nearest; the exact search holds all and still passes lists by."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = (np.repeat(centres, 60, axis=0) + 0.5 * rng.standard_normal((2400, 32))).astype(np.float32)
    data = [(f"n{i:04d}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 32), ("short", [1.0]), ("none", None), ("nan", [float("nan")] * 32)]
    df = spark.createDataFrame(data, "id string, v array<float>")
    vectors.build_index(df, "id", "v", 32, str(tmp_path / "a"), lists=40)
    hit = kept = 0
    for i in range(0, 2400, 480):
        q = (x[i] + 0.3 * rng.standard_normal(32)).tolist()
        want = [r["id"] for r in retrieval.vector_topk(df, "id", "v", q).collect()]
        near = {r["id"] for r in vectors.search(spark, str(tmp_path / "a"), q, probes=4).collect()}
        hit, kept = hit + len(near & set(want)), kept + len(want)
        assert [r["id"] for r in vectors.search(spark, str(tmp_path / "a"), q, probes=2, exact=True).collect()] == want
    assert hit >= 0.95 * kept
    vectors.build_index(df.limit(0), "id", "v", 32, str(tmp_path / "b"))
    assert vectors.search(spark, str(tmp_path / "b"), [1.0] * 32).count() == 0


def test_ask_with_vectors(small):
    """A node that shares no word with the question is found by its stored vector."""
    nodes = small.nodes.withColumn("embedding", F.when(F.col("id") == "c", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    store = ask.Store(nodes, small.edges)
    assert ask.context(store, "unheard", query_vector=[1.0, 0.0])[0] == "Function `h` in y.py: " and ask.context(store, "unheard") == []
    assert "Function `h`" in ask.answer(store, "unheard", embed=lambda text: [1.0, 0.0])
    assert ask.answer(store, "unheard", embed=None).strip() == ""


def test_ask(small):
    store = ask.Store(small.nodes, small.edges)
    assert ask.resolve_name(small.nodes, "f") == "f"
    blocks = ask.fact_blocks(store, "What breaks within 2 hops if I change g, and what does K inherit?")
    assert blocks[0].startswith("Direct callers of g:\n- f (x.py:3)") and "Functions that reach g within 2 calls:" in blocks[0] and "- f (x.py)" in blocks[0]
    assert blocks[1:] == ["K extends nothing that is indexed.", "No class was found that extends K."]
    assert ask.fact_blocks(store, "What breaks within 2 hops if I change g?", most=1)[0].endswith("- ... 1 more")
    assert ask.answer(store, "nothing", lambda q, c: q.upper()) == "NOTHING"
    assert ask.method_source("<?php class A { function m() { return '}'; } } function m() {}", "m", "A") == "function m() { return '}'; }"
    assert ask.method_source("<?php function m() {", "m") is None
    assert ask.method_source("<?php function m() { " + "x();" * 3000 + " }", "m").endswith(ask.CUT)


def test_ancestors_have_no_last_level(spark, monkeypatch):
    monkeypatch.setattr(resolve, "FOLDED_LEVELS", 9)
    chain = [(f"class::f::{i}", f"class::f::{i + 1}", 0) for i in range(23)]
    above = resolve.ancestors(spark.createDataFrame([*chain, ("class::f::23", "class::f::20", 0)], "src string, dst string, ord int"))
    got = {(r["ancestor"], r["depth"]) for r in above.where("id = 'class::f::0'").collect()}
    assert got == {(f"class::f::{i}", i) for i in range(1, 24)}
    methods = spark.createDataFrame([("function::f::23.run",)], "id string")
    assert ("class::f::0", "run") in {(r["class"], r["method"]) for r in resolve.inherited_methods(above, methods).collect()}


def test_ranked_resolution_of_large_groups(spark, tmp_path, monkeypatch):
    """Odd and large groups give the rows of the SQL, by at most two candidates a row: not by the pairs of a group."""
    odd = [(1, "a", "x", "t"), (1, "a", "x", "t"), (2, "a", "x", "t"), (2, "b", "y", "t"), (3, "b", "z", "t"), (4, "c", "x", "t"), (5, "d", None, "t"), (6, "d", "x", "t"), (7, None, "x", "t"), (8, None, "x", "t"), (None, "a", "x", "t"), (9, "e", "x", None), (10, "e", "y", None), (11, "f", "x", "t"), (11, "f", "x", "t"), (-3, "g", "x", "u"), (0, "g", "x", "t"), (12, "g", "y", "u")]
    data = [*odd, *((k, "one", "x", "t") for k in range(100, 400))]
    spark.createDataFrame(data, "p_partkey long, p_name string, p_brand string, p_type string").toPandas().astype({"p_partkey": "Int64"}).to_parquet(tmp_path / "part.parquet")
    counts, plain = [], resolve.first_ranked

    def counted(candidates, key, rank):
        counts.append(candidates.count())
        return plain(candidates, key, rank)

    monkeypatch.setattr(resolve, "first_ranked", counted)
    same(spark, queries.queries()["ranked_resolution"], queries.oracle_sql()["ranked_resolution"], str(tmp_path))
    assert len(counts) == 1 and 600 <= counts[0] <= 2 * len(data)
