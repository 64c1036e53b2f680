"""DuckDB SQL that gives the same rows as the engine's queries."""

from __future__ import annotations

from . import fixtures

_NODES = "now AS (SELECT id, arg_max({'kind': kind, 'name': name, 'file': file}, indexed_at) AS r FROM nodes GROUP BY id)"
_FILES = "f AS (SELECT file, arg_max(content, indexed_at) AS content FROM files GROUP BY file)"
_PN = """pn AS (
  SELECT 'function::part::' || p_partkey AS id, 'Function' AS kind, p_name AS name, p_brand AS file FROM part
  UNION ALL SELECT 'class::part::' || p_partkey, 'Class', p_partkey::VARCHAR, p_brand FROM part)"""
_PE = """pe AS (
  SELECT DISTINCT 'function::part::' || a.l_partkey AS src, 'function::part::' || b.l_partkey AS dst, 'CALLS' AS kind
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity > 45 AND a.l_partkey <> b.l_partkey
  UNION ALL SELECT 'class::part::' || p_partkey, 'class::part::' || (p_partkey // 4), 'INHERITS' FROM part WHERE p_partkey >= 4)"""
_RULES = """r AS (
  SELECT 'concept::app::' || c_mktsegment AS concept_id, 'module::' || c_nationkey AS target_id,
    arg_max(CASE o_orderstatus WHEN 'F' THEN 'allow' WHEN 'O' THEN 'deny' ELSE 'checked' END, {'a': o_orderdate, 'b': o_orderkey}) AS effect,
    any_value(c_mktsegment) AS role, any_value(c_nationkey) AS nk
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), rn AS (SELECT r.*, n_name FROM r JOIN nation ON nk = n_nationkey)"""
_STOP = "('the','a','an','is','are','was','were','of','to','in','on','and','or','for','with','this','that','what','does','how','do','did','it','its','be','been','as','at','by','from')"
_TOK = f"""tok AS (
  SELECT doc_id, t FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]*'))) AS t FROM documents) WHERE length(t) > 2 AND t NOT IN {_STOP}),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t)"""
_ASKED = r"""asked AS (
  SELECT DISTINCT nullif(regexp_replace(regexp_extract(question, '(https?://\S+)|(?:^|[^\w.])(/\w[\w./-]*)', 0), '^[^\w/]', ''), '') AS url
  FROM messages WHERE question IS NOT NULL), a AS (SELECT url, trim(url, '/') AS path FROM asked WHERE url IS NOT NULL)"""


def _reach(kind: str, seed: str, hops: int, back: bool, node_kind: str) -> str:
    s, d = ("dst", "src") if back else ("src", "dst")
    return f"""WITH RECURSIVE {_PN}, {_PE}, reach AS (
  SELECT e.{d} AS id, 1 AS depth FROM pe e JOIN pn ON pn.id = e.{s} WHERE e.kind = '{kind}' AND pn.kind = '{node_kind}' AND pn.name = '{seed}'
  UNION SELECT e.{d}, depth + 1 FROM reach JOIN pe e ON e.{s} = reach.id WHERE e.kind = '{kind}' AND depth < {hops})
SELECT DISTINCT name, file FROM pn WHERE kind = '{node_kind}' AND id IN (SELECT id FROM reach)"""


def _tfidf(question: list[str], k: int) -> str:
    q = ", ".join(f"('{w}')" for w in question)
    return f"""{_TOK}, n AS (SELECT count(*) AS n FROM documents),
q AS (SELECT t, count(*) * ln((n + 1) / (coalesce(any_value(df), 0) + 1)) AS wq FROM (VALUES {q}) v(t) LEFT JOIN df USING (t), n GROUP BY t, n),
d AS (SELECT doc_id, t, tf * ln((n + 1) / (df + 1)) AS wd FROM tf JOIN df USING (t), n),
s AS (SELECT doc_id, sqrt(sum(wd * wd)) AS dn, sum(wd * wq) AS dot FROM d LEFT JOIN q USING (t) GROUP BY doc_id),
tfidf AS (SELECT doc_id, round(dot / ((SELECT sqrt(sum(wq * wq)) FROM q) * dn), 12) AS score FROM s WHERE dot > 0 ORDER BY score DESC, doc_id LIMIT {k})"""


_ROUTES = r"""routes(pattern, method, target, rx, groups) AS (VALUES
  ('(:any)/config', 'GET', 'App\Pages\Config::show/$1', '^(.*)/config$', 1), ('(:any)/edit', 'GET', 'App\Pages\Edit::$1', '^(.*)/edit$', 1),
  ('(:any)/list', 'GET', 'App\Pages\Listing::', '^(.*)/list$', 1), ('(:any)/show/(:num)', 'GET', 'App\Pages\Show::$1/$2', '^(.*)/show/(\d+)$', 2),
  ('ledger/(:any)', 'GET', '\App\Ledger::$1', '^ledger/(.*)$', 1), ('order/new', 'POST', 'App\Order::create', '^order/new$', 0),
  ('unit/show/(:num)', 'GET', 'App\Unit::page$1', '^unit/show/(\d+)$', 1)),
m AS (SELECT url, path, arg_min({'p': pattern, 't': target, 'rx': rx, 'g': groups}, pattern) AS b FROM a JOIN routes ON regexp_matches(path, '(?i)' || rx) GROUP BY ALL),
hit AS (SELECT url, b.p AS pattern, CASE WHEN b.g >= 2 THEN replace(replace(b.t, '$1', regexp_extract(path, '(?i)' || b.rx, 1)), '$2', regexp_extract(path, '(?i)' || b.rx, 2))
  WHEN b.g = 1 THEN replace(b.t, '$1', regexp_extract(path, '(?i)' || b.rx, 1)) ELSE b.t END AS target FROM m)"""

_VEC = """v AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 1), near AS (
  SELECT vec_id, 1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))) AS distance FROM embeddings, v)"""

_SQL: dict[str, str] = {
    **{f"impact_{h}hop": _reach("CALLS", "small ring", h, True, "Function") for h in (3, 5, 10)},
    "impact_walk_5": _reach("CALLS", "small ring", 5, True, "Function"),
    "ancestors_5": _reach("INHERITS", "199", 5, False, "Class"),
    "subclasses_5": _reach("INHERITS", "3", 5, True, "Class"),
    "cypher_reach": _reach("CALLS", "small ring", 3, True, "Function"),
    "callers": f"WITH {_PN}, {_PE} SELECT a.name AS caller, a.file, 0::BIGINT AS line FROM pe JOIN pn a ON a.id = src JOIN pn b ON b.id = dst WHERE pe.kind = 'CALLS' AND b.name = 'small ring' AND b.kind = 'Function'",
    "cypher_reach_map": _reach("CALLS", "small ring", 3, True, "Function"),
    "cypher_reach_both": f"SELECT * FROM ({_reach('CALLS', 'small ring', 3, True, 'Function')}) WHERE file = 'Brand#11'",
    "cypher_rules": f"WITH {_RULES} SELECT n_name AS target, effect FROM rn WHERE role = 'BUILDING'",
    "cypher_write": f"""WITH {_PN} SELECT id, kind, name, CASE WHEN id = 'function::part::1' THEN 'moved' ELSE file END AS file, CASE WHEN kind = 'Function' AND file = 'Brand#11' THEN 7 ELSE 0 END::BIGINT AS lineno,
  CASE WHEN kind = 'Function' AND file = 'Brand#11' THEN 'seen' ELSE '' END AS docstring FROM pn WHERE NOT (kind = 'Class' AND file = 'Brand#12')
UNION ALL SELECT 'class::new', 'Class', 'New', 'x', NULL, NULL""",
    "cypher_callers": f"WITH {_PN}, {_PE} SELECT DISTINCT a.name AS caller, a.file FROM pe JOIN pn a ON a.id = src JOIN pn b ON b.id = dst WHERE pe.kind = 'CALLS' AND b.name = 'small ring' AND b.kind = 'Function'",
    "cypher_counts": f"WITH {_PN} SELECT name, count(*) AS n FROM pn WHERE kind = 'Function' AND file = 'Brand#11' GROUP BY name ORDER BY n DESC, name LIMIT 20",
    "neighbors": f"WITH {_PE} SELECT dst AS id, kind, 'out' AS direction FROM pe WHERE src = 'function::part::7' UNION ALL SELECT src, kind, 'in' FROM pe WHERE dst = 'function::part::7'",
    "node_stats": f"WITH {_NODES} SELECT k.kind, count(id) AS n FROM (VALUES ('Module'), ('Class'), ('Function'), ('External')) k(kind) LEFT JOIN now ON r.kind = k.kind GROUP BY 1",
    "edge_stats": f"WITH {_PE} SELECT k.kind, count(src) AS n FROM (VALUES ('CONTAINS'), ('IMPORTS'), ('CALLS'), ('INHERITS')) k(kind) LEFT JOIN pe ON pe.kind = k.kind GROUP BY 1",
    "function_names": f"WITH {_NODES} SELECT DISTINCT r.name AS name FROM now WHERE r.kind = 'Function'",
    "module_files": f"WITH {_NODES} SELECT DISTINCT r.file AS file FROM now WHERE r.kind = 'Module'",
    "label_scan": f"WITH {_NODES} SELECT id, r.name AS name, r.file AS file FROM now WHERE r.kind = 'Class'",
    "node_upsert": """WITH t AS (SELECT *, dayofyear(indexed_at) % 2 AS fresh FROM nodes), u AS (
  SELECT id, arg_max({'kind': kind, 'name': name, 'file': file, 'lineno': lineno}, {'a': fresh, 'b': indexed_at}) AS r FROM t GROUP BY id)
SELECT id, r.kind AS kind, r.name AS name, r.file AS file, r.lineno AS lineno FROM u""",
    "edge_upsert_dedup": f"WITH {_PN}, {_PE}, k AS (SELECT id FROM pn WHERE file <> 'Brand#11') SELECT DISTINCT src, dst, kind FROM pe WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "delete_by_file": f"WITH {_PN}, {_PE}, g AS (SELECT id FROM pn WHERE file IN ('Brand#11', 'Brand#12')) SELECT src, dst, kind FROM pe WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)",
    "rule_lww": f"WITH {_RULES} SELECT concept_id, target_id, effect FROM rn",
    "role_rules": f"WITH {_RULES} SELECT n_name AS target, effect FROM rn WHERE role = 'BUILDING'",
    "file_rules": f"WITH {_RULES} SELECT role AS code, effect FROM rn WHERE n_name = 'NATION_3'",
    "role_matrix": f"""WITH {_RULES} SELECT n_name AS file, max(effect) FILTER (role = 'AUTOMOBILE') AS "AUTOMOBILE", max(effect) FILTER (role = 'BUILDING') AS "BUILDING", max(effect) FILTER (role = 'MACHINERY') AS "MACHINERY" FROM rn GROUP BY n_name""",
    "role_pages_list": f"WITH {_RULES} SELECT role, string_agg(DISTINCT n_name || ' (' || effect || ')', '; ' ORDER BY n_name || ' (' || effect || ')') AS pages FROM rn GROUP BY role",
    "file_hashes": f"WITH {_FILES} SELECT file, sha1(content) AS sha1 FROM f WHERE content IS NOT NULL",
    "tfidf_topk": f"WITH {_tfidf(['which', 'function', 'renders', 'ledger', 'page'], 15)} SELECT doc_id, round(score, 6) AS score FROM tfidf",
    "term_stats": f"WITH {_TOK} SELECT t, df FROM df",
    "vector_topk": f"WITH {_VEC} SELECT vec_id, round(distance, 5) AS distance FROM near ORDER BY near.distance, vec_id LIMIT 15",
    "hybrid_topk": f"""WITH {_VEC}, {_tfidf(['schedule', 'voucher', 'total'], 8)},
b AS (SELECT 'd' || doc_id AS label, 0 AS s, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM tfidf UNION ALL
  SELECT 'd' || vec_id, 1, row_number() OVER (ORDER BY distance, vec_id) FROM (SELECT * FROM near ORDER BY distance, vec_id LIMIT 10)),
g AS (SELECT label, min({{'s': s, 'k': k}}) AS f FROM b GROUP BY label)
SELECT label, rank::INTEGER AS rank FROM (SELECT label, row_number() OVER (ORDER BY f, label) AS rank FROM g) WHERE rank <= 15""",
    "url_extract": f"WITH {_ASKED} SELECT url FROM a",
    "url_normalize": f"WITH {_ASKED} SELECT url, path FROM a",
    "route_match": f"WITH {_ASKED}, {_ROUTES} SELECT url, pattern, target FROM hit",
    "route_resolve": rf"""WITH {_ASKED}, {_ROUTES}, p AS (SELECT url, pattern, target, CASE WHEN contains(target, '::') THEN regexp_extract(target, '^(.*)::', 1) END AS c, regexp_extract(target, '([^:]*)$', 1) AS m FROM hit),
w AS (SELECT *, CASE ltrim(c, '\') WHEN 'App\Pages\Edit' THEN 'app/Pages/Edit.php' WHEN 'App\Ledger' THEN 'app\Ledger.php' END AS file FROM p)
SELECT a.url, coalesce(file IS NOT NULL, false) AS resolved, pattern AS matched_pattern, target, CASE WHEN file IS NOT NULL THEN string_split(c, '\')[-1] END AS class_name,
  CASE WHEN file IS NOT NULL THEN CASE WHEN m = '' THEN 'index' ELSE m END END AS method, file FROM a LEFT JOIN w USING (url)""",
    "route_patterns": r"""SELECT '/' || array_to_string(list_transform(range(1, 12), lambda i: 'k' || p_partkey || 'x' || i), '/') || '/' AS url, '/(:any)/(:any)/(:any)/(:any)/(:any)/(:any)/(:any)/(:any)/(:any)/(:any)/(:any)/' AS pattern,
  'App\Deep::go/k' || p_partkey || 'x11/k' || p_partkey || 'x2/k' || p_partkey || 'x9' AS target FROM part UNION ALL SELECT '/order/new', '/order/new/', 'App\Order::create'""",
    "convention_routes": r"""WITH c AS (SELECT DISTINCT regexp_replace(file, '^[^/]+/', '') AS p FROM files),
x AS (SELECT regexp_extract(p, '(?i)^app/Modules/([^/]+)/Controllers/([^/]+)\.php$', 1) AS m, regexp_extract(p, '(?i)^app/Modules/([^/]+)/Controllers/([^/]+)\.php$', 2) AS k FROM c WHERE regexp_matches(p, '(?i)^app/Modules/([^/]+)/Controllers/([^/]+)\.php$')),
y AS (SELECT lower(m) || '/' || lower(k[1]) || k[2:] AS a, 'App\Modules\' || m || '\Controllers\' || k AS t FROM x WHERE lower(m) <> 'ilabo')
SELECT DISTINCT pattern, target FROM (SELECT a AS pattern, t || '::index' AS target FROM y UNION ALL SELECT a || '/(:any)', t || '::$1' FROM y)""",
    "import_resolution": rf"""WITH {_FILES}, l AS (SELECT file, unnest(string_split(content, chr(10))) AS line FROM f WHERE file LIKE '%.py'),
a AS (SELECT file, regexp_extract(line, '^from ([\w.]+) import \w+', 1) AS d FROM l WHERE regexp_matches(line, '^from [\w.]+ import \w+')),
i AS (SELECT regexp_replace(replace(regexp_replace(file, '\.py$', ''), '/', '.'), '\.__init__$', '') AS d, max(file) AS target FROM f WHERE file LIKE '%.py' GROUP BY 1)
SELECT DISTINCT file, coalesce('module::' || target, 'external::' || d) AS dst FROM a LEFT JOIN i USING (d)""",
    "module_names": r"SELECT DISTINCT file, regexp_replace(replace(regexp_replace(file, '\.py$', ''), '/', '.'), '\.__init__$', '') AS dotted FROM files WHERE file LIKE '%.py'",
    "file_languages": "SELECT CASE WHEN file LIKE '%.py' THEN 'python' WHEN file LIKE '%.php' THEN 'php' END AS lang, count(DISTINCT file) AS n FROM files GROUP BY 1",
    "unambiguous_resolve": "SELECT p_name || '|' || p_brand AS name, min(p_partkey) AS p_partkey FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1",
    "ranked_resolution": """WITH c AS (SELECT a.p_partkey AS k, b.p_partkey AS hit, 1 AS rank FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand = b.p_brand
  UNION ALL SELECT a.p_partkey, b.p_partkey, 2 FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_type = b.p_type)
SELECT k, x.hit AS hit, x.rank AS rank FROM (SELECT k, arg_min({'hit': hit, 'rank': rank}, {'r': rank, 'h': hit}) AS x FROM c WHERE k <> hit GROUP BY k)""",
    "method_lookup": """WITH RECURSIVE up AS (SELECT p_partkey AS k, p_partkey // 4 AS a, 1 AS d FROM part WHERE p_partkey >= 4 UNION ALL SELECT k, a // 4, d + 1 FROM up WHERE a >= 4),
h AS (SELECT k, arg_min(a, d) AS a FROM up JOIN part ON p_partkey = a AND p_brand < 'Brand#2' GROUP BY k)
SELECT 'class::f::' || k AS class_name, 'function::f::' || a || '.run' AS fid FROM h""",
    "mentioned_names": rf"""WITH {_NODES}, q AS (SELECT lower('What does LedgerStore do, and why is the order total wrong in PriceJob?') AS q), n AS (SELECT DISTINCT r.name AS name FROM now WHERE r.kind = 'Class')
SELECT name FROM n, q WHERE list_contains(regexp_extract_all(q, '[a-z_][a-z0-9_]*'), lower(name)) OR list_contains(regexp_extract_all(q, '[a-z0-9]+'), lower(name))
  OR (contains(name, '_') AND contains(q, replace(lower(name), '_', ' '))) OR (length(name) > 3 AND contains(q, lower(name))) ORDER BY length(name) DESC, name LIMIT 5""",
    "mentioned_file": r"""WITH q AS (SELECT lower('Which rules gate the ledger store page?') AS q), b AS (SELECT DISTINCT file, regexp_extract(file, '[^/]+$') AS base FROM files),
s AS (SELECT file, base, regexp_replace(base, '\.(php|py)$', '') AS stem FROM b), w AS (SELECT *, lower(trim(regexp_replace(regexp_replace(stem, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'))) AS words FROM s),
l AS (SELECT file, CASE WHEN contains(q, lower(base)) THEN length(base) WHEN length(stem) > 3 AND contains(q, lower(stem)) THEN length(stem) WHEN length(words) > 3 AND contains(q, words) THEN length(words) END AS length FROM w, q)
SELECT file, length::INTEGER AS length FROM l WHERE length IS NOT NULL ORDER BY l.length DESC, file LIMIT 1""",
    "hop_counts": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN greatest(1, least(p_size, 10)) ELSE 3 END::BIGINT AS hops FROM part",
    "top_folder_groups": f"WITH {_NODES} SELECT string_split(r.file, '/')[1] AS folder, count(DISTINCT r.name) AS n, min(r.name) AS first FROM now WHERE r.kind = 'Module' GROUP BY 1",
    "top_folder_forms": r"""WITH f AS (SELECT DISTINCT file FROM files), p AS (SELECT file AS path FROM f UNION SELECT '/' || file FROM f UNION SELECT replace(file, '/', '\') FROM f UNION SELECT '/' UNION SELECT NULL)
SELECT path, CASE WHEN path IS NULL OR path = '/' THEN '(root)' ELSE regexp_extract(path, '[^/\\]+') END AS folder FROM p""",
    "folder_listing": r"""WITH now AS (SELECT id, arg_max({'kind': kind, 'name': name, 'file': file, 'doc': docstring}, indexed_at) AS r FROM nodes GROUP BY id),
d AS (SELECT r, regexp_extract(regexp_replace(coalesce(r.doc, ''), '^\s+', ''), '^[^\r\n]*')[1:140] AS doc FROM now WHERE r.kind = 'Module')
SELECT string_split(r.file, '/')[1] AS folder, '- ' || r.name || ' (' || r.file || ')' || CASE WHEN doc = '' THEN '' ELSE ': ' || doc END AS line FROM d""",
    "chat_list": "WITH c AS (SELECT id, max(updated_at) AS updated_at, arg_max(repo_db_path, updated_at) AS p FROM chats GROUP BY id) SELECT id, updated_at FROM c WHERE p = (SELECT min(repo_db_path) FROM chats)",
    "chat_history": "SELECT DISTINCT id, seq, question, answer FROM messages WHERE chat_id = (SELECT min(chat_id) FROM messages)",
    "chat_next_seq": "SELECT chat_id, coalesce(max(seq), -1) + 1 AS next_seq FROM messages GROUP BY chat_id",
    "registry_latest": "SELECT db_path, arg_max(name, added_at) AS name FROM registry GROUP BY db_path",
    "vault_adjacency": f"""WITH {_PN}, {_PE}, b AS (SELECT src AS id, dst AS other, kind, 'out' AS direction FROM pe UNION ALL SELECT dst, src, kind, 'in' FROM pe)
SELECT b.id, b.kind, direction, count(DISTINCT other) AS n FROM b JOIN pn ON pn.id = other GROUP BY ALL""",
    "export_whole": f"WITH {_PE} SELECT src, dst, kind FROM pe WHERE kind = 'CALLS'",
    "vault_notes": f"""WITH {_PN}, {_PE}, t AS (SELECT *, replace(regexp_replace(id, '^[a-z]+::', ''), ':', '_') || ' (' || kind || ')' AS title FROM pn),
b AS (SELECT src AS id, dst AS other, CASE kind WHEN 'CALLS' THEN 5 ELSE 7 END AS place, CASE kind WHEN 'CALLS' THEN 'Calls' ELSE 'Inherits From' END AS heading FROM pe
  UNION ALL SELECT dst, src, CASE kind WHEN 'CALLS' THEN 6 ELSE 8 END, CASE kind WHEN 'CALLS' THEN 'Called By' ELSE 'Inherited By' END FROM pe),
s AS (SELECT b.id, place, chr(10) || chr(10) || '## ' || heading || chr(10) || string_agg(DISTINCT '- [[' || title || ']]', chr(10) ORDER BY '- [[' || title || ']]') AS s FROM b JOIN t ON t.id = b.other GROUP BY b.id, place, heading),
l AS (SELECT id, string_agg(s, '' ORDER BY place) AS s FROM s GROUP BY id)
SELECT title, '---' || chr(10) || 'kind: ' || kind || chr(10) || 'file: "' || file || '"' || chr(10) || 'tags: [nodeweft, ' || kind || ']' || chr(10) || '---' || chr(10) || chr(10) || '# ' || name || chr(10) || chr(10)
  || '*' || kind || '* in `' || file || '`' || coalesce(s, '') || chr(10) AS body FROM t LEFT JOIN l USING (id)""",
    "vault_titles": """WITH n AS (SELECT DISTINCT 'function::' || p_name || repeat(':', (p_partkey % 7)::INT) || repeat('/', (6 - p_partkey % 7)::INT) AS id FROM part),
t AS (SELECT id, replace(replace(regexp_replace(id, '^function::', ''), ':', '_'), '/', '_') || ' (Function)' AS base FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM t)
SELECT id, CASE WHEN k = 1 THEN base ELSE base || ' ' || k END AS title FROM r""",
    "export_capped": f"WITH {_PN}, {_PE}, k AS (SELECT id FROM pn WHERE kind = 'Function' ORDER BY id LIMIT 500) SELECT src, dst, kind FROM pe WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "chat_titles": r"""WITH q AS (SELECT chat_id, arg_min({'q': question}, {'s': coalesce(seq, 4611686018427387904), 'i': id}).q AS q FROM messages WHERE chat_id IS NOT NULL GROUP BY chat_id),
t AS (SELECT chat_id, trim(replace(trim(coalesce(q, '')), chr(10), ' ')) AS c FROM q)
SELECT chat_id, CASE WHEN c = '' THEN '(image)' WHEN length(c) > 60 THEN rtrim(c[1:59]) || '…' ELSE c END AS title FROM t""",
}
_SQL["route_load"] = "SELECT 'route::explicit::app/Config/Routes.php::' || i || '::' || m || '::' || p AS id, p AS pattern FROM (VALUES (0, 'GET', '(:any)/config'), (1, 'GET', '(:any)/edit'), (2, 'GET', '(:any)/list'), (3, 'GET', '(:any)/show/(:num)'), (4, 'GET', 'ledger/(:any)'), (5, 'POST', 'order/new'), (6, 'GET', 'unit/show/(:num)')) v(i, m, p)"
_SQL["stored_answers"] = r"""WITH m AS (SELECT DISTINCT id, answer FROM messages WHERE answer IS NOT NULL),
j AS (SELECT *, json_valid(answer) AND regexp_matches(answer, '^\s*\{') AS ok FROM m),
x AS (SELECT id, answer, ok, CASE WHEN ok THEN json_extract_string(answer, '$.type') END AS t,
  CASE WHEN ok AND json_type(answer, '$.content') = 'NULL' THEN 'None' WHEN ok THEN json_extract_string(answer, '$.content') END AS c,
  CASE WHEN ok AND json_type(answer, '$.detail') = 'NULL' THEN 'None' WHEN ok THEN json_extract_string(answer, '$.detail') END AS d FROM j),
y AS (SELECT *, regexp_replace(regexp_replace(coalesce(c, ''), '^[\s\p{Z}\x{85}]+', ''), '[\s\p{Z}\x{85}]+$', '') AS cs, regexp_replace(regexp_replace(coalesce(d, ''), '^[\s\p{Z}\x{85}]+', ''), '[\s\p{Z}\x{85}]+$', '') AS ds FROM x)
SELECT id, CASE WHEN t IN ('answer', 'clarify') THEN t ELSE 'answer' END AS type, CASE WHEN cs = '' THEN answer ELSE cs END AS content, ds AS detail FROM y"""
_SQL["stored_hashes"] = f"WITH {_FILES} SELECT file, sha1(CASE WHEN length(file) % 3 = 0 THEN content || 'ÿ' ELSE content END) AS sha1 FROM f WHERE content IS NOT NULL"
# The patterns are written out here, so that the list in the code is checked too.
_SQL["data_evidence"] = rf"""WITH {_FILES}, l AS (SELECT file, regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM f), x AS (SELECT file, unnest(ls) AS line, generate_subscripts(ls, 1) AS lineno FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY lineno) AS n FROM x WHERE regexp_matches(line, '\$this\s*->\s*db\b') OR regexp_matches(line, '->\s*(table|query|where|get)\s*\(') OR regexp_matches(line, '\bModel\s*::')
  OR regexp_matches(line, '\bextends\s+\w*Model\b') OR regexp_matches(line, 'App\\Models\\\w+') OR regexp_matches(line, '\bfind\s*\(') OR regexp_matches(line, '\$_(GET|POST|REQUEST|SESSION)\b'))
SELECT file, lineno, regexp_replace(regexp_replace(line, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')[1:120] AS line FROM h WHERE n <= 20"""
_INTENT_FORMS = {
    "roles": r"\brole|\bpermission|\baccess level|\bwho can\b",
    "rules": r"\brule|\bgate|\ballow|\bdeny|\bvalidat|\bcondition|\brestrict",
    "data_source": r"\bdata\b.*\bcome|\bwhere.*data|\bdatabase|\btable\b|\bsql\b|\bmodel\b|\bsource\b|\bfetch|\bquery",
    "inherits": r"\bextend|\binherit|\bparent class|\bsubclass|\bbase class",
    "impact": r"\bcall|\bbreak|\bimpact|\bdepend|\baffect",
    "matrix": r"\bmatrix|\bwhich pages?\b|\bevery page\b|\ball pages\b",
    "views": r"\bview\b|\brender|\btemplate|\bpartial",
}
_HITS = ", ".join(f"CASE WHEN regexp_matches(question, '(?is){p}') THEN '{k}' END" for k, p in sorted(_INTENT_FORMS.items()))
_SQL["question_intents"] = f"SELECT question, concat_ws(',', {_HITS}) AS intents FROM (SELECT DISTINCT question FROM messages WHERE question IS NOT NULL)"
_DIFF = """v AS (SELECT file, arg_min(content, {'a': indexed_at, 'c': content}) AS c0, arg_max(content, indexed_at) AS c1 FROM files GROUP BY file),
o AS (SELECT file, sha1(c0) AS before FROM v WHERE NOT starts_with(file, 'lumen') AND c0 IS NOT NULL), n AS (SELECT file, sha1(c1) AS after FROM v WHERE NOT starts_with(file, 'maple_api') AND c1 IS NOT NULL),
d AS (SELECT file, CASE WHEN after IS NULL THEN 'removed' WHEN before IS NOT DISTINCT FROM after THEN 'unchanged' ELSE 'changed' END AS status FROM o FULL JOIN n USING (file))"""
_SQL["file_diff_status"] = f"WITH {_DIFF} SELECT file, status FROM d"
_SQL["file_diff_counts"] = f"WITH {_DIFF} SELECT status, count(*) AS n FROM d GROUP BY status"
_SQL["hybrid_context"] = f"""WITH now AS (SELECT id, arg_max({{'kind': kind, 'name': name, 'file': file, 'doc': docstring, 'x': embedding}}, indexed_at) AS r FROM nodes GROUP BY id),
c AS (SELECT id AS doc_id, r.x AS x, r.kind || ' `' || r.name || '` in ' || r.file || ': ' || coalesce(r.doc, '')[1:150] AS label, concat_ws(' ', r.name, r.doc) AS text FROM now WHERE r.kind IN ('Module', 'Class', 'Function')),
{_tfidf(['which', 'class', 'renders', 'ledger', 'page'], 8).replace('FROM documents', 'FROM c')},
q1 AS (SELECT x FROM c WHERE doc_id = (SELECT min(id) FROM now WHERE r.kind = 'Class' AND len(r.x) = 384 AND NOT isnan(list_sum(r.x)) AND list_sum(list_transform(r.x, lambda v: abs(v))) > 0)),
near AS (SELECT label, doc_id, 1 - list_dot_product(c.x::DOUBLE[], q1.x::DOUBLE[]) / (CASE WHEN list_dot_product(c.x::DOUBLE[], c.x::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_dot_product(c.x::DOUBLE[], c.x::DOUBLE[])) END * sqrt(list_dot_product(q1.x::DOUBLE[], q1.x::DOUBLE[]))) AS distance FROM c, q1 WHERE len(c.x) = 384),
b AS (SELECT label, 0 AS s, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM tfidf JOIN c USING (doc_id) UNION ALL
  SELECT label, 1, row_number() OVER (ORDER BY distance, doc_id) FROM (SELECT * FROM near ORDER BY distance, doc_id LIMIT 8)),
g AS (SELECT label, min({{'s': s, 'k': k}}) AS f FROM b GROUP BY label)
SELECT label, rank::INTEGER AS rank FROM (SELECT label, row_number() OVER (ORDER BY f, label) AS rank FROM g) WHERE rank <= 8"""
_SQL["embed_hashed"] = """WITH now AS (SELECT id, arg_max({'kind': kind, 'doc': docstring}, indexed_at) AS r FROM nodes GROUP BY id),
d AS (SELECT id, CASE WHEN trim(coalesce(r.doc, '')) = '' THEN '(no description)' ELSE r.doc END AS t FROM now WHERE r.kind = 'Class'),
w AS (SELECT id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS w FROM d), h AS (SELECT id, ('0x' || md5(w)[1:15])::BIGINT AS h FROM w),
v AS (SELECT id, h % 384 AS place, sum(CASE WHEN (h // 384) % 2 = 1 THEN -1 ELSE 1 END)::DOUBLE AS x FROM h GROUP BY ALL),
n AS (SELECT id, sqrt(sum(x * x)) AS n FROM v GROUP BY id)
SELECT v.id, v.place, round((x / n)::FLOAT::DOUBLE, 6) AS value FROM v JOIN n USING (id) WHERE x <> 0"""
# What the lines of the tables' PHP files say, by patterns over lines instead of a tokenizer.
_LINES = rf"""{_FILES}, l AS (SELECT file, string_split(content, chr(10)) AS ls FROM f WHERE file LIKE '%.php'), x AS (SELECT file, unnest(ls) AS line, generate_subscripts(ls, 1) AS lineno FROM l),
c AS (SELECT * FROM x WHERE NOT regexp_matches(line, '^\s*(//|\*|/\*|#)')),
m AS (SELECT *, last_value(nullif(regexp_extract(line, '^(?:abstract |final )?class (\w+)', 1), '') IGNORE NULLS) OVER w AS cls, last_value(nullif(regexp_extract(line, '^\s*(?:(?:public|private|protected|static|final|abstract) )*function &?(\w+)\s*\(', 1), '') IGNORE NULLS) OVER w AS fn, last_value(CASE WHEN regexp_matches(line, '^\s*(?:(?:public|private|protected|static|final|abstract) )*function &?\w+\s*\(') THEN starts_with(line, ' ') END IGNORE NULLS) OVER w AS inside FROM c WINDOW w AS (PARTITION BY file ORDER BY lineno))"""
_SQL["source_views"] = rf"""WITH {_LINES}, v AS (SELECT *, regexp_extract(line, '(?:^|[^>:\w])view\(''([^'']+)''', 1) AS view_arg FROM m)
SELECT file AS source_file, 'Function' AS source_kind, lineno, view_arg, NULL::VARCHAR AS target_file, false AS resolved FROM v WHERE view_arg <> ''"""
_SQL["source_rules"] = rf"""WITH {_LINES}, g AS (SELECT *, regexp_extract(line, 'if (\(.*[Rr]ole.*\)) \{{', 1) AS condition, lead(line) OVER (PARTITION BY file ORDER BY lineno) AS next FROM m)
SELECT 'concept::app::' || upper(regexp_extract(condition, '''(\w+)''', 1)) AS concept_id, 'function::' || file || '::' || concat_ws('.', CASE WHEN inside THEN cls END, fn) AS target_id, 'Function' AS target_kind,
  CASE WHEN regexp_matches(next, '(?i)\$\w*(flag|redirect|deny|block)\w*\s*=\s*(true|1);') THEN 'deny' WHEN regexp_matches(next, '(?i)\$\w*(flag|redirect|deny|block)\w*\s*=\s*(false|0);') THEN 'allow' ELSE 'checked' END AS effect, condition FROM g WHERE condition <> ''"""
_SQL["source_php_definitions"] = rf"""WITH {_LINES}, d AS (SELECT DISTINCT file, cls, fn, inside FROM m)
SELECT DISTINCT 'class::' || file || '::' || cls AS id, 'Class' AS kind, cls AS name, file FROM d WHERE cls IS NOT NULL
UNION ALL SELECT DISTINCT 'function::' || file || '::' || concat_ws('.', CASE WHEN inside THEN cls END, fn), 'Function', fn, file FROM d WHERE fn IS NOT NULL"""
_SQL["source_php_edges"] = rf"""WITH {_LINES}, d AS (SELECT DISTINCT file, cls, fn, inside FROM m)
SELECT DISTINCT 'module::' || file AS src, 'class::' || file || '::' || cls AS dst, 'CONTAINS' AS kind FROM d WHERE cls IS NOT NULL
UNION ALL SELECT DISTINCT CASE WHEN inside AND cls IS NOT NULL THEN 'class::' || file || '::' || cls ELSE 'module::' || file END, 'function::' || file || '::' || concat_ws('.', CASE WHEN inside THEN cls END, fn), 'CONTAINS' FROM d WHERE fn IS NOT NULL
UNION ALL SELECT DISTINCT 'module::' || file, 'external::' || regexp_extract(line, '^use ([^;]+);', 1), 'IMPORTS' FROM m WHERE regexp_matches(line, '^use [^;]+;')"""
_SQL["app_names"] = r"""WITH f AS (SELECT DISTINCT file FROM files WHERE file IS NOT NULL), p AS (SELECT file AS path FROM f UNION SELECT replace(file, '/', '\') FROM f UNION SELECT 'Modules/' || file FROM f),
s AS (SELECT path, string_split(replace(path, '\', '/'), '/') AS s FROM p) SELECT path, CASE WHEN coalesce(list_position(s, 'Modules'), 0) > 0 THEN coalesce(s[list_position(s, 'Modules') + 1], s[1]) ELSE s[1] END AS app FROM s"""
_SQL["qualified_targets"] = r"""WITH n AS (SELECT *, replace(p_brand, '#', '') AS n FROM part)
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '\Core\' WHEN p_size % 3 = 1 THEN 'Sub\' WHEN p_partkey % 3 < 2 THEN 'App\Pages\' ELSE '' END || n || '::go' AS target, 'app/' || n || '.php' AS file, lower(n[1]) || n[2:] AS first FROM n"""
_SQL["file_titles"] = r"""WITH q AS (SELECT DISTINCT question FROM messages WHERE question IS NOT NULL),
t AS (SELECT question, regexp_replace(regexp_replace(regexp_replace(question, '[\\/:*?"<>|]', '_', 'g'), '^[\s\p{Z}\x{85}]+', ''), '[\s\p{Z}\x{85}]+$', '')[1:180] AS t, regexp_replace(regexp_replace(regexp_replace(question, '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+', ''), '_+$', '')[1:60] AS s FROM q)
SELECT question, CASE WHEN t = '' THEN 'untitled' ELSE t END AS title, CASE WHEN s = '' THEN 'repo' ELSE s END AS slug FROM t"""
_SQL["vector_index_topk"] = _SQL["vector_topk"]
_SQL["concept_upsert"] = """WITH p AS (SELECT 'concept::app::' || c_mktsegment AS id, c_mktsegment AS code, c_custkey % 2 AS half, count(*) AS n FROM customer GROUP BY ALL),
k AS (SELECT * FROM p WHERE NOT (half = 0 AND code = 'BUILDING') AND NOT (half = 1 AND code = 'MACHINERY')) SELECT id, code, arg_max(n, half) AS lineno FROM k GROUP BY id, code"""
_W = f"""{_PN}, {_PE}, m AS (SELECT p_partkey::VARCHAR AS k, 'pkg/' || lower(replace(p_brand, '#', '')) || '.py' AS f FROM part),
e AS (SELECT pe.kind, a.k AS a, a.f AS af, b.k AS b, b.f AS bf FROM pe JOIN m a ON a.k = string_split(src, '::')[3] JOIN m b ON b.k = string_split(dst, '::')[3])"""
_SQL["written_definitions"] = f"""WITH {_W} SELECT 'function::' || f || '::f_' || k AS id, 'Function' AS kind, 'f_' || k AS name, f AS file, 'Part ' || k || '.' AS docstring FROM m
UNION ALL SELECT 'class::' || f || '::C_' || k, 'Class', 'C_' || k, f, '' FROM m UNION ALL SELECT DISTINCT 'module::' || f, 'Module', f, f, '' FROM m UNION ALL SELECT 'module::pkg/__init__.py', 'Module', 'pkg/__init__.py', 'pkg/__init__.py', ''"""
_SQL["written_edges"] = f"""WITH {_W} SELECT 'function::' || af || '::f_' || a AS src, 'function::' || bf || '::f_' || b AS dst, kind FROM e WHERE kind = 'CALLS'
UNION ALL SELECT 'class::' || af || '::C_' || a, 'class::' || bf || '::C_' || b, kind FROM e WHERE kind = 'INHERITS'
UNION ALL SELECT DISTINCT 'module::' || af, 'module::' || bf, 'IMPORTS' FROM e WHERE af <> bf
UNION ALL SELECT 'module::' || f, 'function::' || f || '::f_' || k, 'CONTAINS' FROM m UNION ALL SELECT 'module::' || f, 'class::' || f || '::C_' || k, 'CONTAINS' FROM m"""
_SQL["written_impact"] = f"""WITH RECURSIVE {_W}, r AS (SELECT a, af, 1 AS d FROM e WHERE kind = 'CALLS' AND b = '7' UNION SELECT e.a, e.af, d + 1 FROM r JOIN e ON e.b = r.a WHERE kind = 'CALLS' AND d < 3)
SELECT DISTINCT 'f_' || a AS name, af AS file FROM r"""
_SQL["written_callers"] = f"WITH {_W} SELECT 'f_' || a AS caller, af AS file FROM e WHERE kind = 'CALLS' AND b = '7'"
_SQL["written_subclasses"] = f"""WITH RECURSIVE {_W}, r AS (SELECT a, af, 1 AS d FROM e WHERE kind = 'INHERITS' AND b = '3' UNION SELECT e.a, e.af, d + 1 FROM r JOIN e ON e.b = r.a WHERE kind = 'INHERITS' AND d < 5)
SELECT DISTINCT 'C_' || a AS name, af AS file FROM r"""


def oracle_sql() -> dict[str, str]:
    return _SQL | fixtures.oracle_sql()
