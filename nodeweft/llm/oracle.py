"""DuckDB SQL that gives the same rows as the queries of this package, where SQL can say it over whole tables."""

from __future__ import annotations

_TERMS = r"""
WITH now AS (
  SELECT id, arg_max({'kind': kind, 'name': name, 'docstring': docstring}, indexed_at) AS r FROM nodes GROUP BY id
), said AS (
  SELECT id AS node_id, CASE WHEN r.kind = 'Function' THEN concat_ws(' ', r.name, r.docstring) ELSE coalesce(r.docstring, '') END AS s
  FROM now WHERE r.kind IN ('Function', 'Class') AND id IS NOT NULL
), word AS (
  SELECT node_id, unnest(regexp_extract_all(lower(regexp_replace(s, '([a-z])([A-Z])', '\1 \2', 'g')), '\pL+')) AS term FROM said
), counts AS (
  SELECT node_id, term, count(*) AS tf FROM word WHERE length(term) >= 3 GROUP BY ALL
), stats AS (
  SELECT term, sum(tf) AS cf, count(*) AS df FROM counts GROUP BY term
)"""

P2_FOUND = _TERMS + """
SELECT node_id, term FROM counts JOIN stats USING (term) WHERE tf >= 2 AND df BETWEEN 2 AND 12"""

P2_SCORES = _TERMS + """, size AS (
  SELECT node_id, sum(tf)::DOUBLE AS n FROM counts GROUP BY node_id
), total AS (
  SELECT sum(cf)::DOUBLE AS t FROM stats
), x AS (
  SELECT node_id, term, tf::BIGINT AS tf, df::BIGINT AS df, tf::DOUBLE AS y, n, (cf - tf)::DOUBLE AS o, t, 500.0::DOUBLE * cf::DOUBLE / t AS a
  FROM counts JOIN stats USING (term) JOIN size USING (node_id), total
)
SELECT node_id, term, tf, df,
  round((ln((y + a) / (n + 500 - y - a)) - ln((o + a) / (t - n + 500 - o - a))) / sqrt(1 / (y + a) + 1 / (o + a)), 6) AS z
FROM x"""

P9_FOUND = r"""
WITH word AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS t
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '\pL+') AS w FROM documents)
), five AS (
  SELECT doc_id, i, concat_ws(' ', t, lead(t, 1) OVER d, lead(t, 2) OVER d, lead(t, 3) OVER d, lead(t, 4) OVER d) AS g, lead(t, 4) OVER d AS last
  FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), again AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) > 1 AS repeats FROM five WHERE last IS NOT NULL
), covered AS (
  SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE repeats
)
SELECT doc_id FROM (SELECT doc_id, count(*) AS n FROM word GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS r FROM covered GROUP BY doc_id) USING (doc_id)
WHERE r >= 0.5 * n"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_scores": P2_SCORES, "p9_found": P9_FOUND}
