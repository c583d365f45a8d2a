"""DuckDB SQL for the queries over documents: the same texts, taken apart by the other engine's own JSON functions."""

from __future__ import annotations

_PATHS = r"p AS MATERIALIZED (SELECT page_id AS k, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)"

_FAULTY = f"""{_PATHS}, parts AS (
  SELECT k, '{{"nodes":[{{"id":"a' || k || '","type":" HTTP ","name":" Page ' || k || ' ","config":{{"url":"' || CASE WHEN k % 3 = 0 THEN substr(path, 2) ELSE path END || '","method":"' || CASE WHEN k % 4 = 0 THEN 'trace' ELSE 'get' END || '"}}}},'
    || '{{"id":' || k || ',"kind":"postgres","config":null}},{{"id":" b ","type":"rest","name":null,"config":{{"url":null,"route":"/r","Auth":1}}}},'
    || CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"text"' WHEN 2 THEN '{{}}' WHEN 3 THEN '{{"id":"b"}}' ELSE '{{"id":"q","type":"kafka","kind":"x","config":[1]}}' END
    || ',{{"id":"svc","type":"service","config":"x"}},[]],"edges":'
    || CASE WHEN k % 12 = 7 THEN '{{}}' ELSE '[{{"from":"a' || k || '","to":"b"}},{{"source":"b","target":" svc ","kind":" Queue-x "}},{{"from":"svc","to":"nope"}},{{"from":"nope","to":"svc","metadata":{{"protocol":"ASYNC"}}}},7,{{"from":"","source":"b","to":"b"}},{{"from":"svc","to":"'
      || CASE WHEN k % 2 = 1 THEN 'a' || k ELSE 'svc' END || '","metadata":{{"kind":"call","protocol":"http"}},"kind":"queue","config":{{"async":true}}}}]' END || '}}' AS g FROM p
), raw AS (
  SELECT k, CASE k % 12 WHEN 0 THEN '5' WHEN 1 THEN 'null' WHEN 2 THEN '[]' WHEN 3 THEN '{{"metadata":{{}}}}' WHEN 4 THEN '{{"graph":{{"nodes":{{}}}}}}' WHEN 5 THEN '{{"nodes":[]}}' WHEN 6 THEN '{{"graph":'
    ELSE CASE WHEN k % 2 = 0 THEN '{{"graph":' || g || '}}' ELSE g END END AS raw FROM parts
)"""

_GRAPHS = """, roots AS (SELECT k, CASE WHEN json_valid(raw) THEN raw::JSON END AS j FROM raw),
graphs AS MATERIALIZED (
  SELECT k, coalesce(json_type(j), 'NONE') AS root, CASE WHEN json_type(j) = 'OBJECT' THEN CASE WHEN json_type(j->'graph') IN ('OBJECT', 'ARRAY') THEN j->'graph' WHEN json_type(j->'nodes') = 'ARRAY' THEN j END END AS g FROM roots
), shaped AS MATERIALIZED (
  SELECT k, g, CASE WHEN root NOT IN ('OBJECT', 'ARRAY') THEN 'IR-STRUCT-INVALID_ROOT' WHEN g IS NULL THEN 'IR-STRUCT-NO_GRAPH' WHEN coalesce(json_type(g->'nodes'), '') <> 'ARRAY' THEN 'IR-STRUCT-NODES_NOT_ARRAY'
    WHEN json_array_length(g->'nodes') = 0 THEN 'IR-STRUCT-EMPTY_GRAPH' END AS shape_code FROM graphs
), ns AS MATERIALIZED (SELECT k, i, json_extract(g->'nodes', '$[' || i || ']') AS s FROM (SELECT *, unnest(range(json_array_length(g->'nodes')::BIGINT)) AS i FROM shaped WHERE shape_code IS NULL)),
es AS MATERIALIZED (SELECT k, i, json_extract(g->'edges', '$[' || i || ']') AS s FROM (SELECT *, unnest(range(json_array_length(g->'edges')::BIGINT)) AS i FROM shaped WHERE shape_code IS NULL AND json_type(g->'edges') = 'ARRAY')),
n AS MATERIALIZED (
  SELECT k, i, CASE WHEN json_type(s) IN ('OBJECT', 'ARRAY', 'NULL') THEN lower(json_type(s)) ELSE 'scalar' END AS slot_kind, trim(coalesce(s->>'id', '')) AS id,
    lower(trim(coalesce(s->>'type', s->>'kind', ''))) AS type, trim(coalesce(s->>'name', '')) AS name,
    CASE json_type(s->'config') WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' ELSE coalesce('number' || json_type(s->'config'), 'absent') END AS config_type,
    CASE WHEN json_type(s->'config') = 'OBJECT' THEN array_to_string(list_sort(json_keys(s->'config')), ',') END AS config_keys,
    CASE WHEN json_type(s->'config') = 'OBJECT' THEN trim(coalesce(s->'config'->>'url', s->'config'->>'route', '')) ELSE '' END AS http_path,
    CASE WHEN json_type(s->'config') = 'OBJECT' THEN trim(coalesce(s->'config'->>'method', 'post')) ELSE 'post' END AS http_method FROM ns
), e AS MATERIALIZED (
  SELECT k, i, CASE WHEN json_type(s) IN ('OBJECT', 'ARRAY', 'NULL') THEN lower(json_type(s)) ELSE 'scalar' END AS slot_kind, trim(coalesce(s->>'from', s->>'source', '')) AS src, trim(coalesce(s->>'to', s->>'target', '')) AS dst,
    coalesce((s->'config'->>'async') = 'true', false) OR lower(coalesce((s->'metadata'->>'protocol'), '')) = 'async' OR regexp_matches(lower(coalesce(s->'metadata'->>'kind', s->>'kind', '')), 'queue') AS is_async FROM es
)"""

_FOUND = """, c AS (SELECT k, id, count(*) AS m FROM n WHERE id <> '' GROUP BY ALL),
ends AS MATERIALIZED (SELECT e.*, coalesce(a.m, 0) AS a, coalesce(b.m, 0) AS b FROM e LEFT JOIN c a ON a.k = e.k AND a.id = src LEFT JOIN c b ON b.k = e.k AND b.id = dst),
f AS (
  SELECT k, shape_code AS code, NULL AS node_id, NULL AS edge_index, CASE shape_code WHEN 'IR-STRUCT-INVALID_ROOT' THEN 'IR must be a JSON object' WHEN 'IR-STRUCT-NO_GRAPH' THEN 'IR has no graph: expected `.graph` or top-level `.nodes` array'
    WHEN 'IR-STRUCT-NODES_NOT_ARRAY' THEN '`nodes` must be an array' ELSE 'Graph has no nodes' END AS message FROM shaped WHERE shape_code IS NOT NULL
  UNION ALL SELECT k, 'IR-STRUCT-EDGES_NOT_ARRAY', NULL, NULL, '`edges` is present but not an array; treating as []' FROM shaped WHERE shape_code IS NULL AND json_type(g->'edges') <> 'ARRAY'
  UNION ALL SELECT k, 'IR-STRUCT-NODE_INVALID', NULL, NULL, 'Node at index ' || i || ' is not an object' FROM n WHERE slot_kind IN ('null', 'scalar')
  UNION ALL SELECT k, 'IR-STRUCT-NODE_NO_ID', NULL, NULL, 'Node at index ' || i || ' is missing a non-empty `id`' FROM n WHERE slot_kind IN ('object', 'array') AND id = ''
  UNION ALL SELECT k, 'IR-STRUCT-DUP_NODE_ID', id, NULL, 'Duplicate node id "' || id || '"' FROM (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY i) AS r FROM n WHERE id <> '') WHERE r > 1
  UNION ALL SELECT k, 'IR-STRUCT-NODE_INVALID_CONFIG', id, NULL, 'Node "' || id || '" has a non-object `config` (got ' || config_type || '); treated as {}' FROM n WHERE id <> '' AND config_type NOT IN ('object', 'absent')
  UNION ALL SELECT k, 'IR-STRUCT-HTTP_PATH', id, NULL, 'HTTP endpoint node "' || id || '" has invalid path: config.url must be a non-empty string starting with /' FROM n WHERE id <> '' AND type IN ('http', 'rest') AND NOT starts_with(http_path, '/')
  UNION ALL SELECT k, 'IR-STRUCT-HTTP_METHOD', id, NULL, 'HTTP endpoint node "' || id || '" has unsupported method "' || http_method || '"' FROM n WHERE id <> '' AND type IN ('http', 'rest') AND http_method NOT IN ('get', 'post')
  UNION ALL SELECT k, 'IR-STRUCT-EDGE_INVALID', NULL, i, 'Edge at index ' || i || ' is not an object' FROM e WHERE slot_kind IN ('null', 'scalar')
  UNION ALL SELECT k, 'IR-STRUCT-EDGE_NO_ENDPOINTS', NULL, i, 'Edge at index ' || i || ' is missing from/source or to/target' FROM e WHERE slot_kind = 'object' AND (src = '' OR dst = '')
  UNION ALL SELECT k, CASE WHEN a = 0 THEN 'IR-STRUCT-EDGE_UNKNOWN_FROM' ELSE 'IR-STRUCT-EDGE_AMBIGUOUS_FROM' END, src, i, CASE WHEN a = 0 THEN 'Edge at index ' || i || ' references unknown source node "' || src || '"'
    ELSE 'Edge at index ' || i || ' references duplicate node id "' || src || '" (ambiguous source)' END FROM ends WHERE src <> '' AND dst <> '' AND a <> 1
  UNION ALL SELECT k, CASE WHEN b = 0 THEN 'IR-STRUCT-EDGE_UNKNOWN_TO' ELSE 'IR-STRUCT-EDGE_AMBIGUOUS_TO' END, dst, i, CASE WHEN b = 0 THEN 'Edge at index ' || i || ' references unknown target node "' || dst || '"'
    ELSE 'Edge at index ' || i || ' references duplicate node id "' || dst || '" (ambiguous target)' END FROM ends WHERE src <> '' AND dst <> '' AND b <> 1
  UNION ALL SELECT k, 'IR-STRUCT-CYCLE', CASE WHEN k % 2 = 1 THEN 'a' || k ELSE 'svc' END, NULL, 'Directed cycle detected: ' || CASE WHEN k % 2 = 1 THEN 'a' || k || ' → b → svc → a' || k ELSE 'svc → svc' END
    FROM shaped WHERE shape_code IS NULL AND json_type(g->'edges') = 'ARRAY' AND (k % 2 = 0 OR k % 5 <> 3)
), sound AS (
  SELECT k + 1000000000 AS k, 'IR-LINT-MISSING-AUTH-010' AS code, 'g' AS node_id, NULL AS edge_index, 'HTTP entry node "g" has no auth node or auth config in its immediate graph neighbourhood' AS message FROM p WHERE k % 4 IN (2, 3)
  UNION ALL SELECT k + 1000000000, 'IR-LINT-NO-HEALTHCHECK-003', NULL, NULL, 'No HTTP node exposes a typical health/readiness path (/health, /healthz, /healthcheck, /ping, /status, /live, /ready). Heuristic: one route per HTTP node; gateway/BFF with many routes may need a dedicated health node.' FROM p WHERE k % 5 <> 0
  UNION ALL SELECT k + 1000000000, 'IR-LINT-DUPLICATE-EDGE-006', 's', 2, 'Duplicate edge from "s" to "d" (also at index 1)' FROM p WHERE k % 3 = 0
), every AS (
  SELECT *, CASE WHEN code IN ('IR-STRUCT-EDGES_NOT_ARRAY', 'IR-STRUCT-NODE_INVALID_CONFIG') THEN 'warning' ELSE 'error' END AS severity, 'structural' AS layer FROM f UNION ALL SELECT *, 'warning', 'lint' FROM sound
)"""

_JSON = f"WITH {_FAULTY}{_GRAPHS}"

#: What the three findings of the sound documents say beside their message.
_SAYS = {
    "IR-LINT-DUPLICATE-EDGE-006": ("Collapse duplicate edges or distinguish them with metadata if your IR allows.", "Parallel duplicate edges rarely add information and clutter graph views.", "Downstream generators and metrics may double-count dependencies."),
    "IR-LINT-MISSING-AUTH-010": (
        "Add an auth/middleware node with an edge to or from this entry, or set config.authRequired: false for intentionally public endpoints.",
        "Connect an auth, oauth, jwt, or middleware node. For PCI-DSS / HIPAA systems, every HTTP entry must have a documented auth boundary.",
        "Unauthenticated HTTP entry points are a compliance gap in regulated environments and a common attack surface.",
    ),
    "IR-LINT-NO-HEALTHCHECK-003": ("Add a GET route such as /health for orchestrators and load balancers.", "Expose liveness vs readiness separately if your platform distinguishes them.", "Weaker deploy/rollback safety and harder operations automation."),
}
_SAID = ", ".join(f"('{code}', '{fix}', '{hint}', '{impact}')" for code, (fix, hint, impact) in _SAYS.items())

_SHAPES = """WITH w AS (SELECT page_id AS k, page_id % 11 = 10 AS scalar, page_id % 4 AS v, page_id % 3 AS h, page_id % 5 AS i FROM pages), l AS (
  SELECT k, CASE WHEN scalar THEN ['Document is empty or not an object'] ELSE list_filter([CASE v WHEN 1 THEN 'Expected OpenAPI 3.x, got: 2' WHEN 3 THEN 'Missing openapi or swagger version field' END,
    CASE WHEN h > 0 THEN 'Missing or invalid paths object' END, CASE WHEN i = 3 THEN 'Missing info object' END, CASE WHEN i IN (1, 2) THEN 'Missing info.title' END, CASE WHEN i = 2 THEN 'Missing info.version' END], lambda x: x IS NOT NULL) END AS e FROM w)
"""

SQL: dict[str, str] = {
    "json_graphs": f"""{_JSON} SELECT k AS graph_id, shape_code, shape_code IS NULL AND json_type(g->'edges') <> 'ARRAY' AS edges_malformed,
CASE WHEN json_type(g->'nodes') = 'ARRAY' THEN json_array_length(g->'nodes') ELSE 0 END::INT AS n_raw_nodes, CASE WHEN json_type(g->'edges') = 'ARRAY' THEN json_array_length(g->'edges') ELSE 0 END::INT AS n_raw_edges FROM shaped""",
    "json_nodes": f"{_JSON} SELECT k AS graph_id, i::INT AS node_ord, slot_kind, id, type, name, config_type, config_keys, http_path, http_method FROM n",
    "json_edges": f"{_JSON} SELECT k AS graph_id, i::INT AS edge_index, slot_kind, src, dst, is_async FROM e",
    "validated_documents": f"{_JSON}{_FOUND} SELECT k AS graph_id, code, severity, layer, message, node_id, edge_index::INT AS edge_index FROM every",
    "policy_verdicts": f"""{_JSON}{_FOUND}, ids AS (SELECT k FROM p UNION ALL SELECT k + 1000000000 FROM p)
SELECT ids.k AS graph_id, count(code) FILTER (WHERE severity = 'error') AS n_errors, count(code) FILTER (WHERE severity = 'warning') AS n_warnings, count(code) > 0 AS failed FROM ids LEFT JOIN every ON every.k = ids.k GROUP BY 1""",
    "findings_report": f"""{_JSON}{_FOUND}, says(code, fix, hint, impact) AS (VALUES {_SAID})
SELECT k AS graph_id, (row_number() OVER (PARTITION BY k ORDER BY code))::INT AS place,
'{{"code":"' || code || '","severity":"warning","message":"' || replace(replace(message, '"', '\\"'), '/', '/') || '"' || CASE WHEN node_id IS NULL THEN '' ELSE ',"nodeId":"' || node_id || '"' END || CASE WHEN edge_index IS NULL THEN '' ELSE ',"edgeIndex":' || edge_index END
  || ',"fixHint":"' || fix || '","layer":"lint","suggestion":"' || hint || '","impact":"' || impact || '"}}' AS object,
'⚠️ ' || code || ': ' || message || chr(10) || '   Fix: ' || fix || chr(10) || '   Suggestion: ' || hint || chr(10) || '   Impact: ' || impact AS text FROM sound JOIN says USING (code)""",
    "rewrapped_documents": f"""WITH {_FAULTY} SELECT k AS graph_id, CASE WHEN k % 12 IN (0, 1) THEN 'IR-STRUCT-NO_GRAPH' WHEN k % 12 IN (2, 3, 4) THEN 'IR-STRUCT-NODES_NOT_ARRAY' WHEN k % 12 = 5 THEN 'IR-STRUCT-EMPTY_GRAPH' WHEN k % 12 = 6 THEN 'IR-STRUCT-INVALID_ROOT' END AS shape_code,
CASE WHEN k % 12 < 7 THEN 0 ELSE 6 END AS n_raw_nodes FROM raw""",
    "json_endpoints": f"""WITH {_PATHS}, m AS (SELECT *, ['post', 'delete', 'post', 'put', 'put'][k % 5 + 1] AS method FROM p)
SELECT k AS graph_id, 'e' || k AS id, CASE WHEN k % 3 = 0 AND k % 5 <> 1 THEN '/r' || k ELSE path END AS route, method, true AS has_body,
CASE WHEN method = 'delete' THEN 204 WHEN method = 'put' THEN 200 WHEN k % 5 = 0 THEN 202 ELSE 201 END AS success FROM m WHERE k % 4 < 2""",
    "json_other_nodes": "SELECT page_id AS graph_id, 'e' || page_id AS id, CASE page_id % 4 WHEN 1 THEN 'cloudFunction' ELSE 'service' END AS raw_type FROM pages WHERE page_id % 2 = 1",
    "yaml_nodes": f"""WITH {_PATHS} SELECT k::VARCHAR AS graph_id, 0 AS node_ord, ['yes', '15', 'n1'][k % 3 + 1] AS id, 'http' AS type, path AS http_path FROM p WHERE k % 7 > 1
UNION ALL SELECT k::VARCHAR, 1, 'b', 'postgres', '' FROM p WHERE k % 7 > 1""",
    "yaml_canonical": f"""WITH {_PATHS} SELECT k::VARCHAR AS graph_id, CASE WHEN k % 7 > 1 THEN replace('{{
  "graph": {{
    "metadata": {{
      "name": "p' || k || '"
    }},
    "nodes": [
      {{
        "id": ' || ['"yes"', '15', '"n1"'][k % 3 + 1] || ',
        "type": "HTTP",
        "config": {{
          "url": "' || path || '",
          "on": true
        }}
      }},
      {{
        "id": "b",
        "kind": "postgres"
      }}
    ],
    "edges": [
      {{
        "from": "b",
        "to": "b"
      }}
    ]
  }}
}}
', chr(13), '') END AS text FROM p""",
    "yaml_errors": "SELECT page_id::VARCHAR AS graph_id, page_id % 7 < 2 AS failed FROM pages",
    "openapi_collisions": rf"""WITH {_PATHS}, o AS (
  SELECT k, 0 AS o, 'Get' AS name, path AS url, 'GET' AS method, NULL AS operation_id FROM p UNION ALL SELECT k, 1, 'POST ' || path, path, 'POST', NULL FROM p
  UNION ALL SELECT k, 2, 'GET ' || path || '/', path || '/', 'GET', NULL FROM p UNION ALL SELECT k, 3, 'op', '/' || substr(path, 2) || '-', 'GET', 'op' FROM p
), s AS (SELECT *, left('openapi_' || lower(regexp_replace(regexp_replace(method || '_' || url, '[^a-zA-Z0-9]+', '_', 'g'), '^_|_$', '', 'g')), 80) AS base FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY k, base ORDER BY o) - 1 AS again FROM s)
SELECT k AS doc_id, o AS node_ord, base || CASE WHEN again > 0 THEN '_' || again ELSE '' END AS id, name, url, method, operation_id FROM r""",
    "openapi_shapes": f"{_SHAPES}SELECT k AS doc_id, len(e) = 0 AS ok, array_to_string(e, '; ') AS errors FROM l",
    "openapi_failures": f"""{_SHAPES}SELECT k AS doc_id, CASE WHEN len(e) > 0 THEN 'Invalid OpenAPI document shape: ' || array_to_string(e, '; ')
ELSE 'No operations found under `paths` (supported methods: GET, POST, PUT, PATCH, DELETE, OPTIONS, HEAD).' END AS error FROM l""",
    "openapi_graphs": "SELECT page_id AS graph_id, NULL::VARCHAR AS shape_code, 4 AS n_raw_nodes, 'api-' || page_id AS service FROM pages",
    "drift_verdicts": r"""WITH d AS (SELECT *, doc_id % 20 AS g FROM documents),
s AS (SELECT g, count(*) FILTER (WHERE doc_id % 11 = 0) AS missing, count(*) FILTER (WHERE doc_id % 11 <> 0 AND doc_id % 7 = 0) AS modified, count(*) FILTER (WHERE doc_id % 13 = 0) AS extra FROM d GROUP BY 1)
SELECT i AS graph_id, i <> 19 AND coalesce(missing + modified + extra, 0) = 0 AS ok, i <> 19 AND coalesce(extra, 0) > 0 AS extra_blocking, CASE WHEN i = 19 THEN 0 ELSE coalesce(missing, 0) END AS n_missing, (i = 19)::BIGINT AS n_no_export
FROM range(20) r(i) LEFT JOIN s ON s.g = i""",
    "effective_settings": """WITH e AS (SELECT user_id, event_type, event_id, (props->>'$.k')::INT % 4 AS a FROM events),
f AS (SELECT user_id, event_type, min(event_id) AS i, arg_min(a, event_id) AS a FROM e GROUP BY 1, 2),
m AS (SELECT event_type, arg_max(a, i) FILTER (WHERE a <> 0) AS attempts FROM f GROUP BY 1)
SELECT event_type AS dst, coalesce(any_value(attempts), CASE WHEN min(event_id) % 2 = 0 THEN 9 END, 2) AS attempts FROM events JOIN m USING (event_type) GROUP BY 1""",
    "text_functions": rf"""WITH {_PATHS} SELECT k AS page_id, substr(path, 2) AS trimmed, '/' || substr(path, 2) AS slashed, regexp_replace(path, '[^A-Za-z0-9_-]', '_', 'g') AS safe, CASE WHEN k * 701 BETWEEN 1 AND 65535 THEN (k * 701)::INT ELSE 8080 END AS port FROM p""",
}
