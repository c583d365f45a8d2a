"""DuckDB SQL for the rows of the queries."""

from __future__ import annotations

from . import document_oracles

# The words by which types are classified, here in the other engine's own regular expressions.
_HTTP = r"(type IN ('http','https','rest','api','graphql','gateway','bff','grpc') OR regexp_matches(type, '\b(api|gateway|bff|graphql|grpc)\b'))"
_DB = r"regexp_matches(type, '\b(db|database|datastore)\b|postgres|mongodb|mysql|sqlite|redis|cassandra|dynamo|sql|nosql|warehouse|s3')"
_AUTH = r"regexp_matches(type, '\b(auth|authentication|authorization|middleware|security|iam|idp|identity)\b|oauth|jwt|saml|keycloak|okta|cognito|auth0|ldap|sso')"
_QUEUE = r"regexp_matches(type, '\b(queue|topic|stream|pubsub|event|bus)\b|kafka|sns|sqs|amqp|mqtt|nats|rabbitmq|pulsar')"

SUPPLY = f"""
WITH RECURSIVE placed AS (SELECT c_nationkey AS g, o_orderkey, o_orderstatus, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (SELECT g, l.* FROM lineitem l JOIN placed ON l_orderkey = o_orderkey),
n AS MATERIALIZED (
  SELECT *, {_HTTP} AS http, {_DB} AS db, {_AUTH} AS auth, {_QUEUE} AS queue FROM (
  SELECT c_nationkey AS graph_id, c_custkey AS ord, 'c' || c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 'gateway' WHEN 'BUILDING' THEN 'http'
    WHEN 'AUTOMOBILE' THEN 'rest-api' WHEN 'FURNITURE' THEN 'service' ELSE 'oauth-proxy' END AS type, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS name FROM customer
  UNION ALL SELECT g, 1000000000000 + o_orderkey, 'o' || o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'service' WHEN 'O' THEN 'kafka-topic' ELSE 'processor' END, 'x' FROM placed
  UNION ALL SELECT n_nationkey, 2000000000000 + p_partkey, 'p' || p_partkey, CASE p_type WHEN 'SMALL' THEN 'redis-cache' WHEN 'PROMO' THEN 'iam' ELSE 'service' END, 'x' FROM part, nation
  UNION ALL SELECT DISTINCT g, 3000000000000 + l_suppkey, 's' || l_suppkey, 'postgres', 'x' FROM lines)
), e AS MATERIALIZED (
  SELECT g AS graph_id, src, dst, row_number() OVER (PARTITION BY g ORDER BY k, k0, k1, k2, k3) - 1 AS i FROM (
  SELECT g, 'c' || c_custkey AS src, 'o' || o_orderkey AS dst, 1 AS k, o_orderkey AS k0, 0 AS k1, 0 AS k2, 0 AS k3 FROM placed
  UNION ALL SELECT g, 'o' || l_orderkey, 'p' || l_partkey, 2, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lines
  UNION ALL SELECT g, 'p' || l_partkey, 's' || l_suppkey, 3, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lines
  UNION ALL SELECT c_nationkey, 'c' || c_custkey, 'p' || c_custkey, 4, c_custkey, 0, 0, 0 FROM customer)
), v AS MATERIALIZED (SELECT e.* FROM e JOIN n a ON a.graph_id = e.graph_id AND a.id = src JOIN n b ON b.graph_id = e.graph_id AND b.id = dst),
d AS MATERIALIZED (
  SELECT n.*, coalesce(o, 0) AS outs, coalesce(x, 0) AS ins FROM n
  LEFT JOIN (SELECT graph_id, src AS id, count(*) AS o FROM v GROUP BY 1, 2) USING (graph_id, id)
  LEFT JOIN (SELECT graph_id, dst AS id, count(*) AS x FROM v GROUP BY 1, 2) USING (graph_id, id)
)"""

_COLUMNS = "graph_id, code, node_id, edge_index, message"


def _node(code: str, where: str, message: str) -> str:
    return f"SELECT graph_id, '{code}' AS code, id AS node_id, NULL::INT AS edge_index, {message} AS message FROM d WHERE {where}"


# each part selects from the relations of SUPPLY
_PARTS = {
    "lint_direct_db": """SELECT DISTINCT v.graph_id, 'IR-LINT-DIRECT-DB-ACCESS-002' AS code, src AS node_id, NULL::INT AS edge_index,
  'API node "' || src || '" connects directly to datastore node "' || dst || '"' AS message
  FROM v JOIN n a ON a.graph_id = v.graph_id AND a.id = src JOIN n b ON b.graph_id = v.graph_id AND b.id = dst WHERE a.http AND b.db""",
    "lint_high_fanout": _node("IR-LINT-HIGH-FANOUT-004", "outs >= 5", "'Node \"' || id || '\" has ' || outs || ' outgoing dependencies (threshold 5)'"),
    "lint_sync_chain": """SELECT graph_id, 'IR-LINT-SYNC-CHAIN-001' AS code, NULL AS node_id, NULL::INT AS edge_index,
  'Long synchronous dependency chain from HTTP entry (depth ≈ ' || depth || ' hops; async-marked edges excluded)' AS message FROM (SELECT graph_id, max(k) AS depth FROM walk GROUP BY 1) WHERE depth >= 3""",
    "lint_isolated": _node("IR-LINT-ISOLATED-NODE-005", "outs = 0 AND ins = 0", "'Node \"' || id || '\" is not connected to any edge (disconnected subgraph)'"),
    "lint_duplicate_edge": """SELECT graph_id, 'IR-LINT-DUPLICATE-EDGE-006' AS code, src AS node_id, i::INT AS edge_index,
  'Duplicate edge from "' || src || '" to "' || dst || '" (also at index ' || first || ')' AS message
  FROM (SELECT *, min(i) OVER (PARTITION BY graph_id, src, dst) AS first FROM e) WHERE i > first""",
    "lint_missing_name": _node("IR-LINT-HTTP-MISSING-NAME-007", "http AND name = ''", "'HTTP-like node \"' || id || '\" has no display name'"),
    "lint_datastore_no_incoming": _node("IR-LINT-DATASTORE-NO-INCOMING-008", "db AND ins = 0", "'Datastore-like node \"' || id || '\" has no incoming edges'"),
    "lint_multiple_entries": """SELECT graph_id, 'IR-LINT-MULTIPLE-HTTP-ENTRIES-009' AS code, NULL AS node_id, NULL::INT AS edge_index,
  'Multiple HTTP entry nodes with no incoming edges (' || count(*) || '): ' || string_agg(id, ', ' ORDER BY ord) AS message
  FROM d WHERE http AND ins = 0 GROUP BY graph_id HAVING count(*) > 1""",
    "lint_missing_auth": _node(
        "IR-LINT-MISSING-AUTH-010",
        "http AND ins = 0 AND NOT EXISTS (SELECT 1 FROM v JOIN n b ON b.graph_id = v.graph_id AND b.id = dst WHERE v.graph_id = d.graph_id AND src = d.id AND b.auth)",
        "'HTTP entry node \"' || id || '\" has no auth node or auth config in its immediate graph neighbourhood'",
    ),
    "lint_dead_node": _node("IR-LINT-DEAD-NODE-011", "outs = 0 AND ins > 0 AND NOT db AND NOT queue AND NOT http", "'Node \"' || id || '\" (type: ' || type || ') receives edges but has no outgoing edges — possible missing integration or dead component'"),
}

_WALK = """, sync AS MATERIALIZED (SELECT v.* FROM v JOIN n b ON b.graph_id = v.graph_id AND b.id = dst WHERE NOT b.queue),
walk AS (
  SELECT graph_id, id, 0 AS k FROM n WHERE http AND NOT EXISTS (SELECT 1 FROM sync WHERE sync.graph_id = n.graph_id AND dst = n.id)
  UNION SELECT sync.graph_id, sync.dst, k + 1 FROM walk JOIN sync ON sync.graph_id = walk.graph_id AND sync.src = walk.id
)"""

# every turn leads to one other at most, so a walk from an entry is a path until it ends or meets itself
_TALKS = """
WITH RECURSIVE n AS MATERIALIZED (SELECT coalesce(conv_id::VARCHAR, '') AS g, conv_id, turn, max(role) AS role FROM conversations GROUP BY ALL),
e AS MATERIALIZED (SELECT a.g, a.turn AS src, b.turn AS dst FROM n a JOIN n b ON a.g = b.g AND b.turn = a.turn + 1 UNION ALL SELECT g, max(turn), min(turn) FROM n WHERE conv_id % 10 = 0 GROUP BY 1),
h AS MATERIALIZED (SELECT g, turn, EXISTS (SELECT 1 FROM e WHERE e.g = n.g AND dst = n.turn) AS entered FROM n WHERE role = 'user')"""
_DEPTHS = f"""{_TALKS}, w AS (
  SELECT g, turn AS root, turn, 0 AS k, [turn] AS seen, false AS closed FROM h WHERE NOT entered OR g NOT IN (SELECT g FROM h WHERE NOT entered)
  UNION ALL SELECT e.g, root, e.dst, k + 1, list_append(seen, e.dst), list_contains(seen, e.dst) FROM w JOIN e ON e.g = w.g AND e.src = w.turn WHERE NOT closed
) SELECT nullif(g, '')::BIGINT AS graph_id, max(k) AS max_depth FROM w GROUP BY 1"""
_CYCLES = f"""{_TALKS} SELECT conv_id AS graph_id, string_agg('t' || turn, ' ' ORDER BY turn) AS path FROM n WHERE conv_id % 10 = 0 GROUP BY 1 HAVING max(turn) - min(turn) + 1 = count(*)"""

_PATHS = r"pages_path AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)"
_HEALTH = f"""
WITH {_PATHS}, h AS (
  SELECT page_id % 20 AS graph_id, page_id, path || CASE WHEN page_id % 20 = 3 AND page_id % 7 IN (0, 1, 3) THEN '' WHEN page_id % 7 = 0 THEN '/health' WHEN page_id % 7 = 1 THEN '/healthz?x=1' WHEN page_id % 7 = 2 THEN '/unhealthy' WHEN page_id % 7 = 3 THEN '/ping/' WHEN page_id % 7 = 4 THEN '/statusx' ELSE '' END AS path
  FROM pages_path
), f AS (SELECT *, regexp_matches(lower(path), '(^|/)(healthz?|healthcheck|ping|status|alive|live|ready)(/|$|\\?)') AS is_health FROM h)"""
_METHOD = "['get','post','put','patch','delete','options','head'][page_id % 7 + 1]"
_SLUG = rf"left('openapi_' || lower(regexp_replace(regexp_replace({_METHOD} || '_' || path, '[^a-zA-Z0-9]+', '_', 'g'), '^_|_$', '', 'g')), 80)"

_DAMAGED = """
WITH n AS (SELECT o_orderkey AS ord, (CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey - 1 ELSE o_orderkey END)::VARCHAR AS id FROM orders),
c AS (SELECT id, count(*) AS k FROM n GROUP BY 1),
e AS (SELECT o_orderkey AS i, (CASE WHEN o_orderkey % 37 = 0 THEN -1 ELSE o_orderkey END)::VARCHAR AS src, '7' AS dst FROM orders),
s AS (SELECT i, 'source' AS word, 'FROM' AS name, src AS id FROM e UNION ALL SELECT i, 'target', 'TO', dst FROM e),
k AS (SELECT s.*, coalesce(k, 0) AS k FROM s LEFT JOIN c USING (id))"""
_COUNTS = " UNION ALL ".join(f"SELECT graph_id, code FROM ({p})" for p in _PARTS.values())
_NO_HEALTH = "SELECT DISTINCT graph_id, 'IR-LINT-NO-HEALTHCHECK-003' AS code FROM n WHERE http"

SQL: dict[str, str] = {
    "classify_nodes": f"{SUPPLY} SELECT graph_id, id, type, type IN ('http','https','rest','api','graphql') AS is_http_endpoint, http AS is_http_like, db AS is_db_like, auth AS is_auth_like, queue AS is_queue_like FROM n",
    "degree_table": f"{SUPPLY} SELECT graph_id, id, outs AS out_deg, ins AS in_deg FROM d",
    **{name: f"{SUPPLY}{_WALK if name == 'lint_sync_chain' else ''} SELECT {_COLUMNS} FROM ({part})" for name, part in _PARTS.items()},
    "lint_no_healthcheck": f"{_HEALTH} SELECT graph_id, 'IR-LINT-NO-HEALTHCHECK-003' AS code FROM f GROUP BY 1 HAVING NOT bool_or(is_health)",
    "health_url_flags": f"{_HEALTH} SELECT page_id, path, is_health FROM f",
    "sync_chain_depth": _DEPTHS,
    "sync_chain_depth_in_rounds": _DEPTHS,
    "async_edges": """SELECT event_id, event_id % 11 = 0 OR event_id % 5 IN (1, 2) OR regexp_matches(CASE event_id % 6 WHEN 0 THEN 'upstream' WHEN 1 THEN 'kafka-link' ELSE lower(event_type) END, 'queue|topic|stream|kafka|sns|sqs|amqp|mqtt|nats') AS is_async FROM events""",
    "async_targets": f"{SUPPLY} SELECT e.graph_id, count(*) AS n, count(*) FILTER (WHERE b.queue) AS n_async FROM e LEFT JOIN n b ON b.graph_id = e.graph_id AND b.id = e.dst GROUP BY 1",
    "dup_node_id": f"""{_DAMAGED} SELECT 0 AS graph_id, ord AS item_ord, 'IR-STRUCT-DUP_NODE_ID' AS code, id AS node_id, NULL::INT AS edge_index, 'Duplicate node id "' || id || '"' AS message
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS r FROM n) WHERE r > 1""",
    "edge_unknown_endpoint": f"""{_DAMAGED} SELECT 0 AS graph_id, i AS item_ord, 'IR-STRUCT-EDGE_UNKNOWN_' || name AS code, id AS node_id, i::INT AS edge_index,
'Edge at index ' || i || ' references unknown ' || word || ' node "' || id || '"' AS message FROM k WHERE k = 0""",
    "edge_ambiguous": f"""{_DAMAGED} SELECT 0 AS graph_id, i AS item_ord, 'IR-STRUCT-EDGE_AMBIGUOUS_' || name AS code, id AS node_id, i::INT AS edge_index,
'Edge at index ' || i || ' references duplicate node id "' || id || '" (ambiguous ' || word || ')' AS message FROM k WHERE k > 1""",
    "http_path_method": f"""WITH {_PATHS}, n AS (
  SELECT page_id % 20 AS graph_id, 'n' || page_id AS id, CASE WHEN page_id % 6 = 0 THEN substr(path, 2) ELSE path END AS path,
    ['get','POST','Put','fetch','delete','trace','HEAD'][page_id % 7 + 1] AS method, ['http','rest','gateway','graphql','service'][page_id % 5 + 1] AS type FROM pages_path)
SELECT graph_id, id AS node_id, 'IR-STRUCT-HTTP_PATH' AS code, 'HTTP endpoint node "' || id || '" has invalid path: config.url must be a non-empty string starting with /' AS message
  FROM n WHERE type IN ('http', 'rest', 'graphql') AND NOT starts_with(path, '/')
UNION ALL SELECT graph_id, id, 'IR-STRUCT-HTTP_METHOD', 'HTTP endpoint node "' || id || '" has unsupported method "' || method || '"'
  FROM n WHERE type IN ('http', 'rest', 'graphql') AND upper(method) NOT IN ('GET','POST','PUT','PATCH','DELETE','HEAD','OPTIONS')""",
    "cycle_graphs": _CYCLES,
    "cycle_graphs_in_rounds": _CYCLES,
    "findings_sorted_counts": f"{SUPPLY}{_WALK} SELECT graph_id, 'warning' AS severity, code, count(*) AS n FROM ({_COUNTS} UNION ALL {_NO_HEALTH}) GROUP BY 1, 3",
    "policy_gate": f"""{SUPPLY}, f AS (SELECT graph_id FROM ({_PARTS["lint_high_fanout"]}) UNION ALL SELECT graph_id FROM ({_PARTS["lint_duplicate_edge"]}))
SELECT g.graph_id, 0 AS n_errors, count(f.graph_id) AS n_warnings, count(f.graph_id) > 300 AS failed FROM (SELECT DISTINCT graph_id FROM n) g LEFT JOIN f ON f.graph_id = g.graph_id GROUP BY 1""",
    "drift_diff": r"""WITH x AS (SELECT 'd/' || doc_id AS path, text FROM documents),
a AS (SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN text || ' x' WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'x/' || doc_id, text FROM documents WHERE doc_id % 13 = 0),
r AS (SELECT coalesce(x.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'MISSING' WHEN x.path IS NULL THEN 'EXTRA' WHEN replace(x.text, chr(13) || chr(10), chr(10)) <> replace(a.text, chr(13) || chr(10), chr(10)) THEN 'MODIFIED' END AS c FROM x FULL JOIN a ON x.path = a.path)
SELECT 'DRIFT-' || c AS code, path, CASE c WHEN 'MISSING' THEN 'Expected generated file is missing from the comparison set' WHEN 'MODIFIED' THEN 'File content differs from deterministic export for this IR'
  ELSE 'File exists in comparison set but is not part of the deterministic export' END AS message FROM r WHERE c IS NOT NULL""",
    "openapi_nodes": f"""WITH {_PATHS} SELECT page_id AS doc_id, 0 AS node_ord, {_SLUG} AS id,
CASE page_id % 3 WHEN 0 THEN 'Page ' || page_id WHEN 1 THEN 'op' || page_id ELSE upper({_METHOD}) || ' ' || path END AS name, path AS url, upper({_METHOD}) AS method,
CASE WHEN page_id % 3 = 1 THEN 'op' || page_id END AS operation_id FROM pages_path""",
    "security_resolution": """SELECT page_id AS doc_id, CASE WHEN page_id % 5 = 0 THEN false END AS auth_required,
CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN 'alpha,zeta' WHEN page_id % 20 < 10 THEN 'bearer' END AS security FROM pages""",
    "slug_ids": rf"""WITH {_PATHS} SELECT page_id, {_SLUG} AS node_id,
left(lower(regexp_replace(regexp_replace(trim(' My Service/' || path), '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')), 63) AS service FROM pages_path""",
    "effective_edge_config": """WITH e AS (SELECT user_id, event_type, event_id, (props->>'$.k')::INT % 4 AS a FROM events),
p AS (SELECT user_id, event_type, min(event_id) AS i, arg_min(a, event_id) AS a FROM e GROUP BY 1, 2)
SELECT 0 AS graph_id, event_type AS dst, arg_max(a, i) FILTER (WHERE a <> 0) AS attempts FROM p GROUP BY 2""",
    "endpoint_table": f"""WITH {_PATHS}, n AS (SELECT *, ['http','cloudFunction','httpRequest','HTTP','service','rest'][page_id % 6 + 1] AS t, ['get','post','delete','post','put'][page_id % 5 + 1] AS m FROM pages_path)
SELECT page_id % 20 AS graph_id, page_id AS node_ord, 'n' || page_id AS id, path AS route, m AS method, m <> 'get' AS has_body,
CASE m WHEN 'post' THEN CASE WHEN page_id % 3 = 0 THEN 202 ELSE 201 END WHEN 'delete' THEN 204 ELSE 200 END AS success FROM n WHERE t IN ('http', 'cloudFunction', 'httpRequest')""",
    "other_nodes": """SELECT * FROM (SELECT page_id % 20 AS graph_id, 'n' || page_id AS id, ['http','cloudFunction','httpRequest','HTTP','service','rest'][page_id % 6 + 1] AS raw_type FROM pages) WHERE NOT contains(lower(raw_type), 'http')""",
    "predicates_in_sql": f"{SUPPLY} SELECT DISTINCT type, type IN ('http','https','rest','api','graphql') AS is_http_endpoint, http AS is_http_like, db AS is_db_like, auth AS is_auth_like, queue AS is_queue_like FROM n",
    **document_oracles.SQL,
}
