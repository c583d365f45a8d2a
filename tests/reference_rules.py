"""A plain row-at-a-time statement of the graph rules, for comparison with the tables' results."""

import re

W = r"(?<![A-Za-z0-9_])(?:%s)(?![A-Za-z0-9_])"


def text(v):
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, dict):
        return "[object Object]"
    if isinstance(v, list):
        return ",".join("" if x is None else text(x) for x in v)
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def first(d, *names):
    return next((d[n] for n in names if isinstance(d, dict) and d.get(n) is not None), None)


def s(v):
    return text(v).strip() if v is not None else ""


def http(t):
    return t in "http https rest api graphql gateway bff grpc".split() or bool(re.search(W % "api|gateway|bff|graphql|grpc", t))


def db(t):
    return bool(re.search(W % "db|database|datastore" + "|postgres|mongodb|mysql|sqlite|redis|cassandra|dynamo|sql|nosql|warehouse|s3", t))


def auth(t):
    return bool(re.search(W % "auth|authentication|authorization|middleware|security|iam|idp|identity" + "|oauth|jwt|saml|keycloak|okta|cognito|auth0|ldap|sso", t))


def queue(t):
    return bool(re.search(W % "queue|topic|stream|pubsub|event|bus" + "|kafka|sns|sqs|amqp|mqtt|nats|rabbitmq|pulsar", t))


def structural(ir):
    """(code, node, edge) of all structural findings, as emitted."""
    if not isinstance(ir, (dict, list)):
        return [("INVALID_ROOT", None, None)]
    if isinstance(ir, list):
        return [("NO_GRAPH", None, None)]
    g = ir["graph"] if isinstance(ir.get("graph"), (dict, list)) else ir if isinstance(ir.get("nodes"), list) else None
    if g is None:
        return [("NO_GRAPH", None, None)]
    nodes = g.get("nodes") if isinstance(g, dict) else None
    if not isinstance(nodes, list):
        return [("NODES_NOT_ARRAY", None, None)]
    if not nodes:
        return [("EMPTY_GRAPH", None, None)]
    out = []
    edges = g.get("edges")
    if "edges" in g and not isinstance(edges, list):
        out.append(("EDGES_NOT_ARRAY", None, None))
    edges = edges if isinstance(edges, list) else []
    count = {}
    for n in nodes:
        if not isinstance(n, (dict, list)):
            out.append(("NODE_INVALID", None, None))
            continue
        i = s(first(n, "id"))
        if not i:
            out.append(("NODE_NO_ID", None, None))
            continue
        count[i] = count.get(i, 0) + 1
        if count[i] > 1:
            out.append(("DUP_NODE_ID", i, None))
        if "config" in n and not isinstance(n["config"], dict):
            out.append(("NODE_INVALID_CONFIG", i, None))
        if s(first(n, "type", "kind")).lower() in ("http", "https", "rest", "api", "graphql"):
            c = n.get("config") if isinstance(n.get("config"), dict) else {}
            if not s(first(c, "url", "route")).startswith("/"):
                out.append(("HTTP_PATH", i, None))
            m = first(c, "method")
            if (s(m) if m is not None else "post").upper() not in "GET POST PUT PATCH DELETE HEAD OPTIONS".split():
                out.append(("HTTP_METHOD", i, None))
    good = []
    for k, e in enumerate(edges):
        if not isinstance(e, (dict, list)):
            out.append(("EDGE_INVALID", None, k))
            continue
        a, b = s(first(e, "from", "source")), s(first(e, "to", "target"))
        if not a or not b:
            out.append(("EDGE_NO_ENDPOINTS", None, k))
            continue
        for end, name in ((a, "FROM"), (b, "TO")):
            if count.get(end, 0) != 1:
                out.append((f"EDGE_{'AMBIGUOUS' if end in count else 'UNKNOWN'}_{name}", end, k))
        if count.get(a) == 1 and count.get(b) == 1:
            good.append((a, b))
    cycle = first_cycle(good)
    return out + ([("CYCLE", cycle[0], None)] if cycle else [])


def first_cycle(edges):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, []).append(b)
    done, path = set(), []

    def visit(u):
        if u in path:
            return path[path.index(u) :]
        if u in done:
            return None
        path.append(u)
        for v in adj.get(u, ()):
            found = visit(v)
            if found:
                return found
        path.pop()
        done.add(u)
        return None

    for root in list(adj):
        found = visit(root)
        if found:
            return found
    return None


def is_async(e, target):
    c = e.get("config") if isinstance(e.get("config"), dict) else {}
    m = dict(e["metadata"]) if isinstance(e.get("metadata"), dict) else {}
    if s(e.get("kind")) and not s(m.get("kind")):
        m["kind"] = s(e["kind"])
    if m.get("async") is True or c.get("async") is True:
        return True
    p, k = (first(m, n) if first(m, n) is not None else first(c, n) for n in ("protocol", "kind"))
    if p is not None and text(p).lower() in ("async", "message", "queue", "event", "pubsub"):
        return True
    if k is not None and re.search("queue|topic|stream|kafka|sns|sqs|amqp|mqtt|nats", text(k).lower()):
        return True
    return target is not None and queue(target)


def sync_depth(starts, adj):
    best = 0
    for start in starts:
        memo = {}

        def depth(u, stack):
            if u in stack:
                return 0
            if u not in memo:
                memo[u] = max((1 + depth(v, stack | {u}) for v in adj.get(u, ())), default=0)
            return memo[u]

        best = max(best, depth(start, frozenset()))
    return best


def lint(ir):
    """(code, node, edge) of all lint findings of a well-shaped document, as emitted."""
    g = ir["graph"]
    nodes = {}
    for n in g["nodes"]:
        i = s(first(n, "id"))
        if i:
            nodes[i] = {"type": s(first(n, "type", "kind")).lower(), "name": s(n.get("name")), "config": n.get("config") if isinstance(n.get("config"), dict) else {}}
    edges = g.get("edges") or []
    ends = [(s(first(e, "from", "source")), s(first(e, "to", "target"))) for e in edges]
    valid = [(a, b) for a, b in ends if a in nodes and b in nodes]
    outs, ins = {}, {}
    for a, b in valid:
        outs[a] = outs.get(a, 0) + 1
        ins[b] = ins.get(b, 0) + 1
    kind = {i: n["type"] for i, n in nodes.items()}
    found, seen = [], set()
    for a, b in valid:
        if http(kind[a]) and db(kind[b]) and (a, b) not in seen:
            seen.add((a, b))
            found.append(("DIRECT-DB-ACCESS-002", a, None))
    found += [("HIGH-FANOUT-004", i, None) for i, k in outs.items() if k >= 5]
    sync = [(a, b) for e, (a, b) in zip(edges, ends, strict=True) if not is_async(e, kind.get(b))]
    entered, adj = {b for _, b in sync if b}, {}
    for a, b in sync:
        if a in nodes and b in nodes:
            adj.setdefault(a, []).append(b)
    https = [i for i in nodes if http(kind[i])]
    if sync_depth([i for i in https if i not in entered] or https, adj) >= 3:
        found.append(("SYNC-CHAIN-001", None, None))
    if https and not any(re.search(r"(^|/)(healthz?|healthcheck|ping|status|alive|live|ready)(/|$|\?)", s(first(nodes[i]["config"], "url")).lower()) for i in https):
        found.append(("NO-HEALTHCHECK-003", None, None))
    if edges and len(nodes) > 1:
        found += [("ISOLATED-NODE-005", i, None) for i in nodes if i not in outs and i not in ins]
    pairs = {}
    for k, (a, b) in enumerate(ends):
        if a and b:
            if (a, b) in pairs:
                found.append(("DUPLICATE-EDGE-006", a, k))
            pairs.setdefault((a, b), k)
    found += [("HTTP-MISSING-NAME-007", i, None) for i in https if not nodes[i]["name"]]
    found += [("DATASTORE-NO-INCOMING-008", i, None) for i in nodes if db(kind[i]) and i not in ins]
    entries = [i for i in https if i not in ins]
    if len(entries) > 1:
        found.append(("MULTIPLE-HTTP-ENTRIES-009", None, None))
    for i in entries:
        keys = {k.lower() for k in nodes[i]["config"]}
        if not any(a == i and auth(kind[b]) for a, b in valid) and not keys & {"auth", "authrequired", "authentication", "authorization", "security"}:
            found.append(("MISSING-AUTH-010", i, None))
    found += [("DEAD-NODE-011", i, None) for i in nodes if i not in outs and i in ins and not db(kind[i]) and not queue(kind[i]) and not http(kind[i])]
    return found
