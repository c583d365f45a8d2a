"""What a generator knows of one graph: its endpoints, its other nodes, and what its edges ask of their targets.

Works on one parsed document, since a project is the files of one document; a corpus is generated document by document
in Arrow batches.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

# Types of which endpoints are made, and what holds if neither edge nor node says otherwise.
ENDPOINT_TYPES = ("cloudFunction", "http", "httpRequest")
TIMEOUT_MS, RETRY = 2000, {"maxAttempts": 2, "backoffMs": 500}


def safe_id(text: Any) -> str:
    return re.sub(r"[^A-Za-z0-9_-]", "_", str(text if text is not None else ""))


def identifier(text: Any, fallback: str = "handler") -> str:
    name = re.sub(r"\W+", "_", str(text or ""), flags=re.ASCII).strip("_").lower() or fallback
    return f"n_{name}" if name[0].isdigit() else name


def compact(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def literal(value: Any) -> str:
    """A JSON value as Python writes it, without blanks."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{compact(str(k))}:{literal(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(literal, value)) + "]"
    return str(value) if value is None or isinstance(value, bool) else compact(value)


def one_line(text: Any) -> str:
    """A text that fits into a comment."""
    return " ".join(str(text).split())


def _record(value: Any) -> dict[str, Any]:
    return value if isinstance(value, dict) else {}


@dataclass
class Step:
    """What an inner node does: authenticate, validate, parse, retry, guard, or something of its own, which `kind` then
    says. attempts: of a retry."""

    kind: str
    label: str
    attempts: int = 1


def step(node: dict[str, Any]) -> Step:
    """A transform node does what its config's transform says, others what their type or config says."""
    kind, config = str(node.get("type") or node.get("kind") or "step").lower(), _record(node.get("config"))
    told = config.get("transform") if kind == "transform" else None
    told = told.lower() if isinstance(told, str) and told else kind
    label = str(node.get("name") or node.get("id") or "step")
    for part, does in (("auth", "authenticate"), ("valid", "validate"), ("parse", "parse")):
        if part in told:
            return Step(does, label)
    if kind == "retry" or config.get("retryPolicy"):
        asked = {**_record(config.get("retryPolicy")), **config}
        number = asked.get("maxAttempts") or asked.get("max_attempts") or 3
        return Step("retry", label, int(number) if str(number).isdigit() else 3)
    if kind == "error-handler" or config.get("errorHandling"):
        return Step("guard", label)
    return Step(told, label)


@dataclass
class Endpoint:
    id: str
    handler: str
    model: str
    route: str
    method: str
    success: int
    summary: str
    request: dict[str, Any]
    response: dict[str, Any]
    timeout_ms: int
    retry: dict[str, Any]
    breaker: dict[str, Any] | None
    steps: list[Step] = field(default_factory=list)
    note: str = ""
    settings: dict[str, Any] = field(default_factory=dict)

    @property
    def has_body(self) -> bool:
        return self.method != "get"


@dataclass
class Project:
    name: str
    endpoints: list[Endpoint]
    others: list[dict[str, Any]]


def edge_settings(edges: list[Any], node: str) -> dict[str, Any]:
    """timeout, retry and circuitBreaker of the edges to a node: of parallel edges the first one's configuration counts,
    of several sources the last that has a value that isn't empty or 0."""
    first: dict[str, dict[str, Any]] = {}
    found: dict[str, Any] = {}
    ends = [(str(e.get("from") or e.get("source") or ""), str(e.get("to") or e.get("target") or ""), e) for e in edges if isinstance(e, dict)]
    for source, target, edge in ends:
        if target == node:
            config = first.setdefault(source, _record(edge.get("config")))
            if config.get("timeout"):
                found["timeout"] = config["timeout"]
            if (_record(config.get("retry")).get("maxAttempts") or 0) > 0:
                found["retry"] = config["retry"]
            if _record(config.get("circuitBreaker")).get("enabled"):
                found["circuitBreaker"] = config["circuitBreaker"]
    return found


def schema_kind(value: dict[str, Any]) -> str:
    """A schema's type, told or by what it has."""
    kind = value.get("type") or value.get("dataType")
    return str(kind) if kind else "object" if isinstance(value.get("properties"), dict) else "array" if "items" in value else "string"


def _schema(value: Any) -> dict[str, Any]:
    """A schema as an object with properties; a list of fields becomes one, and so does a map of fields."""
    if isinstance(value, list):
        value = {"type": "object", "properties": {str(f.get("name")): {"type": f.get("type", "string")} for f in value if isinstance(f, dict) and f.get("name")}}
    if not isinstance(value, dict):
        return {}
    if value and not any(k in value for k in ("type", "dataType", "properties", "items", "required", "$ref")):
        value = {"type": "object", "properties": {str(k): v if isinstance(v, dict) else {"type": str(v)} for k, v in value.items()}}
    return value


def endpoint(node: dict[str, Any], edges: list[Any], merge_data: bool) -> Endpoint:
    own = _record(node.get("config"))
    config = {**own, **_record(_record(node.get("data")).get("config"))}
    asked = config if merge_data else own
    id_ = safe_id(node.get("id") or node.get("name"))
    method = str(asked.get("method") or "post").lower()
    later = any(config.get(k) is True for k in ("async", "asyncProcessing", "accepted"))
    by_edges = edge_settings(edges, str(node.get("id") or ""))
    route = str(asked.get("route") or asked.get("url") or f"/{id_}")
    return Endpoint(
        id=str(node.get("id") or ""),
        handler=identifier(own["name"]) if own.get("name") else f"handler_{identifier(id_, 'node')}",
        model=re.sub(r"[^A-Za-z0-9]", "", id_) or "Request",
        route=route if route.startswith("/") else f"/{route}",
        method=method,
        success={"post": 202 if later else 201, "delete": 204}.get(method, 200),
        summary=str(node.get("name") or node.get("id") or route),
        request=_schema(config.get("schema") or config.get("fields")),
        response=_schema(config.get("responseSchema") or config.get("response_schema") or config.get("response")),
        timeout_ms=int(by_edges.get("timeout") or config.get("timeoutMs") or TIMEOUT_MS),
        retry=by_edges.get("retry") or config.get("retryPolicy") or dict(RETRY),
        breaker=by_edges.get("circuitBreaker"),
        steps=[step(n) for n in node.get("innerNodes") or [] if isinstance(n, dict)],
        note=one_line(config.get("businessLogic") or node.get("businessLogic") or node.get("description") or ""),
        settings={"operation": str(config.get("operation") or "read"), "key": str(config.get("primaryKey") or "id"), "table": str(config.get("table") or "records"), "query": str(config.get("query") or "")},
    )


def project(document: Any, name: str | None = None, merge_data: bool = True, fallback: str = "generated") -> Project:
    """The project of a graph document, wrapped or bare; names come from the outer metadata."""
    outer = _record(document)
    graph = _record(outer.get("graph")) if outer.get("graph") else outer
    nodes = [n for n in graph.get("nodes") or [] if isinstance(n, dict)]
    edges = graph.get("edges") if isinstance(graph.get("edges"), list) else []
    made = [endpoint(n, edges, merge_data) for n in nodes if n.get("type") in ENDPOINT_TYPES]
    taken: set[str] = set()
    for e in made:
        # names that two endpoints would share get a number
        for part, join in (("handler", "_"), ("model", "")):
            own = getattr(e, part)
            setattr(e, part, next(name for name in (own, *(f"{own}{join}{k}" for k in range(2, 2 * len(made) + 2))) if name not in taken))
            taken.add(getattr(e, part))
    others = [n for n in nodes if "http" not in str(n.get("type") or "").lower()]
    return Project(str(name or _record(outer.get("metadata")).get("name") or fallback), made, others)
