"""The API description of a generated project, which every target shares."""

from __future__ import annotations

import json
import re
from typing import Any

from .model import Endpoint, Project, schema_kind

# What integers and unknown types are described as.
_TYPES = {"integer": "number", "number": "number", "boolean": "boolean", "array": "array", "object": "object"}


def schema_of(value: dict[str, Any]) -> dict[str, Any]:
    """A schema reduced to what the description shows, all the way down."""
    properties = value.get("properties")
    out: dict[str, Any] = {"type": _TYPES.get(schema_kind(value), "string")}
    if isinstance(properties, dict):
        out["properties"] = {str(k): schema_of(v if isinstance(v, dict) else {}) for k, v in properties.items()}
    if isinstance(value.get("items"), dict):
        out["items"] = schema_of(value["items"])
    if isinstance(value.get("required"), list) and value["required"]:
        out["required"] = [str(r) for r in value["required"]]
    if isinstance(value.get("format"), str):
        out["format"] = value["format"]
    return out


def _operation(e: Endpoint) -> dict[str, Any]:
    body = {"content": {"application/json": {"schema": {"$ref": f"#/components/schemas/{e.model}Request"}}}}
    answer: dict[str, Any] = {"description": "Success"}
    if e.success != 204:
        answer["content"] = {"application/json": {"schema": {"$ref": f"#/components/schemas/{e.model}Response"}}}
    out: dict[str, Any] = {"operationId": e.handler, "summary": e.summary}
    if e.has_body:
        out["requestBody"] = body
    return out | {"responses": {str(e.success): answer}}


def description(p: Project) -> dict[str, Any]:
    """Operations by path and method; the first of two with the same path and method stands."""
    paths: dict[str, dict[str, Any]] = {}
    schemas: dict[str, Any] = {}
    for e in p.endpoints:
        if paths.setdefault(e.route, {}).setdefault(e.method, _operation(e))["operationId"] == e.handler:
            schemas[f"{e.model}Request"] = schema_of(e.request or {"type": "object", "properties": {}})
            schemas[f"{e.model}Response"] = schema_of(e.response or {"type": "object", "properties": {}})
    parts = []
    for n in p.others:
        config = n.get("config") if isinstance(n.get("config"), dict) else {}
        part = {"id": str(n.get("id") or ""), "type": str(n.get("type") or ""), "name": str(n.get("name") or ""), "config": [str(k) for k in config][:8]}
        schema = n.get("schema") or config.get("schema")
        if isinstance(schema, dict) and schema:
            name = re.sub(r"[^A-Za-z0-9]", "", f"{part['type']} {part['id']}") or "Component"
            schemas.setdefault(name, schema_of(schema))
            part["schemaRef"] = f"#/components/schemas/{name}"
        parts.append(part)
    components = {"schemas": schemas}
    return {"openapi": "3.0.3", "info": {"title": p.name, "version": "0.1.0"}, "paths": paths, "components": components, "x-components": parts}


def _scalar(value: Any) -> str:
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return "true" if value is True else "false" if value is False else "null" if value is None else str(value)


def yaml_text(value: Any, depth: int = 0) -> str:
    """YAML in block style with quoted strings; empty lists and maps are written as such."""
    pad = "  " * depth
    if isinstance(value, dict) and value:
        rows = []
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            rows.append(f"{pad}{json.dumps(str(k), ensure_ascii=False)}:" + (f"\n{yaml_text(v, depth + 1)}" if nested else f" {yaml_text(v)}\n"))
        return "".join(rows)
    if isinstance(value, list) and value:
        rows = []
        for v in value:
            nested = isinstance(v, (dict, list)) and v
            rows.append(f"{pad}-\n{yaml_text(v, depth + 1)}" if nested else f"{pad}- {yaml_text(v)}\n")
        return "".join(rows)
    return "{}" if value == {} else "[]" if value == [] else _scalar(value)
