"""Projects, drift of projects, the command line, and validation of a stream."""

import ast
import json
import logging
import shutil
import subprocess
import time
from datetime import datetime, timezone

import pytest

from graphloom.cli import main
from graphloom.export import edge_code, fastapi
from graphloom.export.bundle import completed, host_port
from graphloom.export.model import edge_settings
from graphloom.export.pipeline import drifted, exported, one_document, project_files
from graphloom.sources.documents import parsed_description
from graphloom.streaming.validation import arriving, validate_stream

PAYMENT = {
    "metadata": {"name": "pay"},
    "graph": {
        "nodes": [
            {"id": "api", "type": "http", "name": "Api", "config": {"url": "/pay/{id}", "method": "POST", "schema": {"properties": {"amount": {"type": "integer"}, "a-b": {}}, "required": ["amount"]}}, "innerNodes": [{"type": "auth"}, {"type": "validate"}, {"type": "map", "name": "m"}]},
            {"id": "pay", "type": "cloudFunction", "config": {"route": "/charge", "method": "delete", "async": True}},
            {"id": "db", "type": "postgres"},
        ],
        "edges": [{"from": "api", "to": "pay", "config": {"timeout": 900, "retry": {"maxAttempts": 3, "backoffMs": 500, "strategy": "exponential"}, "circuitBreaker": {"enabled": True, "failureThreshold": 2}}}],
    },
}
BAD = {"graph": {"nodes": [{"id": "a"}, {"id": "a"}]}}


@pytest.mark.parametrize("target", ["python", "node"])
def test_files(target):
    files = project_files(PAYMENT, target, 18080)
    assert {"openapi.yaml", "README.md", "docker-compose.yml", "Dockerfile", "Makefile", "tests/contract.test.js"} < set(files)
    assert '"18080:8080"' in files["docker-compose.yml"] and "localhost:18080" in files["README.md"]
    spec, form = parsed_description(files["openapi.yaml"])
    assert form == "yaml" and set(spec["paths"]) == {"/pay/{id}", "/charge"} and list(spec["paths"]["/charge"]["delete"]["responses"]) == ["204"]
    main_file = files["app/main.py" if target == "python" else "app/index.js"]
    assert '{"maxAttempts":3,"backoffMs":500,"strategy":"exponential"}' in main_file
    if target == "python":
        ast.parse(main_file)
        assert "def retry_with_exponential_backoff(func, max_attempts=" in main_file
    assert files == project_files(PAYMENT, target, 18080)


def test_target_and_ports():
    with pytest.raises(ValueError):
        project_files(PAYMENT, "rust")
    assert [host_port(x) for x in (None, "90x", "0", 70000, " 81 ", "x")] == [8080, 90, 8080, 8080, 81, 8080]


def test_edge_settings():
    edges = [{"from": "a", "to": "t", "config": {"timeout": 0}}, {"from": "a", "to": "t", "config": {"timeout": 7}}, {"source": "b", "target": "t", "config": {"timeout": 5, "retry": {"maxAttempts": 0}}}]
    assert edge_settings(edges, "t") == {"timeout": 5}


def test_export_is_gated_by_graph(spark):
    docs = one_document(spark, PAYMENT, "good").unionByName(one_document(spark, BAD, "bad"))
    made = exported(docs, "python")
    assert {r["graph_id"] for r in made.files.select("graph_id").distinct().collect()} == {"good"}
    assert {(r["graph_id"], r["code"]) for r in made.structural.collect()} == {("bad", "IR-STRUCT-DUP_NODE_ID")}
    assert made.warnings.isEmpty()
    actual = made.files.where("path <> 'Makefile'").unionByName(spark.createDataFrame([("good", "extra", "")], made.files.schema))
    result = drifted(docs, "python", actual, strict_extra=True)
    assert sorted((r["graph_id"], r["code"], r["path"]) for r in result.findings.collect()) == [("bad", "DRIFT-NO-EXPORT", "."), ("good", "DRIFT-EXTRA", "extra"), ("good", "DRIFT-MISSING", "Makefile")]
    assert {r["graph_id"]: (r["ok"], r["extra_blocking"]) for r in result.verdicts.collect()} == {"good": (False, True), "bad": (False, False)}


def test_command_line(spark, tmp_path, capsys):
    ir, out = tmp_path / "ir.json", tmp_path / "out"
    ir.write_text(json.dumps(PAYMENT))
    assert main(["validate", "--ir", str(ir), "--json"], spark) == 0
    assert {f["layer"] for f in json.loads(capsys.readouterr().out)} == {"lint"}
    assert main(["export", "--ir", str(ir), "--target", "python", "--out", str(out), "--skip-host-port-check", "--max-warnings", "0"], spark) == 1
    assert not out.exists()
    assert main(["export", "--ir", str(ir), "--target", "python", "--out", str(out), "--skip-host-port-check", "--skip-ir-lint"], spark) == 0
    (out / "Dockerfile").unlink()
    capsys.readouterr()
    assert main(["validate-drift", "--ir", str(ir), "--target", "python", "--out", str(out), "--json", "--skip-ir-lint"], spark) == 1
    assert [f["code"] for f in json.loads(capsys.readouterr().out)["driftFindings"]] == ["DRIFT-MISSING"]
    (tmp_path / "g.yaml").write_text("nodes: [{id: a}]")
    assert main(["yaml-to-ir", "--yaml", str(tmp_path / "g.yaml")]) == 0
    assert json.loads(capsys.readouterr().out) == {"graph": {"nodes": [{"id": "a"}]}}
    assert main(["validate", "--ir", str(tmp_path / "none")], spark) == 1
    ir.write_text("null")
    assert main(["validate", "--ir", str(ir)], spark) == 1


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(PAYMENT))
    (folder / "b.json").write_text(json.dumps(BAD))
    query = validate_stream(arriving(spark, str(folder)), str(tmp_path / "found"), str(tmp_path / "check"), skip_lint=True)
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "found")).collect()
    assert [(r["graph_id"].rsplit("/", 1)[1], r["code"]) for r in got] == [("b.json", "IR-STRUCT-DUP_NODE_ID")]


@pytest.mark.parametrize(("target", "file", "auth", "valid"), [("python", "app/main.py", "status_code=401", "needs a body"), ("node", "app/index.js", "status(401)", "a body is needed")])
def test_transform_nodes_inside_are_read(target, file, auth, valid):
    inner = [{"type": "transform", "config": {"transform": t}} for t in ("authenticate", "validate")]
    made = {m: project_files({"graph": {"nodes": [{"id": "a", "type": "http", "config": {"url": "/a", "method": m}, "innerNodes": inner}]}}, target)[file] for m in ("POST", "GET")}
    assert auth in made["POST"] and valid in made["POST"] and auth in made["GET"] and valid not in made["GET"]


ALL_STEPS = [{"type": "transform", "config": {"transform": t}} for t in ("authenticate", "validate", "parse")] + [{"type": "retry", "config": {"maxAttempts": 4}}, {"kind": "error-handler", "type": "error-handler", "name": "eh"}, {"type": "map", "name": "m"}]


@pytest.mark.parametrize(("target", "file", "marks"), [("python", "app/main.py", ["authenticated(request)", "missing([", "parsed(body)", "work, 4, 1000)", 'guarded(work, "eh")', 'state["m"]']), ("node", "app/index.js", ["authenticated(req)", "state.missing", "parsed(body)", "maxAttempts: 4", '"eh")', 'state["m"]'])])
def test_all_steps_are_made(target, file, marks, tmp_path):
    node = {"id": "a", "type": "http", "config": {"url": "/a/{k}", "operation": "update", "primaryKey": "k", "retryPolicy": {"maxAttempts": 2, "strategy": "fixed", "odd": None, "yes": True}, "businessLogic": 'check "it" \\ \n now'}, "innerNodes": ALL_STEPS}
    made = project_files({"graph": {"nodes": [node, {"id": "d", "type": "postgres", "schema": {"properties": {"x": {"type": "integer"}}}}]}}, target)
    text = made[file]
    assert all(m in text for m in marks) and "update" in text and "now" in text
    spec, _ = parsed_description(made["openapi.yaml"])
    ref = spec["x-components"][0]["schemaRef"].rsplit("/", 1)[1]
    assert spec["components"]["schemas"][ref]["properties"] == {"x": {"type": "number"}}
    if target == "python":
        ast.parse(text)
    elif shutil.which("node"):
        (tmp_path / "index.mjs").write_text(text)
        subprocess.run(["node", "--check", str(tmp_path / "index.mjs")], check=True, timeout=60)


def test_generated_operations():
    class HTTPException(Exception):
        def __init__(self, status_code, detail):
            self.status_code, self.detail = status_code, detail

    names = {"logging": logging, "json": json, "time": time, "datetime": datetime, "timezone": timezone, "HTTPException": HTTPException, "ThreadPoolExecutor": lambda: None, "__name__": "made"}
    exec(fastapi._HELPERS, names)
    settings = {"operation": "read", "key": "k", "table": "t", "query": ""}
    page = names["operate"](settings, {}, {"page": "3", "pageSize": "2", "status": "new"})
    assert [r["k"] for r in page["rows"]] == ["3-1", "3-2"] and page["rows"][0]["status"] == "new"
    assert names["operate"]({**settings, "operation": "create"}, {"k": 5, "a": 1}, {})["created"]["k"] == 5
    assert names["operate"]({**settings, "operation": "delete"}, {}, {"k": "7"}) == {"deleted": True, "k": "7", "table": "t", "query": None}
    for operation in ("update", "delete"):
        with pytest.raises(HTTPException):
            names["operate"]({**settings, "operation": operation}, {"a": 1}, {})
    assert names["missing"](["a", "b"], {"a": 0}, {}) == ["b"] and names["parsed"]({"a": "[1]", "b": "x", "c": 2}) == {"a": [1], "b": "x", "c": 2}
    with pytest.raises(HTTPException) as e:
        names["guarded"](lambda: 1 / 0, "w")()
    assert e.value.status_code == 500


def ran(text, **more):
    names = dict(more)
    exec(text, names)
    return names


def test_retries_wait_as_asked(monkeypatch):
    waits = []
    monkeypatch.setattr(time, "sleep", waits.append)
    for strategy, wanted in (("exponential", [0.5, 1.0]), ("fixed", [0.5, 0.5])):
        waits.clear()
        names = ran(edge_code.retry_text({"config": {"retry": {"maxAttempts": 3, "backoffMs": 500, "strategy": strategy}}}, "python"))
        with pytest.raises(ZeroDivisionError):
            names[f"retry_with_{'exponential' if strategy == 'exponential' else 'linear'}_backoff"](lambda: 1 / 0)
        assert [int(w * 10) / 10 for w in waits] == wanted
    assert edge_code.retry_text({}, "python") == edge_code.breaker_text({}, "go") == ""
    assert "backoff_ms=1000" in edge_code.retry_text({"config": {"retry": {"maxAttempts": 1}}}, "python")


def test_breaker_opens_and_closes(monkeypatch):
    now = [0.0]
    monkeypatch.setattr(time, "monotonic", lambda: now[0])
    breaker = ran(edge_code.breaker_text({"config": {"circuitBreaker": {"enabled": True, "failureThreshold": 2}}}, "python"))["CircuitBreaker"]()
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            breaker.call(lambda: 1 / 0)
    with pytest.raises(RuntimeError):
        breaker.call(lambda: 1)
    now[0] = 61.0
    assert breaker.call(lambda: 1) == 1 and breaker.failures == 0


@pytest.mark.parametrize("edge", [{}, {"protocol": "http", "config": {"timeout": 5, "retry": {"maxAttempts": 3, "strategy": "fixed"}}}, {"config": {"circuitBreaker": {"enabled": True}, "retry": {"maxAttempts": 2}}}])
def test_clients(edge, tmp_path):
    text = edge_code.client_text(edge, "host/a", "GET", "python")
    ast.parse(text)
    assert f"{edge.get('protocol', 'https')}://host/a" in text and ("circuit" in text) == ("circuitBreaker" in edge.get("config", {}))
    if shutil.which("node"):
        (tmp_path / "client.mjs").write_text(edge_code.client_text(edge, "host/a", "GET", "nodejs"))
        subprocess.run(["node", "--check", str(tmp_path / "client.mjs")], check=True, timeout=60)
    assert all(edge_code.client_text(edge, "host/a", "GET", language).startswith("// client: GET ") for language in ("java", "csharp", "go"))
    with pytest.raises(ValueError):
        edge_code.client_text(edge, "host/a", "GET", "cobol")


def test_malformed_documents_have_no_files(spark):
    docs = spark.createDataFrame([("bad", "{"), ("none", None), ("foo", '{"foo":1}')], "graph_id string, raw string").unionByName(one_document(spark, PAYMENT, "good"))
    made = exported(docs, "node", skip_structural=True, skip_lint=True)
    assert {r["graph_id"] for r in made.files.select("graph_id").distinct().collect()} == {"good", "foo"}
    made = exported(docs.where("graph_id = 'foo'"), "node")
    assert [r["code"] for r in made.structural.collect()] == ["IR-STRUCT-NODES_NOT_ARRAY"]


def test_names_and_fields():
    nodes = [{"id": "a-1", "type": "http", "config": {"url": "/a", "fields": {"n": "integer", "o": {"properties": {}}, "l": {"items": {}}}}}, {"id": "b", "type": "http", "config": {"url": "/b", "name": "do it"}}, {"id": "a_1", "type": "http", "config": {"url": "/c", "fields": [{"name": "x", "type": "boolean"}, 5]}}]
    text = project_files({"graph": {"nodes": nodes}}, "python")["app/main.py"]
    ast.parse(text)
    for line in ("def handler_a_1(", "def do_it(", "def handler_a_1_2(", "    n: float | None", "    o: dict | None", "    l: list | None", "    x: bool | None"):
        assert line in text


def test_bundle_of_other_files():
    files = completed({"app/main.py": "uvicorn.run(app, port = 8000)", "README.md": " "}, "python", 9000)
    assert files["app/main.py"] == "uvicorn.run(app, port = 8080)" and files["README.md"].startswith("# Generated service") and "localhost:9000" in files["README.md"]
    assert completed(files, "python", 9000)["README.md"] == files["README.md"]
    files = completed({"app/index.js": "app.listen(process.env.PORT || 3000)", "package.json": '{"scripts": {"dev": "x", "lint": "y"}}'}, "node")
    assert "|| 8080" in files["app/index.js"] and json.loads(files["package.json"])["scripts"] == {"start": "node app/index.js", "dev": "node --watch app/index.js", "lint": "y"}
