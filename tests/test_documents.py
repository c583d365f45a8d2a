"""Sources, API descriptions, drift and configurations of edges."""

import json

import pytest

from graphloom.operators import drift, endpoints, openapi
from graphloom.sources import documents as D
from graphloom.sources.sinks import canonical_json, canonical_texts, serialized, write_tree, write_trees

YAML = "graph:\n  metadata: {name: x}\n  nodes:\n    - id: yes\n      type: http\n      since: 2024-01-01\n      config: {url: /signup, on: true, port: 0o17}\n"


def test_yaml_has_the_types_of_json():
    node = D.canonical_of_yaml(YAML)["graph"]["nodes"][0]
    assert node["id"] == "yes" and node["since"] == "2024-01-01" and node["config"] == {"url": "/signup", "on": True, "port": 15}


@pytest.mark.parametrize("text", ["a: [", "- 1", "5", "", "x: 1", "graph: [1]", "graph: {a: 1, a: 2}"])
def test_yaml_errors(text):
    with pytest.raises(D.YamlError):
        D.canonical_of_yaml(text)


def test_bare_yaml_is_wrapped():
    assert D.canonical_of_yaml("nodes: [{id: a}]\nmetadata: {}") == {"graph": {"nodes": [{"id": "a"}], "metadata": {}}}


def test_yaml_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML)
    (tmp_path / "b.yaml").write_text("[")
    rows = D.json_of_yaml(D.texts(spark, str(tmp_path))).collect()
    assert sorted((r["raw"] is None, r["error"] is None) for r in rows) == [(False, True), (True, False)]
    tables = D.graphs_of_yaml(D.texts(spark, str(tmp_path / "a.yaml")))
    assert [(r["id"], r["type"], r["http_path"]) for r in tables.nodes.collect()] == [("yes", "http", "/signup")]


def test_missing_and_bad_json(spark, tmp_path):
    with pytest.raises(D.SourceError) as e:
        D.texts(spark, str(tmp_path / "none.json"))
    assert e.value.kind == "missing"
    (tmp_path / "bad.json").write_text("{")
    assert D.graphs_of_json(D.texts(spark, str(tmp_path / "bad.json"))).graphs.first()["shape_code"] == "IR-STRUCT-INVALID_ROOT"


def test_repeated_keys_keep_the_last(spark):
    rows = spark.createDataFrame([("g", '{"nodes":[{"id":"a","id":"b"}]}')], "graph_id string, raw string")
    assert D.graphs_of_json(rows).nodes.first()["id"] == "b"


SPEC = {
    "openapi": "3.1.0",
    "info": {"title": " My API! ", "version": "2", "description": " d "},
    "security": [{"key": []}],
    "paths": {
        "/z": {"post": {"summary": "", "operationId": "zed"}, "get": {"operationId": " "}, "trace": {}, "put": None},
        "a/{id}": {"get": {"summary": "S", "security": []}, "delete": {"security": [{"b": []}, {" a ": []}, {"": []}]}},
        "/Z": {"post": {"security": None}, "head": {"security": [{}]}},
        "/list": [],
    },
}


def test_operations(spark):
    docs = openapi.described(spark.createDataFrame([("d", json.dumps(SPEC))], "doc_id string, raw string"))
    got = [(r["id"], r["name"], r["url"], r["method"], r["operation_id"], r["auth_required"], r["security"]) for r in openapi.operations(docs).orderBy("node_ord").collect()]
    assert got == [
        ("openapi_get_z", " ", "/z", "GET", None, None, ["key"]),
        ("openapi_post_z", "POST /z", "/z", "POST", "zed", None, ["key"]),
        ("openapi_get_a_id", "S", "/a/{id}", "GET", None, False, None),
        ("openapi_delete_a_id", "DELETE /a/{id}", "/a/{id}", "DELETE", None, None, ["a", "b"]),
        ("openapi_post_z_1", "POST /Z", "/Z", "POST", None, None, None),
        ("openapi_head_z", "HEAD /Z", "/Z", "HEAD", None, None, None),
    ]


def test_description_to_graph(spark):
    got = D.graph_of_description(spark, SPEC)
    assert got["metadata"] == {"name": "my-api"} and got["graph"]["metadata"] == {"name": "my-api", "description": "d", "provenance": {"source": "openapi-ingest", "openapiVersion": "3.1.0", "specTitle": " My API! ", "specVersion": "2"}}
    assert got["graph"]["edges"] == [] and got["graph"]["nodes"][2]["config"] == {"url": "/a/{id}", "route": "/a/{id}", "method": "GET", "openApiIngest": True, "authRequired": False}
    assert D.graph_of_description(spark, serialized(SPEC, "yaml"))["graph"]["nodes"][0]["id"] == "openapi_get_z"
    for bad in ("nothing", {"openapi": "3"}, {**SPEC, "paths": {}}, 5):
        with pytest.raises(openapi.IngestError):
            D.graph_of_description(spark, bad)


@pytest.mark.parametrize(
    ("doc", "errors"),
    [
        ({"openapi": "3.0", "paths": {}, "info": {"title": "t", "version": "1"}}, []),
        ({"openapi": "3.0", "paths": {}, "info": {"title": None, "version": "1"}}, []),
        ({"openapi": 2, "paths": 1, "info": {}}, ["Expected OpenAPI 3.x, got: 2", "Missing or invalid paths object", "Missing info.title", "Missing info.version"]),
        ({"swagger": "2.0", "paths": {}}, ["Missing info object"]),
        ({}, ["Missing openapi or swagger version field", "Missing or invalid paths object", "Missing info object"]),
        (5, ["Document is empty or not an object"]),
    ],
)
def test_shapes(spark, doc, errors):
    docs = openapi.described(spark.createDataFrame([("d", json.dumps(doc))], "doc_id string, raw string"))
    assert openapi.checked(docs).first()["errors"] == errors


def test_bundle_places(spark):
    rows = [("g", "openapi.json", "{}"), ("g", "openapi.yaml", " \n"), ("g", "docs/openapi.yaml", "x"), ("h", "other", "x")]
    got = openapi.found_in_bundles(spark.createDataFrame(rows, "graph_id string, path string, content string")).collect()
    assert [tuple(r) for r in got] == [("g", "openapi.json", "{}")]


def test_drift(spark):
    expected = D.files_table(spark, {"a": "1\n2", "b": "x", "c": "same"})
    actual = D.files_table(spark, {"a": "1\r\n2", "b": "y", "d": "new"})
    got = [(r["code"], r["path"]) for r in drift.in_order(drift.diff(expected, actual, True)).collect()]
    assert got == [("DRIFT-MODIFIED", "b"), ("DRIFT-MISSING", "c"), ("DRIFT-EXTRA", "d")]
    assert drift.diff(expected, actual).where("code = 'DRIFT-EXTRA'").isEmpty()


def test_edge_configs(spark):
    rows = [("g", "a", "t", 0, 0), ("g", "a", "t", 1, 9), ("g", "b", "t", 2, 5), ("g", "c", "t", 3, None), ("g", "c", "u", 4, None)]
    edges = spark.createDataFrame(rows, "graph_id string, src string, dst string, edge_index int, attempts int")
    assert {r["dst"]: r["attempts"] for r in endpoints.effective_configs(edges, "attempts").collect()} == {"t": 5, "u": None}


def test_trees(tmp_path):
    write_tree(str(tmp_path), {"a/b.txt": "x\r\ny", ".h": "1", "_s/c": "2"})
    assert D.directory_map(str(tmp_path)) == {"a/b.txt": "x\r\ny", ".h": "1", "_s/c": "2"}
    with pytest.raises(ValueError):
        write_tree(str(tmp_path), {"../out": ""})
    assert canonical_json({"a": "é"}) == '{\n  "a": "é"\n}\n'


def test_trees_of_a_corpus(spark, tmp_path):
    files = spark.createDataFrame([(f"g{k}", f"a/{j}.txt", f"{k}\r\n{j}") for k in range(5) for j in range(3)], "graph_id string, path string, content string")
    write_trees(str(tmp_path), files.repartition(4))
    assert D.directory_map(str(tmp_path)) == {f"g{k}/a/{j}.txt": f"{k}\r\n{j}" for k in range(5) for j in range(3)}


def test_canonical_texts(spark):
    rows = spark.createDataFrame([(1, '{"b":[],"a":"é"}'), (2, "{"), (3, None)], "graph_id long, raw string")
    assert {r["graph_id"]: r["text"] for r in canonical_texts(rows).collect()} == {1: '{\n  "b": [],\n  "a": "é"\n}\n', 2: None, 3: None}
