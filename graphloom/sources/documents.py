"""Sources: graph documents in JSON or YAML, API descriptions, directory trees, objects in memory.

JSON is parsed in the JVM. YAML needs Python, which turns it into JSON text in Arrow batches; from there all is alike.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import openapi
from ..plans.tables import GraphTables, normalized

#: Documents of a batch that Python converts.
BATCH = 256


class SourceError(ValueError):
    """A file that isn't there, can't be read, or isn't what it should be. kind says which."""

    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


class YamlError(SourceError):
    def __init__(self, message: str) -> None:
        super().__init__("invalid", message)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(graph_id, raw) of files, whole; graph_id is the file's URI."""
    try:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("graph_id"), F.col("value").alias("raw"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise SourceError("missing", f"no such file: {path}") from e
        raise SourceError("unreadable", str(e)) from e


def graphs_of_json(raw: DataFrame) -> GraphTables:
    """The tables of (graph_id, raw) JSON documents; what can't be parsed has no root."""
    return normalized(raw.select("graph_id", F.try_parse_json("raw").alias("root")))


def graphs_in_memory(spark: SparkSession, documents: Mapping[str, Any] | Iterable[tuple[str, Any]]) -> GraphTables:
    pairs = documents.items() if isinstance(documents, Mapping) else documents
    return graphs_of_json(spark.createDataFrame([(k, json.dumps(v)) for k, v in pairs], "graph_id string, raw string"))


def _loader(core: bool):
    """A YAML loader: with `core`, scalars are what JSON has, by YAML 1.2; dates stay text; a repeated key is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

        def construct_mapping(self, node, deep=False):
            seen = set()
            for key, _ in node.value:
                name = self.construct_object(key, deep=True)
                if not isinstance(name, (str, int, float, bool, type(None))):
                    raise yaml.constructor.ConstructorError(None, None, "a key must be a scalar", key.start_mark)
                if name in seen:
                    raise yaml.constructor.ConstructorError(None, None, f"duplicated mapping key {name!r}", key.start_mark)
                seen.add(name)
            return super().construct_mapping(node, deep)

    rules = [
        ("tag:yaml.org,2002:bool", r"^(?:true|True|TRUE|false|False|FALSE)$", "tTfF"),
        ("tag:yaml.org,2002:int", r"^[-+]?(?:0b[01_]+|0o[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*)$", "-+0123456789"),
        ("tag:yaml.org,2002:float", r"^(?:[-+]?(?:[0-9][0-9_]*)(?:\.[0-9_]*)?(?:[eE][-+]?[0-9]+)?|[-+]?\.[0-9_]+(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", "-+0123456789."),
        ("tag:yaml.org,2002:null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
    ]
    if not core:
        rules += [("tag:yaml.org,2002:merge", r"^(?:<<)$", ["<"])]
    for tag, pattern, first in rules:
        Loader.add_implicit_resolver(tag, re.compile(pattern), list(first))
    Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: _integer(node.value))
    return Loader


def _integer(text: str) -> int:
    body = text.replace("_", "").lstrip("+-")
    value = int(body, 0) if body[:2].lower() in ("0b", "0o", "0x") else int(body)
    return -value if text.startswith("-") else value


def yaml_value(text: str, core: bool = True) -> Any:
    """The value of YAML text."""
    import yaml

    try:
        return yaml.load(text, Loader=_loader(core))
    except (yaml.YAMLError, ValueError) as e:
        raise YamlError(f"Invalid YAML: {e}") from e


def canonical_of_yaml(text: str) -> dict[str, Any]:
    """A graph document of YAML text, always wrapped."""
    value = yaml_value(text)
    if not isinstance(value, dict):
        raise YamlError("YAML root must be a mapping (object), not null, a scalar, or a sequence at the top level.")
    if isinstance(value.get("graph"), dict):
        return {"graph": value["graph"]}
    if isinstance(value.get("nodes"), list):
        return {"graph": value}
    raise YamlError("YAML must define either top-level `graph:` (object) or top-level `nodes:` (array).")


def _converted(convert, names: tuple[str, ...]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                rows = [convert(text) for text in part.column(1).to_pylist()]
                columns = [pa.array(x, pa.string()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=[part.schema.names[0], *names])

    return of


def _yaml_row(text: str | None) -> tuple[str | None, str | None]:
    try:
        return json.dumps(canonical_of_yaml(text or "")), None
    except YamlError as e:
        return None, str(e)


def json_of_yaml(raw: DataFrame) -> DataFrame:
    """(graph_id, raw, error): JSON of (graph_id, raw) YAML documents, or what is wrong with them."""
    return raw.select("graph_id", "raw").mapInArrow(_converted(_yaml_row, ("raw", "error")), "graph_id string, raw string, error string")


def graphs_of_yaml(raw: DataFrame) -> GraphTables:
    return graphs_of_json(json_of_yaml(raw).select("graph_id", "raw"))


def parsed_description(text: str | None) -> tuple[Any, str] | None:
    """An API description and its format, JSON tried first; None if it is neither or no object."""
    for form, parse in (("json", json.loads), ("yaml", lambda t: yaml_value(t, core=False))):
        try:
            value = parse((text or "").strip())
        except ValueError:
            continue
        if isinstance(value, (dict, list)):
            return value, form
    return None


def _description_row(text: str | None) -> tuple[str | None, str | None]:
    got = parsed_description(text)
    return (json.dumps(got[0], default=str), got[1]) if got else (None, None)


def descriptions(raw: DataFrame) -> DataFrame:
    """(doc_id, raw, doc, format) of (doc_id, raw) descriptions in JSON or YAML; null where they are neither."""
    found = raw.select("doc_id", "raw").mapInArrow(_converted(_description_row, ("raw", "format")), "doc_id string, raw string, format string")
    return found.select("doc_id", "raw", F.try_parse_json("raw").alias("doc"), "format")


def graph_of_description(spark: SparkSession, description: str | Mapping[str, Any]) -> dict[str, Any]:
    """The graph document of one description, given as text or as an object; raises IngestError."""
    if isinstance(description, str):
        got = parsed_description(description)
        if got is None:
            raise openapi.IngestError("Could not parse OpenAPI as JSON or YAML")
        description = got[0]
    if not isinstance(description, Mapping):
        raise openapi.IngestError("OpenAPI input must be a JSON/YAML string or a parsed object")
    docs = openapi.described(spark.createDataFrame([("0", json.dumps(description, default=str))], "doc_id string, raw string"))
    good, bad = openapi.canonical(docs)
    for row in bad.collect():
        raise openapi.IngestError(row["error"])
    return json.loads(good.first()["raw"])


def directory_files(root: str) -> list[str]:
    """Paths of all files below a local folder, relative and with slashes, hidden ones too."""
    found = []
    for folder, _, names in os.walk(root):
        found += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names]
    return sorted(found)


def directory_map(root: str) -> dict[str, str]:
    """Path to content of all files below a local folder that are text."""
    out = {}
    for path in directory_files(root):
        with open(os.path.join(root, *path.split("/")), encoding="utf-8", errors="replace", newline="") as f:
            out[path] = f.read()
    return out


def files_table(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """(path, content) of a file map."""
    return spark.createDataFrame(list(files.items()), "path string, content string")
