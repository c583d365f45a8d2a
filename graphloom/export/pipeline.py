"""Exporting graphs as projects: validation first, then files for every graph that has no error.

Generation runs as a pass over (graph_id, raw) documents in Arrow batches; findings gate it by an anti-join, so errors
of one graph don't hold up others.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, openapi
from ..operators.findings import erroneous
from ..operators.lint import lint_findings
from ..operators.structural import structural_findings
from ..sources.documents import descriptions, graphs_of_json
from ..storage import saved
from . import express, fastapi
from .bundle import completed, host_port
from .model import project

TARGETS = ("python", "node", "nodejs")
BATCH = 128


class Export(NamedTuple):
    """files: graph_id, path, content. warnings: graph_id, warning, of descriptions of bad shape. Findings of both kinds."""

    files: DataFrame
    warnings: DataFrame
    structural: DataFrame
    lint: DataFrame


def check_target(target: str) -> str:
    name = str(target or "").lower()
    if name not in TARGETS:
        raise ValueError(f'unsupported target "{target}". Use "python", "node", or "nodejs".')
    return "python" if name == "python" else "node"


def project_files(document: Any, target: str, port: int = 8080, name: str | None = None) -> dict[str, str]:
    """The files of one document's project. A document that can't be generated leaves the bundle alone."""
    kind = check_target(target)
    try:
        made = fastapi.generated(project(document, name, True, "generated-fastapi")) if kind == "python" else express.generated(project(document, name, False, "generated-express"))
    except (TypeError, ValueError, AttributeError, KeyError):
        made = {}
    return completed(made, kind, port)


def _loaded(raw: str | None) -> Any:
    """The document, or nothing where it can't be parsed."""
    try:
        return json.loads(raw or "")
    except ValueError:
        return None


def generated(documents: DataFrame, target: str, port: int = 8080) -> DataFrame:
    """(graph_id, path, content) of (graph_id, raw) documents; one that can't be parsed has no files."""
    check_target(target)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                parsed = [(g, _loaded(raw)) for g, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                rows = [(g, path, text) for g, document in parsed if document is not None for path, text in project_files(document, target, port).items()]
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.schema.field(0).type), *(pa.array(c, pa.string()) for c in columns[1:])], names=["graph_id", "path", "content"])

    kind = documents.schema["graph_id"].dataType.simpleString()
    return documents.select("graph_id", "raw").mapInArrow(of, f"graph_id {kind}, path string, content string")


def rewrapped(documents: DataFrame) -> DataFrame:
    """Documents as an export takes them: what has no graph of its own is taken as one."""
    whole = F.get_json_object("raw", "$.graph")
    return documents.withColumn("raw", F.when(whole.isNotNull() & ~whole.isin("", "0", "false"), F.col("raw")).otherwise(F.concat(F.lit('{"graph":'), F.col("raw"), F.lit("}"))))


def exported(documents: DataFrame, target: str, port: object = 8080, skip_structural: bool = False, skip_lint: bool = False) -> Export:
    """Projects of (graph_id, raw) documents that have no structural error; without the structural pass, of those whose
    shape lets lint look into them."""
    check_target(target)
    documents = rewrapped(documents)
    tables = graphs_of_json(documents).saved()
    none = structural_findings(tables).limit(0)
    lint = none
    if skip_structural:
        looked = saved(lint_findings(tables), "lint")
        structural = looked.where("code like 'IR-STRUCT-%'") if not skip_lint else none
        lint = looked.where("code not like 'IR-STRUCT-%'") if not skip_lint else none
    else:
        structural = saved(structural_findings(tables), "structural")
        if not skip_lint:
            lint = saved(lint_findings(tables.without(erroneous(structural))), "lint")
    sound = documents.join(erroneous(structural), "graph_id", "left_anti")
    files = saved(generated(sound, target, host_port(port)), "files")
    found = openapi.found_in_bundles(files)
    shapes = descriptions(found.select(F.col("graph_id").cast("string").alias("doc_id"), F.col("content").alias("raw")))
    bad = shapes.select("doc_id", F.when(F.col("format").isNull(), F.array(F.lit("Could not parse as JSON or YAML"))).otherwise(openapi.shape_errors(F.col("doc"))).alias("errors")).where("size(errors) > 0")
    warnings = bad.join(found.select(F.col("graph_id").cast("string").alias("doc_id"), "graph_id", "path"), "doc_id").select("graph_id", F.explode(F.transform("errors", lambda e: F.concat(F.col("path"), F.lit(": "), e))).alias("warning"))
    return Export(files, warnings, structural, lint)


class Drift(NamedTuple):
    """findings: graph_id, code, path, message. verdicts: graph_id, ok, extra_blocking."""

    findings: DataFrame
    verdicts: DataFrame
    export: Export


def drifted(documents: DataFrame, target: str, actual: DataFrame, strict_extra: bool = False, messages: str = "map", **options: Any) -> Drift:
    """Compares what documents export now with (graph_id, path, content) files."""
    export = exported(documents, target, **options)
    found = drift.no_export(drift.diff(export.files, actual, strict_extra, messages, ("graph_id",)), documents, export.files)
    found = saved(found, "drift")
    return Drift(found, drift.verdicts(documents, found, strict_extra), export)


def one_document(spark: SparkSession, document: Any, graph_id: str = "document") -> DataFrame:
    return spark.createDataFrame([(graph_id, json.dumps(document))], "graph_id string, raw string")
