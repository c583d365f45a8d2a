"""The command line: validate, yaml-to-ir, ingest openapi, export, validate-drift."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .export.bundle import host_port, port_is_free
from .export.pipeline import drifted, exported, one_document
from .operators import drift, findings
from .operators.openapi import IngestError
from .plans.validation import validated
from .session import session
from .sources.documents import SourceError, canonical_of_yaml, directory_map, graph_of_description, graphs_of_json
from .sources.sinks import canonical_json, write_tree


class Stop(Exception):
    """Ends the command with a message and exit code 1."""


def _text(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except FileNotFoundError as e:
        raise Stop(f"file not found: {path}") from e
    except (OSError, UnicodeDecodeError) as e:
        raise Stop(f"could not read {path}: {e}") from e


def _document(path: str) -> Any:
    try:
        return json.loads(_text(path))
    except ValueError as e:
        raise Stop(f"invalid JSON in {path}: {e}") from e


def _wrapped(document: Any) -> Any:
    return document if isinstance(document, dict) and document.get("graph") else {"graph": document}


def _emit(text: str, out: str | None) -> None:
    if out:
        os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
        with open(out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)


def _policy(a: argparse.Namespace) -> findings.Policy:
    return findings.Policy(a.fail_on_warning, a.max_warnings)


def _failed(found: list[dict[str, Any]], policy: findings.Policy) -> bool:
    warnings = sum(f["severity"] == "warning" for f in found)
    return any(f["severity"] == "error" for f in found) or (policy.fail_on_warning and warnings > 0) or (policy.max_warnings is not None and warnings > policy.max_warnings)


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    document = _document(a.ir)
    if document is None:
        return 1
    found = findings.as_objects(validated(graphs_of_json(one_document(spark, document)), a.skip_lint).findings)
    if a.json:
        sys.stdout.write(findings.json_report(found))
    else:
        findings.printed(found)
        if not found:
            print("no findings", file=sys.stderr)
    return int(_failed(found, _policy(a)))


def yaml_to_ir(spark: SparkSession | None, a: argparse.Namespace) -> int:
    _emit(canonical_json(canonical_of_yaml(_text(a.yaml))), a.out)
    return 0


def ingest_openapi(spark: SparkSession, a: argparse.Namespace) -> int:
    _emit(canonical_json(graph_of_description(spark, _text(a.spec))), a.out)
    return 0


def _port(a: argparse.Namespace) -> int:
    port = host_port(a.host_port)
    if not a.skip_host_port_check and not port_is_free(port):
        if getattr(a, "strict_host_port", False):
            raise Stop(f"port {port} is in use")
        print(f"note: port {port} is in use", file=sys.stderr)
    return port


def _reported(*tables: DataFrame) -> list[dict[str, Any]]:
    return [f for t in tables for f in findings.as_objects(t)]


def export(spark: SparkSession, a: argparse.Namespace) -> int:
    made = exported(one_document(spark, _wrapped(_document(a.ir))), a.target, _port(a), a.danger_skip_ir_structural_validation, a.skip_ir_lint)
    found = _reported(made.structural, made.lint)
    findings.printed(found)
    for row in made.warnings.collect():
        print(f"warning: {row['warning']}", file=sys.stderr)
    if _failed(found, _policy(a)):
        return 1
    files = {r["path"]: r["content"] for r in made.files.collect()}
    write_tree(a.out, files)
    print(f"wrote {len(files)} files to {a.out}", file=sys.stderr)
    return 0


def validate_drift(spark: SparkSession, a: argparse.Namespace) -> int:
    document = one_document(spark, _wrapped(_document(a.ir)))
    if not os.path.isdir(a.out):
        raise Stop(f"no such folder: {a.out}")
    actual = spark.createDataFrame([("document", p, c) for p, c in directory_map(a.out).items()], "graph_id string, path string, content string")
    result = drifted(document, a.target, actual, a.strict_extra, "directory", port=host_port(a.host_port), skip_structural=a.danger_skip_ir_structural_validation, skip_lint=a.skip_ir_lint)
    rows = [{"code": r["code"], "path": r["path"], "message": r["message"]} for r in drift.in_order(result.findings).collect()]
    verdict = result.verdicts.first()
    if a.json:
        print(json.dumps({"ok": verdict["ok"], "extraBlocking": verdict["extra_blocking"], "driftFindings": rows, "irStructuralFindings": _reported(result.export.structural), "irLintFindings": _reported(result.export.lint)}, indent=2, ensure_ascii=False))
    else:
        for r in rows:
            print(f"{findings.ICONS['info' if r['code'] == 'DRIFT-EXTRA' else 'error']} {r['code']}: {r['path']}: {r['message']}", file=sys.stderr)
        print("no drift" if verdict["ok"] else "drift found", file=sys.stderr)
    return int(not verdict["ok"])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom")
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, to=commands, **required: str) -> argparse.ArgumentParser:
        p = to.add_parser(name)
        p.set_defaults(run=run)
        for flag, help_ in required.items():
            p.add_argument(f"--{flag}", required=True, help=help_)
        return p

    def gated(p: argparse.ArgumentParser) -> None:
        p.add_argument("--fail-on-warning", action="store_true")
        p.add_argument("--max-warnings", type=int)

    def exporting(p: argparse.ArgumentParser) -> None:
        p.add_argument("--host-port")
        for flag in ("--skip-host-port-check", "--danger-skip-ir-structural-validation", "--skip-ir-lint"):
            p.add_argument(flag, action="store_true")

    p = command("validate", validate, ir="graph document in JSON")
    gated(p)
    p.add_argument("--json", action="store_true")
    p.add_argument("--skip-lint", action="store_true")
    command("yaml-to-ir", yaml_to_ir, yaml="graph document in YAML").add_argument("--out")
    kinds = commands.add_parser("ingest").add_subparsers(required=True)
    command("openapi", ingest_openapi, kinds, spec="API description").add_argument("--out")
    p = command("export", export, ir="graph document in JSON", target="python, node or nodejs", out="folder to write to")
    gated(p)
    exporting(p)
    p.add_argument("--strict-host-port", action="store_true")
    p = command("validate-drift", validate_drift, ir="graph document in JSON", target="python, node or nodejs", out="folder to compare with")
    exporting(p)
    p.add_argument("--strict-extra", action="store_true")
    p.add_argument("--json", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(spark or (None if a.run is yaml_to_ir else session("local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"})), a)
    except (Stop, SourceError, IngestError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
