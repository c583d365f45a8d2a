"""Sinks: file trees, and the canonical text of a graph document."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

#: Documents of a batch that Python converts.
BATCH = 256


def canonical_json(document: Mapping[str, Any]) -> str:
    """Two spaces, keys as they are, a line break at the end."""
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def serialized(document: Mapping[str, Any], form: str) -> str:
    """An API description as JSON or YAML text."""
    if form == "json":
        return json.dumps(document, indent=2, ensure_ascii=False)
    import yaml

    return yaml.safe_dump(dict(document), sort_keys=False, width=120, allow_unicode=True)


def _inside(root: str, path: str) -> str:
    target = os.path.normpath(os.path.join(root, *path.split("/")))
    if os.path.commonpath([os.path.abspath(root), os.path.abspath(target)]) != os.path.abspath(root):
        raise ValueError(f"{path} leads out of {root}")
    return target


def write_tree(root: str, files: Mapping[str, str] | Iterable[tuple[str, str]]) -> None:
    """Writes a file map below a local folder."""
    for path, content in files.items() if isinstance(files, Mapping) else files:
        target = _inside(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8", newline="") as f:
            f.write(content)


def write_trees(root: str, files: DataFrame) -> None:
    """Writes (graph_id, path, content) below a folder for each graph. Every task writes its rows: on a cluster the folder
    must be one that all machines have mounted."""
    files.select("graph_id", "path", "content").foreachPartition(lambda rows: write_tree(root, ((f"{r['graph_id']}/{r['path']}", r["content"]) for r in rows)))


def canonical_texts(documents: DataFrame) -> DataFrame:
    """(graph_id, text): the canonical text of (graph_id, raw) JSON documents; null where there is none or it can't be
    parsed."""

    def one(raw: str | None) -> str | None:
        try:
            return canonical_json(json.loads(raw or ""))
        except ValueError:
            return None

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(one, part.column(1).to_pylist()), pa.string())], names=["graph_id", "text"])

    kind = documents.schema["graph_id"].dataType.simpleString()
    return documents.select("graph_id", "raw").mapInArrow(of, f"graph_id {kind}, text string")


def write_files(files: DataFrame, path: str) -> None:
    """(graph_id, path, content) as Parquet, for corpora that no single machine holds."""
    files.write.mode("overwrite").parquet(path)
