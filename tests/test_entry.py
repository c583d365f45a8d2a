"""What is registered, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from graphloom.plans import oracles, queries

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_flagship(spark):
    assert entry.entry(spark).columns == ["graph_id", "code", "node_id", "edge_index", "message"]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) - set(oracles.SQL) == {"generated_files"}


@pytest.mark.parametrize("left_over", ["nothing", "compiled", "pipeline"])
def test_the_rest_works_alone(tmp_path, left_over):
    shutil.copytree(f"{ROOT}/graphloom", tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left_over == "compiled":
        (tmp_path / "graphloom" / "llm" / "__pycache__").mkdir(parents=True)
    if left_over == "pipeline" and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) < set(e.queries()); print(sorted(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == str(sorted(queries.QUERIES))
