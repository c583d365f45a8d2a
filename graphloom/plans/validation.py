"""The whole of a validation: structural findings, lint for graphs without errors, the policy's verdict."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame

from ..operators import findings as results
from ..operators.lint import lint_findings
from ..operators.rules import Custom, Rule
from ..operators.structural import structural_findings
from ..storage import saved
from .tables import GraphTables


class Validation(NamedTuple):
    """`findings` of all graphs, and for each graph whether it `failed`."""

    findings: DataFrame
    verdicts: DataFrame


def validated(tables: GraphTables, skip_lint: bool = False, policy: results.Policy = results.Policy(), extra_rules: Iterable[Rule | Custom] = ()) -> Validation:
    """Lint looks only at graphs in which the structural rules find no error."""
    tables = tables.saved()
    found = saved(structural_findings(tables), "structural")
    every = found
    if not skip_lint:
        sound = tables.without(results.erroneous(found))
        every = saved(found.unionByName(lint_findings(sound, extra_rules=extra_rules)), "findings")
    return Validation(every, results.gated(tables.graphs, every, policy))
