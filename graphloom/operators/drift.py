"""Drift: whether files are still what an export makes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import DRIFT_MESSAGES, NO_EXPORT
from ..functions.text import unix_lines


def diff(expected: DataFrame, actual: DataFrame, strict_extra: bool = False, messages: str = "map", keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, code, path, message) of files that are missing, modified, or extra if asked for; tables of (*keys, path,
    content). Line ends don't count. One full outer join on hashes of the contents: texts aren't shuffled."""
    by = [*keys, "path"]
    hashed = lambda t, name: t.select(*by, F.sha2(unix_lines(F.col("content")), 256).alias(name))
    both = hashed(expected, "wanted").join(hashed(actual, "got"), by, "full_outer")
    code = F.when(F.col("got").isNull(), "DRIFT-MISSING").when(F.col("wanted").isNull(), "DRIFT-EXTRA").when(F.col("wanted") != F.col("got"), "DRIFT-MODIFIED")
    rows = both.withColumn("code", code).where(F.col("code").isNotNull())
    if not strict_extra:
        rows = rows.where("code <> 'DRIFT-EXTRA'")
    text = F.element_at(F.create_map(*(F.lit(x) for pair in DRIFT_MESSAGES[messages].items() for x in pair)), F.col("code"))
    return rows.select(*keys, "code", "path", text.alias("message"))


def in_order(findings: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Missing and modified files by path, then extra ones by path."""
    return findings.orderBy(*keys, F.when(F.col("code") == "DRIFT-EXTRA", 1).otherwise(0), "path")


def no_export(findings: DataFrame, graphs: DataFrame, expected: DataFrame) -> DataFrame:
    """The findings, with one for each graph of which nothing was exported in place of its others."""
    none = graphs.select("graph_id").distinct().join(expected.select("graph_id").distinct(), "graph_id", "left_anti")
    said = none.select("graph_id", F.lit("DRIFT-NO-EXPORT").alias("code"), F.lit(".").alias("path"), F.lit(NO_EXPORT).alias("message"))
    return findings.join(none, "graph_id", "left_anti").unionByName(said)


def verdicts(graphs: DataFrame, findings: DataFrame, strict_extra: bool = False) -> DataFrame:
    """(graph_id, ok, extra_blocking) for every graph."""
    extra = F.col("code") == "DRIFT-EXTRA"
    sums = findings.groupBy("graph_id").agg(F.bool_or(~extra).alias("blocking"), F.bool_or(extra & F.lit(strict_extra)).alias("extra_blocking"))
    rows = graphs.select("graph_id").join(sums, "graph_id", "left").fillna(False, ["blocking", "extra_blocking"])
    return rows.select("graph_id", (~F.col("blocking") & ~F.col("extra_blocking")).alias("ok"), "extra_blocking")
