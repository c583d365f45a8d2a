"""Queries over the driver's tables: each applies an operator to a graph derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import algorithms, drift, endpoints, findings, lint, openapi, rules, structural
from ..session import configured
from . import derived, document_queries
from .tables import Facts, edge_is_async

Query = Callable[[SparkSession, str], DataFrame]


def classify_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = Facts(derived.supply(spark, folder)).classified
    flags = ("is_http_like", "is_db_like", "is_auth_like", "is_queue_like")
    return nodes.select("graph_id", "id", "type", T.is_http_endpoint(F.col("type")).alias("is_http_endpoint"), *flags)


def degree_table(spark: SparkSession, folder: str) -> DataFrame:
    return Facts(derived.supply(spark, folder)).node_facts(frozenset({"degrees"})).select("graph_id", "id", "out_deg", "in_deg")


def _lint(code: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return lint.lint_findings(derived.supply(spark, folder), [code]).select("graph_id", "code", "node_id", "edge_index", "message")

    query.__doc__ = f"Findings of {code} in the supply graphs."
    return query


def lint_no_healthcheck(spark: SparkSession, folder: str) -> DataFrame:
    pages = derived.health_pages(spark, folder)
    nodes = derived.as_nodes(pages.select("graph_id", F.col("page_id").alias("node_ord"), F.concat(F.lit("n"), "page_id").alias("id"), F.lit("http").alias("type"), F.col("path").alias("health_url")))
    edges = derived.as_edges(nodes.where("false").select("graph_id", F.lit(0).alias("edge_index"), F.col("id").alias("src"), F.col("id").alias("dst")))
    return lint.lint_findings(derived.as_tables(nodes, edges), ["IR-LINT-NO-HEALTHCHECK-003"]).select("graph_id", "code")


def health_url_flags(spark: SparkSession, folder: str) -> DataFrame:
    return derived.health_pages(spark, folder).select("page_id", "path", T.is_health_url(F.col("path")).alias("is_health"))


def _sync_depths(few: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        """Depths of all conversations that have an entry, bent back or not, those of a null conv_id as one."""
        facts = Facts(derived.talks(spark, folder))
        found = algorithms.sync_depths(facts.classified, facts.edge_facts, few=few)
        return found.select(F.when(F.col("graph_id") != "", F.col("graph_id")).cast("long").alias("graph_id"), "max_depth")

    return query


def async_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = derived.channel_edges(spark, folder)
    return edges.select("event_id", edge_is_async(F.col("marked"), F.col("protocol"), F.col("kind")).alias("is_async"))


def async_targets(spark: SparkSession, folder: str) -> DataFrame:
    """How many edges of each supply graph are asynchronous by their target."""
    return Facts(derived.supply(spark, folder)).edge_facts.groupBy("graph_id").agg(F.count("*").alias("n"), F.count_if("is_async").alias("n_async"))


def _structural(level: str, *codes: str) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        tables = derived.damaged(spark, folder)
        found = rules.fired(structural.ranked_nodes(tables.nodes), structural.node_rules()) if level == "node" else rules.fired(structural.counted_edges(tables), structural.edge_rules())
        return found.where(F.col("code").isin(*codes)).select("graph_id", "item_ord", "code", "node_id", "edge_index", "message")

    return query


def http_path_method(spark: SparkSession, folder: str) -> DataFrame:
    found = rules.fired(structural.ranked_nodes(derived.http_pages(spark, folder)), structural.node_rules())
    return found.select("graph_id", "node_id", "code", "message")


def _cycles(few: int) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        found = algorithms.first_cycles(derived.talks(spark, folder).edges, few=few)
        return found.select(F.when(F.col("graph_id") != "", F.col("graph_id")).cast("long").alias("graph_id"), F.array_join("path", " ").alias("path"))

    return query


def findings_sorted_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = findings.counts(lint.lint_findings(derived.supply(spark, folder)))
    return found.select("graph_id", "severity", "code", "n").orderBy("graph_id", findings.severity_rank(F.col("severity")), F.collate("code", "UNICODE"))


def policy_gate(spark: SparkSession, folder: str) -> DataFrame:
    tables = derived.supply(spark, folder)
    codes = ["IR-LINT-HIGH-FANOUT-004", "IR-LINT-DUPLICATE-EDGE-006"]
    return findings.gated(tables.graphs, lint.lint_findings(tables, codes), findings.Policy(max_warnings=300))


def drift_diff(spark: SparkSession, folder: str) -> DataFrame:
    return drift.diff(*derived.file_maps(spark, folder), strict_extra=True)


def openapi_nodes(spark: SparkSession, folder: str) -> DataFrame:
    docs = openapi.described(derived.specs(spark, folder))
    return openapi.operations(docs).select("doc_id", "node_ord", "id", "name", "url", "method", "operation_id")


def security_resolution(spark: SparkSession, folder: str) -> DataFrame:
    docs = openapi.described(derived.specs(spark, folder))
    return openapi.operations(docs).select("doc_id", "auth_required", F.array_join("security", ",").alias("security"))


def slug_ids(spark: SparkSession, folder: str) -> DataFrame:
    return derived.slugs(spark, folder)


def effective_edge_config(spark: SparkSession, folder: str) -> DataFrame:
    return endpoints.effective_configs(derived.edge_configs(spark, folder), "attempts").select("graph_id", "dst", "attempts")


def endpoint_table(spark: SparkSession, folder: str) -> DataFrame:
    return endpoints.endpoints(derived.endpoint_pages(spark, folder))


def other_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return endpoints.other_nodes(derived.endpoint_pages(spark, folder)).select("graph_id", "id", "raw_type")


LINT_QUERIES = {
    "lint_direct_db": "IR-LINT-DIRECT-DB-ACCESS-002",
    "lint_high_fanout": "IR-LINT-HIGH-FANOUT-004",
    "lint_sync_chain": "IR-LINT-SYNC-CHAIN-001",
    "lint_isolated": "IR-LINT-ISOLATED-NODE-005",
    "lint_duplicate_edge": "IR-LINT-DUPLICATE-EDGE-006",
    "lint_missing_name": "IR-LINT-HTTP-MISSING-NAME-007",
    "lint_datastore_no_incoming": "IR-LINT-DATASTORE-NO-INCOMING-008",
    "lint_multiple_entries": "IR-LINT-MULTIPLE-HTTP-ENTRIES-009",
    "lint_missing_auth": "IR-LINT-MISSING-AUTH-010",
    "lint_dead_node": "IR-LINT-DEAD-NODE-011",
}

_QUERIES: dict[str, Query] = {
    "classify_nodes": classify_nodes,
    "degree_table": degree_table,
    **{name: _lint(code) for name, code in LINT_QUERIES.items()},
    "lint_no_healthcheck": lint_no_healthcheck,
    "health_url_flags": health_url_flags,
    "sync_chain_depth": _sync_depths(algorithms.FEW),
    "sync_chain_depth_in_rounds": _sync_depths(0),
    "async_edges": async_edges,
    "async_targets": async_targets,
    "dup_node_id": _structural("node", "IR-STRUCT-DUP_NODE_ID"),
    "edge_unknown_endpoint": _structural("edge", "IR-STRUCT-EDGE_UNKNOWN_FROM", "IR-STRUCT-EDGE_UNKNOWN_TO"),
    "edge_ambiguous": _structural("edge", "IR-STRUCT-EDGE_AMBIGUOUS_FROM", "IR-STRUCT-EDGE_AMBIGUOUS_TO"),
    "http_path_method": http_path_method,
    "cycle_graphs": _cycles(algorithms.FEW),
    "cycle_graphs_in_rounds": _cycles(0),
    "findings_sorted_counts": findings_sorted_counts,
    "policy_gate": policy_gate,
    "drift_diff": drift_diff,
    "openapi_nodes": openapi_nodes,
    "security_resolution": security_resolution,
    "slug_ids": slug_ids,
    "effective_edge_config": effective_edge_config,
    "endpoint_table": endpoint_table,
    "other_nodes": other_nodes,
    **document_queries.QUERIES,
}


def _with_settings(query: Query) -> Query:
    return lambda spark, folder: query(configured(spark), folder)


QUERIES: dict[str, Query] = {name: _with_settings(query) for name, query in _QUERIES.items()}
