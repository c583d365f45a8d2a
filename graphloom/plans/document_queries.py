"""Queries that go the whole way from the text of documents: parsing, normalising, rules, verdicts, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..export.pipeline import generated, rewrapped
from ..functions import sql
from ..functions import text as T
from ..operators import drift, endpoints, findings, openapi
from ..sources.documents import graphs_of_json, json_of_yaml
from ..sources.sinks import canonical_texts
from . import derived, made_documents
from .tables import GraphTables
from .validation import Validation, validated

Query = Callable[[SparkSession, str], DataFrame]


def _faulty(spark: SparkSession, folder: str) -> GraphTables:
    return graphs_of_json(made_documents.faulty(spark, folder))


def _both(spark: SparkSession, folder: str) -> Validation:
    every = made_documents.faulty(spark, folder).unionByName(made_documents.services(spark, folder))
    return validated(graphs_of_json(every), policy=findings.Policy(fail_on_warning=True))


def json_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Roots, unwrapped: why there is no graph, or how large it is."""
    return _faulty(spark, folder).graphs.select("graph_id", "shape_code", "edges_malformed", "n_raw_nodes", "n_raw_edges")


def json_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Node slots of all kinds, normalised."""
    return _faulty(spark, folder).nodes.select("graph_id", "node_ord", "slot_kind", "id", "type", "name", "config_type", F.array_join(F.array_sort("config_keys"), ",").alias("config_keys"), "http_path", "http_method")


def json_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edge slots of all kinds, normalised, and whether their own data makes them asynchronous."""
    return _faulty(spark, folder).edges.select("graph_id", "edge_index", "slot_kind", "src", "dst", "is_async")


def validated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All findings of faulty and sound documents: lint looks at the sound ones alone."""
    return findings.with_layer(_both(spark, folder).findings).select("graph_id", "code", "severity", "layer", "message", "node_id", "edge_index")


def policy_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """What a policy that forbids warnings says of each document."""
    return _both(spark, folder).verdicts


def findings_report(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the sound documents as JSON objects and as text, in the order of a report."""
    found = validated(graphs_of_json(made_documents.services(spark, folder))).findings
    return findings.reported(found)


def rewrapped_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Why documents have no graph where they are taken as an export takes them."""
    return graphs_of_json(rewrapped(made_documents.faulty(spark, folder))).graphs.select("graph_id", "shape_code", "n_raw_nodes")


def json_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Endpoints of documents whose nodes are configured in two places."""
    nodes = graphs_of_json(made_documents.configured(spark, folder)).nodes
    return endpoints.endpoints(endpoints.merged_config(nodes)).select("graph_id", "id", "route", "method", "has_body", "success")


def json_other_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Their nodes that aren't for HTTP, by the type as it is written."""
    nodes = graphs_of_json(made_documents.configured(spark, folder)).nodes
    return endpoints.other_nodes(endpoints.merged_config(nodes)).select("graph_id", "id", "raw_type")


def yaml_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of YAML documents by way of JSON."""
    return graphs_of_json(json_of_yaml(made_documents.yaml_texts(spark, folder))).nodes.select("graph_id", "node_ord", "id", "type", "http_path")


def yaml_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Which YAML documents give no graph."""
    return json_of_yaml(made_documents.yaml_texts(spark, folder)).select("graph_id", F.col("raw").isNull().alias("failed"))


def yaml_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The canonical text of YAML documents."""
    return canonical_texts(json_of_yaml(made_documents.yaml_texts(spark, folder)))


def openapi_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Operations of descriptions in which several get the same id."""
    docs = openapi.described(made_documents.many_operations(spark, folder))
    return openapi.operations(docs).select("doc_id", "node_ord", "id", "name", "url", "method", "operation_id")


def openapi_shapes(spark: SparkSession, folder: str) -> DataFrame:
    found = openapi.checked(openapi.described(made_documents.shapes(spark, folder)))
    return found.select("doc_id", "ok", F.array_join("errors", "; ").alias("errors"))


def openapi_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """Graph documents of descriptions, parsed again: as many nodes as operations, and the service's name."""
    docs = openapi.described(made_documents.many_operations(spark, folder))
    good, _ = openapi.canonical(docs)
    tables = graphs_of_json(good.withColumnRenamed("doc_id", "graph_id"))
    name = good.select(F.col("doc_id").alias("graph_id"), F.get_json_object("raw", "$.graph.metadata.name").alias("service"))
    return tables.graphs.select("graph_id", "shape_code", "n_raw_nodes").join(name, "graph_id")


def openapi_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Why descriptions give no graph."""
    return openapi.canonical(openapi.described(made_documents.shapes(spark, folder)))[1]


def drift_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts of twenty groups of files, extra ones forbidden, and one of which nothing was exported."""
    group = lambda t: t.withColumn("graph_id", F.regexp_extract("path", "([0-9]+)$", 1).cast("long") % 20)
    expected, actual = (group(t) for t in derived.file_maps(spark, folder))
    expected = expected.where("graph_id <> 19")
    graphs = spark.range(20).select(F.col("id").alias("graph_id"))
    found = drift.no_export(drift.diff(expected, actual, True, "directory", ("graph_id",)), graphs, expected)
    counted = found.groupBy("graph_id").agg(F.count_if(F.col("code") == "DRIFT-MISSING").alias("n_missing"), F.count_if(F.col("code") == "DRIFT-NO-EXPORT").alias("n_no_export"))
    return drift.verdicts(graphs, found, True).join(counted, "graph_id", "left").fillna(0, ["n_missing", "n_no_export"])


def effective_settings(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts of each target: what an edge says, else the node, else the default."""
    found = endpoints.effective_configs(derived.edge_configs(spark, folder), "attempts")
    targets = derived.read(spark, folder, "events").groupBy(F.col("event_type").alias("dst")).agg(F.when(F.min("event_id") % 2 == 0, 9).alias("own"))
    return targets.join(found, "dst", "left").select("dst", endpoints.with_defaults(F.col("own"), F.col("attempts"), 2).alias("attempts"))


def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Trimming, slashes, safe ids and ports over paths of pages."""
    path, k = F.col("path"), F.col("page_id")
    odd = F.concat(F.lit(" \t"), F.substring(path, 2, 1000), F.lit("﻿ "))
    port = F.concat(F.lit(" "), (k * 701).cast("string"), F.when(k % 2 == 0, "x").otherwise(""))
    return derived.page_paths(spark, folder).select("page_id", T.trimmed(odd).alias("trimmed"), T.with_slash(odd).alias("slashed"), T.safe_id(path).alias("safe"), T.host_port(port).alias("port"))


def predicates_in_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The classes of types, asked for in SQL."""
    sql.registered(spark)
    derived.supply(spark, folder).nodes.select("type").distinct().createOrReplaceTempView("graphloom_types")
    return spark.sql("SELECT type, is_http_endpoint(type) AS is_http_endpoint, is_http_like(type) AS is_http_like, is_db_like(type) AS is_db_like, is_auth_like(type) AS is_auth_like, is_queue_like(type) AS is_queue_like FROM graphloom_types")


def generated_files(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the files of the sound documents' projects for both targets. Generated text has no SQL."""
    docs = made_documents.services(spark, folder).withColumn("raw", F.replace("raw", F.lit('"gateway"'), F.lit('"http"')))
    made = [generated(docs, target).withColumn("target", F.lit(target)) for target in ("python", "node")]
    return made[0].unionByName(made[1]).select("graph_id", "target", "path", F.sha2("content", 256).alias("sha256"))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        json_graphs,
        json_nodes,
        json_edges,
        validated_documents,
        policy_verdicts,
        findings_report,
        rewrapped_documents,
        json_endpoints,
        json_other_nodes,
        yaml_nodes,
        yaml_errors,
        yaml_canonical,
        openapi_collisions,
        openapi_shapes,
        openapi_graphs,
        openapi_failures,
        drift_verdicts,
        effective_settings,
        text_functions,
        predicates_in_sql,
        generated_files,
    )
}
