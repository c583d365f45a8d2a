"""What generators take from a graph: endpoints, other nodes, and the configuration that edges give to their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import variants as V
from ..functions.text import safe_id

# The types, as written, of which endpoints are made.
ENDPOINT_TYPES = ("cloudFunction", "http", "httpRequest")
DEFAULT_TIMEOUT_MS = 2000


def success_code(method: Column, is_async: Column) -> Column:
    """201 for POST, or 202 if it is asynchronous; 204 for DELETE; else 200."""
    lower = F.lower(method)
    return F.when(lower == "post", F.when(F.coalesce(is_async, F.lit(False)), 202).otherwise(201)).when(lower == "delete", 204).otherwise(200)


def endpoints(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_ord, id, route, method, has_body, success) of nodes (graph_id, node_ord, id, raw_type, route,
    url, method, is_async): the types are compared as written; a blank route gives way to the url, and that to the id. Only GET has no body."""
    method = F.lower(F.coalesce(F.nullif("method", F.lit("")), F.lit("post")))
    rows = nodes.where(F.col("raw_type").isin(*ENDPOINT_TYPES))
    return rows.select(
        "graph_id",
        "node_ord",
        "id",
        F.coalesce(F.nullif("route", F.lit("")), F.nullif("url", F.lit("")), F.concat(F.lit("/"), safe_id(F.col("id")))).alias("route"),
        method.alias("method"),
        (method != "get").alias("has_body"),
        success_code(method, F.col("is_async")).alias("success"),
    )


def merged_config(nodes: DataFrame) -> DataFrame:
    """(graph_id, node_ord, id, raw_type, route, url, method, is_async) of the nodes of documents, as `endpoints` takes
    them: what a node's data.config has counts before its config, even a null."""

    def value(name: str) -> Column:
        own, data = V.raw_member(F.col("config"), name), V.raw_member(F.col("data_config"), name)
        return F.when(V.kind_of(data) != "absent", data).otherwise(own)

    names = ("route", "url", "method", "async", "asyncProcessing", "accepted")
    rows = nodes.select("graph_id", "node_ord", "id", F.col("typed").alias("raw_type"), F.inline(F.array(F.struct(*(value(n).alias(f"_{n}") for n in names)))))
    text = lambda n: F.when(~V.text_of(F.col(n)).isin("", "0", "false"), V.text_of(F.col(n)))
    later = V.is_true(F.col("_async")) | V.is_true(F.col("_asyncProcessing")) | V.is_true(F.col("_accepted"))
    return rows.select("graph_id", "node_ord", "id", "raw_type", text("_route").alias("route"), text("_url").alias("url"), text("_method").alias("method"), later.alias("is_async"))


def other_nodes(nodes: DataFrame) -> DataFrame:
    """The nodes whose type doesn't mention http, in any case."""
    return nodes.where(~F.lower(F.coalesce("raw_type", F.lit(""))).contains("http"))


def pair_configs(edges: DataFrame, *values: str) -> DataFrame:
    """(graph_id, src, dst, edge_index, *values): of edges between the same two nodes the first one's configuration."""
    first = edges.groupBy("graph_id", "src", "dst").agg(F.min_by(F.struct("edge_index", *values), "edge_index").alias("c"))
    return first.select("graph_id", "src", "dst", "c.*")


def effective_configs(edges: DataFrame, *values: str) -> DataFrame:
    """(graph_id, dst, *values): of all that lead to a node, each value by the last edge for which it is neither null
    nor 0; parallel edges all count as their first one."""
    first = pair_configs(edges, *values)
    truthy = lambda v: F.col(v).isNotNull() & (F.col(v).cast("string") != "0")
    return first.groupBy("graph_id", "dst").agg(*(F.max_by(F.when(truthy(v), F.col(v)), F.when(truthy(v), F.col("edge_index"))).alias(v) for v in values))


def with_defaults(own: Column, edge: Column, default: object) -> Column:
    """What an edge says, else what the node says, else the default."""
    return F.coalesce(edge, own, F.lit(default))
