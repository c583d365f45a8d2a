"""Graphs derived from ordinary warehouse tables, so that the same rules run over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import GraphTables

_NOTHING = {"slot_kind": "object", "config_state": "absent", "config_type": "absent", "http_path": "", "http_method": "post", "health_url": ""}


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def case(value: Column, otherwise: str, **names: str) -> Column:
    out = F.lit(otherwise)
    for key, to in names.items():
        out = F.when(value == key, to).otherwise(out)
    return out


def as_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of rows (graph_id, node_ord, id, type, ...): what isn't given is absent."""
    rows = rows.withColumns({c: F.lit(v) for c, v in _NOTHING.items() if c not in rows.columns})
    if "name" not in rows.columns:
        rows = rows.withColumn("name", F.col("id"))
    return rows if "config_keys" in rows.columns else rows.withColumn("config_keys", F.lit(None).cast("array<string>"))


def as_edges(rows: DataFrame) -> DataFrame:
    rows = rows if "slot_kind" in rows.columns else rows.withColumn("slot_kind", F.lit("object"))
    return rows if "is_async" in rows.columns else rows.withColumn("is_async", F.lit(False))


def as_tables(nodes: DataFrame, edges: DataFrame) -> GraphTables:
    """The three tables of well-formed nodes and edges."""
    sizes = edges.groupBy("graph_id").agg(F.count("*").cast("int").alias("n_raw_edges"))
    graphs = nodes.groupBy("graph_id").agg(F.count("*").cast("int").alias("n_raw_nodes")).join(sizes, "graph_id", "left").fillna(0, ["n_raw_edges"])
    return GraphTables(graphs.withColumn("shape_code", F.lit(None).cast("string")).withColumn("edges_malformed", F.lit(False)), nodes, edges)


def supply(spark: SparkSession, folder: str) -> GraphTables:
    """One graph for each nation: customers, their orders, all parts, and the suppliers of what was ordered."""
    customer, orders, part, items, nation = (read(spark, folder, t) for t in ("customer", "orders", "part", "lineitem", "nation"))
    buyer = customer.select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("graph_id"))
    placed = orders.join(buyer, F.col("o_custkey") == F.col("custkey")).select("graph_id", "o_orderkey", "o_orderstatus", "custkey")
    lines = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(placed.select("graph_id", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    far = lambda k: F.lit(k * 10**12)
    key = F.col("c_custkey")
    kind = case(F.col("c_mktsegment"), "oauth-proxy", MACHINERY="gateway", BUILDING="http", AUTOMOBILE="rest-api", FURNITURE="service")
    nodes = customer.select(F.col("c_nationkey").alias("graph_id"), key.alias("node_ord"), F.concat(F.lit("c"), key).alias("id"), kind.alias("type"), F.when(key % 7 == 0, "").otherwise(F.col("c_name")).alias("name"))
    key = F.col("o_orderkey")
    id_ = F.concat(F.lit("o"), key)
    nodes = nodes.unionByName(placed.select("graph_id", (far(1) + key).alias("node_ord"), id_.alias("id"), case(F.col("o_orderstatus"), "processor", P="service", O="kafka-topic").alias("type"), id_.alias("name")))
    key = F.col("p_partkey")
    id_ = F.concat(F.lit("p"), key)
    every = F.broadcast(nation.select(F.col("n_nationkey").alias("graph_id")))
    nodes = nodes.unionByName(part.crossJoin(every).select("graph_id", (far(2) + key).alias("node_ord"), id_.alias("id"), case(F.col("p_type"), "service", SMALL="redis-cache", PROMO="iam").alias("type"), id_.alias("name")))
    key = F.col("l_suppkey")
    id_ = F.concat(F.lit("s"), key)
    sold = lines.select("graph_id", "l_suppkey").distinct()
    nodes = nodes.unionByName(sold.select("graph_id", (far(3) + key).alias("node_ord"), id_.alias("id"), F.lit("postgres").alias("type"), id_.alias("name")))

    def edge(rows: DataFrame, kind: int, src: tuple[str, str], dst: tuple[str, str], *keys: str) -> DataFrame:
        ends = [F.concat(F.lit(p), F.col(c)).alias(n) for (p, c), n in ((src, "src"), (dst, "dst"))]
        return rows.select("graph_id", *ends, F.lit(kind).alias("k"), *(F.coalesce(F.col(c) if c else F.lit(None), F.lit(0)).cast("long").alias(f"k{i}") for i, c in enumerate((*keys, "", "", "")[:4])))

    line_keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = edge(placed, 1, ("c", "custkey"), ("o", "o_orderkey"), "o_orderkey")
    rows = rows.unionByName(edge(lines, 2, ("o", "l_orderkey"), ("p", "l_partkey"), *line_keys))
    rows = rows.unionByName(edge(lines, 3, ("p", "l_partkey"), ("s", "l_suppkey"), *line_keys))
    rows = rows.unionByName(edge(buyer, 4, ("c", "custkey"), ("p", "custkey"), "custkey"))
    edges = _numbered(rows, F.col("k") * (1 << 40) + F.shiftright("k0", 14), ("k", "k0", "k1", "k2", "k3")).select("graph_id", "edge_index", "src", "dst")
    return as_tables(as_nodes(nodes), as_edges(edges))


def _numbered(rows: DataFrame, part: Column, order: tuple[str, ...]) -> DataFrame:
    """rows with edge_index, their places in their graph in the given order; `part` grows along that order. Each part is
    sorted by itself, and begins with the number of rows in those before it."""
    rows = rows.withColumn("_part", part)
    parts = rows.groupBy("graph_id", "_part").agg(F.count("*").alias("_n"))
    parts = parts.select("graph_id", "_part", (F.sum("_n").over(Window.partitionBy("graph_id").orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("graph_id", "_part").orderBy(*order))
    return rows.withColumn("_place", place).join(parts, ["graph_id", "_part"]).withColumn("edge_index", (F.col("_before") + F.col("_place") - 1).cast("int"))


def talks(spark: SparkSession, folder: str) -> GraphTables:
    """One graph for each conversation: a chain of its turns, every tenth bent back to its beginning. Graphs go by conv_id
    as text, '' where it is null: those turns are a conversation too. Rows of one turn, which only a null conv_id should
    have, count once, with the greatest role."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    rows = read(spark, folder, "conversations").groupBy("conv_id", "turn").agg(F.max("role").alias("role"))
    return _chains(rows.select(name.alias("graph_id"), "turn", "role", (F.col("conv_id") % 10 == 0).alias("bent")))


def _chains(turns: DataFrame) -> GraphTables:
    id_ = lambda c: F.concat(F.lit("t"), c)
    nodes = turns.select("graph_id", F.col("turn").alias("node_ord"), id_(F.col("turn")).alias("id"), case(F.col("role"), "other", user="http", assistant="service", system="auth").alias("type"))
    later = turns.select("graph_id", (F.col("turn") - 1).alias("turn"))
    steps = turns.select("graph_id", "turn").join(later, ["graph_id", "turn"]).select("graph_id", F.col("turn").alias("edge_index"), id_(F.col("turn")).alias("src"), id_(F.col("turn") + 1).alias("dst"))
    ends = turns.where("bent").groupBy("graph_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    bent = ends.select("graph_id", F.col("b").alias("edge_index"), id_(F.col("b")).alias("src"), id_(F.col("a")).alias("dst"))
    return as_tables(as_nodes(nodes), as_edges(steps.unionByName(bent)))


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """pages with `path`, that of their URL."""
    return read(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))


def health_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, page_id, path): paths of pages with typical endings, but for graph 3 none that is healthy."""
    k = F.col("page_id") % 7
    ending = F.when((F.col("page_id") % 20 == 3) & k.isin(0, 1, 3), "").when(k == 0, "/health").when(k == 1, "/healthz?x=1").when(k == 2, "/unhealthy").when(k == 3, "/ping/").when(k == 4, "/statusx").otherwise("")
    return page_paths(spark, folder).select((F.col("page_id") % 20).alias("graph_id"), "page_id", F.concat("path", ending).alias("path"))


def damaged(spark: SparkSession, folder: str) -> GraphTables:
    """Orders as nodes of which every fiftieth takes its neighbour's id, and edges of which every 37th has no source."""
    rows = read(spark, folder, "orders").select(F.lit(0).alias("graph_id"), F.col("o_orderkey").alias("k"))
    nodes = rows.select("graph_id", F.col("k").alias("node_ord"), F.when(F.col("k") % 50 == 0, F.col("k") - 1).otherwise(F.col("k")).cast("string").alias("id"), F.lit("service").alias("type"))
    edges = rows.select("graph_id", F.col("k").alias("edge_index"), F.when(F.col("k") % 37 == 0, -1).otherwise(F.col("k")).cast("string").alias("src"), F.lit("7").alias("dst"))
    return as_tables(as_nodes(nodes), as_edges(edges))


def http_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as HTTP nodes of which some have a bad path, a bad method, or an odd type."""
    k = F.col("page_id")
    path = F.when(k % 6 == 0, F.substring("path", 2, 100)).otherwise(F.col("path"))
    method = F.element_at(F.array(*map(F.lit, ("get", "POST", "Put", "fetch", "delete", "trace", "HEAD"))), (k % 7 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("http", "rest", "gateway", "graphql", "service"))), (k % 5 + 1).cast("int"))
    return as_nodes(page_paths(spark, folder).select((k % 20).alias("graph_id"), k.alias("node_ord"), F.concat(F.lit("n"), k).alias("id"), kind.alias("type"), path.alias("http_path"), method.alias("http_method")))


def specs(spark: SparkSession, folder: str) -> DataFrame:
    """An API description for each page: (doc_id, raw)."""
    k = F.col("page_id")
    method = F.element_at(F.array(*map(F.lit, ("get", "post", "put", "patch", "delete", "options", "head"))), (k % 7 + 1).cast("int"))
    own = F.when(k % 5 == 0, F.lit(',"security":[]')).when(k % 5 == 1, F.lit(',"security":[{"zeta":[]},{" alpha ":[],"zeta":[]}]')).otherwise("")
    overall = F.when(k % 20 < 10, F.lit(',"security":[{"bearer":[]}]')).otherwise("")
    summary = F.when(k % 3 == 0, F.concat(F.lit('"summary":"Page '), k, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('"operationId":"op'), k, F.lit('"'))).otherwise(F.lit('"summary":""'))
    raw = F.concat(F.lit('{"openapi":"3.0.3","info":{"title":"Spec '), k, F.lit('","version":"1"},"paths":{"'), F.col("path"), F.lit('":{"'), method, F.lit('":{'), summary, own, F.lit("}}}"), overall, F.lit("}"))
    return page_paths(spark, folder).select(k.alias("doc_id"), raw.alias("raw"))


def edge_configs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as edges from users to event types, with attempts."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, folder, "events").select(F.lit(0).alias("graph_id"), F.col("user_id").cast("string").alias("src"), F.col("event_type").alias("dst"), F.col("event_id").alias("edge_index"), (k % 4).alias("attempts"))


def channel_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Events as edges that are marked, or have a protocol, or a kind."""
    k = F.col("event_id")
    protocol = F.element_at(F.array(*map(F.lit, ("http", "ASYNC", "Queue", "grpc", ""))), (k % 5 + 1).cast("int"))
    kind = F.when(k % 6 == 0, "upstream").when(k % 6 == 1, "Kafka-Link").otherwise(F.col("event_type"))
    return read(spark, folder, "events").select(k.alias("event_id"), (k % 11 == 0).alias("marked"), F.lower(protocol).alias("protocol"), F.lower(kind).alias("kind"))


def file_maps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents as expected files, and a copy of which some are gone, changed, or new."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    name = lambda p: F.concat(F.lit(p), k).alias("path")
    expected = docs.select(name("d/"), F.col("text").alias("content"))
    changed = F.when(k % 7 == 0, F.concat("text", F.lit(" x"))).when(k % 5 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    actual = docs.where(k % 11 != 0).select(name("d/"), changed.alias("content"))
    return expected, actual.unionByName(docs.where(k % 13 == 0).select(name("x/"), F.col("text").alias("content")))


def endpoint_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as raw nodes of generators."""
    k = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, ("http", "cloudFunction", "httpRequest", "HTTP", "service", "rest"))), (k % 6 + 1).cast("int"))
    method = F.element_at(F.array(*map(F.lit, ("GET", "POST", "DELETE", "", "put"))), (k % 5 + 1).cast("int"))
    return page_paths(spark, folder).select((k % 20).alias("graph_id"), k.alias("node_ord"), F.concat(F.lit("n"), k).alias("id"), kind.alias("raw_type"), F.when(k % 4 == 0, "").otherwise(F.col("path")).alias("route"), F.col("path").alias("url"), method.alias("method"), (k % 3 == 0).alias("is_async"))


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, node_id, service) of pages."""
    k = F.col("page_id")
    method = F.element_at(F.array(*map(F.lit, ("get", "post", "put", "patch", "delete", "options", "head"))), (k % 7 + 1).cast("int"))
    return page_paths(spark, folder).select("page_id", T.slug_of_node(F.col("path"), method).alias("node_id"), T.slug_of_service(F.concat(F.lit(" My Service/"), F.col("path"))).alias("service"))
