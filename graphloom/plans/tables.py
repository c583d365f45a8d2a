"""The tables of a corpus of graphs, and the facts that rules are evaluated over.

`graphs`: graph_id, shape_code (why there is nothing to look into, or null), edges_malformed, n_raw_nodes, n_raw_edges.
`nodes`: graph_id, node_ord, slot_kind, id, type, typed (`type` as written), name, config_state, config_keys, http_path,
http_method, health_url, and the open objects config, schema and data_config.
`edges`: graph_id, edge_index, slot_kind, src, dst, is_async (by the edge itself, not by what it leads to).

A graph's rows needn't be in one partition: all joins are by (graph_id, id), so one giant graph spreads like many small
ones. Facts are columns that rules ask for by group; joins that no rule asks for aren't planned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variants as V
from ..storage import saved


@dataclass(frozen=True)
class GraphTables:
    graphs: DataFrame
    nodes: DataFrame
    edges: DataFrame

    def without(self, graph_ids: DataFrame) -> GraphTables:
        """The tables without the graphs of the given ids."""
        return GraphTables(*(t.join(graph_ids.select("graph_id").distinct(), "graph_id", "left_anti") for t in (self.graphs, self.nodes, self.edges)))

    def saved(self) -> GraphTables:
        """The tables written once, without the open objects that no rule reads: documents are parsed once, and what
        follows plans from plain columns."""
        slim = ([c for c, kind in t.dtypes if kind != "variant"] for t in (self.graphs, self.nodes, self.edges))
        return GraphTables(*(saved(t.select(*columns), name) for t, columns, name in zip((self.graphs, self.nodes, self.edges), slim, ("graphs", "nodes", "edges"), strict=True)))

    def views(self) -> None:
        """Registers the three tables for spark.sql."""
        for name in ("graphs", "nodes", "edges"):
            getattr(self, name).createOrReplaceTempView(name)


def _object_or_none(value: Column) -> Column:
    return F.when(V.kind_of(value) == "object", value)


def _once(rows: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The kept columns and new ones, each computed once however often it is used: the optimizer doesn't copy what comes
    out of a generator into all that refers to it, filters included."""
    return rows.select(*keep, F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def normalized(documents: DataFrame) -> GraphTables:
    """Tables of documents (graph_id, root VARIANT); a null root is a document that could not be parsed."""
    root = F.col("root")
    rows = _once(documents, "graph_id", "root", whole=V.kind_of(root), inner=V.raw_member(root, "graph"), listed=V.kind_of(V.raw_member(root, "nodes")))
    rows = _once(rows, "graph_id", "root", "whole", "inner", "listed", wrapped=V.kind_of(F.col("inner")).isin("object", "array"))
    graph = F.when(F.col("wrapped"), F.col("inner")).when(F.col("listed") == "array", root)
    rows = _once(rows, "graph_id", "whole", graph=F.when(F.col("whole") == "object", graph))
    rows = _once(rows, "graph_id", "whole", "graph", raw_nodes=V.raw_member(F.col("graph"), "nodes"), raw_edges=V.raw_member(F.col("graph"), "edges"))
    slots = lambda name: F.when(V.kind_of(F.col(name)) == "array", F.try_variant_get(name, "$", "array<variant>"))
    rows = _once(rows, "graph_id", "whole", "graph", node_slots=slots("raw_nodes"), edge_slots=slots("raw_edges"), edge_kind=V.kind_of(F.col("raw_edges")))
    shape = (
        F.when(~F.col("whole").isin("object", "array"), "IR-STRUCT-INVALID_ROOT")
        .when(F.col("graph").isNull(), "IR-STRUCT-NO_GRAPH")
        .when(F.col("node_slots").isNull(), "IR-STRUCT-NODES_NOT_ARRAY")
        .when(F.size("node_slots") == 0, "IR-STRUCT-EMPTY_GRAPH")
    )
    rows = _once(rows, "graph_id", "graph", "node_slots", "edge_slots", "edge_kind", shape_code=shape)
    size = lambda name: F.when(F.col(name).isNotNull(), F.size(name)).otherwise(0)
    graphs = rows.select(
        "graph_id",
        "shape_code",
        (F.col("shape_code").isNull() & ~F.col("edge_kind").isin("absent", "array")).alias("edges_malformed"),
        size("node_slots").alias("n_raw_nodes"),
        size("edge_slots").alias("n_raw_edges"),
        V.raw_member(F.col("graph"), "metadata").alias("metadata"),
    )
    good = rows.where("shape_code is null")
    return GraphTables(graphs, _nodes(good.select("graph_id", F.posexplode("node_slots").alias("node_ord", "slot"))), _edges(good.select("graph_id", F.posexplode("edge_slots").alias("edge_index", "slot"))))


def _text(name: str) -> Column:
    return T.trimmed(F.coalesce(V.text_of(F.col(name)), F.lit("")))


def _nodes(slots: DataFrame) -> DataFrame:
    slot, config = F.col("slot"), F.col("config")
    rows = _once(slots, "graph_id", "node_ord", slot_kind=V.kind_of(slot), raw_id=V.member(slot, "id"), raw_type=V.member(slot, "type", "kind"), raw_typed=V.member(slot, "type"), raw_name=V.member(slot, "name"), raw_config=V.raw_member(slot, "config"), raw_schema=V.raw_member(slot, "schema"), raw_data=V.raw_member(V.raw_member(slot, "data"), "config"))
    rows = _once(
        rows,
        "graph_id",
        "node_ord",
        "slot_kind",
        id=_text("raw_id"),
        type=F.lower(_text("raw_type")),
        typed=V.text_of(F.col("raw_typed")),
        name=_text("raw_name"),
        config_type=V.script_type(F.col("raw_config")),
        config_state=V.kind_of(F.col("raw_config")),
        config=_object_or_none(F.col("raw_config")),
        schema=_object_or_none(F.col("raw_schema")),
        data_config=_object_or_none(F.col("raw_data")),
    )
    rows = _once(rows, *rows.columns, raw_path=V.member(config, "url", "route"), raw_method=V.member(config, "method"), raw_health=V.member(config, "url"))
    return rows.select(
        *(c for c in rows.columns if not c.startswith("raw_")),
        F.json_object_keys(F.to_json(config)).alias("config_keys"),
        _text("raw_path").alias("http_path"),
        T.trimmed(F.coalesce(V.text_of(F.col("raw_method")), F.lit("post"))).alias("http_method"),
        _text("raw_health").alias("health_url"),
    )


def _edges(slots: DataFrame) -> DataFrame:
    slot, config, metadata = F.col("slot"), F.col("config"), F.col("metadata")
    rows = _once(
        slots,
        "graph_id",
        "edge_index",
        slot_kind=V.kind_of(slot),
        raw_id=V.member(slot, "id"),
        raw_src=V.member(slot, "from", "source"),
        raw_dst=V.member(slot, "to", "target"),
        raw_kind=V.member(slot, "kind"),
        raw_config=V.raw_member(slot, "config"),
        raw_metadata=V.raw_member(slot, "metadata"),
    )
    rows = _once(rows, "graph_id", "edge_index", "slot_kind", id=_text("raw_id"), src=_text("raw_src"), dst=_text("raw_dst"), config=_object_or_none(F.col("raw_config")), metadata=_object_or_none(F.col("raw_metadata")), top_kind=_text("raw_kind"))
    members = {f"raw_{side}_{name}": V.member(F.col(side), name) for side in ("metadata", "config") for name in ("kind", "protocol")}
    rows = _once(rows, *rows.columns, **members, marked=V.is_true(V.raw_member(metadata, "async")) | V.is_true(V.raw_member(config, "async")))
    rows = _once(rows, *(c for c in rows.columns if not c.startswith("raw_")), **{name[4:]: V.text_of(F.col(name)) for name in members})
    own_kind = F.col("metadata_kind")
    promoted = (F.col("top_kind") != "") & (T.trimmed(F.coalesce(own_kind, F.lit(""))) == "")
    kind = F.lower(F.coalesce(F.when(promoted, F.col("top_kind")).otherwise(own_kind), "config_kind", F.lit("")))
    protocol = F.lower(F.coalesce("metadata_protocol", "config_protocol", F.lit("")))
    rows = rows.withColumn("is_async", edge_is_async(F.col("marked"), protocol, kind))
    return rows.drop("marked", *(name[4:] for name in members))


def edge_is_async(marked: Column, protocol: Column, kind: Column) -> Column:
    """Whether an edge is asynchronous by its own data: a mark, the (lower-case) protocol, or the kind."""
    return F.coalesce(marked, F.lit(False)) | F.coalesce(protocol.isin(*T.ASYNC_PROTOCOLS), F.lit(False)) | F.coalesce(kind.rlike(T.ASYNC_KIND_PARTS), F.lit(False))


class Facts:
    """Derived tables, each planned when first asked for."""

    def __init__(self, tables: GraphTables) -> None:
        self.tables = tables

    @cached_property
    def classified(self) -> DataFrame:
        """One row for each id: of nodes that share it the last one's values, at the first one's place."""
        named = self.tables.nodes.where("id <> ''")
        values = [c for c in ("type", "name", "config_keys", "health_url") if c in named.columns]
        rows = named.groupBy("graph_id", "id").agg(F.max_by(F.struct(*values), "node_ord").alias("v"), F.min("node_ord").alias("first_ord"))
        rows = rows.select("graph_id", "id", "first_ord", "v.*")
        kind = F.col("type")
        return rows.select(
            *rows.columns,
            T.is_http_like(kind).alias("is_http_like"),
            T.is_db_like(kind).alias("is_db_like"),
            T.is_auth_like(kind).alias("is_auth_like"),
            T.is_queue_like(kind).alias("is_queue_like"),
        )

    def written(self) -> Facts:
        """The same facts, with those that all others rest on written once."""
        out = Facts(GraphTables(saved(self.tables.graphs, "graphs"), self.tables.nodes, self.tables.edges))
        out.__dict__["classified"] = saved(self.classified, "classified")
        out.__dict__["edge_facts"] = saved(out.edge_facts, "edge-facts")
        return out

    def _known(self, side: str, *flags: str) -> DataFrame:
        return self.classified.select("graph_id", F.col("id").alias(side), F.lit(True).alias(f"{side}_known"), *(F.col(f).alias(f"{side}_{f}") for f in flags))

    @cached_property
    def edge_facts(self) -> DataFrame:
        """Every edge slot, with what is known of both ends and whether it is asynchronous in the end."""
        rows = self.tables.edges.join(self._known("src", "is_http_like"), ["graph_id", "src"], "left")
        rows = rows.join(self._known("dst", "is_db_like", "is_queue_like", "is_auth_like"), ["graph_id", "dst"], "left")
        flags = [c for c in rows.columns if c.startswith(("src_", "dst_"))]
        rows = rows.select(*(c for c in rows.columns if c not in flags), *(F.coalesce(c, F.lit(False)).alias(c) for c in flags))
        return rows.withColumn("valid", F.col("src_known") & F.col("dst_known")).withColumn("is_async", F.col("is_async") | F.col("dst_is_queue_like"))

    @cached_property
    def degrees(self) -> DataFrame:
        """(graph_id, id, out_deg, in_deg, first_out) over edges between known nodes, repeats counted."""
        ends = self.edge_facts.where("valid").select("graph_id", "edge_index", F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))).alias("e"))
        out = F.col("e.out")
        return ends.groupBy("graph_id", F.col("e.id").alias("id")).agg(F.sum(out).alias("out_deg"), F.sum(1 - out).alias("in_deg"), F.min(F.when(out == 1, F.col("edge_index"))).alias("first_out"))

    def node_facts(self, needs: frozenset[str] = frozenset({"degrees", "auth", "size"})) -> DataFrame:
        """classified with the groups of columns that are needed."""
        rows = self.classified
        if "degrees" in needs:
            rows = rows.join(self.degrees, ["graph_id", "id"], "left").fillna(0, ["out_deg", "in_deg"])
        if "auth" in needs:
            led = self.edge_facts.where("valid and dst_is_auth_like").select("graph_id", F.col("src").alias("id")).distinct().withColumn("to_auth", F.lit(True))
            rows = rows.join(led, ["graph_id", "id"], "left").fillna(False, ["to_auth"])
        if "size" in needs:
            sizes = self.classified.groupBy("graph_id").agg(F.count("*").alias("n_nodes")).join(self.tables.graphs.select("graph_id", "n_raw_edges"), "graph_id")
            rows = rows.join(sizes, "graph_id")
        return rows

    @cached_property
    def pairs(self) -> DataFrame:
        """edge_facts with each edge's rank among those with the same ends, and the first one's index."""
        same = Window.partitionBy("graph_id", "src", "dst").orderBy("edge_index")
        named = self.edge_facts.where("src <> '' and dst <> ''")
        return named.withColumn("pair_rank", F.row_number().over(same)).withColumn("first_pair_index", F.first("edge_index").over(same))
