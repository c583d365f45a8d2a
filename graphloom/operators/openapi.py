"""API descriptions: their shape, their operations as nodes, and what security an operation ends up with.

Descriptions are rows (doc_id, raw, doc): JSON text, whose order of keys counts, and the same as VARIANT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variants as V

# The methods in the order in which a path's operations are listed, and the places of a description.
METHODS = ("get", "post", "put", "patch", "delete", "options", "head")
BUNDLE_PATHS = ("openapi.yaml", "openapi.yml", "openapi.json", "docs/openapi.yaml")


class IngestError(ValueError):
    """A description that gives no graph."""


def described(rows: DataFrame) -> DataFrame:
    """(doc_id, raw, doc) of (doc_id, raw); doc is null where raw is no JSON."""
    return rows.select("doc_id", "raw", F.try_parse_json("raw").alias("doc"))


def _members(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.when(V.kind_of(value) == "object", value), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def shape_errors(doc: Column) -> Column:
    """What is wrong with a description's shape, in order; empty if nothing."""
    kind = V.kind_of(doc)
    version, openapi = V.text_of(V.member(doc, "openapi", "swagger")), V.member(doc, "openapi")
    paths, info = V.kind_of(V.raw_member(doc, "paths")), V.raw_member(doc, "info")
    no_info = ~V.kind_of(info).isin("object", "array")
    blank = lambda name: (V.kind_of(V.raw_member(info, name)) == "absent") | ((F.schema_of_variant(V.raw_member(info, name)) == "STRING") & (V.text_of(V.raw_member(info, name)) == ""))
    errors = F.array_compact(
        F.array(
            F.when(version.isNull(), "Missing openapi or swagger version field").when(openapi.isNotNull() & ~version.startswith("3"), F.concat(F.lit("Expected OpenAPI 3.x, got: "), version)),
            F.when(~paths.isin("object", "array"), "Missing or invalid paths object"),
            F.when(no_info, "Missing info object"),
            F.when(~no_info & blank("title"), "Missing info.title"),
            F.when(~no_info & blank("version"), "Missing info.version"),
        )
    )
    return F.when(~kind.isin("object", "array"), F.array(F.lit("Document is empty or not an object"))).otherwise(errors)


def checked(docs: DataFrame) -> DataFrame:
    """(doc_id, ok, errors)."""
    rows = docs.select("doc_id", shape_errors(F.col("doc")).alias("errors"))
    return rows.select("doc_id", (F.size("errors") == 0).alias("ok"), "errors")


def scheme_names(requirements: Column) -> Column:
    """The distinct trimmed scheme names of a list of requirements, sorted."""
    lists = F.transform(F.try_variant_get(requirements, "$", "array<variant>"), lambda r: F.map_keys(_members(r)))
    names = F.transform(F.flatten(F.coalesce(lists, F.array().cast("array<array<string>>"))), T.trimmed)
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def resolved_security(operation: Column, overall: Column) -> tuple[Column, Column]:
    """(authRequired, security) of an operation: its own key counts even if its value is null or no list."""
    own = F.map_contains_key(_members(operation), "security")
    effective = F.when(own, V.raw_member(operation, "security")).otherwise(overall)
    listed = V.kind_of(effective) == "array"
    empty = F.size(F.try_variant_get(effective, "$", "array<variant>")) == 0
    names = scheme_names(effective)
    return F.when(listed & empty, F.lit(False)), F.when(listed & ~empty & (F.size(names) > 0), names)


def operations(docs: DataFrame) -> DataFrame:
    """One row for each operation: doc_id, node_ord, id, type, kind, name, url, method, operation_id, auth_required,
    security. Ids that collide get a number, in order; so does what was cut to the same 80 characters."""
    rows = docs.select("doc_id", V.raw_member(F.col("doc"), "security").alias("overall"), F.explode(_members(V.raw_member(F.col("doc"), "paths"))).alias("path_key", "item"), F.json_object_keys(F.get_json_object("raw", "$.paths")).alias("keys"))
    rows = rows.select("doc_id", "overall", "path_key", F.array_position("keys", F.col("path_key")).alias("path_ord"), _members(F.col("item")).alias("item"))
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, METHODS))).alias("method_ord", "verb")).withColumn("operation", F.try_element_at("item", F.col("verb")))
    rows = rows.where(V.kind_of(F.col("operation")) == "object")
    url = T.with_slash(F.col("path_key"))
    string = lambda name: F.when(F.schema_of_variant(V.raw_member(F.col("operation"), name)) == "STRING", V.text_of(V.raw_member(F.col("operation"), name)))
    title = F.coalesce(string("summary"), string("operationId"), F.lit(""))
    auth, security = resolved_security(F.col("operation"), F.col("overall"))
    rows = rows.select(
        "doc_id",
        "path_ord",
        "method_ord",
        T.slug_of_node(url, F.col("verb")).alias("base"),
        F.coalesce(F.nullif(title, F.lit("")), F.concat(F.upper("verb"), F.lit(" "), url)).alias("name"),
        url.alias("url"),
        F.upper("verb").alias("method"),
        F.when(T.trimmed(string("operationId")) != "", string("operationId")).alias("operation_id"),
        auth.alias("auth_required"),
        security.alias("security"),
    )
    order = Window.partitionBy("doc_id").orderBy("path_ord", "method_ord")
    same = Window.partitionBy("doc_id", "base").orderBy("path_ord", "method_ord")
    k = F.row_number().over(same) - 1
    return rows.select(
        "doc_id",
        (F.row_number().over(order) - 1).alias("node_ord"),
        F.when(k > 0, F.concat("base", F.lit("_"), k.cast("string"))).otherwise(F.col("base")).alias("id"),
        F.lit("http").alias("type"),
        F.lit("http").alias("kind"),
        "name",
        "url",
        "method",
        "operation_id",
        "auth_required",
        "security",
    )


def canonical(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph documents (doc_id, raw) of good descriptions, and (doc_id, error) of the others."""
    shape = checked(docs)
    nodes = operations(docs.join(shape.where("ok"), "doc_id", "left_semi"))
    config = F.struct(F.col("url"), F.col("url").alias("route"), "method", F.lit(True).alias("openApiIngest"), F.col("operation_id").alias("operationId"), F.col("auth_required").alias("authRequired"), "security")
    listed = nodes.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_ord", F.struct("id", "type", "kind", "name", config.alias("config")).alias("node")))), lambda x: x["node"]).alias("nodes"))
    doc = F.col("doc")
    info = V.raw_member(doc, "info")
    read = lambda name, default: F.coalesce(V.text_of(V.member(info, name)), F.lit(default))
    service = T.slug_of_service(read("title", "OpenAPI service"))
    provenance = F.struct(F.lit("openapi-ingest").alias("source"), F.coalesce(V.text_of(V.member(doc, "openapi", "swagger")), F.lit("")).alias("openapiVersion"), read("title", "").alias("specTitle"), read("version", "").alias("specVersion"))
    metadata = F.struct(service.alias("name"), F.nullif(T.trimmed(read("description", "")), F.lit("")).alias("description"), provenance.alias("provenance"))
    graph = F.struct(metadata.alias("metadata"), "nodes", F.array().alias("edges"))
    out = docs.join(listed, "doc_id").select("doc_id", F.to_json(F.struct(F.struct(service.alias("name")).alias("metadata"), graph.alias("graph"))).alias("raw"))
    bad = shape.where("not ok").select("doc_id", F.concat(F.lit("Invalid OpenAPI document shape: "), F.array_join("errors", "; ")).alias("error"))
    empty = shape.where("ok").join(listed, "doc_id", "left_anti").select("doc_id", F.lit("No operations found under `paths` (supported methods: GET, POST, PUT, PATCH, DELETE, OPTIONS, HEAD).").alias("error"))
    return out, bad.unionByName(empty)


def found_in_bundles(files: DataFrame) -> DataFrame:
    """(graph_id, path, content): of each bundle the first description, by place, that isn't blank."""
    order = F.array_position(F.array(*map(F.lit, BUNDLE_PATHS)), F.col("path"))
    rows = files.where(F.col("path").isin(*BUNDLE_PATHS) & (T.trimmed(F.col("content")) != ""))
    return rows.groupBy("graph_id").agg(F.min_by(F.struct("path", "content"), order).alias("f")).select("graph_id", "f.*")
