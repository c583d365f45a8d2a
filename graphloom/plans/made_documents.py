"""Documents in JSON and YAML made from the pages table, with every fault that the rules know, to be parsed again.

`faulty`: graph documents of which five in twelve have a bad root, no graph, or no nodes, one can't be parsed, and all
others have bad nodes and edges. `services`: small graphs without errors that differ in what lint looks at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import page_paths


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _by(number: Column, *values: Column | str) -> Column:
    out = F.lit(values[-1]) if isinstance(values[-1], str) else values[-1]
    for k in range(len(values) - 2, -1, -1):
        out = F.when(number == k, values[k]).otherwise(out)
    return out


def faulty(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, raw)."""
    k = F.col("page_id")
    path = F.when(k % 3 == 0, F.substring("path", 2, 1000)).otherwise(F.col("path"))
    nodes = _text(
        '[{"id":"a', k, '","type":" HTTP ","name":" Page ', k, ' ","config":{"url":"', path, '","method":"', F.when(k % 4 == 0, "trace").otherwise("get"), '"}},',
        '{"id":', k, ',"kind":"postgres","config":null},',
        '{"id":" b ","type":"rest","name":null,"config":{"url":null,"route":"/r","Auth":1}},',
        _by(k % 5, "null", '"text"', "{}", '{"id":"b"}', '{"id":"q","type":"kafka","kind":"x","config":[1]}'),
        ',{"id":"svc","type":"service","config":"x"},[]]',
    )
    edges = _text(
        '[{"from":"a', k, '","to":"b"},{"source":"b","target":" svc ","kind":" Queue-x "},{"from":"svc","to":"nope"},',
        '{"from":"nope","to":"svc","metadata":{"protocol":"ASYNC"}},7,{"from":"","source":"b","to":"b"},',
        '{"from":"svc","to":"', F.when(k % 2 == 1, _text("a", k)).otherwise("svc"), '","metadata":{"kind":"call","protocol":"http"},"kind":"queue","config":{"async":true}}]',
    )
    inner = _text('{"nodes":', nodes, ',"edges":', F.when(k % 12 == 7, F.lit("{}")).otherwise(edges), "}")
    whole = F.when(k % 2 == 0, _text('{"graph":', inner, "}")).otherwise(inner)
    raw = _by(k % 12, "5", "null", "[]", '{"metadata":{}}', '{"graph":{"nodes":{}}}', '{"nodes":[]}', '{"graph":', whole)
    return page_paths(spark, folder).select(k.alias("graph_id"), raw.alias("raw"))


def services(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, raw): graphs of a gateway, a service and a datastore, numbered after those of `faulty`."""
    k = F.col("page_id")
    key = _by(k % 4, ',"authRequired":false', ',"Security":[]', ',"other":1', "")
    url = F.when(k % 5 == 0, "/health").otherwise(F.col("path"))
    more = F.when(k % 3 == 0, ',{"source":"s","target":"d"}').otherwise("")
    raw = _text('{"graph":{"nodes":[{"id":"g","type":"gateway","name":"G","config":{"url":"', url, '"', key, '}},{"id":"s","type":"service"},{"id":"d","type":"postgres"}],"edges":[{"from":"g","to":"s"},{"from":"s","to":"d"}', more, "]}}")
    return page_paths(spark, folder).select((k + 1_000_000_000).alias("graph_id"), raw.alias("raw"))


def configured(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, raw): graphs of one node whose configuration is told in two places, of which one overrules."""
    k = F.col("page_id")
    own = _text('"config":{"route":', _by(k % 3, _text('"/r', k, '"'), '""', "null"), ',"url":"', F.col("path"), '","method":"PUT"}')
    data = _by(k % 5, ',"data":{"config":{"method":"POST","accepted":true}}', ',"data":{"config":{"method":"delete","route":null}}', ',"data":{"config":{"method":"","async":"true"}}', ',"data":{"config":[1]}', ',"data":null')
    raw = _text('{"nodes":[{"id":"e', k, '","type":"', _by(k % 4, "http", "cloudFunction", "HTTP", "service"), '",', own, data, "}]}")
    return page_paths(spark, folder).select(k.alias("graph_id"), raw.alias("raw"))


def yaml_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(graph_id, raw): YAML documents, two in seven without a graph."""
    k = F.col("page_id")
    good = _text("# page\ngraph:\n  metadata: {name: p", k, "}\n  nodes:\n    - id: ", _by(k % 3, "yes", "0o17", "n1"), "\n      type: HTTP\n      config: {url: '", F.col("path"), "', on: true}\n    - {id: b, kind: postgres}\n  edges:\n    - from: b\n      to: b\n")
    raw = _by(k % 7, "a: [", "- 1", good)
    return page_paths(spark, folder).select(k.cast("string").alias("graph_id"), raw.alias("raw"))


def many_operations(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, raw): descriptions with paths whose operations get the same id, and methods that count and don't."""
    k = F.col("page_id")
    path = F.col("path")
    raw = _text('{"openapi":"3.0.0","info":{"title":" Api ', k, '! ","version":"2"},"paths":{"', path, '":{"post":{},"get":{"summary":"Get"},"trace":{}},"', path, '/":{"get":{}},"', F.substring(path, 2, 1000), '-":{"get":{"operationId":"op"},"head":null}}}')
    return page_paths(spark, folder).select(k.alias("doc_id"), raw.alias("raw"))


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, raw): descriptions with what may be wrong with their shape."""
    k = F.col("page_id")
    version = _by(k % 4, '"openapi":"3.1.0",', '"openapi":2,', '"swagger":"2.0",', "")
    paths = _by(k % 3, '"paths":{},', '"paths":1,', "")
    info = _by(k % 5, '"info":{"title":"t","version":"1"}', '"info":{"title":"","version":"1"}', '"info":{}', '"info":null', '"info":{"title":null,"version":"1"}')
    raw = F.when(k % 11 == 10, "5").otherwise(_text("{", version, paths, info, "}"))
    return page_paths(spark, folder).select(k.alias("doc_id"), raw.alias("raw"))
