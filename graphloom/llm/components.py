"""Connected components of a table of edges, without ever gathering a node's neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import joined_by, saved, scratch

#: Edges that a task ties together at once. Where no more are left, one task ties them all.
CHUNK = 1 << 19


def _tied(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the least that these edges connect it with."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    least = np.arange(len(nodes))
    while len(a):
        # both ends are roots: the larger goes under the least that it meets, and all find their roots again
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := least[least], least):
            least = up
        a, b = least[a], least[b]
        apart = a != b
        a, b = a[apart], b[apart]
    below = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[below], nodes[least[below]]


def _contracted(most: int):
    """For mapInArrow: edges (u, v) that connect what a task's edges connect, `most` of them at a time, as stars."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            ends = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("u", "v"))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _tied(*ends)], names=["u", "v"])

        for batch in batches:
            for k in range(0, batch.num_rows, most):
                part = batch.slice(k, most)
                if parts and sum(p.num_rows for p in parts) + part.num_rows > most:
                    yield closed()
                    parts = []
                parts.append(part)
        if parts:
            yield closed()

    return of


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (u, v): each u's listed neighbours are tied to the least of them (and u) instead of to u.

    With both, u sees all its neighbours and the larger ones are tied anew; else it sees the smaller ones only.
    """
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = saved(seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k")), "least")
    moved = joined_by(seen, least, ["u"], "k", F.xxhash64("v"))
    if both:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every node that has an edge; component is the least node that it reaches.

    Each task first ties what its own edges connect. If CHUNK edges or fewer are left, one task ties them all. Else large
    and small stars alternate until nothing moves; the rounds grow with the logarithm of the longest chain, and each is
    two joins with minima that are combined before they are shuffled; the edges of a node that has very many are joined
    in many tasks. Nodes are whole numbers; nulls and loops are no edges. The result is written.
    """
    with scratch(edges.sparkSession):
        now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        now, mark = saved(now.mapInArrow(_contracted(CHUNK), "u long, v long"), "edges"), None
        alone = now.count() <= CHUNK
        if alone:
            now = saved(now.coalesce(1).mapInArrow(_contracted(CHUNK), "u long, v long"), "tied")
        while not alone:
            print_of = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
            new = now.agg(F.count("*").alias("n"), print_of.alias("h")).first()
            if (new["n"], new["h"]) == mark or not new["n"]:
                break
            mark = (new["n"], new["h"])
            now = saved(_stars(_stars(now, True), False), "stars")
        centres = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
        return saved(now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(centres), "components", keep=True)
