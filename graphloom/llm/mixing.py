"""Mixing sources to target weights by a splitting tree of exact block quotas.

Sizes are words. Each source's target is its share by weight of the words asked for, at most `most` times its size; what
a source can't take is shared anew among the others. A target is taken as whole passes over the source and a part of
one more pass. A source's documents are dealt by a hash to blocks; a pass visits the blocks in an order of its own, and
the last pass ends in the middle of a block, and there in the middle of a document, where the target is met.

The draws (source, pass, block) are dealt to output shards without replacement: at the root of a tree stand all
sources' quotas; each node draws how many of each source go left from the multivariate hypergeometric distribution, so
quotas stay exact and every shard has the mix that a shuffle of all draws would have given it, without that shuffle.
Each source's permuted draws are then cut at the shards' quotas, and documents are shuffled only inside their shard.

Only a row per source and the quotas that aren't 0 reach the driver, no more of them than there are draws; where these
are very many, shards are larger. Nothing sorts a whole source: blocks have about `block_docs` documents, and the order
of a source's blocks is found in some thousand parts. Blocks go by ids and sizes, so that reruns agree; rows that share
both by the thousands, and would make one huge block, are dealt anew by row.

Defined results: null and empty texts have size 0 and are taken as such; a null source is a source, the last one; equal
rows are separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import bare, saved, scratch

WORD = r"[^\x20\x09-\x0D]+"
#: The most sources that the driver handles, and about the most quotas.
MOST_SOURCES, MOST_QUOTAS = 100_000, 4_000_000


class Mix(NamedTuple):
    """`documents`: a row for every row of the input, with row, doc_id, source, size, source_size, target.
    `draws`: a row for each time that a document is taken: row, doc_id, source, copy, words, shard, position.
    Both are already written; draws of a document that is taken in part have fewer words than it."""

    documents: DataFrame
    draws: DataFrame


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = 3, total: int | None = None) -> list[Fraction]:
    """Each source's share by weight of the total, none above `most` times its size, the excess reshared by weight."""
    asked = Fraction(sum(sizes) if total is None else total)
    weigh = [Fraction(w) for w in weights]
    out, free = [Fraction(0)] * len(sizes), list(range(len(sizes)))
    while free:
        scale = asked / (sum(weigh[i] for i in free) or 1)
        above = [i for i in free if weigh[i] * scale > most * sizes[i]]
        for i in above or free:
            out[i] = Fraction(most * sizes[i]) if above else weigh[i] * scale
        if not above:
            break
        asked -= sum(out[i] for i in above)
        free = [i for i in free if i not in set(above)]
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, source, draws): how many of each source's draws each shard gets, from the splitting tree, without zeros,
    by source and then shard. A node of the tree has only the sources with draws in it."""
    random = np.random.default_rng(seed)
    every = np.asarray(quotas, np.int64)
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    todo = [(np.flatnonzero(every), every[every > 0], 0, shards)]
    while todo:
        source, here, first, last = todo.pop()
        if last - first == 1 or not len(here):
            out.append((first, source, here))
            continue
        middle = (first + last) // 2
        left = random.multivariate_hypergeometric(here, int(here.sum()) * (middle - first) // (last - first), method="marginals")
        for draws, a, b in ((left, first, middle), (here - left, middle, last)):
            todo.append((source[draws > 0], draws[draws > 0], a, b))
    shard = np.repeat([s for s, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int64)
    source, draws = (np.concatenate([x[k] for x in out]) for k in (1, 2))
    order = np.lexsort((shard, source))
    return shard[order], source[order], draws[order]


def _permuted(*columns: Column | str) -> Column:
    return F.xxhash64(*columns)


def _running(rows: DataFrame, value: Column, part: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with `name`, the sum of `value` over the rows of a source until this one, in order of `part` and then `order`:
    each part is sorted by itself, and begins with the sum of the parts before it."""
    rows = rows.withColumn("_part", part).withColumn("_value", value)
    parts = rows.groupBy("s", "_part").agg(F.sum("_value").alias("_sum"))
    parts = parts.select("s", "_part", (F.sum("_sum").over(Window.partitionBy("s").orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum("_value").over(Window.partitionBy("s", "_part").orderBy(*order))
    return rows.join(parts, ["s", "_part"]).withColumn(name, F.col("_before") + within).drop("_part", "_value", "_before")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, total: int | None = None, whole: bool = False, block_docs: int = 512, shard_blocks: int = 64, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> Mix:
    """The mix of all documents; see the module's text. Sources by code point, null last, weigh as `weights` repeats.

    whole: take the document at a target's end whole if most of it is due, else not at all. row_col: a unique, written
    key of the rows that becomes `row`.
    """
    with scratch(docs.sparkSession):
        spark = docs.sparkSession
        sized = bare(docs, doc_id=id_col, source=source_col, text=text_col, **({"row": row_col} if row_col else {}))
        sized = sized.select(F.col("row") if row_col else F.monotonically_increasing_id().alias("row"), "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
        sized = saved(sized, "sized")
        stats = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MOST_SOURCES + 1).collect()
        if len(stats) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources: mix groups of them first")
        stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        aims = targets([r["size"] for r in stats], [weights[i % len(weights)] for i in range(len(stats))], most, total)
        info = []
        for i, (r, aim) in enumerate(zip(stats, aims, strict=True)):
            words = min(round(aim), most * r["size"])
            passes, part = divmod(words, r["size"]) if r["size"] else (0, 0)
            info.append((i, r["source"], r["size"], float(aim), int(passes), int(part), max(1, -(-r["docs"] // block_docs))))
        known = F.broadcast(spark.createDataFrame(info, "s int, name string, source_size long, target double, passes int, part long, blocks int"))
        rows = sized.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name")
        rows = rows.withColumn("spot", _permuted(F.lit(seed), "doc_id", "size"))
        rows = saved(rows.withColumn("block", F.pmod("spot", "blocks")), "documents", keep=True)
        summed = lambda: saved(rows.groupBy("s", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("passes").alias("passes"), F.first("part").alias("part")), "summed")
        blocks = summed()
        limit = max(8 * block_docs, sum(r["docs"] for r in stats) // 256)
        huge = blocks.where(F.col("n") > limit).select("s", "block", "n").collect()  # fewer than 256
        if huge:
            dealt = rows.join(F.broadcast(spark.createDataFrame(huge, "s int, block long, n long")), ["s", "block"], "left")
            dealt = dealt.withColumn("spot", F.when(F.col("n") > 0, _permuted(F.lit(seed), "spot", "row")).otherwise(F.col("spot")))
            within = F.col("blocks") * (1 + F.pmod("spot", F.ceil(F.col("n") / block_docs)))
            rows = saved(dealt.withColumn("block", F.when(F.col("n") > 0, F.col("block") + within).otherwise(F.col("block"))).drop("n"), "documents", keep=True)
            blocks = summed()

        # the order of the part pass, and where it ends
        key = _permuted(F.lit(seed + 1), "s", "block")
        blocks = _running(blocks, F.col("words"), F.shiftright(key, 52), [key, "block"], "upto")
        blocks = blocks.withColumn("due", F.greatest(F.lit(0), F.least("words", F.col("part") - F.col("upto") + F.col("words"))))
        drawn = F.transform(F.sequence(F.lit(0), F.col("passes")), lambda p: F.struct(p.alias("copy"), F.when(p < F.col("passes"), F.col("words")).otherwise(F.col("due")).alias("due")))
        drawn = blocks.select("s", "block", F.col("words").alias("all"), F.explode(F.filter(drawn, lambda d: (d["copy"] < F.col("passes")) | (d["due"] > 0))).alias("d")).select("s", "block", "all", "d.copy", "d.due")
        drawn = saved(drawn, "drawn")
        key = _permuted(F.lit(seed + 2), "s", "block", "copy")
        ranked = saved(_running(drawn, F.lit(1), F.col("copy") * 4096 + F.shiftright(key, 52), [key, "block"], "rank"), "ranked")

        # the splitting tree, and each source's cuts
        quota = {r["s"]: r["n"] for r in drawn.groupBy("s").agg(F.count("*").alias("n")).collect()}
        total_draws = sum(quota.values())
        shards = max(1, -(-total_draws // shard_blocks))
        if min(shards * len(stats), total_draws) > MOST_QUOTAS:
            shards = max(1, MOST_QUOTAS // len(stats))
        shard, source, draws = split_quotas([quota.get(i, 0) for i in range(len(stats))], shards, seed)
        ends = np.cumsum(draws)
        ends -= np.repeat((ends - draws)[np.flatnonzero(np.diff(source, prepend=-1))], np.bincount(source)[np.unique(source)]) if len(source) else 0
        cuts = pa.table({"s": pa.array(source, pa.int32()), "shard": pa.array(shard, pa.int32()), "low": pa.array(ends - draws, pa.int64()), "high": pa.array(ends, pa.int64())})
        cuts = spark.createDataFrame(cuts).select("s", "shard", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("rank"))
        placed = ranked.join(cuts, ["s", "rank"])

        # documents of the draws; the one block in which a source's part pass ends is cut at its words
        taken = rows.select("row", "doc_id", "source", "size", "spot", "s", "block").join(placed, ["s", "block"])
        whole_blocks = taken.where("due = all").withColumn("words", F.col("size"))
        within = Window.partitionBy("s", "block", "copy").orderBy("spot", "row")
        cut = taken.where("due < all").withColumn("upto", F.sum("size").over(within))
        due = F.greatest(F.lit(0), F.least("size", F.col("due") - F.col("upto") + F.col("size")))
        cut = cut.withColumn("words", F.when(2 * due >= F.col("size"), F.col("size")).otherwise(0) if whole else due).drop("upto").where("words > 0")
        local = Window.partitionBy("shard").orderBy(_permuted(F.lit(seed + 3), "shard", "row", "copy"), "row", "copy")
        draws = whole_blocks.unionByName(cut).withColumn("position", F.row_number().over(local) - 1)
        draws = saved(draws.select("row", "doc_id", "source", "copy", "words", "shard", "position"), "draws", keep=True)
        return Mix(rows.select("row", "doc_id", "source", "size", "source_size", "target"), draws)


def words_taken(mix: Mix) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) for every document, taken or not."""
    sums = mix.draws.groupBy("row").agg(F.sum("words").alias("taken"), F.count("*").alias("copies"))
    out = mix.documents.join(sums, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"))
