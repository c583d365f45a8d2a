"""What the operators share: tables under an operator's own names, and joins that a hot key can't hold up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import released, saved, scratch, shared_folder

__all__ = ["bare", "joined_by", "released", "saved", "scratch", "shared_folder"]

#: A key with more than one row in so many is hot: fewer than so many keys can be.
HOT = 256


def bare(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the given names: other columns can't clash with an operator's own."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def joined_by(rows: DataFrame, dims: DataFrame, keys: Sequence[str], weight: str, spread: Column | None = None) -> DataFrame:
    """The inner join of rows with dims, a written table with one row for each key and in `weight` how many rows have it.

    Rows of a key with more than 1/HOT of all rows are dealt to HOT tasks, each with a copy of the key's one row; which
    keys these are is broadcast, and fewer than HOT can be. Without such a key it is a plain join. Null keys join nothing. Rows are dealt by `spread`, an integer
    that tells most rows of a key apart, else by their places: then they must come from a written table without a shuffle
    in between, so that a task that is repeated deals them as before.
    """
    found = dims.agg(F.sum(weight).alias("n"), F.max(weight).alias("most")).first()
    total = found["n"] or 0
    if (found["most"] or 0) <= total // HOT + 1:
        return rows.join(dims, list(keys))
    hot = dims.where(F.col(weight) > total // HOT + 1).select(*keys, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), list(keys), "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id() if spread is None else spread, F.lit(HOT)).cast("int")).otherwise(0)).drop("_hot")
    salts = F.when(F.col(weight) > total // HOT + 1, F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(dims.withColumn("_salt", F.explode(salts)), [*keys, "_salt"]).drop("_salt")
