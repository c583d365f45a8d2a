"""Exact duplicates: groups of equal texts, found by hash and told apart by their bytes.

DataFrame functions only. Texts are grouped by a 128-bit hash together with the text itself, so the aggregation's
grouping compares bytes and a collision of hashes never joins two texts; copies are combined before the shuffle, so a
text with very many copies is no hot group. Each row then finds its group by two digests, the rows of a large group in
many tasks; should two different texts agree in both, which is checked, rows are joined by text instead.

Defined results: a null text counts as empty, and empty texts are equal to each other; A-Z are lower-cased first unless
told otherwise; null ids lose against any id; rows with the kept id in the same group are all kept, as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bare, joined_by, saved


def lower_ascii(text: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digests(text: Column) -> tuple[Column, Column]:
    return F.unhex(F.md5(text)), F.sha2(text, 256)


def exact_duplicates(docs: DataFrame, keep: str = "smallest", fold_case: bool = True, id_col: str = "doc_id", text_col: str = "text", digests=_digests) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row. keep: "smallest" or "largest" id of equal texts."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = bare(docs, doc_id=id_col, text=text_col).withColumn("text", lower_ascii(text) if fold_case else text)
    hash_128, second = digests(F.col("text"))
    best = F.min("doc_id") if keep == "smallest" else F.max("doc_id")
    groups = rows.withColumn("hash", hash_128).groupBy("hash", "text").agg(best.alias("keep_id"), F.count("*").alias("group_size"))
    slim = saved(groups.select("hash", second.alias("second"), F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    keyed = rows.withColumn("hash", hash_128).withColumn("second", second)
    if slim.groupBy("hash", "second").count().where("count > 1").isEmpty():
        # null ids, which no hash tells apart, by their places
        spread = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).otherwise(F.monotonically_increasing_id())
        found = joined_by(keyed.drop("text"), slim, ["hash", "second"], "group_size", spread)
    else:
        found = keyed.join(groups.withColumn("text_sha256", F.sha2("text", 256)), ["hash", "text"])
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
