"""A corpus in five steps: toxic documents go, near copies go, benchmark passages go, sources are mixed, rows are sharded.

Each stage takes (spark, docs, sf_dir) and returns a table that the next one gets written and read again; all but the
last return the columns of `documents`. A stage first notes which rows go, or how often they are taken, in a small table,
which travels to the rows if it is small enough; what the operators wrote on the way is deleted by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import toxicity
from graphloom.llm.contamination import contamination
from graphloom.llm.mixing import mixed
from graphloom.llm.near_dedup import near_duplicates
from graphloom.llm.session import table
from graphloom.llm.sharding import sharded
from graphloom.llm.tables import saved, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with `_row`, a key written once: stages decide on rows by it, as doc_ids may be null or repeated."""
    return saved(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under one half, by a model of the labels; every document is scored."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.learned(docs, labels)
    rows = docs.select(*COLUMNS)
    return rows.mapInArrow(toxicity.keeper(model), rows.schema)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; null is the greatest."""
    docs = _keyed(docs)
    with scratch(spark):
        groups = near_duplicates(docs.select("_row", "text"), percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
        least = groups.join(docs.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("least"))
        gone = saved(groups.join(least.select("least._row"), "_row", "left_anti").select("_row"), "gone", keep=True)
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item, nor a shorter item as a whole."""
    docs = _keyed(docs)
    with scratch(spark):
        found = contamination(docs, table(spark, sf_dir, "benchmark"), row_col="_row").where("contaminated")
        gone = saved(found.select(F.col("row").alias("_row")), "gone", keep=True)
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whole."""
    docs = _keyed(docs)
    with scratch(spark):
        times = mixed(docs, whole=True, row_col="_row").draws.groupBy(F.col("row").alias("_row")).agg(F.count("*").cast("int").alias("_times"))
        times = saved(times, "times", keep=True)
    # there are about as many draws as rows: at any size both are dealt by row, none is sent everywhere
    return docs.join(times.hint("merge"), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with slot and shard."""
    return sharded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard_rows),
]

#: SQL can express neither the learned stage nor the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return docs
