"""Validation of documents as they arrive: each is complete in itself, so a batch needs neither state nor watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.validation import validated
from ..sources.documents import graphs_of_json, graphs_of_yaml


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of (graph_id, raw) of the files that come into a folder, whole."""
    rows = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", most_files).text(folder)
    return rows.select(F.col("_metadata.file_path").alias("graph_id"), F.col("value").alias("raw"))


def validate_stream(documents: DataFrame, path: str, checkpoint: str, form: str = "json", skip_lint: bool = False, each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Starts writing the findings of every batch below `path`, in a folder of the batch's number, so that a batch that
    is run again replaces what it wrote. `each` gets them too."""

    def batch(rows: DataFrame, number: int) -> None:
        found = validated((graphs_of_yaml if form == "yaml" else graphs_of_json)(rows), skip_lint).findings
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if each:
            each(rows.sparkSession.read.parquet(f"{path}/batch={number}"), number)

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
