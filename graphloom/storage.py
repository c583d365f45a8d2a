"""Intermediate tables in the folder that all machines share; loops write them to cut their lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_here = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session. Where it is unset, a temporary folder serves a session on this machine
    alone, as in tests; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def _scratches() -> list[list[str]]:
    """Paths that each open scratch of this thread deletes when it closes, the innermost last."""
    if not hasattr(_here, "scratches"):
        _here.scratches = []
    return _here.scratches


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/graphloom/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """The table written as Parquet and read again: later steps don't repeat the work, and a lost executor costs no more
    than the tasks that it ran. keep: the table outlives the scratch in which it is written. options: of the writer."""
    path = f"{_place(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    df.write.options(compression="zstd", **options).parquet(path)
    if len(_scratches()) > keep:
        _scratches()[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what is saved in it and not kept; what is kept belongs to the scratch around this one, if any.
    All that is planned from such tables must be written before the end."""
    _scratches().append([])
    try:
        yield
    finally:
        for path in _scratches().pop():
            _deleted(spark, path.rsplit("/", 1)[0])


def released(spark: SparkSession) -> bool:
    """Deletes all that this application has saved; tables that read from it are of no use afterwards."""
    return _deleted(spark, _place(spark))
