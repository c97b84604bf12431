"""Helpers shared by the text operators: reading tables, stage tables under the
shared folder, Arrow batch sizes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Words of the quality rules: anything but white space in ASCII.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 * 1024 * 1024
#: Shuffle files go when their job ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of one given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_or_empty(name: str) -> Column:
    """The text column, null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python workers by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_folders: list[tuple[SparkSession, str]] = []
_inner: ContextVar[list[str] | None] = ContextVar("_inner", default=None)


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder; removed when the program ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{tag}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    if (inner := _inner.get()) is not None:
        inner.append(path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back, which
    cuts its lineage: a lost executor costs a read, not a recomputation."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """As :func:`stage` of what ``make`` returns; the stage tables that ``make`` wrote on
    the way are removed, as nothing reads them any more, and so are shuffle files as soon
    as their job ends."""
    cleaned = spark.conf.get(_CLEANUP)
    token = _inner.set(made := [])
    try:
        spark.conf.set(_CLEANUP, "true")
        df = stage(make(), tag)
    finally:
        spark.conf.set(_CLEANUP, cleaned)
        _inner.reset(token)
    *gone, kept = made
    for path in gone:
        remove(spark, path)
    if (outer := _inner.get()) is not None:
        outer.append(kept)
    return df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this module made, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_folders() -> None:
    for spark, path in _folders:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the shared folder's owner cleans up
            return
