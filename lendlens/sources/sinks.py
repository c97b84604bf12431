"""Table sinks: the audit's stage tables are parquet folders.

``CREATE OR REPLACE TABLE`` maps to :func:`replace_table`, which keeps the old table until the new one is whole
(``mode("overwrite")`` deletes it first, which is enough for scratch tables); ``CREATE TABLE`` (fails when present)
to ``mode("errorifexists")``; views to temp views.
"""

from __future__ import annotations

import atexit
import os
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def write_table(
    df: DataFrame,
    path: str,
    *,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def create_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Create-only sink: raises if the table already exists."""
    write_table(df, path, mode="errorifexists", partition_by=partition_by)


#: Names inside a replaceable table's folder: its versions, and the pointer to the current one.
VERSIONS, POINTER = "versions", "_current"


def _hadoop(spark: SparkSession, path: str):
    """(path object, its file system) on the JVM side."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), keep: int = 1) -> DataFrame:
    """Create or replace the table at ``path`` and return it read back.

    The rows go to a new folder ``versions/<id>``; only when that write has succeeded does the pointer file change,
    by one rename over the old pointer (atomic on file systems with atomic renames; an object store without them
    needs its own committer). A write that fails half-way leaves the old table as it was, and its own folder is
    removed. Of older versions, ``keep`` stay for readers that have begun; with several writers the last rename
    wins. ``df`` may read the table that it replaces.
    """
    spark = df.sparkSession
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/{VERSIONS}/{version}"
    try:
        write_table(df, folder, mode="errorifexists", partition_by=partition_by)
    except BaseException:
        remove_path(spark, folder)
        raise
    new, fs = _hadoop(spark, f"{path}/{POINTER}.{version}")
    out = fs.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark._sc._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    target = fs.makeQualified(jvm.Path(f"{path}/{POINTER}"))
    jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(new), target, options)
    names = sorted(f.getPath().getName() for f in fs.listStatus(jvm.Path(f"{path}/{VERSIONS}")))
    older = [n for n in names if n < version]
    for name in older[: max(0, len(older) - keep)]:
        remove_path(spark, f"{path}/{VERSIONS}/{name}")
    return read_replaced(spark, path)


def read_replaced(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by :func:`replace_table`."""
    pointer, fs = _hadoop(spark, f"{path}/{POINTER}")
    if not fs.exists(pointer):
        raise FileNotFoundError(f"no table at {path}")
    stream = fs.open(pointer)
    try:
        version = bytes(stream.readNBytes(200)).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{path}/{VERSIONS}/{version}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def create_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def stage_table(spark: SparkSession, df: DataFrame, name: str, root: str | None = None,
                partition_by: Sequence[str] = (), bucket_by: str | None = None, buckets: int = 0,
                table_prefix: str = "lendlens") -> DataFrame:
    """Materialise ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage of a stage that several later stages reuse, the way the
    audited script stores each step as a table. ``bucket_by`` stores it as a
    bucketed external table (session catalog, data in the same folder). The folder comes from
    ``spark.checkpoint.dir`` (shared storage on a cluster), so a lost executor
    re-reads the stored table instead of recomputing the whole audit.
    """
    base = root or os.path.join(ensure_checkpoint_dir(spark), "lendlens-stages")
    path = os.path.join(base, name)
    if bucket_by and buckets > 0:
        # Bucketed external table: later joins of tables bucketed the same way on
        # the same key read co-partitioned data and skip the shuffle.
        table = f"{table_prefix}_{name}"
        (
            df.repartition(buckets, bucket_by)
            .write.mode("overwrite")
            .bucketBy(buckets, bucket_by)
            .sortBy(bucket_by)
            .option("path", path)
            .saveAsTable(table)
        )
        return spark.table(table)
    write_table(df, path, partition_by=partition_by)
    return spark.read.parquet(path)


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a folder of its own under the shared checkpoint folder and read it back; the folder is
    removed when the program ends."""
    spark = df.sparkSession
    root = os.path.join(ensure_checkpoint_dir(spark), "lendlens-stages", uuid.uuid4().hex[:12])
    atexit.register(_forget, spark, root)
    return stage_table(spark, df, name, root)


def _forget(spark: SparkSession, root: str) -> None:
    try:
        remove_path(spark, root)
    except Exception:  # the session has ended; the shared folder's owner cleans up
        return
