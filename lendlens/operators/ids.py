"""Surrogate ids: ``<lei>_<year>_<n>`` with ``n`` numbered per lender.

A window ``row_number() OVER (PARTITION BY lei ORDER BY key)`` would put every
application of one lender into one task; a single lender may file a third of
all applications. Lenders of at most ``HOT_ROWS`` rows, which one task sorts
easily, are numbered by that window. The others, found by one count a lender,
are numbered in two levels:

1. ``chunk = key div chunk_width``; count rows per ``(lei, chunk)`` (partial
   aggregation);
2. running sums of those counts give each chunk's offset, in two levels as well:
   over the chunks of one run of chunks, and over the runs of one lender, so no
   window holds all chunks of a hot lender;
3. the offset is joined back on ``(lei, chunk)`` -- a hot lender is spread over
   all its chunks -- and ``row_number`` runs inside each ``(lei, chunk)``.

Chunks of many small lenders would hold a row or two each, so that their counts
were a second table of the size of the first; hence the hot lenders only. The
result equals the single-window numbering exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import scratch_table

#: Chunks whose counts one window sums.
CHUNKS_PER_RUN = 4096
#: Rows of a group up to which one task numbers it.
HOT_ROWS = 100_000


def number_within(
    df: DataFrame,
    partition_col: str,
    order_key: str,
    out_col: str = "rownum",
    chunk_width: int = 4096,
    hashed_key: bool = False,
    hashed_chunk_bits: int = 24,
    hot_rows: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add ``out_col`` = 1-based rank of ``order_key`` within ``partition_col``.

    ``order_key`` is an integral column. A dense key (row ids) is chunked by
    ``key div chunk_width``. A hashed key (uniform over 64 bits, e.g. a content
    hash) is chunked by its top ``hashed_chunk_bits`` bits, so the chunk count
    stays bounded (2^24 by default) however many rows there are; ``key div
    width`` would make one chunk per row there. Rows without a group or a key are
    left out. Counting the groups of more than ``hot_rows`` rows is a job of its own;
    ``sizes``, rows of ``partition_col`` at least as many as ``df`` has, may be cheaper to
    count (the numbers don't depend on which groups count as hot).
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    kept = df.where(F.col(partition_col).isNotNull() & F.col(order_key).isNotNull())
    counted = kept if sizes is None else sizes.where(F.col(partition_col).isNotNull())
    hot = counted.groupBy(partition_col).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = scratch_table(hot.select(partition_col), "hot_groups")
    if hot.isEmpty():
        return kept.withColumn(out_col, F.row_number().over(Window.partitionBy(partition_col).orderBy(order_key)).cast("bigint"))
    if hashed_key:
        chunk = F.shiftright(F.col(order_key), 64 - hashed_chunk_bits)
    else:
        chunk = F.floor(F.col(order_key) / F.lit(chunk_width)).cast("bigint")
    counts = kept.join(hot, partition_col, "left_semi").groupBy(partition_col, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n"))
    # written once: the running sums over chunks and over runs both read it
    counts = scratch_table(counts.withColumn("_run", F.floor(F.col("_chunk") / F.lit(CHUNKS_PER_RUN)).cast("bigint")), "chunk_counts")
    before = lambda *by: Window.partitionBy(partition_col, *by).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_n").over(before("_run").orderBy("_chunk")), F.lit(0))
    runs = counts.groupBy(partition_col, "_run").agg(F.sum("_n").alias("_rows"))
    runs = runs.select(
        partition_col, "_run", F.coalesce(F.sum("_rows").over(before().orderBy("_run")), F.lit(0)).alias("_before")
    )
    offsets = (
        counts.select(partition_col, "_run", "_chunk", inside.alias("_inside"))
        .join(runs, [partition_col, "_run"])
        .select(partition_col, "_chunk", (F.col("_inside") + F.col("_before")).alias("_offset"))
    )
    # one shuffle of the rows by (group, chunk): the offsets join and the numbering run on it
    keyed = kept.join(hot.withColumn("_hot", F.lit(True)), partition_col, "left")
    keyed = keyed.withColumn("_chunk", F.when(F.col("_hot"), chunk)).drop("_hot").repartition(partition_col, "_chunk")
    within = Window.partitionBy(partition_col, "_chunk").orderBy(order_key)
    return (
        keyed.join(offsets, [partition_col, "_chunk"], "left")
        .withColumn(out_col, F.coalesce("_offset", F.lit(0)) + F.row_number().over(within))
        .select(*df.columns, out_col)
    )


def application_ids(
    df: DataFrame, order_key: str = "source_key", chunk_width: int = 4096, out_col: str = "application_id",
    hashed_key: bool = False, sizes: DataFrame | None = None,
) -> DataFrame:
    """``CONCAT(lei, '_', activity_year, '_', n)`` with applications numbered 1..n per
    lender; NULL when ``lei`` is NULL. Rows of equal key get different numbers."""
    numbered = number_within(df, "lei", order_key, "_rownum", chunk_width, hashed_key=hashed_key, sizes=sizes)
    return numbered.withColumn(
        out_col,
        F.concat(
            F.col("lei"), F.lit("_"), F.col("activity_year").cast("string"), F.lit("_"),
            F.col("_rownum").cast("string"),
        ),
    ).drop("_rownum")
