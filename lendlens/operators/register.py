"""Surrogate ids that stay when files are added (W1 / D3 with memory).

:func:`lendlens.operators.ids.number_within` numbers one table; another file shifts the numbers of all rows behind
its own. Here a stored register remembers which number each content was given, and later loads only go on from each
lender's high-water mark. Its rows are runs::

    lei, content_key, first_ordinal, first_number, n, load

"copies ``first_ordinal`` to ``first_ordinal + n - 1`` of this content have the numbers from ``first_number`` on".

Rows equal in all columns can't be told apart, so they are counted, not ranked: one aggregate with map-side combine
makes a content that fills a third of the table one row, and its numbers are spread again in pieces. New contents are
numbered in key order by running sums over chunks of the key (two levels, as in ``ids``), so no window holds a lender.

Defined cases: rows without ``lei`` get no number and a null id; equal rows get different numbers; a row that a
later load lacks keeps its number in the register and gets it again when it returns; an empty load changes nothing.
Contents are compared by the MD5 of all columns' texts, taken by name, so a change of schema makes new contents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import read_replaced, replace_table, scratch_table
from .ids import CHUNKS_PER_RUN

REGISTER_SCHEMA = "lei string, content_key string, first_ordinal long, first_number long, n long, load long"
#: Numbers that one piece of a run gives out, and hex digits of the key that make a chunk (2^24 chunks).
PIECE, CHUNK_DIGITS = 65_536, 6


def empty_register(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTER_SCHEMA)


def content_key(columns: Sequence[str]) -> Column:
    """MD5 of the columns' texts in name order, each with its length before it; null is ``-``."""
    texts = [F.col(c).cast("string") for c in sorted(columns)]
    return F.md5(F.concat(*[
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]))


def _contents(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("_key", content_key(rows.columns)).groupBy("_key", *rows.columns)
        .agg(F.count(F.lit(1)).alias("_count"))
    )


def _new_runs(contents: DataFrame, register: DataFrame, whole: bool) -> DataFrame:
    """The runs that this load adds to the register."""
    held = register.groupBy("lei", "content_key").agg(F.sum("n").alias("_held"))
    have = F.coalesce(F.col("_held"), F.lit(0))
    fresh = (
        contents.where(F.col("lei").isNotNull())
        .select("lei", F.col("_key").alias("content_key"), "_count")
        .join(held, ["lei", "content_key"], "left")
        .select(
            "lei", "content_key", (have + 1).alias("first_ordinal"),
            (F.col("_count") - have if whole else F.col("_count")).alias("n"),
            F.conv(F.substring("content_key", 1, CHUNK_DIGITS), 16, 10).cast("long").alias("_chunk"),
        )
        .where("n > 0")
    )
    fresh = scratch_table(fresh, "fresh_contents")  # counted, then numbered
    before = lambda *by: Window.partitionBy("lei", *by).rowsBetween(Window.unboundedPreceding, -1)
    chunks = fresh.groupBy("lei", "_chunk").agg(F.sum("n").alias("_n")).withColumn(
        "_run", F.floor(F.col("_chunk") / F.lit(CHUNKS_PER_RUN)).cast("long")
    )
    inside = F.coalesce(F.sum("_n").over(before("_run").orderBy("_chunk")), F.lit(0))
    runs = chunks.groupBy("lei", "_run").agg(F.sum("_n").alias("_rows")).select(
        "lei", "_run", F.coalesce(F.sum("_rows").over(before().orderBy("_run")), F.lit(0)).alias("_before")
    )
    marks = register.groupBy("lei").agg(F.max(F.col("first_number") + F.col("n") - 1).alias("_mark"))
    offsets = (
        chunks.select("lei", "_run", "_chunk", inside.alias("_inside"))
        .join(runs, ["lei", "_run"])
        .join(marks, "lei", "left")
        .select("lei", "_chunk", (F.col("_inside") + F.col("_before") + F.coalesce("_mark", F.lit(0))).alias("_offset"))
    )
    earlier = F.coalesce(F.sum("n").over(before("_chunk").orderBy("content_key")), F.lit(0))
    load = F.coalesce(register.select(F.max("load")).scalar(), F.lit(0)) + 1
    return fresh.join(offsets, ["lei", "_chunk"]).select(
        "lei", "content_key", "first_ordinal", (F.col("_offset") + earlier + 1).alias("first_number"), "n",
        load.cast("long").alias("load"),
    )


def _numbered(contents: DataFrame, columns: list[str], runs: DataFrame, whole: bool, piece: int) -> DataFrame:
    """Every row of the load with its number: each content once per number of its runs."""
    used = F.least(F.col("n"), F.col("_count") - F.col("first_ordinal") + 1) if whole else F.col("n")
    runs = runs.withColumnsRenamed({"lei": "_lei", "content_key": "_ck", "load": "_load"})
    parts = [*columns, "_key", "first_number", "_used", "_load"]
    known = contents.join(runs, (F.col("lei") == F.col("_lei")) & (F.col("_key") == F.col("_ck")))
    known = known.withColumn("_used", used).where("_used > 0").select(*parts)
    nobody = contents.where(F.col("lei").isNull()).select(
        *columns, "_key", F.lit(1).cast("long").alias("first_number"), F.col("_count").alias("_used"),
        F.lit(None).cast("long").alias("_load"),
    )
    rows = known.unionByName(nobody)
    short = rows.where(F.col("_used") <= piece).withColumn("_piece", F.lit(0).cast("long"))
    # a number of partitions of its own: rows are few and small here, but many after the last step
    width = int(contents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.floor((F.col("_used") - 1) / piece).cast("long")
    long = rows.where(F.col("_used") > piece).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = short.unionByName(long.repartition(width, "_key", "_piece"))
    start = F.col("_piece") * piece
    size = F.least(F.lit(piece), F.col("_used") - start)
    first = F.col("first_number") + start
    return pieces.select(*columns, "_load", F.explode(F.sequence(first, first + size - 1)).alias("_number"))


def register_ids(
    rows: DataFrame, register: DataFrame, path: str, whole: bool = True, out_col: str = "application_id",
    piece: int = PIECE,
) -> DataFrame:
    """``rows`` with ``out_col`` = ``<lei>_<activity_year>_<number>`` and ``first_load``, the load that gave the number.

    ``whole=True``: ``rows`` are all rows so far, old files and new; known rows get their old ids, and running the
    same load again changes nothing. ``whole=False``: ``rows`` are the added files alone, all of them new. The
    register grows by this load's runs and is replaced at ``path`` (see :func:`~lendlens.sources.replace_table`)
    before any id is given out, so a load that fails later finds its numbers again.
    """
    columns = rows.columns
    contents = scratch_table(_contents(rows), "contents")
    fresh = scratch_table(_new_runs(contents, register, whole), "new_runs")
    grown = replace_table(register.unionByName(fresh), path)
    numbered = _numbered(contents, columns, grown if whole else fresh, whole, piece)
    new_id = F.concat_ws("_", "lei", F.col("activity_year").cast("string"), F.col("_number").cast("string"))
    return numbered.select(
        F.when(F.col("lei").isNotNull() & F.col("activity_year").isNotNull(), new_id).alias(out_col), *columns,
        F.col("_load").alias("first_load"),
    )


def load_applications(rows: DataFrame, path: str, whole: bool = True, piece: int = PIECE) -> DataFrame:
    """:func:`register_ids` with the register kept at ``path``; the first load makes it."""
    spark = rows.sparkSession
    try:
        register = read_replaced(spark, path)
    except FileNotFoundError:
        register = empty_register(spark)
    return register_ids(rows, register, path, whole, piece=piece)
