"""Sharding: a Feistel permutation over global row numbers.

Rows get gapless numbers 0 .. N-1 in an order that depends on the data alone
(doc_id, then checksum, size and hash of the text), by a range partitioning with
one count a partition; no task and no window sees all rows. A number is written as
two digits, to the bases a and b with a * b >= N, and a Feistel network adds a
keyed function of one digit to the other, round by round, which is a permutation of
0 .. a*b-1. Numbers that leave 0 .. N-1 walk on along their cycle until they are
back, so the whole is a permutation of 0 .. N-1 that is never stored: the shuffled
place of any row, and the row at any place, follow from (N, seed) alone.

Shard and slot are place mod and div the shard count: shards hold equal numbers of
rows but for one, slots are gapless, and a reader can find the row of any slot.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common

SHARDS, SEED, ROUNDS = 24, 20_240_101, 8
#: Law under which the shards are filled: counts at most one apart.
LAW = "rows"
_KEYS = ["doc_id", "text_crc32", "size", "_hash"]


class Feistel:
    """A keyed permutation of 0 .. n-1 on numpy int64 arrays, and its inverse."""

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS) -> None:
        if n < 0 or n >= 2**62:
            raise ValueError(f"cannot permute {n} numbers")
        self.n, self.a = n, max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        with np.errstate(over="ignore"):
            self.keys = arrays.mix(np.arange(1, rounds + 1, dtype=arrays.U64) * arrays.U64(0x9E3779B97F4A7C15) + arrays.U64(seed))

    def _drawn(self, digit: np.ndarray, k: int, base: int) -> np.ndarray:
        """The keyed function of round k: a number below ``base`` for each digit."""
        with np.errstate(over="ignore"):
            mixed = arrays.mix(arrays.mix(digit.astype(arrays.U64) + self.keys[k]) + self.keys[k])
        return (mixed % arrays.U64(base)).astype(np.int64)

    def _round_trip(self, x: np.ndarray, back: bool) -> np.ndarray:
        high, low = x // self.b, x % self.b
        rounds = range(len(self.keys))
        for k in reversed(rounds) if back else rounds:
            if k % 2:
                step = self._drawn(high, k, self.b)
                low = (low - step if back else low + step) % self.b
            else:
                step = self._drawn(low, k, self.a)
                high = (high - step if back else high + step) % self.a
        return high * self.b + low

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.int64)
        if len(x) and (x.min() < 0 or x.max() >= self.n):
            raise ValueError(f"row numbers must lie in 0 .. {self.n - 1}")
        out = self._round_trip(x, back)
        while (outside := out >= self.n).any():
            out[outside] = self._round_trip(out[outside], back)
        return out

    def place(self, row: np.ndarray) -> np.ndarray:
        """The shuffled place of each row number."""
        return self._walk(row, back=False)

    def row(self, place: np.ndarray) -> np.ndarray:
        """The row number at each shuffled place."""
        return self._walk(place, back=True)


def locate(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number among ``n``."""
    place = int(Feistel(n, seed).place(np.array([row]))[0])
    return place % shards, place // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that lies in a slot: what a reader asks for."""
    return int(Feistel(n, seed).row(np.array([slot * shards + shard]))[0])


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull())


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    text = F.encode(common.text_or_empty("text"), "UTF-8")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.crc32(text).alias("text_crc32"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        _text_hash().alias("_hash"),
        *more,
    )


def _ranges(docs: DataFrame) -> DataFrame:
    """The distinct rows with their ``copies``, in ranges of the order, and the number ``_part`` of each range."""
    runs = _keyed(docs).groupBy(*_KEYS).agg(F.count("*").alias("copies"))
    ranged = runs.repartitionByRange(*_KEYS).withColumn("_part", F.spark_partition_id())
    # written once: partition numbers and rows stay together, whatever is computed again
    return common.stage(ranged, "ranges")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text_crc32, size, _hash and row_number: gapless from 0, ascending by
    doc_id (null first), then by the other columns.

    Rows alike in all four are counted before they are moved, so a row that is
    repeated without end is one row here; they are dealt out again at the end, where
    a run of copies is cut into pieces of 10,000 that separate tasks expand."""
    return _dealt(_ranges(docs))


def _dealt(ranged: DataFrame) -> DataFrame:
    sizes = ranged.groupBy("_part").agg(F.sum("copies").alias("_rows"))
    # one row a partition of the range shuffle
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*_KEYS).rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.withColumn("_before", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(offsets, "_part")
    first = first.withColumn("_first", F.col("_offset") + F.col("_before"))
    single = first.filter("copies = 1").select(*_KEYS, F.col("_first").alias("row_number"))
    piece = 10_000
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(piece).cast("long")))
    many = first.filter("copies > 1").select(*_KEYS, "_first", "copies", starts.alias("_from"))
    many = many.repartition(*_KEYS, "_from")
    each = F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + piece, F.col("copies")) - 1))
    many = many.select(*_KEYS, "_first", each.alias("_copy"))
    return single.unionByName(many.select(*_KEYS, (F.col("_first") + F.col("_copy")).alias("row_number")))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, text_crc32, size (bytes of the text plus 8), _hash (of
    the text), row_number, shard and slot.

    Input: columns doc_id and text; others are ignored. A null text has no bytes, like
    an empty one; a null doc_id is numbered first. Rows alike in both columns take
    neighbouring row numbers, and so different slots. Equal texts under different
    doc_ids aren't kept together: counts at most one apart is the law. An empty table
    gives no rows. More shards than rows leave the last shards empty.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    ranged = _ranges(docs)
    rows, permutation = _dealt(ranged), Feistel(ranged.agg(F.sum("copies")).first()[0] or 0, seed)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.place(numbers.to_numpy()))

    placed = rows.withColumn("_place", place("row_number"))
    return placed.select(
        *_KEYS,
        "row_number",
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, pieces: int = 1) -> DataFrame:
    """Write doc_id, text, slot under ``path``/shard=K, each file ascending by slot, and
    return the written table read back. ``pieces`` tasks share the writing of a shard."""
    placed = assign(docs, shards, seed)
    # one text for each hash meets the slots of all its copies, so that no pair is lost or doubled
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("_hash", _text_hash()).dropDuplicates(["doc_id", "_hash"])
    joined = placed.select("doc_id", "_hash", "shard", "slot").alias("p").join(
        texts.alias("t"), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("p._hash") == F.col("t._hash"))
    )
    rows = joined.select("p.shard", "p.slot", "p.doc_id", "t.text")
    rows = rows.repartition(shards * pieces, "shard", F.expr(f"slot % {pieces}")).sortWithinPartitions("shard", "slot")
    rows.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assign(common.read(spark, sf_dir, "documents", ["doc_id", "text"]))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
