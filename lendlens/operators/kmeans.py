"""K-means as DataFrame steps (M6), the same result on every run and engine.

Vectors become integers: standardised by exact sums, 1024 steps a standard deviation. All distances and sums
after that are integers below 2^53, so neither the order of summation nor the partitioning can change them.

1. *Seeds*: among the ``CANDIDATES`` rows of smallest id hash, the first, then always the one farthest from all
   seeds so far (ties: earlier in hash order).
2. *Steps*: each assigns every row to its nearest centre (ties: the smaller number) in Arrow batches, sums rows by
   centre in each task, adds the tasks' sums up, and moves each centre to the floor of its mean; a centre without
   rows stays. A step's state is k centres.
3. A last assignment to the centres of the last step.

The driver holds the candidates (bounded) and k centres; tasks hand on at most k sums each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit
from ..sources.sinks import scratch_table

CANDIDATES, STEPS = 1000, 5
#: Fixed-point steps of a raw entry, and of a standardised one.
FINE, COARSE = 2**20, 1024


def _fixed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    fine = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * dlit(FINE) + dlit(0.5)).cast("bigint"))
    return df.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("_id"), fine.alias("_q"))


def moments(fixed: DataFrame) -> list[tuple[int, int, int]]:
    """(n, sum, sum of squares) of every coordinate, exact."""
    each = fixed.select(F.posexplode("_q").alias("i", "q"))
    q = F.col("q").cast("decimal(38,0)")
    rows = each.groupBy("i").agg(F.count("q").alias("n"), F.sum(q).alias("s"), F.sum(q * q).alias("s2")).orderBy("i").collect()
    return [(r["n"], int(r["s"]), int(r["s2"])) for r in rows]


def scaled(fixed: DataFrame, standardize: bool = True) -> DataFrame:
    """``_id`` and ``_z``, the integer vector; a coordinate that is the same in all rows is 0."""
    if not standardize:
        z = F.transform("_q", lambda q: F.floor(q / dlit(FINE / COARSE) + dlit(0.5)).cast("bigint"))
        return fixed.select("_id", z.alias("_z"))
    mean, spread = [], []
    for n, s, s2 in moments(fixed):
        mean.append(float(s) / float(n))
        spread.append(math.sqrt(float(n * s2 - s * s) / (float(n) * float(n - 1))) if n > 1 else 0.0)
    means, spreads = (F.array(*(dlit(v) for v in values)) if values else F.array().cast("array<double>") for values in (mean, spread))
    z = F.transform(
        "_q",
        lambda q, i: F.when(F.get(spreads, i) > 0, F.floor((q - F.get(means, i)) / F.get(spreads, i) * dlit(COARSE) + dlit(0.5))).otherwise(0).cast("bigint"),
    )
    return fixed.select("_id", z.alias("_z"))


def seeds(rows: DataFrame, k: int) -> np.ndarray:
    """Farthest-point seeds among the rows of smallest id hash."""
    order = [F.md5(F.col("_id").cast("string")), F.col("_id").cast("string")]
    x = np.array([r["_z"] for r in rows.orderBy(*order).limit(CANDIDATES).select("_z").collect()], float)
    if not len(x):
        return np.zeros((0, 0))
    picked, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(k, len(x)) and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer-valued doubles: exact, so ties are ties."""
    return ((c * c).sum(axis=1)[None, :] - 2.0 * x @ c.T).argmin(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def step(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres after one assignment and mean."""
    k, dim = centres.shape

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                own = _nearest(x, centres)
                count += np.bincount(own, minlength=k)
                np.add.at(total, own, x.astype(np.int64))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["c", "n", "s"]
        )

    parts = rows.select("_z").mapInArrow(part, "c int, n bigint, s array<bigint>")
    summed = parts.select("c", "n", F.posexplode("s").alias("i", "s")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    new = centres.copy()
    for r in summed.collect():  # k centres
        new[r["c"], r["i"]] = math.floor(float(r["s"]) / float(r["n"]))
    return new


def kmeans(df: DataFrame, id_col: str, vector_col: str, k: int = 50, steps: int = STEPS, standardize: bool = True) -> DataFrame:
    """``(id, kmeans_cluster)`` for every row with a vector: clusters 0 .. k-1 in the order of their seeds.

    Rows without a vector are left out; repeated rows and ids count as rows. Vectors must be of one length, entries
    finite and below 2^30. Fewer different candidates than ``k`` give fewer clusters; an empty table gives no rows.
    """
    rows = scratch_table(scaled(_fixed(df, id_col, vector_col), standardize), "kmeans_rows")
    centres = seeds(rows, k)
    id_type = rows.schema["_id"].dataType.simpleString()
    if not len(centres):
        return rows.select(F.col("_id").alias(id_col), F.lit(0).alias("kmeans_cluster"))
    for _ in range(steps):
        centres = step(rows, centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _nearest(_matrix(batch.column(1)), centres) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32())], names=[id_col, "kmeans_cluster"])

    return rows.select("_id", "_z").mapInArrow(assign, f"{id_col} {id_type}, kmeans_cluster int")
