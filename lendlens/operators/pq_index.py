"""Nearest-neighbour search over inverted lists of product-quantised residuals (M5), re-ranked exactly.

1. *Fit*, on a bounded sample (the ``SAMPLE`` rows of smallest id hash): ``nlist`` coarse centres, and for each
   group of ``SUB`` coordinates a codebook of at most 256 residuals (what a centre leaves of a vector).
2. *Encode*, all rows, in Arrow batches: list number and one byte a coordinate group. This table is the index;
   it holds no vectors.
3. *Search*: a query asks the lists nearest to it. A task takes one list (a long list is cut into parts) and a
   block of queries, tabulates for each query the distance to every codebook entry, and adds up table entries by
   the rows' bytes. The best ``rerank`` rows of each query go on.
4. *Re-rank*: the vectors of these rows alone are fetched by id, and the exact distances decide.

Vectors are scaled to unit length; their squared distance is twice the cosine distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dlit
from ..functions.vectors import dot, normalize
from ..sources.sinks import scratch_table

#: Rows the quantisers are fitted on, most lists, coordinates of a code, entries of a codebook.
SAMPLE, MAX_LISTS, SUB, ENTRIES = 20_000, 1024, 2, 256
#: Rows of a list part and queries of a block that meet in one task.
PART_ROWS, BLOCK_QUERIES = 50_000, 1024
#: Neighbours times this many rows are re-ranked.
RERANK = 6


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """At most ``k`` centres of the rows of ``x``: seeds drawn by distance, then mean steps."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = near.sum()
        pick = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        centres.append(x[pick])
        near = np.minimum(near, ((x - x[pick]) ** 2).sum(axis=1))
    c = np.array(centres)
    for _ in range(rounds):
        own = nearest(x, c)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest of the rows of ``c`` for each row of ``x``."""
    out = np.empty(len(x), np.int64)
    for k in range(0, len(x), 4096):
        part = x[k : k + 4096]
        out[k : k + 4096] = ((c * c).sum(axis=1)[None, :] - 2.0 * part @ c.T).argmin(axis=1)
    return out


class Quantiser:
    """Coarse centres and residual codebooks, fitted on a sample."""

    def __init__(self, sample: np.ndarray, nlist: int, sub: int = SUB):
        self.dim = sample.shape[1]
        self.centres = lloyd(sample, nlist)
        residual = sample - self.centres[nearest(sample, self.centres)]
        self.groups = [slice(j, min(j + sub, self.dim)) for j in range(0, self.dim, sub)]
        self.books = [lloyd(residual[:, g], ENTRIES) for g in self.groups]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List number and bytes [row, group]."""
        own = nearest(x, self.centres)
        residual = x - self.centres[own]
        return own, np.column_stack([nearest(residual[:, g], b) for g, b in zip(self.groups, self.books, strict=True)]).astype(np.uint8)

    def distances(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances [query, row] of queries to the coded rows of one list, by tables."""
        residual = q - self.centres[cell]
        out = np.zeros((len(q), len(codes)), np.float32)
        for j, (g, book) in enumerate(zip(self.groups, self.books, strict=True)):
            r = residual[:, g]
            table = ((r * r).sum(axis=1)[:, None] - 2.0 * r @ book.T + (book * book).sum(axis=1)[None, :]).astype(np.float32)
            out += table[:, codes[:, j]]
        return out


def _units(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, _units(batch.column("_unit"))


def pq_knn(queries: DataFrame, base: DataFrame, *, query_id: str, base_id: str, vector_col: str, k: int = 10,
           nlist: int | None = None, probe_share: float = 0.75, rerank: int = RERANK, exclude_self: bool = True,
           sub: int = SUB, part_rows: int = PART_ROWS) -> DataFrame:
    """``(query_id, neighbour_id, cosine_distance, neighbour_rank)`` of the ``k`` nearest base rows of every query.

    Null vectors are left out on both sides; all others must be of one length. ``probe_share``: lists that a query
    asks, as a share of all (vectors that hardly cluster need most of them, and a table lookup is cheap);
    ``k * rerank`` rows a query are scored exactly. Distances are exact, only the choice of rows is not. The codes,
    the index, are written once under the shared folder.
    """
    unit = base.where(F.col(vector_col).isNotNull()).select(F.col(base_id).alias("_bid"), normalize(F.col(vector_col)).alias("_unit"))
    asked = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_id).alias("_qid"), normalize(F.col(vector_col)).alias("_unit"))
    n = base.count()
    sample = unit.orderBy(F.xxhash64("_bid"), "_bid").limit(SAMPLE).select("_unit").collect()
    id_type, bid_type = (d.schema[c].dataType.simpleString() for d, c in ((asked, "_qid"), (unit, "_bid")))
    empty = f"{query_id} {id_type}, neighbour_id {bid_type}, cosine_distance double, neighbour_rank int"
    if not sample:
        return base.sparkSession.createDataFrame([], empty)
    nlist = nlist or max(1, min(MAX_LISTS, math.isqrt(n)))
    quantiser = Quantiser(np.array([r["_unit"] for r in sample], float), nlist, sub)
    lists = len(quantiser.centres)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(batches):
            own, codes = quantiser.encode(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_bid"), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["_bid", "_cell", "_codes"]
            )

    index = scratch_table(unit.mapInArrow(encode, f"_bid {bid_type}, _cell int, _codes binary"), "pq_index")
    sizes = {r["_cell"]: r["count"] for r in index.groupBy("_cell").count().collect()}  # at most nlist rows
    parts = np.array([max(1, -(-sizes.get(c, 0) // part_rows)) for c in range(lists)])
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))
    probes = max(1, math.ceil(probe_share * lists))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = quantiser.centres
        for batch, x in _batches(batches):
            order = np.argsort((c * c).sum(axis=1)[None, :] - 2.0 * x @ c.T, axis=1, kind="stable")[:, :probes]
            row, cell = np.repeat(np.arange(len(x)), order.shape[1]), order.reshape(-1)
            times = parts[cell]
            part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at = pa.array(np.repeat(row, times))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_qid").take(at), batch.column("_unit").take(at), batch.column("_block").take(at), pa.array(np.repeat(cell, times), pa.int32()), pa.array(part, pa.int32())],
                names=["_qid", "_unit", "_block", "_cell", "_part"],
            )

    blocked = asked.withColumn("_block", F.pmod(F.xxhash64("_qid"), F.lit(blocks)).cast("int"))
    asking = blocked.mapInArrow(ask, f"_qid {id_type}, _unit array<double>, _block int, _cell int, _part int")
    part_of = F.get(F.array(*(F.lit(int(p)) for p in parts)), F.col("_cell"))
    held = index.withColumn("_part", F.pmod(F.xxhash64("_bid"), part_of).cast("int")).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    keep = k * rerank

    def look(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(rows):
            return pd.DataFrame({"_qid": asking["_qid"][:0], "_bid": rows["_bid"][:0], "_guess": np.zeros(0)})
        codes = np.frombuffer(b"".join(rows["_codes"]), np.uint8).reshape(len(rows), -1)
        cell, qid, bid = int(asking["_cell"].iloc[0]), asking["_qid"].to_numpy(), rows["_bid"].to_numpy()
        found = []
        for s in range(0, len(asking), 64):
            d = quantiser.distances(np.vstack(asking["_unit"].iloc[s : s + 64]), cell, codes)
            best = np.argpartition(d, keep, axis=1)[:, : keep + 1] if d.shape[1] > keep + 1 else np.tile(np.arange(d.shape[1]), (len(d), 1))
            row = np.repeat(np.arange(len(d)), best.shape[1])
            found.append(pd.DataFrame({"_qid": qid[s + row], "_bid": bid[best.reshape(-1)], "_guess": d[row, best.reshape(-1)].astype(float)}))
        out = pd.concat(found)
        return out[out["_qid"] != out["_bid"]] if exclude_self else out

    group = ["_cell", "_part", "_block"]
    renamed = held.select(*(F.col(c).alias(f"b{c}") if c in group else F.col(c) for c in ("_bid", "_codes", *group)))
    guessed = asking.groupBy(*group).cogroup(renamed.groupBy(*(f"b{c}" for c in group))).applyInPandas(look, f"_qid {id_type}, _bid {bid_type}, _guess double")
    first = Window.partitionBy("_qid").orderBy("_guess", "_bid")
    kept = guessed.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep).select("_qid", "_bid")
    scored = kept.join(unit.withColumnRenamed("_unit", "_b"), "_bid").join(asked.withColumnRenamed("_unit", "_q"), "_qid")
    scored = scored.select("_qid", "_bid", (dlit(1.0) - dot("_q", "_b")).alias("cosine_distance"))
    best = Window.partitionBy("_qid").orderBy("cosine_distance", "_bid")
    ranked = scored.withColumn("neighbour_rank", F.row_number().over(best)).where(F.col("neighbour_rank") <= k)
    return ranked.select(F.col("_qid").alias(query_id), F.col("_bid").alias("neighbour_id"), "cosine_distance", "neighbour_rank")
