"""The top ``k`` partners of every application in a dense cell, without all its pairs.

The cell join of :mod:`pairs` compares all rows of a cell, which is fine for cells of some thousand rows and
quadratic beyond. A dense cell is searched instead:

1. Its rows (own rows and copies from neighbour cells) are sorted by a range partitioning on (cell, first
   direction coordinate, id) and cut into *pieces* of bounded size, however many rows the cell holds.
2. A piece's rows are split like a ball tree, on the widest coordinate of (log income, log loan, DTI,
   direction of the vector), into leaves of at most ``LEAF`` rows or of equal rows. For a block of base rows the
   leaves are visited nearest first, and a base row leaves off at the first leaf that lies beyond its k-th partner.
   A leaf that holds no larger id, or none within the tolerances, is passed over. Of equal rows only the k next
   ids can count, so a leaf of them is a binary search, whatever its size.
3. Base rows of cells with several pieces carry their k-th distance to the other pieces whose box it reaches.

On unit vectors, ``1 - cos`` is half the squared Euclidean distance, which boxes bound from below. Bounds only
prune; predicates and ranking are those of the join, evaluated with the same arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import dlit

#: Rows of a leaf, of a block of base rows, and (about) of a piece.
LEAF, QUERY_BLOCK, PIECE_ROWS = 128, 256, 50_000
#: Direction coordinates that boxes bound (any coordinates give a valid lower bound).
BOX_DIMS = 6
#: Weight of the direction against the tolerances when leaves are split.
NARROW = 32.0
_SLACK = 1e-9


@dataclass(frozen=True)
class Limits:
    """The predicates of the pair search."""

    max_distance: float
    band_low: float
    band_high: float
    band_dti: float
    income_tol: float
    loan_tol: float
    dti_tol: float
    k: int
    both_directions: bool = False

    def reach(self) -> tuple[float, float, float]:
        """Largest |difference| of log income, log loan and DTI of a pair."""
        wide = math.log(max(self.band_high, 1.0 / self.band_low))

        def log_width(tol: float) -> float:
            return -math.log(1.0 - tol) if tol < 1.0 else math.inf

        return min(wide, log_width(self.income_tol)), min(wide, log_width(self.loan_tol)), min(self.band_dti, self.dti_tol)


class Rows:
    """Columns of one piece's rows as arrays; ``rank`` orders the ids."""

    def __init__(self, rank: np.ndarray, income: np.ndarray, loan: np.ndarray, dti: np.ndarray, norm: np.ndarray, vec: np.ndarray):
        self.rank, self.income, self.loan, self.dti, self.norm, self.vec = rank, income, loan, dti, norm, vec

    def __len__(self) -> int:
        return len(self.rank)

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.rank[at], self.income[at], self.loan[at], self.dti[at], self.norm[at], self.vec[at])

    def features(self) -> np.ndarray:
        """log income, log loan, DTI, then the first direction coordinates."""
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = np.where(self.norm[:, None] > 0, self.vec / self.norm[:, None], 0.0)[:, :BOX_DIMS]
        return np.column_stack([np.log(self.income), np.log(self.loan), self.dti, unit])


def leaves(rows: Rows, features: np.ndarray, scale: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of the rows, split on the widest scaled coordinate until a part holds at most ``size`` rows or equal
    rows only; each part ascending by rank."""
    out, todo = [], [np.argsort(rows.rank, kind="stable")]
    exact = np.column_stack([rows.income, rows.loan, rows.dti, rows.norm, rows.vec])
    while todo:
        part = todo.pop()
        if len(part) <= size:
            out.append(part)
            continue
        f = features[part]
        spread = (f.max(axis=0) - f.min(axis=0)) * scale
        value = f[:, int(np.argmax(spread))]
        if not spread.max() > 0:
            e = exact[part]
            spread = e.max(axis=0) - e.min(axis=0)
            value = e[:, int(np.argmax(spread))]
            if not spread.max() > 0:  # equal rows stay together
                out.append(part)
                continue
        middle = np.partition(value, len(value) // 2)[len(value) // 2]
        low = value < middle
        if not low.any():
            low = value <= middle
        todo += [part[low], part[~low]]
    return out


class Pool:
    """The rows that partners are taken from, in leaves with boxes."""

    def __init__(self, rows: Rows, limits: Limits):
        self.limits = limits
        reach = np.array(limits.reach())
        f = rows.features()
        # the k-th partner is near in direction, so leaves are narrow there first; tolerances come second
        extent = float((f[:, 3:].max(axis=0) - f[:, 3:].min(axis=0)).max()) if len(f) else 0.0
        self.scale = np.concatenate([1.0 / reach, np.full(f.shape[1] - 3, NARROW / extent if extent > 0 else 0.0)])
        parts = leaves(rows, f, self.scale, LEAF)
        self.low = np.array([f[p].min(axis=0) for p in parts]).reshape(len(parts), f.shape[1])
        self.high = np.array([f[p].max(axis=0) for p in parts]).reshape(len(parts), f.shape[1])
        self.top = np.array([rows.rank[p[-1]] for p in parts])
        #: The rows leaf by leaf, the leaves' borders, and where each row came from.
        self.source = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.rows, self.at = rows.take(self.source), np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
        self.reach = reach * (1 + 1e-9) + 1e-12
        #: Pairs whose predicates were evaluated.
        self.compared = 0

    def _gap(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bound of the cosine distance from the box(es) to every leaf, and whether the
        scalar tolerances can hold."""
        gap = np.maximum(np.maximum(self.low - high, low - self.high), 0.0)
        return (gap[..., 3:] ** 2).sum(axis=-1) / 2.0, (gap[..., :3] <= self.reach).all(axis=-1)

    def search(self, base: Rows, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base place, pool place, distance) of the best k partners of every base row within this pool.
        ``bound``: a distance beyond which a base row needs no partner."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        f = base.features()
        for block in self._blocks(base, f):
            start = np.full(len(block), np.inf) if bound is None else bound[block]
            found.append(self._block(base.take(block), f[block], np.minimum(start, self.limits.max_distance), block))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _blocks(self, base: Rows, f: np.ndarray) -> Iterator[np.ndarray]:
        """Blocks of base rows that lie close together."""
        for part in leaves(base, f, self.scale, QUERY_BLOCK):
            for k in range(0, len(part), QUERY_BLOCK):
                yield part[k : k + QUERY_BLOCK]

    def _block(self, q: Rows, f: np.ndarray, bound: np.ndarray, names: np.ndarray):
        lower, may = self._gap(f.min(axis=0), f.max(axis=0))
        if not self.limits.both_directions:
            may &= self.top > q.rank.min()
        order = np.flatnonzero(may)
        order = order[np.argsort(lower[order], kind="stable")]
        held = Held(len(q), self.limits.k)
        for leaf in order:
            if lower[leaf] > bound.max() + _SLACK:
                break
            own = np.maximum(np.maximum(self.low[leaf] - f, f - self.high[leaf]), 0.0)
            active = ((own[:, 3:] ** 2).sum(axis=1) / 2.0 <= bound + _SLACK) & (own[:, :3] <= self.reach).all(axis=1)
            if not self.limits.both_directions:
                active &= q.rank < self.top[leaf]
            who = np.flatnonzero(active)
            if not len(who):
                continue
            lo, hi = self.at[leaf], self.at[leaf + 1]
            ranks = self.rows.rank[lo:hi]
            if hi - lo > LEAF:
                # equal rows tie in all but the id: the k next ids (and the own row, if it is among them)
                first = np.zeros(len(who), np.int64) if self.limits.both_directions else np.searchsorted(ranks, q.rank[who], side="right")
                at = first[:, None] + np.arange(self.limits.k + 1)[None, :]
                inside = at < hi - lo
                a, b = np.repeat(who, inside.sum(axis=1)), lo + at[inside]
                self.compared += len(a)
                distance = self._distance(q.vec[a], self.rows.vec[b], q.norm[a], self.rows.norm[b])
                near = self._near(distance, bound[a], q.rank[a], self.rows.rank[b])
                a, b, distance = a[near], b[near], distance[near]
            else:
                self.compared += len(who) * int(hi - lo)
                each = self._distance(q.vec[who][:, None, :], self.rows.vec[None, lo:hi], q.norm[who][:, None], self.rows.norm[None, lo:hi])
                a, b = np.nonzero(self._near(each, bound[who][:, None], q.rank[who][:, None], ranks[None, :]))
                distance, a, b = each[a, b], who[a], b + lo
            a, b, values = self._judged(q, a, b, distance)
            if len(a):
                held.add(a, b, values)
                bound = np.minimum(bound, held.worst())
        a, b, d = held.rows()
        return names[a], self.source[b], d

    @staticmethod
    def _distance(v: np.ndarray, w: np.ndarray, v_norm: np.ndarray, w_norm: np.ndarray) -> np.ndarray:
        """1 - cos, summed from left to right as in the join."""
        dot = v[..., 0] * w[..., 0]
        for j in range(1, v.shape[-1]):
            dot = dot + v[..., j] * w[..., j]
        with np.errstate(divide="ignore", invalid="ignore"):
            return 1.0 - dot / (v_norm * w_norm)

    def _near(self, distance: np.ndarray, bound: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
        # NaN and infinite distances (vectors of length zero) fail these
        near = (distance < self.limits.max_distance) & (distance <= bound) & (distance > -np.inf)
        return near & ((own != other) if self.limits.both_directions else (own < other))

    def _judged(self, q: Rows, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Those of the pairs (a, b) that meet the scalar predicates, and their ranking values, as
        the join computes them."""
        p, lim = self.rows, self.limits
        bi, si, bl, sl = q.income[a], p.income[b], q.loan[a], p.loan[b]
        income, loan = np.abs(bi - si) / np.maximum(bi, si), np.abs(bl - sl) / np.maximum(bl, sl)
        dti = np.abs(q.dti[a] - p.dti[b])
        keep = (bi >= si * lim.band_low) & (bi <= si * lim.band_high) & (bl >= sl * lim.band_low) & (bl <= sl * lim.band_high)
        keep &= (dti < lim.band_dti) & (income < lim.income_tol) & (loan < lim.loan_tol) & (dti < lim.dti_tol)
        keep &= (q.norm[a] > 0) & (p.norm[b] > 0)
        return a[keep], b[keep], [x[keep] for x in (distance, income, loan, dti, p.rank[b])]


class Held:
    """The best k partners so far of some base rows."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.a, self.b, self.values = np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0) for _ in range(5)]

    def add(self, a: np.ndarray, b: np.ndarray, values: list[np.ndarray]) -> None:
        a, b = np.concatenate([self.a, a]), np.concatenate([self.b, b])
        values = [np.concatenate(x) for x in zip(self.values, values, strict=True)]
        order = np.lexsort((*values[::-1], a))
        a, b, values = a[order], b[order], [v[order] for v in values]
        place = np.arange(len(a)) - np.searchsorted(a, a, side="left")
        best = place < self.k
        self.a, self.b, self.values = a[best], b[best], [v[best] for v in values]

    def worst(self) -> np.ndarray:
        """The k-th distance of each base row; infinite until k are found."""
        out = np.full(self.n, np.inf)
        last = np.arange(len(self.a)) - np.searchsorted(self.a, self.a, side="left") == self.k - 1
        out[self.a[last]] = self.values[0][last]
        return out

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.a, self.b, self.values[0]


# ---- the Spark plan ---------------------------------------------------------------

_ROW = ["_id", "_income", "_loan", "_dti", "_norm", "_vec"]


def _rows(pdf: pd.DataFrame, rank: np.ndarray) -> Rows:
    def number(name: str) -> np.ndarray:
        return pdf[name].to_numpy(dtype=float)

    vec = np.vstack(pdf["_vec"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, 1))
    return Rows(rank, number("_income"), number("_loan"), number("_dti"), number("_norm"), vec)


def _ranks(*ids: pd.Series) -> list[np.ndarray]:
    """Numbers in the order of the ids, the same number for the same id."""
    every = np.concatenate([x.to_numpy() for x in ids])
    if len(every) and isinstance(every[0], str):  # the order of UTF-8 bytes, as in the join
        every = every.astype(str)
    numbers = np.unique(every, return_inverse=True)[1]
    return np.split(numbers, np.cumsum([len(x) for x in ids])[:-1])


def top_pairs(copies: DataFrame, keys: Sequence[str], limits: Limits, pieces: int, store) -> DataFrame:
    """(base_app_id, similar_app_id): the best ``limits.k`` partners in their cell of all rows with ``_own`` set.

    ``copies``: ``keys`` (the cell), ``_own`` and ``_id, _income, _loan, _dti, _norm, _vec``, each row in every cell
    where it may be a partner. ``pieces``: range partitions; ``store``: writes a table and reads it back.
    """
    keys = list(keys)
    first = F.when(F.col("_norm") > 0, F.get("_vec", 0) / F.col("_norm")).otherwise(dlit(0.0))
    placed = copies.withColumn("_u0", first).repartitionByRange(max(1, pieces), *keys, "_u0", "_id")
    # written once: a piece keeps its rows, whatever is computed again
    placed = store(placed.withColumn("_piece", F.spark_partition_id()), "dense_pieces")
    id_type = placed.schema["_id"].dataType.simpleString()
    schema = f"_base {id_type}, _similar {id_type}, _distance double"

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        (rank,) = _ranks(pdf["_id"])
        rows, mine = _rows(pdf, rank), np.flatnonzero(pdf["_own"].to_numpy(dtype=bool))
        a, b, d = Pool(rows, limits).search(rows.take(mine))
        ids = pdf["_id"].to_numpy()
        return pd.DataFrame({"_base": ids[mine[a]], "_similar": ids[b], "_distance": d})

    group = ["_piece", *keys]
    near = store(placed.groupBy(*group).applyInPandas(own, schema), "dense_pairs")
    # cells that lie in several pieces: the other pieces within reach of a row's k-th distance
    box = _boxed()
    outline = placed.groupBy(*group).agg(
        F.max("_id").alias("_top"), *(f(c).alias(f"_{n}{i}") for i, c in enumerate(box) for f, n in ((F.min, "lo"), (F.max, "hi")))
    )
    several = outline.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    outline = outline.join(several, keys).withColumnRenamed("_piece", "_to")
    kth = near.groupBy("_base").agg(F.count("*").alias("_n"), F.max("_distance").alias("_kth"))
    kth = kth.where(F.col("_n") >= limits.k).select(F.col("_base").alias("_id"), "_kth")
    asking = placed.where("_own").join(several, keys).join(kth, "_id", "left")
    asking = asking.withColumn("_bound", F.coalesce("_kth", dlit(limits.max_distance)))
    gaps = [F.greatest(F.col(f"_lo{i}") - c, c - F.col(f"_hi{i}"), dlit(0.0)) for i, c in enumerate(box)]
    reach = limits.reach()
    within = (F.col("_to") != F.col("_piece")) & (sum((g * g for g in gaps[3:]), dlit(0.0)) / 2.0 <= F.col("_bound") + dlit(_SLACK))
    for g, r in zip(gaps[:3], reach, strict=True):
        within &= g <= dlit(r * (1 + 1e-9) + 1e-12) if math.isfinite(r) else F.lit(True)
    if not limits.both_directions:
        within &= F.col("_top") > F.col("_id")
    probes = asking.join(outline, keys).where(within).select(
        F.col("_to").alias("q_piece"), *(F.col(c).alias(f"q{c}") for c in (*keys, *_ROW, "_bound"))
    )

    def other(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"_base": held["_id"][:0], "_similar": held["_id"][:0], "_distance": np.zeros(0)})
        asked = asked.rename(columns={f"q{c}": c for c in (*_ROW, "_bound")})
        base_rank, pool_rank = _ranks(asked["_id"], held["_id"])
        a, b, d = Pool(_rows(held, pool_rank), limits).search(_rows(asked, base_rank), asked["_bound"].to_numpy(dtype=float))
        return pd.DataFrame({"_base": asked["_id"].to_numpy()[a], "_similar": held["_id"].to_numpy()[b], "_distance": d})

    far = probes.groupBy(*(f"q{c}" for c in group)).cogroup(placed.join(several, keys, "left_semi").groupBy(*group)).applyInPandas(other, schema)
    return near.unionByName(far).select(F.col("_base").alias("base_app_id"), F.col("_similar").alias("similar_app_id"))


def _boxed() -> list[Column]:
    """The coordinates that a piece's box bounds; three of the direction are enough between pieces."""
    unit = [F.when((F.col("_norm") > 0) & (F.size("_vec") > i), F.get("_vec", i) / F.col("_norm")).otherwise(dlit(0.0)) for i in range(3)]
    return [F.log(F.col("_income")), F.log(F.col("_loan")), F.col("_dti"), *unit]
